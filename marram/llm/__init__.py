"""Operators of a training-data pipeline over the tables of texts, pages and vectors."""
