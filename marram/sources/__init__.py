"""Readers and writers: files of records, feeds and crawled bodies as DataFrames."""
