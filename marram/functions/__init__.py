"""Column functions: each takes columns and gives a column, evaluated in the JVM."""
