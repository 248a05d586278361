"""Statements and expressions of the SQL dialect that Spark's own parser doesn't take."""
