"""Operators that Spark SQL has no single clause for, composed from DataFrame operations."""
