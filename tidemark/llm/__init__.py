"""Operators for large text corpora, and the queries and SQL that apply them to the given tables."""
