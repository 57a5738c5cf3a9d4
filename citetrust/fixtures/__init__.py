"""Revision tables derived from the given tables, and the SQL the queries are checked against."""
