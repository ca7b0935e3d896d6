"""Relational sparse linear algebra on Spark."""
