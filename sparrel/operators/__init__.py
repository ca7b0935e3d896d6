"""Operators on matrices as relations."""
