"""Relational operators on canonical rows."""
