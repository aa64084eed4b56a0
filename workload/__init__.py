"""Operators run on the benchmark tables, with the SQL they must agree with."""
