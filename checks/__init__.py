"""Queries over the given tables, one per operator, each beside the SQL it must agree with."""
