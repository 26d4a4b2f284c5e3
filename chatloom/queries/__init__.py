"""Registered queries: the operators over a chat view of the given tables, with SQL twins."""
