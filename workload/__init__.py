"""Registered queries over the given tables, their oracle SQL and the derived market tables."""
