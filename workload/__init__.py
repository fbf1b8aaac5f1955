"""Registered queries: each one runs a library operator over the given tables."""
