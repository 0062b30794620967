"""Queries: operators put together over given tables, each with its SQL."""
