"""Queries: operators over the tables, and composite gates."""
