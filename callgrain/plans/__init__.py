"""Queries by name, their fixtures and their SQL."""
