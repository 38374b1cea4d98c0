"""Queries bound to tables, and their SQL."""
