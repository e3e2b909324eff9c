"""Queries over the corpus tables, with the same in SQL."""
