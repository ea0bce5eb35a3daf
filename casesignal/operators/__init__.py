"""Relational steps. Column names are parameters throughout."""
