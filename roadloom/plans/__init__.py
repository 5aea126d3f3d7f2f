"""Queries over the operators, the tables they derive, and their SQL twins."""
