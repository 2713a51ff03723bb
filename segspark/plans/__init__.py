"""Queries over the tables at hand, composed of the operators, each with the SQL that gives the same rows."""
