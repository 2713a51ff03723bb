"""All queries of the library, by name, with the SQL that gives the same rows where SQL can."""

from segspark.plans import axis, derived, events, files, folds, neutral, sampled, sites, windows

_PARTS = (sites, axis, windows, events, derived, neutral, sampled, files, folds)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
