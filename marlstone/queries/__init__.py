"""Queries over the driver's tables, and the same in DuckDB SQL where SQL can say it."""

from . import corpus, tables, trees, vectors

QUERIES = corpus.QUERIES | tables.QUERIES | vectors.QUERIES | trees.QUERIES
ORACLE_SQL = corpus.ORACLE_SQL | tables.ORACLE_SQL | vectors.ORACLE_SQL | trees.ORACLE_SQL
