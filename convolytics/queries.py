"""The registry of queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from convolytics.plans import audit_queries, block_queries, evidence_queries, feature_queries, job_queries, session_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**session_queries.QUERIES, **feature_queries.QUERIES, **evidence_queries.QUERIES, **audit_queries.QUERIES, **job_queries.QUERIES, **block_queries.QUERIES}


def materialized(sql: str) -> str:
    """The SQL with each of its named relations computed once, however often it is read."""
    return re.sub(r"\b(\w+) AS \(\s*(?=SELECT|WITH)", r"\1 AS MATERIALIZED (", sql)


_SQL = {**session_queries.ORACLE_SQL, **feature_queries.ORACLE_SQL, **evidence_queries.ORACLE_SQL, **audit_queries.ORACLE_SQL, **job_queries.ORACLE_SQL, **block_queries.ORACLE_SQL}
ORACLE_SQL: dict[str, str] = {name: materialized(sql) for name, sql in _SQL.items()}
