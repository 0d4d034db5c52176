"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The events as a stream, in SQL: e; with null keys and values: n; as it arrives out of order in one partition: a.
PRELUDE = """WITH e AS (SELECT user_id AS key, event_type AS value, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 1000 AS ts,
  event_id AS "offset", CAST(user_id % 4 AS INTEGER) AS partition, props, 'events-' || event_type AS topic FROM events),
n AS (SELECT * REPLACE (CASE WHEN "offset" % 17 = 0 THEN NULL ELSE key END AS key, CASE WHEN "offset" % 13 = 0 THEN NULL ELSE value END AS value) FROM e),
a AS (SELECT * REPLACE ("offset" // 1000003 * 1000003 + "offset" % 1000003 * 7919 % 1000003 AS "offset") FROM e)
"""


def query(sql: str | None = None, prelude: bool = True, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql is not None:
            text = sql.strip()
            if prelude:
                recursive = text.startswith("WITH RECURSIVE ")
                text = PRELUDE.replace("WITH", "WITH RECURSIVE" if recursive else "WITH", 1) + (", " + text.removeprefix("WITH ").removeprefix("RECURSIVE ") if text.startswith("WITH ") else text)
            ORACLES[key] = text
        return f

    return add
