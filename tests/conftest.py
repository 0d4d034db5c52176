import datetime
import os
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


@pytest.fixture(scope="session")
def oracle():
    """(sf, sql) -> (names, rows) by DuckDB."""
    import duckdb

    made = {}

    def run(sf, sql):
        if sf not in made:
            made[sf] = duckdb.connect()
            made[sf].execute("SET TimeZone = 'UTC'")
            for t in TABLES:
                made[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
        got = made[sf].execute(sql)
        names = [x[0] for x in got.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())

    return run
