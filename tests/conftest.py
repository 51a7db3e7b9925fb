"""One Spark session for all tests, and the tables of the smallest scale."""

from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.sql.session.timeZone": "UTC", "spark.local.dir": folder, "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the small tables as views."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def comparable(value):
    """A value as both engines print it: floats to nine digits."""
    import decimal

    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return [comparable(v) for v in value]
    return str(value)


def rows_of(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(str([comparable(r[n]) for n in names]) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[str]]:
    found = con.execute(sql)
    given = [d[0] for d in found.description]
    names = sorted(given)
    return names, sorted(str([comparable(r[given.index(n)]) for n in names]) for r in found.fetchall())
