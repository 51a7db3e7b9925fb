"""The fact table ``tasks`` over the driver's tables, and the engine's settings.

The same SQL text serves both engines, so that queries and their SQL start from the same rows.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds of the analyses."""

    default_department: str = "Unassigned"
    week_start: str = "MONDAY"
    date_order: str = "DMY"
    repeat_lookback_days: int = 30
    repeat_same_day_review_min: int = 3
    repeat_high_min: int = 8
    repeat_recurring_min: int = 3
    similarity_threshold: float = 0.88
    slow_task_multiplier: float = 1.5
    min_baseline_sample: int = 3
    max_rows_per_document: int = 2000


FACTS_SQL = """
SELECT r.r_regionkey + 1 AS owner_user_id,
       concat('TSK-', cast(o.o_orderkey AS varchar(20))) AS task_id,
       cast(o.o_orderdate AS date) AS task_date,
       CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE n.n_name END AS department,
       c.c_name AS employee_name,
       concat(c.c_mktsegment, ' ', n.n_name) AS team,
       c.c_acctbal > 0 AS is_person,
       p.p_name AS task, p.p_name AS task_normalized, p.p_type AS task_category,
       CASE WHEN o.o_orderstatus = 'F' THEN 'Completed'
            WHEN o.o_orderstatus = 'O' THEN CASE WHEN o.o_orderkey % 4 = 0 THEN 'Not Started' ELSE 'In Progress' END
            WHEN o.o_orderkey % 29 = 0 THEN 'Ambiguous'
            WHEN o.o_orderkey % 7 = 0 THEN 'Cancelled'
            WHEN o.o_orderkey % 5 = 0 THEN 'Blocked' ELSE 'Pending' END AS task_status,
       CASE WHEN o.o_orderkey % 11 = 0 THEN 'PLANNED' ELSE 'REPORTED' END AS work_kind,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
            ELSE cast(round(cast(o.o_totalprice AS decimal(18,4)) / 10000, 2) AS double) END AS actual_duration,
       CASE WHEN o.o_orderkey % 3 = 0 THEN cast(p.p_size AS double) ELSE NULL END AS expected_duration
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
JOIN part p ON p.p_partkey = o.o_orderkey % 200
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimensions are small beside the orders. Customers grow with them, so they are shuffled: their files are several
    times smaller than their rows, and would be sent through the driver for long by their size. Of parts, the keys that a
    remainder by 200 can have are read."""
    named = {x: table(spark, sf_dir, x) for x in TABLES}
    named["customer"] = named["customer"].hint("shuffle_hash")
    named["part"] = named["part"].where("p_partkey between -199 and 199")
    text = FACTS_SQL
    for name, alias in (("orders", "o"), ("customer", "c"), ("nation", "n"), ("region", "r"), ("part", "p")):
        text = text.replace(f" {name} {alias}", f" {{{name}}} {alias}")
    return spark.sql(text, **named)


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='workpulse-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves
    a local master; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; set it to a folder that the driver and all executors share")
        folder = _local_folder()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read again, which ends its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}
TABLES = ("orders", "customer", "nation", "region", "part")


def version(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> str:
    """What tells one state of some tables' files from another: how many there are, their bytes, and when the newest
    folder or file was written. Two calls for each table, however many files it has."""
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(conf)
        summary = files.getContentSummary(path)
        found.append(f"{summary.getFileCount()}:{summary.getLength()}:{files.getFileStatus(path).getModificationTime()}")
    return ",".join(found)


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives for the tables in ``sf_dir``, written by the first query of a Spark application that needs it
    and scanned by the others: facts are analysed once, not by each dashboard. When files of the tables change, it is
    built anew; ``forget`` drops what was written. Frames that read a former version keep it until then."""
    key, now = (spark.sparkContext.applicationId, sf_dir, name), version(spark, sf_dir)
    if key not in _WRITTEN or _WRITTEN[key][0] != now:
        _WRITTEN[key] = (now, written(build(), name))
    return _WRITTEN[key][1]


def forget(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Drops what ``once`` keeps of a folder (of all, if none is given) and deletes its files."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId and sf_dir in (None, k[1])]:
        _, rows = _WRITTEN.pop(key)
        for folder in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
