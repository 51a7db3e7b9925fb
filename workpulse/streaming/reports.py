"""Reports as a stream: each micro-batch is ingested by the same builders as a batch job.

A batch's facts go to a folder named by its number, written by overwriting: a batch that is run again after a failure
replaces what it wrote, so every row arrives once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import IngestConfig, raw_rows, routed, validated
from ..sources.grids import read_grids

FACTS_SQL = "owner_user_id int, fingerprint string, document_id string, table_index int, row_index int, task_date date, employee_name string, department string, task string, task_normalized string, task_status string, work_kind string, actual_duration double, link string, notes string"
REJECTED_SQL = "document_id string, table_index int, row_index int, reason string"


def stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches under ``folder``, with batch, the number of the batch that wrote a row; empty before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(folder)


def ingest_batch(documents: DataFrame, batch: int, folder: str, owner: int = 1, config: IngestConfig = IngestConfig()) -> None:
    """Facts and rejections of one batch, against the facts that other batches stored."""
    spark = documents.sparkSession
    known = stored(spark, f"{folder}/facts", FACTS_SQL).where(F.col("batch") != batch).groupBy("owner_user_id", "fingerprint").agg(F.min("document_id").alias("document_id"))
    documents = documents.dropDuplicates(["document_id"])  # a document that arrives twice is one
    rows = validated(raw_rows(read_grids(documents), config), config=config).persist()
    out = routed(rows, known, owner).persist()
    names = [c.split()[0] for c in FACTS_SQL.split(", ")]
    out.where("route = 'insert'").select(*names).write.mode("overwrite").parquet(f"{folder}/facts/batch={batch}")
    place = ("document_id", "table_index", "row_index")
    rejected = rows.where("reject_reason is not null").select(*place, F.col("reject_reason").alias("reason"))
    twice = out.where("route = 'reject'").select(*place, F.lit("DUPLICATE_ACROSS_DOCUMENTS").alias("reason"))
    rejected.unionByName(twice).write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch}")
    out.unpersist()
    rows.unpersist()


def ingest_stream(documents: DataFrame, folder: str, owner: int = 1, config: IngestConfig = IngestConfig()) -> StreamingQuery:
    """Runs all that has arrived, then stops; ``documents`` is a stream of (document_id, html, text, attachment_name)."""
    write = documents.writeStream.foreachBatch(lambda rows, batch: ingest_batch(rows, batch, folder, owner, config))
    return write.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a stream of events (ts, event_type) by tumbling window; events over ``late`` behind are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")
