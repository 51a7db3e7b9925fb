"""Rows from JSON texts and parallel arrays, and bulk updates by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .merges import update_from


def recordset(rows: DataFrame, column: str, schema: str, keep: list[str]) -> DataFrame:
    """A row for each object in the JSON array of ``column``, with the fields of ``schema`` (DDL) beside ``keep``.

    A field that is missing, or of another type than asked for, is null; fields that aren't asked for go. A null, empty or
    broken text and an empty array give no rows; ``unreadable`` tells which texts were broken. An element that is no
    object gives no row. ``keep`` and the schema share no name.
    """
    elements = F.from_json(column, ArrayType(StructType.fromDDL(schema)))
    return rows.where(readable(F.col(column))).select(*keep, F.inline(F.filter(elements, lambda x: x.isNotNull())))


def readable(text: Column) -> Column:
    """Whether a text is a JSON array; false for a null."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("ARRAY")), F.lit(False))


def unreadable(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose text is neither null nor blank nor a JSON array."""
    return rows.where((F.trim(column) != "") & ~readable(F.col(column)))


def parallel(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """A row for each place of some arrays, which are read side by side; shorter ones, and null ones, go on with nulls."""
    arrays = [F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c) for c in columns]
    return rows.select(*keep, *arrays).select(*keep, F.inline(F.arrays_zip(*(F.col(c) for c in columns))))


def latest(values: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order`` (which should leave no ties); null keys go. A partial aggregate, so
    a key with most of the rows sends one from each task."""
    names = [c for c in values.columns if c != key]
    last = F.max_by(F.struct(*names), F.struct(*order))
    return values.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in names))


def bulk_update(stored: DataFrame, values: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``stored`` with the columns of ``values`` written over where it has their key; of several rows with one key the
    last by ``order`` counts, columns of which aren't written. Keys that it doesn't have change nothing."""
    return update_from(stored, latest(values, key, order).drop(*(c for c in order if c not in stored.columns)), key)


def register_all(register, with_facts, tasks, table) -> None:
    # Each third order brings a batch that corrects its own task and the one of the order before, so that some tasks get
    # several corrections; each ninth batch is cut short.
    @register("json_bulk_update", with_facts("""SELECT t.task_id, coalesce(u.category, CASE WHEN u.task_id IS NULL THEN t.task_category END) AS task_category, CASE WHEN u.task_id IS NULL THEN t.expected_duration ELSE u.hours END AS expected_duration FROM tasks t LEFT JOIN (
        SELECT 'TSK-' || (o_orderkey - i) AS task_id, 'Batch ' || o_orderkey % 5 || CASE i WHEN 1 THEN ' "b"' ELSE '' END AS category, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 + 0.5 END::DOUBLE AS hours FROM orders, (SELECT unnest([0, 1]) AS i)
        WHERE o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY o_orderkey - i ORDER BY o_orderkey DESC) = 1) u USING (task_id)"""))
    def _(spark, sf_dir):
        k = F.col("o_orderkey")
        hours = F.when(k % 2 == 0, (k % 7 + F.lit(0.5)).cast("double"))
        one = lambda i, more: F.struct(F.concat(F.lit("TSK-"), (k - i).cast("string")).alias("task_id"), F.concat(F.lit("Batch "), (k % 5).cast("string"), F.lit(more)).alias("task_category"), hours.alias("expected_duration"))
        text = F.to_json(F.array(one(0, ""), one(1, ' "b"')))
        batches = table(spark, sf_dir, "orders").where(k % 3 == 0).select(k.alias("batch"), F.when(k % 9 == 0, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text).alias("payload"))
        values = recordset(batches, "payload", "task_id string, task_category string, expected_duration double", ["batch"])
        return bulk_update(tasks(spark, sf_dir), values, "task_id", ["batch"]).select("task_id", "task_category", "expected_duration")

    # Two arrays of each order: line numbers and quantities, the second without its last line.
    @register("parallel_arrays", "SELECT l_orderkey AS batch, l_linenumber::BIGINT AS line, CASE WHEN row_number() OVER w < count(*) OVER (PARTITION BY l_orderkey) THEN l_quantity::DOUBLE END AS quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::DOUBLE)")
    def _(spark, sf_dir):
        lines = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_quantity").cast("double").alias("quantity"))))
        orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(lines.alias("lines"))
        arrays = orders.select("batch", F.col("lines.line").alias("line"), F.slice("lines.quantity", F.lit(1), F.size("lines") - 1).alias("quantity"))
        return parallel(arrays, ["line", "quantity"], ["batch"])
