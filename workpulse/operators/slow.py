"""Slow tasks: durations against a configured expectation or a median of comparable tasks, the task itself left out.

A median without one of its own values needs three values around the middle of the sorted list, whatever value is
left out. They are found from counts by (key, value), which the tasks pre-aggregate: a key with most of the rows sends
one row for each different duration, never all its tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up

#: Where a baseline comes from, in falling order of authority.
SOURCES = (("task_normalized", "task history"), ("task_category", "category history"), ("department", "department history"))


def middles(timed: DataFrame, key: str) -> DataFrame:
    """Per owner and key: n values, and the values at ranks n/2 (rounded down), the next and the one after."""
    by = Window.partitionBy("owner_user_id", key)
    counts = timed.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy("owner_user_id", key, "actual_duration").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(by.orderBy("actual_duration").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.select("owner_user_id", key, "actual_duration", (upto - F.col("m")).alias("after"), upto.alias("upto"), F.sum("m").over(by).alias("n"))
    half = F.floor(F.col("n") / 2)
    at = lambda i: F.max(F.when((F.col("after") < half + i) & (half + i <= F.col("upto")), F.col("actual_duration")))
    return ranked.groupBy("owner_user_id", key).agg(F.max("n").alias("n"), at(0).alias("low"), at(1).alias("middle"), at(2).alias("high"))


def median_of_others(n: Column, low: Column, middle: Column, high: Column, own: Column) -> Column:
    first = F.when(low < own, low).otherwise(middle)
    second = F.when(middle < own, middle).otherwise(high)
    return F.when(n % 2 == 0, first).otherwise((first + second) / 2)


def slow_analysis(tasks: DataFrame, multiplier: float = 1.5, least: int = 3) -> DataFrame:
    """``tasks`` with expected, baseline_source, baseline_sample_size, slow_variance_hours and slow_task_flag.

    A task without a positive duration, or without an expectation, has too little data; it is never slow.
    """
    timed = tasks.where(F.col("actual_duration") > 0)
    out = tasks
    own = F.col("actual_duration")
    for i, (key, _) in enumerate(SOURCES):
        found = middles(timed, key).select("owner_user_id", key, F.struct("n", "low", "middle", "high").alias(f"b{i}"))
        out = out.join(found, ["owner_user_id", key], "left")
    configured = F.when(F.col("expected_duration") > 0, F.struct(F.col("expected_duration").alias("expected"), F.lit("configured").alias("source"), F.lit(0).cast("bigint").alias("sample")))
    learned = [
        F.when(F.col(f"b{i}.n") - 1 >= least, F.struct(
            median_of_others(*(F.col(f"b{i}.{x}") for x in ("n", "low", "middle", "high")), own).alias("expected"), F.lit(source).alias("source"),
            (F.col(f"b{i}.n") - 1).cast("bigint").alias("sample"),
        )) for i, (_, source) in enumerate(SOURCES)
    ]
    base = F.when(own > 0, reduce(lambda a, b: F.coalesce(a, b), [configured, *learned]))
    out = out.withColumn("base", base).withColumn("base", F.when(F.col("base.expected") > 0, F.col("base")))
    expected = F.col("base.expected")
    flag = F.when(F.col("base").isNull(), "INSUFFICIENT_DATA").when(own > expected * multiplier, "TRUE").otherwise("FALSE")
    return out.select(
        *tasks.columns, expected.alias("expected"), F.col("base.source").alias("baseline_source"), F.col("base.sample").alias("baseline_sample_size"),
        F.when(F.col("base").isNotNull(), half_up(own - expected, 2)).alias("slow_variance_hours"), flag.alias("slow_task_flag"),
    )


def slow_tasks(analysed: DataFrame, limit: int | None = None, search: str | None = None) -> DataFrame:
    """The slow ones, by variance; ``search`` is matched anywhere in the task, whatever the case."""
    rows = analysed.where("slow_task_flag = 'TRUE'")
    if search is not None:
        rows = rows.where(F.col("task").ilike(f"%{search}%"))
    pct = half_up(100 * (F.col("actual_duration") - F.col("expected")) / F.col("expected"), 1)
    rows = rows.select(
        "owner_user_id", "task_id", "task_date", "department", F.col("employee_name").alias("employee"), "task", "task_category", "task_status",
        half_up(F.col("expected"), 2).alias("expected_duration"), "actual_duration", F.col("slow_variance_hours").alias("variance_hours"), pct.alias("variance_pct"),
        "baseline_source", "baseline_sample_size",
    ).orderBy(F.desc("variance_hours"), "task_id")
    return rows if limit is None else rows.limit(limit)
