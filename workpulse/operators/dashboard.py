"""Dashboard queries: indicators, series, breakdowns, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_where, distinct_where
from .measures import completion_rate, counted, scoped, status_counts, total

UNIT = {"day": "day", "week": "week", "month": "month"}


def kpis(flagged: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each owner: counts, rate, people and departments, and how many repeat groups there are."""
    rows = counted(flagged)
    main = rows.groupBy("owner_user_id").agg(
        total().alias("total"), *status_counts("Completed", "Pending", "In Progress", "Blocked"), completion_rate().alias("completion_rate"),
        count_where(F.col("slow_task_flag") == "TRUE").alias("slow_tasks"), count_where("repeated_task_flag").alias("repeated_tasks"),
        distinct_where(F.col("department")).alias("departments_reporting"),
        distinct_where(F.col("employee_name"), F.col("is_person")).alias("employees_reporting"),
        count_where(F.col("slow_task_flag") == "INSUFFICIENT_DATA").alias("insufficient_duration"),
        count_where((F.col("slow_task_flag") == "INSUFFICIENT_DATA") & F.col("actual_duration").isNull()).alias("untimed"),
        F.min("task_date").alias("first_date"), F.max("task_date").alias("last_date"),
    )
    repeats = groups.groupBy("owner_user_id").agg(
        total().alias("repeat_groups"), count_where(F.col("classification").isin("Needs Review", "Potential Duplication")).alias("repeat_attention")
    )
    zero = F.lit(0).cast("bigint")
    return main.join(repeats, "owner_user_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("repeat_groups", "repeat_attention")})


def period_series(tasks: DataFrame, grain: str = "month", limit: int = 60, **scope) -> DataFrame:
    """The last ``limit`` periods that have work, oldest first, of all owners together or one."""
    rows = counted(scoped(tasks, **scope))
    period = F.date_trunc(UNIT[grain], "task_date").cast("date")
    series = rows.groupBy(period.alias("period")).agg(
        total().alias("total"), *status_counts("Completed", "Pending", "In Progress", "Blocked", "Cancelled", "Not Started"),
        completion_rate().alias("completion_rate"), distinct_where(F.col("employee_name"), F.col("is_person")).alias("employees"),
        distinct_where(F.col("department")).alias("departments"),
    )
    series = series.withColumn("backlog", F.col("total") - F.col("completed") - F.col("cancelled"))
    return series.orderBy(F.desc("period")).limit(limit).orderBy("period")


def aligned(tasks: DataFrame, facts: DataFrame | None = None, grain: str = "month", limit: int = 12, **scope) -> DataFrame:
    """The rows of ``facts`` (``tasks`` if none) that a series of ``tasks`` with that grain, limit and scope shows, so
    that panels beside it say the same. The first day is read back from the series, as sparse periods reach further than
    the calendar does, unless the scope has one. It is a scalar subquery: one plan, and partitions by day are pruned as it runs.
    No rows if the series is empty."""
    rows = scoped(tasks if facts is None else facts, **scope)
    if scope.get("first") is not None:
        return rows
    start = period_series(tasks, grain, limit, **scope).agg(F.min("period"))
    return rows.where(F.col("task_date") >= start.scalar())


def department_breakdown(flagged: DataFrame, managers: DataFrame, **scope) -> DataFrame:
    """Per department, with its manager looked up by lower-case name."""
    rows = counted(scoped(flagged, **scope)).groupBy(F.coalesce("department", F.lit("Unknown")).alias("department")).agg(
        total().alias("total"), *status_counts("Completed", "Pending", "In Progress", "Blocked"), completion_rate().alias("completion_rate"),
        count_where(F.col("slow_task_flag") == "TRUE").alias("slow_tasks"), count_where("repeated_task_flag").alias("repeated_tasks"),
        distinct_where(F.col("employee_name"), F.col("is_person")).alias("employees"),
    )
    led = managers.select(F.lower("department_name").alias("key"), "manager")
    out = rows.join(led, F.lower("department") == F.col("key"), "left").drop("key")
    return out.withColumn("manager", F.coalesce("manager", F.lit(""))).orderBy(F.desc("total"), "department")


def status_distribution(tasks: DataFrame, **scope) -> DataFrame:
    return counted(scoped(tasks, **scope)).groupBy(F.col("task_status").alias("name")).agg(total().alias("value")).orderBy(F.desc("value"), "name")


def employee_activity(tasks: DataFrame, limit: int | None = 12, people: bool = True, **scope) -> DataFrame:
    """The busiest people (or the names that aren't people), cut only after the others are left out."""
    rows = counted(scoped(tasks, **scope)).groupBy(F.col("employee_name").alias("employee")).agg(
        F.max("department").alias("department"), F.max("is_person").alias("is_person"), total().alias("total"), *status_counts("Completed"),
        completion_rate().alias("completion_rate"), distinct_where(F.col("task_date")).alias("days"),
    )
    rows = rows.where(F.col("is_person") == people).drop("is_person").orderBy(F.desc("total"), "employee")
    return rows if limit is None else rows.limit(limit)


def hidden_names(tasks: DataFrame, **scope) -> DataFrame:
    """How many names, and tasks under them, the people ranking leaves out."""
    rows = employee_activity(tasks, None, people=False, **scope)
    return rows.agg(total().alias("hidden_names"), F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("hidden_tasks"))


def filter_options(tasks: DataFrame, roster: DataFrame) -> DataFrame:
    """What can be chosen: departments and employees that reports or the roster name, with the range of days."""
    named = tasks.select(F.lit("department").alias("kind"), F.col("department").alias("name")).union(tasks.select(F.lit("employee"), "employee_name"))
    return named.union(roster.select(F.lit("employee"), "employee_name")).where("name is not null").distinct()


def date_bounds(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("owner_user_id").agg(F.min("task_date").alias("min_date"), F.max("task_date").alias("max_date"))


def work_days(tasks: DataFrame, limit: int = 45) -> DataFrame:
    """The latest days with work."""
    return counted(tasks).select("task_date").distinct().orderBy(F.desc("task_date")).limit(limit)


def latest_and_previous(series: DataFrame) -> DataFrame:
    """The last point of a series beside the one before it."""
    top = series.orderBy(F.desc("period")).limit(2).agg(F.array_sort(F.collect_list(F.struct("period", "total", "completion_rate"))).alias("p"))
    last, before = F.element_at("p", -1), F.try_element_at("p", F.lit(-2))
    return top.select(last["period"].alias("period"), last["total"].alias("total"), before["total"].alias("previous_total"),
                      (last["total"] - before["total"]).alias("change"), last["completion_rate"].alias("completion_rate"))
