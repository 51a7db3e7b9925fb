"""Summary views with grouping sets, windows anchored on the newest day, and the projections for BI tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.numbers import count_where, distinct_where, pp_change, rate
from .measures import ALL_STATUSES, completion_rate, status_counts, total

OWNER = "owner_user_id"


def period_view(flagged: DataFrame, grain: str, first: str = "MONDAY") -> DataFrame:
    """Per owner, period and department, and per owner and period as department ``ALL``; planned work counts here."""
    start = dates.period_start(F.col("task_date"), grain, first)
    rows = flagged.withColumn("period_start", start)
    sets = [[F.col(OWNER), F.col("period_start"), F.col("department")], [F.col(OWNER), F.col("period_start")]]
    out = rows.groupingSets(sets, OWNER, "period_start", "department").agg(
        F.grouping("department").alias("rolled"), total().alias("total_tasks"), *status_counts(*ALL_STATUSES),
        completion_rate().alias("completion_rate"), count_where(F.col("slow_task_flag") == "TRUE").alias("slow_tasks"),
        count_where("repeated_task_flag").alias("repeated_tasks"), distinct_where(F.col("employee_name")).alias("employees_reporting"),
    )
    label = F.when(F.col("rolled") == 1, "ALL").otherwise(F.coalesce("department", F.lit("Unassigned")))
    return out.withColumn("department", label).withColumn("period_end", dates.period_end(F.col("period_start"), grain)).drop("rolled")


def daily_trend(view: DataFrame, days: int = 14) -> DataFrame:
    """The ``ALL`` rows of the last days of each owner that have work."""
    rank = F.row_number().over(Window.partitionBy(OWNER).orderBy(F.desc("period_start")))
    return view.where("department = 'ALL'").withColumn("rank", rank).where(F.col("rank") <= days).drop("rank")


def period_changes(view: DataFrame) -> DataFrame:
    """The rate of the period before that has work, and the change in points."""
    before = F.lag("completion_rate").over(Window.partitionBy(OWNER, "department").orderBy("period_start"))
    rows = view.select(OWNER, "department", "period_start", "completion_rate", before.alias("prev_completion_rate"))
    return rows.withColumn("completion_rate_pp_change", pp_change(F.col("completion_rate"), F.col("prev_completion_rate")))


def with_anchor(tasks: DataFrame) -> DataFrame:
    """Rows beside the newest day of their owner: one row for each owner is joined."""
    anchors = tasks.groupBy(OWNER).agg(F.max("task_date").alias("anchor"))
    return tasks.join(anchors, OWNER)


def windowed(days: int):
    """Conditions of the last ``days`` days and the ``days`` before them."""
    age = F.datediff("anchor", "task_date")
    return age.between(0, days - 1), age.between(days, 2 * days - 1)


def department_summary(flagged: DataFrame, default: str = "Unassigned") -> DataFrame:
    """Per department: measures, first and last day, and the last seven days against the seven before."""
    last, before = windowed(7)
    done = F.col("task_status") == "Completed"
    out = with_anchor(flagged).groupBy(OWNER, F.coalesce("department", F.lit(default)).alias("department")).agg(
        total().alias("total_tasks"), *status_counts(*ALL_STATUSES), completion_rate().alias("completion_rate"),
        count_where(F.col("slow_task_flag") == "TRUE").alias("slow_tasks"), count_where("repeated_task_flag").alias("repeated_tasks"),
        distinct_where(F.col("employee_name")).alias("employees_reporting"), F.min("task_date").alias("first_date"), F.max("task_date").alias("last_date"),
        count_where(last).alias("last_7d_tasks"), count_where(before).alias("prev_7d_tasks"),
        rate(F.count_if(last & done), F.count_if(last)).alias("last_7d_completion_rate"), rate(F.count_if(before & done), F.count_if(before)).alias("prev_7d_completion_rate"),
    )
    change = pp_change(F.col("last_7d_completion_rate"), F.col("prev_7d_completion_rate"))
    return out.withColumn("wow_pp_change", F.when(F.col("prev_7d_tasks") > 0, change))


def sufficiency(n, days):
    return F.when((n >= 30) & (days >= 10), "Sufficient for trend").when(n >= 10, "Indicative only").otherwise("Insufficient — do not rank")


def employee_summary(flagged: DataFrame) -> DataFrame:
    """Per employee: measures, days reported, whether there is enough to rank by, windows of 7 and 30 days, and the
    department of the first row by day and task."""
    last, before = windowed(7)
    last_30, before_30 = windowed(30)
    out = with_anchor(flagged).groupBy(OWNER, F.col("employee_name").alias("employee")).agg(
        F.max("department").alias("department"), F.min_by("department", F.struct("task_date", "task_id")).alias("first_department"),
        total().alias("total_tasks"), *status_counts("Completed", "Pending"), completion_rate().alias("completion_rate"),
        count_where(F.col("slow_task_flag") == "TRUE").alias("slow_tasks"), count_where("repeated_task_flag").alias("repeated_tasks"),
        distinct_where(F.col("task_date")).alias("distinct_days_reported"), count_where(last).alias("last_7d_tasks"), count_where(before).alias("prev_7d_tasks"),
        count_where(last_30).alias("last_30d_tasks"), count_where(before_30).alias("prev_30d_tasks"),
    )
    return out.withColumn("data_sufficiency", sufficiency(F.col("total_tasks"), F.col("distinct_days_reported")))


def bi_tasks(flagged: DataFrame) -> DataFrame:
    """The facts as BI tools read them, with dates bucketed and the counting rules as columns."""
    counted = (F.col("work_kind") != "PLANNED") & (F.col("task_status") != "Ambiguous")
    shown = F.coalesce(F.nullif(F.col("department"), F.lit("")), F.lit("Not identified"))
    return flagged.select(
        OWNER, "task_id", "task_date", dates.week_start(F.col("task_date")).alias("week_start"), F.trunc("task_date", "month").alias("month_start"),
        F.date_format("task_date", "yyyy-MM").alias("month_label"), shown.alias("department"), F.col("employee_name").alias("employee"), "task",
        F.col("task_category").alias("category"), F.col("task_status").alias("status"), "work_kind", counted.alias("counted"),
        (counted & (F.col("task_status") == "Completed")).alias("completed"),
        (counted & ~F.col("task_status").isin("Completed", "Cancelled")).alias("open_work"), "actual_duration", "expected_duration",
        (F.col("slow_task_flag") == "TRUE").alias("is_slow"), F.col("repeated_task_flag").alias("is_repeated"),
    )


def bi_daily_by_department(bi: DataFrame) -> DataFrame:
    return bi.groupBy(OWNER, "task_date", "department").agg(
        count_where("counted").alias("tasks"), count_where("completed").alias("completed"), count_where("open_work").alias("open_work"),
        rate(F.count_if("completed"), F.count_if("counted")).alias("completion_rate"), distinct_where(F.col("employee"), F.col("counted")).alias("employees"),
    )
