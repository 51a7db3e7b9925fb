"""What the summaries share: which rows count, and the measures of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_where, rate


#: Planned work isn't work yet.
NOT_PLANNED = "work_kind <> 'PLANNED'"


def counted(tasks: DataFrame) -> DataFrame:
    """Planned work isn't work yet, and an ambiguous row counts nowhere."""
    return tasks.where((F.col("work_kind") != "PLANNED") & (F.col("task_status") != "Ambiguous"))


def scoped(
    tasks: DataFrame, owner: int | None = None, department: str | None = None, employee: str | None = None,
    first: str | None = None, last: str | None = None,
) -> DataFrame:
    """Rows of an owner, department, employee and inclusive range of days, each of them optional."""
    conditions = [
        None if owner is None else F.col("owner_user_id") == owner,
        None if department is None else F.col("department") == department,
        None if employee is None else F.col("employee_name") == employee,
        None if first is None else F.col("task_date") >= F.lit(first).cast("date"),
        None if last is None else F.col("task_date") <= F.lit(last).cast("date"),
    ]
    for condition in conditions:
        if condition is not None:
            tasks = tasks.where(condition)
    return tasks


def status_counts(*names: str) -> list[Column]:
    return [count_where(F.col("task_status") == n).alias(n.lower().replace(" ", "_")) for n in names]


def total() -> Column:
    return F.count("*").cast("bigint")


def completion_rate() -> Column:
    return rate(F.count_if(F.col("task_status") == "Completed"), F.count("*"))


ALL_STATUSES = ("Completed", "In Progress", "Pending", "Blocked", "Cancelled", "Not Started")
