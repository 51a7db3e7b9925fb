"""Repeated work: the same task of the same person, with near-identical wordings merged, classified by how often.

Rows are aggregated to (person, wording, day) before anything is compared, so what meets are different wordings. Similar
ones are found by a join on few of their tokens, and which wording stands for which is settled in rounds of joins; no
person's wordings come together in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyify, normalize_task, short_hash, task_tokens, tasks_are_similar
from ..plans.facts import EngineConfig, written

WHO = ("owner_user_id", "person")


def recent(tasks: DataFrame, days: int) -> DataFrame:
    """Rows within ``days`` of the newest day of their owner."""
    newest = tasks.groupBy("owner_user_id").agg(F.max("task_date").alias("newest"))
    return tasks.join(newest, "owner_user_id").where(F.col("task_date") >= F.date_sub("newest", days)).drop("newest")


def similar_wordings(wordings: DataFrame, threshold: float) -> DataFrame:
    """Pairs (owner_user_id, person, wording, earlier) of similar wordings of a person; ``earlier`` comes first by
    frequency, then by name. ``wordings``: owner_user_id, person, wording, n, tokens.

    Similar wordings share a token among few: of two sets whose Jaccard similarity is the threshold or more, one of the
    first |a| - ceil(threshold |a|) + 1 tokens of each, in one order of all tokens; and a set that holds another with
    two tokens more at most has the other's first token among its first three. The order is by rarity."""
    rows = wordings.where(F.size("tokens") > 0)
    often = rows.select("owner_user_id", "person", F.explode("tokens").alias("token")).groupBy(*WHO, "token").agg(F.count("*").alias("held"))
    each = rows.select(*WHO, "wording", "n", "tokens", F.explode("tokens").alias("token")).join(often, [*WHO, "token"])
    size = F.size("tokens")
    most = F.greatest(F.lit(3), size - F.ceil(size * threshold).cast("int") + 1)
    place = F.row_number().over(Window.partitionBy(*WHO, "wording").orderBy("held", "token"))
    keys = each.withColumn("place", place).where(F.col("place") <= most).select(*WHO, "token", F.struct((-F.col("n")).alias("rank"), "wording").alias("w"), "tokens")
    left, right = keys.withColumnsRenamed({"w": "a", "tokens": "ta"}), keys.withColumnsRenamed({"w": "b", "tokens": "tb"})
    pairs = left.join(right, [*WHO, "token"]).where("b < a").where(tasks_are_similar(F.col("ta"), F.col("tb"), threshold))
    return pairs.select(*WHO, F.col("a.wording").alias("wording"), F.col("b.wording").alias("earlier"), F.col("b.rank").alias("rank")).distinct()


def canonical_wordings(wordings: DataFrame, threshold: float) -> DataFrame:
    """(owner_user_id, person, wording, canonical): from the most frequent wording down, the first kept one that is
    similar; a wording that is similar to none is kept.

    A wording is kept once all earlier similar ones are known to be merged, and merged once one of them is known to be
    kept; rounds of joins decide what can be decided until nothing is open, as many as the longest chain of similar
    wordings needs."""
    edges = written(similar_wordings(wordings, threshold), "similar-wordings")
    if edges.isEmpty():
        return wordings.select(*WHO, "wording", F.col("wording").alias("canonical"))
    later = edges.select(*WHO, "wording").distinct()
    first = edges.select(*WHO, F.col("earlier").alias("wording")).distinct().join(later, [*WHO, "wording"], "left_anti")
    state = written(first.withColumn("kept", F.lit(True)).unionByName(later.withColumn("kept", F.lit(None).cast("boolean"))), "wordings")
    while not state.where("kept is null").isEmpty():
        known = state.select(*WHO, F.col("wording").alias("earlier"), F.col("kept").alias("earlier_kept"))
        seen = edges.join(known, [*WHO, "earlier"]).groupBy(*WHO, "wording").agg(F.max(F.coalesce("earlier_kept", F.lit(False))).alias("any_kept"), F.min(F.col("earlier_kept").isNotNull()).alias("all_known"))
        now = F.coalesce("kept", F.when(F.col("any_kept"), False), F.when(F.col("all_known"), True))
        state = written(state.join(seen, [*WHO, "wording"], "left").select(*WHO, "wording", now.alias("kept")), "wordings")
    kept = state.where("kept").select(*WHO, F.col("wording").alias("earlier"))
    target = edges.join(kept, [*WHO, "earlier"]).groupBy(*WHO, "wording").agg(F.min(F.struct("rank", "earlier"))["earlier"].alias("target"))
    merged = target.join(state.where("not kept").select(*WHO, "wording"), [*WHO, "wording"])
    return wordings.join(merged, [*WHO, "wording"], "left").select(*WHO, "wording", F.coalesce("target", "wording").alias("canonical"))


def merged_wordings(tasks: DataFrame, config: EngineConfig = EngineConfig(), person: str = "employee_name") -> DataFrame:
    """``canonical_wordings`` of the facts within the lookback."""
    rows = keyed(recent(tasks, config.repeat_lookback_days), person).where("wording != ''")
    wordings = rows.groupBy(*WHO, "wording").agg(F.count("*").alias("n")).withColumn("tokens", task_tokens(F.col("wording")))
    return canonical_wordings(wordings, config.similarity_threshold)


def keyed(tasks: DataFrame, person: str) -> DataFrame:
    """``tasks`` with person and wording, the keys that repeats are looked for by; facts that have both keep them, so that
    what goes over facts several times can work them out once."""
    if {"person", "wording"} <= set(tasks.columns):
        return tasks
    wording = F.coalesce(F.nullif(F.col("task_normalized"), F.lit("")), normalize_task(F.col("task")))
    return tasks.withColumns({"person": keyify(F.col(person)), "wording": wording})


def repeat_groups(tasks: DataFrame, config: EngineConfig = EngineConfig(), person: str = "employee_name", wordings: DataFrame | None = None) -> DataFrame:
    """Groups of two occurrences or more within the lookback, with their classification. ``wordings``:
    ``merged_wordings``, if they are known already."""
    rows = keyed(recent(tasks, config.repeat_lookback_days), person).where("wording != ''")
    merged = rows.join(merged_wordings(tasks, config, person) if wordings is None else wordings, [*WHO, "wording"])
    days = merged.groupBy(*WHO, "canonical", "task_date").agg(
        F.count("*").alias("n"), F.count_if(F.col("task_status") == "Completed").alias("done"), F.min(F.col(person)).alias("employee"),
        F.min(F.struct("task_date", "task_id", "department")).alias("first"),
    )
    shown = merged.select(*WHO, "canonical", "task").distinct()
    shown = shown.withColumn("place", F.row_number().over(Window.partitionBy(*WHO, "canonical").orderBy("task"))).where("place <= 3")
    shown = shown.groupBy(*WHO, "canonical").agg(F.array_join(F.array_sort(F.collect_list("task")), " | ").alias("task"))  # three of each
    groups = days.groupBy(*WHO, "canonical").agg(
        F.sum("n").alias("occurrence_count"), F.count("*").alias("distinct_dates"), F.max("n").alias("max_same_day_count"), F.min("task_date").alias("first_date"),
        F.max("task_date").alias("last_date"), F.sum("done").alias("completed_count"), F.min("employee").alias("employee"), F.min("first")["department"].alias("department"),
        F.array_join(F.transform(F.array_sort(F.collect_list("task_date")), lambda d: d.cast("string")), ",").alias("dates"),  # days of the lookback
    ).where("occurrence_count >= 2").join(shown, [*WHO, "canonical"])
    n, dates = F.col("occurrence_count"), F.col("distinct_dates")
    label = (
        F.when(F.col("max_same_day_count") >= config.repeat_same_day_review_min, "Needs Review")
        .when(n >= config.repeat_high_min, "Highly Repetitive")
        .when(dates >= config.repeat_recurring_min, "Recurring / Legitimate")
        .when(n > dates, "Potential Duplication")
        .otherwise("Recurring / Legitimate")
    )
    return groups.select(
        "owner_user_id", short_hash(F.concat_ws("||", "person", "canonical")).alias("repeat_key"), "employee", "department", "task", F.col("canonical").alias("normalized_task"), "person",
        n.cast("bigint").alias("occurrence_count"), dates.cast("bigint").alias("distinct_dates"), F.col("max_same_day_count").cast("bigint").alias("max_same_day_count"),
        "first_date", "last_date", "dates", F.col("completed_count").cast("bigint").alias("completed_count"), (n - F.col("completed_count")).cast("bigint").alias("open_count"), label.alias("classification"),
    )


def list_groups(groups: DataFrame, department: str | None = None, employee: str | None = None, first: str | None = None, last: str | None = None, search: str | None = None) -> DataFrame:
    """Groups of a department or person whose span overlaps a window and whose task holds a text, most frequent first."""
    for condition in (
        None if department is None else F.col("department") == department,
        None if employee is None else F.col("employee") == employee,
        None if first is None else F.col("last_date") >= F.lit(first).cast("date"),
        None if last is None else F.col("first_date") <= F.lit(last).cast("date"),
        None if search is None else F.col("task").ilike(f"%{search}%"),
    ):
        if condition is not None:
            groups = groups.where(condition)
    return groups.orderBy(F.desc("occurrence_count"), "repeat_key")


def with_repeat_flag(tasks: DataFrame, wordings: DataFrame, groups: DataFrame, config: EngineConfig = EngineConfig(), person: str = "employee_name") -> DataFrame:
    """``tasks`` with repeated_task_flag: whether the row is one of a group's occurrences. ``wordings`` are
    ``merged_wordings``."""
    named = groups.select(*WHO, F.col("normalized_task").alias("canonical"))
    hit = wordings.join(named, [*WHO, "canonical"]).select(*WHO, "wording", F.lit(True).alias("hit"))
    newest = tasks.groupBy("owner_user_id").agg(F.max("task_date").alias("newest"))
    rows = keyed(tasks, person).join(newest, "owner_user_id").join(hit, [*WHO, "wording"], "left")
    inside = F.col("task_date") >= F.date_sub("newest", config.repeat_lookback_days)
    return rows.withColumn("repeated_task_flag", F.coalesce(F.col("hit") & inside, F.lit(False))).select(*tasks.columns, "repeated_task_flag")
