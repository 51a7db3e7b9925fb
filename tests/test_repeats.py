"""Merging of wordings against a walk from the most frequent one down, and repeated work with merged wordings."""

from __future__ import annotations

import datetime
import itertools
import random

from pyspark.sql import functions as F

from workpulse.functions.text import task_tokens
from workpulse.operators import repeats
from workpulse.plans.facts import EngineConfig


def similar(a: set, b: set, threshold: float) -> bool:
    low, high = sorted((len(a), len(b)))
    return bool(a and b) and (len(a & b) / len(a | b) >= threshold or low >= 2 and high - low <= 2 and len(a & b) == low)


def test_wordings_merge_as_in_a_walk(spark):
    draw = random.Random(3)
    words = ["claim", "vendor", "form", "minute", "ledger", "report", "call", "audit", "stock", "route", "truck", "sample"]
    rows = []
    for person in ("ann", "bob", "cy"):
        texts = {" ".join(draw.sample(words, draw.choice((1, 2, 2, 3, 3, 4, 5, 9, 10)))) for _ in range(60)}
        rows += [(1, person, t, draw.randint(1, 4)) for t in texts]
    frame = spark.createDataFrame(rows, "owner_user_id int, person string, wording string, n long").withColumn("tokens", task_tokens(F.col("wording")))
    right = {}
    for person, mine in itertools.groupby(sorted(frame.collect(), key=lambda r: (r["person"], -r["n"], r["wording"])), key=lambda r: r["person"]):
        kept: list = []
        for r in mine:
            tokens = set(r["tokens"])
            found = next((w for w, t in kept if similar(tokens, t, 0.88)), None)
            if found is None:
                kept.append((r["wording"], tokens))
            right[person, r["wording"]] = found or r["wording"]
    found = {(r["person"], r["wording"]): r["canonical"] for r in repeats.canonical_wordings(frame, 0.88).collect()}
    assert found == right
    assert sum(k[1] != v for k, v in right.items()) > 30


def test_groups_hold_merged_wordings(spark):
    day = lambda i: datetime.date(2026, 3, i)
    tasks = ["Checked the claims", "checking claim", "Checked claims today", "Wrote the minutes"]
    rows = [(1, f"T{i}", day(i + 1), "HR", "Ann Lee", t, None, "Completed" if i % 2 else "Pending") for i, t in enumerate(tasks)]
    frame = spark.createDataFrame(rows, "owner_user_id int, task_id string, task_date date, department string, employee_name string, task string, task_normalized string, task_status string")
    config = EngineConfig()
    (group,) = repeats.repeat_groups(frame, config).collect()
    assert (group["occurrence_count"], group["distinct_dates"], group["completed_count"], group["classification"]) == (3, 3, 1, "Recurring / Legitimate")
    assert group["task"] == "Checked claims today | Checked the claims | checking claim"
    groups = repeats.repeat_groups(frame, config)
    flags = {r["task_id"]: r["repeated_task_flag"] for r in repeats.with_repeat_flag(frame, repeats.merged_wordings(frame, config), groups, config).collect()}
    assert flags == {"T0": True, "T1": True, "T2": True, "T3": False}


def test_kept_facts_follow_their_files(spark, small, tmp_path):
    """A query after files were added shows them, and what was kept can be dropped."""
    import os

    from workpulse.plans import facts

    folder = str(tmp_path)
    for name in ("customer", "nation", "region", "part"):
        os.symlink(f"{small}/{name}.parquet", f"{folder}/{name}.parquet")
    orders = spark.read.parquet(f"{small}/orders.parquet")
    orders.where("o_orderkey % 2 = 0").write.parquet(f"{folder}/orders.parquet")
    count = lambda: facts.once(spark, folder, "all", lambda: facts.tasks(spark, folder)).count()
    before = count()
    assert before == orders.where("o_orderkey % 2 = 0").count() == count()
    files = set(facts.once(spark, folder, "all", lambda: None).inputFiles())
    orders.where("o_orderkey % 2 = 1").write.mode("append").parquet(f"{folder}/orders.parquet")
    assert count() == orders.count() > before
    assert files.isdisjoint(facts.once(spark, folder, "all", lambda: None).inputFiles())
    facts.forget(spark, folder)
    assert not [k for k in facts._WRITTEN if k[1] == folder]


def test_customers_are_shuffled_and_parts_pruned(spark, small):
    """The dimensions that grow aren't sent through the driver, however small their files are."""
    from workpulse.plans.facts import tasks

    plan = tasks(spark, small)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "GreaterThanOrEqual(p_partkey,-199), LessThanOrEqual(p_partkey,199)" in plan


def test_keys_of_facts_are_worked_out_once(spark, small):
    """What is looked for in kept facts finds their keys there; the analysed facts don't show them."""
    from workpulse.plans import registry

    kept = registry.kept_tasks(spark, small)
    assert {"person", "wording"} <= set(kept.columns) and repeats.keyed(kept, "team").columns == kept.columns
    assert not {"person", "wording"} & set(registry.flagged(spark, small).columns)
