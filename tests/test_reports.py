"""Commentaries, fingerprints, archives, recordsets and aligned windows on small cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from workpulse.operators import dashboard, narratives, recordsets


def test_loose_json(spark):
    texts = {
        "plain": ' {"a": "x"} ', "fenced": '```json\n{"a": "x"}\n```', "prose": 'Sure: {"a": "x"}. Bye', "nested": '{"a": "x", "b": {"c": [1]}}', "cut": '{"a": "x"', "braces": "} {",
        "empty": "", "none": None, "words": "nothing", "number": '{"a": 5}', "list": "[1]",
    }
    rows = spark.createDataFrame(list(texts.items()), "name string, text string")
    found = {r.name: (r.ok, r.a) for r in rows.select("name", narratives.loose_json(F.col("text")).isNotNull().alias("ok"), narratives._text(narratives.loose_json(F.col("text")), "$.a").alias("a")).collect()}
    assert {n for n, (ok, _) in found.items() if ok} == {"plain", "fenced", "prose", "nested", "number", "list"}
    assert {n for n, (_, a) in found.items() if a == "x"} == {"plain", "fenced", "prose", "nested"}


def verdicts(spark, replies, numbers=(57.1, 40.0, -3.25), subjects=()):
    rows = spark.createDataFrame([(1, str(i), r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(replies)], "owner_user_id int, report_id string, reply string")
    data = spark.createDataFrame([(1, n) for n in numbers], "owner_user_id int, n double")
    known = spark.createDataFrame([(1, *s) for s in subjects], "owner_user_id int, part string, subject string")
    return narratives.gate(rows, narratives.figures((data, ["n"])), known)


def test_numbers_of_sentences(spark):
    """A figure may be quoted as it is, whole, to one decimal, and the first two without its sign; small counts and years aren't claims."""
    said = {
        "57.1% done": None, "57% done": None, "57.2% done": "57.2", "40 and 40.0 tasks": None, "down by 3.25": None, "3.3 less": "3.3", "3.4 less": "3.4", "12 people in 2024": None, "13 people": "13",
        "in 1899 and 2201": "1899, 2201", "99 and 99 and 57": "99", "no number": None, "12.5 hours": "12.5", "9" * 40 + " rows": "9" * 40,
    }
    found = verdicts(spark, [{"summary": t} for t in said]).collect()
    assert {r.text: r.unsupported for r in found} == said
    assert all(r.verdict == ("kept" if r.unsupported is None else "removed") for r in found)


def test_gate(spark):
    subjects = [("department_observations", "Ops"), ("slow_tasks", "T1"), ("repeated_tasks", "ann lee||check mail")]
    reply = {
        "summary": "", "department_observations": [{"department": "Ops", "observation": "All well", "interpretation": "77 failed"}, {"department": "Sales", "observation": "Fine"}, {"department": "Ops"}, 5],
        "attention_items": [{"item": "Look at 77", "why_it_matters": "Late"}, {"why_it_matters": "No item"}, {"item": "Ask", "suggested_action": "Call 77 people"}],
        "slow_tasks": [{"task_id": "T1", "comment": "Slow"}, {"task_id": "T2", "comment": "Slow"}], "repeated_tasks": [{"employee": "Ann  LEE.", "task": "Check mail", "comment": "Often"}, {"employee": "Bob", "task": "x", "comment": "Often"}],
        "trends": ["up", "", 7, "77"] + ["flat"] * 11, "data_quality": "none",
    }
    found = verdicts(spark, [reply, None, "broken {", "[1]"], subjects=subjects).collect()
    got = {(r.part, r.position, r.field): r.verdict for r in found if r.report_id == "0"}
    o, a = "department_observations", "attention_items"
    assert got[("summary", 0, "")] == "missing"
    assert [got.get((o, i, "observation")) for i in range(4)] == ["kept", "dropped", "dropped", "dropped"] and got[(o, 0, "interpretation")] == "removed"
    assert [got[(a, i, "item")] for i in range(3)] == ["removed", "dropped", "kept"]
    assert got[(a, 0, "why_it_matters")] == "dropped" and got[(a, 1, "why_it_matters")] == "dropped" and got[(a, 2, "suggested_action")] == "kept"
    assert [got[("slow_tasks", i, "comment")] for i in (0, 1)] == ["kept", "dropped"] == [got[("repeated_tasks", i, "comment")] for i in (0, 1)]
    trends = [got.get(("trends", i, "")) for i in range(15)]
    assert trends[:4] == ["kept", None, None, "removed"] and trends.count("kept") == 10 and trends[-2:] == ["over_limit"] * 2
    assert {r.report_id: r.verdict for r in found if r.part == "reply"} == {"1": "invalid", "2": "invalid", "3": "invalid"}
    states = {r.report_id: r.status for r in narratives.outcomes(verdicts(spark, [reply, None, {"summary": "57 done"}], subjects=subjects)).collect()}
    assert states == {"0": "PARTIAL", "1": "UNAVAILABLE", "2": "OK"}


def test_no_commentaries(spark):
    empty = spark.createDataFrame([], "owner_user_id int, report_id string, reply string")
    none = spark.createDataFrame([], "owner_user_id int, part string, subject string")
    data = spark.createDataFrame([], "owner_user_id int, n double")
    assert narratives.gate(empty, narratives.figures((data, ["n"])), none).count() == 0


def test_fingerprints(spark):
    rows = [(1, "a", 1), (1, "b", None), (1, "b", None), (2, None, 3)]
    made = lambda data, n=1, schema="owner_user_id int, name string, n int": {r.owner_user_id: r.fingerprint for r in narratives.fingerprints(spark.createDataFrame(data, schema).repartition(n)).collect()}
    first = made(rows)
    assert first == made(rows[::-1], 5)
    assert first == {r.owner_user_id: r.fingerprint for r in narratives.fingerprints(spark.createDataFrame(rows, "owner_user_id int, name string, n int").select("n", "owner_user_id", "name")).collect()}
    assert first[1] != made(rows[:2])[1] and first[2] == made(rows[3:])[2]
    assert made([(1, "1:a", None)]) != made([(1, None, None)]) and made([(1, "", 1)]) != made([(1, None, 1)])
    assert made([(1, "a2", 3)]) != made([(1, "a", 23)])


def test_archive(spark):
    """A report whose dataset is as it was isn't made again, and a second run reads the archive."""
    schema = "report_id string, owner_user_id int, fingerprint string, status string, report string"
    archive = spark.createDataFrame([("M-u1", 1, "f1", "made", "one"), ("M-u2", 2, "old", "made", "two"), ("L-u1", 1, "f1", "made", "other month")], schema)
    now = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3")], "owner_user_id int, fingerprint string")
    texts = spark.createDataFrame([(1, "new one"), (2, "new two"), (3, "new three")], "owner_user_id int, report string")
    after = narratives.refreshed(archive, now, texts, "M")
    rows = lambda df: {r.report_id: (r.fingerprint, r.status, r.report) for r in df.collect()}
    assert rows(after) == {"M-u1": ("f1", "cached", "one"), "M-u2": ("f2", "made", "new two"), "M-u3": ("f3", "made", "new three"), "L-u1": ("f1", "made", "other month")}
    again = rows(narratives.refreshed(after, now, texts.withColumn("report", F.lit("never read")), "M"))
    assert {k: v[2] for k, v in again.items()} == {"M-u1": "one", "M-u2": "new two", "M-u3": "new three", "L-u1": "other month"} and again["M-u2"][1] == "cached"


def test_recordset(spark):
    texts = ['[{"a": 1, "b": "x", "z": 0}, {"a": "no", "b": "y"}, {"b": 2}]', "[]", "", None, "{broken", '{"a": 1}', '[{"a": 7}, null]']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = [(r.k, r.a, r.b) for r in recordsets.recordset(rows, "text", "a int, b string", ["k"]).collect()]
    assert sorted(found, key=str) == sorted([(0, 1, "x"), (0, None, "y"), (0, None, "2"), (6, 7, None)], key=str)
    assert sorted(r.k for r in recordsets.unreadable(rows, "text").collect()) == [4, 5]


def test_parallel_and_update(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], [1.0]), (2, None, [2.0]), (3, [], None)], "k int, names array<string>, n array<double>")
    assert sorted(((r.k, r.names, r.n) for r in recordsets.parallel(rows, ["names", "n"], ["k"]).collect()), key=str) == [(1, "a", 1.0), (1, "b", None), (2, None, 2.0)]
    stored = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (None, "z", 3)], "id int, v string, w int")
    values = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (9, "no", 1), (None, "no", 1), (2, None, 1)], "id int, v string, seq int")
    assert sorted((tuple(r) for r in recordsets.bulk_update(stored, values, "id", ["seq"]).select("id", "v", "w").collect()), key=str) == sorted([(1, "new", 1), (2, None, 2), (None, "z", 3)], key=str)


def test_aligned_prunes(spark, tmp_path):
    """Panels cover what the series shows, and a table by day reads only those folders."""
    days = [(1, f"2024-{m:02d}-0{d}", "Completed", "REPORTED", f"e{m}", True, "Ops") for m in (1, 2, 5, 9) for d in (1, 3)] + [(2, "2020-01-01", "Completed", "REPORTED", "x", True, "Ops")]
    names = "owner_user_id int, task_date string, task_status string, work_kind string, employee_name string, is_person boolean, department string"
    rows = spark.createDataFrame(days, names).withColumn("task_date", F.col("task_date").cast("date"))
    rows.write.partitionBy("task_date").parquet(f"file://{tmp_path}/facts")
    facts = spark.read.parquet(f"file://{tmp_path}/facts")
    panel = dashboard.aligned(facts, None, "month", 2, owner=1)
    assert sorted(str(r.task_date) for r in panel.collect()) == ["2024-05-01", "2024-05-03", "2024-09-01", "2024-09-03"]
    assert panel.count() == dashboard.period_series(facts, "month", 2, owner=1).agg(F.sum("total")).first()[0]
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "subquery" in plan.split("PartitionFilters", 1)[1].split("]")[0].lower()
    assert dashboard.aligned(facts, None, "month", 2, owner=1, first="2024-02-03").count() == 5
    assert dashboard.aligned(facts, None, "month", 2, owner=7).count() == 0
