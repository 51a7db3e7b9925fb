"""The store of reports: batches, replays, versions, failures, and what is rebuilt."""

from __future__ import annotations

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from workpulse.operators.evidence import Masters
from workpulse.operators.ingest import IngestConfig
from workpulse.sources import grids
from workpulse.streaming.store import Store

HEAD = "Date | Employee | Task | Status\n"
FACT = ("owner_user_id", "document_id", "fingerprint", "task_date", "employee_name", "department", "task", "task_status")


def report(*lines):
    return HEAD + "\n".join(lines)


def document(i, text, owner=1, key=None):
    at = datetime.datetime(2026, 3, 1) + datetime.timedelta(minutes=i)
    return {"owner_user_id": owner, "document_id": key or f"d{i:03}", "text": text, "received_at": at.isoformat()}


def landed(folder, documents, first=0):
    """A file each, in order of time."""
    os.makedirs(folder, exist_ok=True)
    for i, d in enumerate(documents, first):
        path = f"{folder}/{i:04}.json"
        with open(path, "w") as f:
            f.write(json.dumps(d))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def facts_of(store):
    return sorted(map(tuple, store.facts().select(*FACT).collect()))


def outcomes_of(store):
    names = ("owner_user_id", "document_id", "status", "rows_extracted", "inserted", "skipped", "rejected", "over_cap", "first_reason")
    return sorted(tuple(str(r[n]) for n in names) for r in store.outcomes().select(*names).collect())


@pytest.fixture(scope="module")
def corpus():
    """Reports of two owners: every third repeats rows of the one before, one is sent again, one has no table."""
    found = []
    for i in range(24):
        lines = [f"2026-0{1 + i % 2}-0{1 + i % 7} | Ann Lee | task number {i} of the week | done", f"2026-03-0{1 + i % 5} | Bob Ray | call {i // 3} to suppliers | WIP"]
        found.append(document(i, report(*lines) if i % 8 != 7 else "no table here", owner=1 + i % 2))
    found.append({**found[3], "received_at": "2026-03-02T00:00:00"})
    return found


def test_bounded_batches_equal_one_batch(spark, tmp_path, corpus):
    landed(str(tmp_path / "in"), corpus)
    whole, parts = Store(spark, str(tmp_path / "whole")), Store(spark, str(tmp_path / "parts"))
    whole.stream(whole.landed(str(tmp_path / "in"), 1000)).awaitTermination()
    parts.stream(parts.landed(str(tmp_path / "in"), 13)).awaitTermination()
    assert (whole.runs().count(), parts.runs().count()) == (1, 2)
    assert facts_of(whole) == facts_of(parts)
    # numbers don't tell tasks apart, so of an owner's rows of one person and day the first to arrive is the fact
    first = {}
    for d in corpus:
        for line in d["text"].splitlines()[1:]:
            day, who = line.split(" | ")[:2]
            first.setdefault((d["owner_user_id"], day, who), d["document_id"])
    assert sorted((f[0], str(f[3]), f[4], f[1]) for f in facts_of(parts)) == sorted((*k, v) for k, v in first.items())
    total = parts.runs().agg(*(F.sum(c).alias(c) for c in ("documents", "inserted", "rejected", "skipped", "failed"))).first()
    assert (total["documents"], total["inserted"], total["failed"]) == (25, len(facts_of(whole)), 0)
    assert total["skipped"] == 2  # the document that came again, in a later batch
    # a later document: only its cells are asked
    landed(str(tmp_path / "in"), [document(99, report("2026-01-02 | Ann Lee | late work on things | done", "2026-01-01 | Ann Lee | task number 0 of the week | done"))], 50)
    parts.stream(parts.landed(str(tmp_path / "in"), 13)).awaitTermination()
    late = parts.outcomes().where("document_id = 'd099'").first()
    assert (late["status"], late["inserted"], late["rejected"], late["first_reason"], late["batch"]) == ("PARTIAL", 1, 1, "DUPLICATE_ACROSS_DOCUMENTS", 2)
    asked = parts._staged(2, "accepted")
    read = {f.split("/facts/")[1].rsplit("/", 2)[0] for f in parts.known(asked, 2).inputFiles()}
    wanted = {f"owner_user_id={r[0]}/month={r[1]}/prefix={r[2]}" for r in asked.select("owner_user_id", "month", "prefix").collect()}
    assert read and read <= wanted and len(wanted) <= 2


def test_replay_gives_the_same_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = spark.createDataFrame([("a", report("2026-03-09 | Ann Lee | filed the claims | done"), 1), ("b", report("2026-03-09 | Ann Lee | filed the claims | done", "2026-03-09 | Bob Ray | called home | odd"), 2)], "document_id string, text string, owner_user_id int")
    second = spark.createDataFrame([("c", report("2026-03-09 | Ann Lee | filed the claims | done", "2026-03-10 | Ann Lee | wrote the minutes | done"), 1)], "document_id string, text string, owner_user_id int")
    store.ingest(first, 0)
    store.ingest(second, 1)
    facts, outcomes = facts_of(store), outcomes_of(store)
    assert [f[:2] for f in facts] == [(1, "a"), (1, "c"), (2, "b")]  # owners don't see each other's rows
    for batch, rows in ((1, second), (0, first)):
        store.stage(rows, batch)
        preview = sorted(tuple(str(r[n]) for n in ("document_id", "status", "inserted", "rejected")) for r in store.preview(batch).collect())
        store.commit(batch)
        written = sorted(tuple(str(r[n]) for n in ("document_id", "status", "inserted", "rejected")) for r in store.outcomes().where(F.col("batch") == batch).collect())
        assert preview == written
    assert (facts_of(store), outcomes_of(store)) == (facts, outcomes)
    assert {tuple(r) for r in store.rejected().select("document_id", "reason").collect()} == {("b", "UNKNOWN_STATUS"), ("c", "DUPLICATE_ACROSS_DOCUMENTS")}


def test_versions_caps_and_rosters(spark, tmp_path):
    roster = spark.createDataFrame([("E1", "Ann Lee", ["A. Lee"], "Sales", "ann@x.example", True, True), ("E2", "Bob Ray", None, "Ops", None, False, True)], "employee_id string, employee_name string, aliases array<string>, department string, email string, on_roster boolean, active boolean")
    departments = spark.createDataFrame([("Sales", ["Selling"], ["x.example"], 1), ("Ops", None, None, 2)], "department_name string, aliases array<string>, sender_domains array<string>, ordinal int")
    store = Store(spark, str(tmp_path), IngestConfig(max_rows_per_document=3), Masters(roster, departments, None, roster_only=True))
    lines = [f"2026-03-0{i} | A. Lee | task number {i} | done" for i in range(1, 6)]
    day = datetime.datetime(2026, 3, 10)
    rows = [
        ("v", report(*lines[:2]), None, None, day), ("v", report(*lines[:3]), None, None, day + datetime.timedelta(hours=1)), ("v", report(*lines[:2]), None, None, day + datetime.timedelta(hours=2)),
        ("cap", report(*[x.replace("task", "capped") for x in lines]), None, None, day), ("out", report("2026-03-01 | Bob Ray | some work | done"), None, None, day), ("none", "no table", None, None, day),
        ("mail", "Employee | Task | Status\nA. Lee | sold the things | done\nAnn Lee | sold more things | done\nAnn | sold it all | WIP", "Yesterday's work of the ops team", "Ann <ann@x.example>", day),
    ]
    docs = spark.createDataFrame(rows, "document_id string, text string, context_text string, sender string, received_at timestamp")
    store.ingest(docs, 0)
    found = {(r["document_id"], r["inserted"]): r for r in store.outcomes().collect()}
    assert {(k[0], r["status"], r["inserted"], r["skipped"], r["outside"], r["over_cap"]) for k, r in found.items()} >= {
        ("v", "SUCCESS", 2, 0, 0, 0), ("v", "SUCCESS", 1, 2, 0, 0), ("cap", "PARTIAL", 3, 0, 0, 2), ("out", "NO_DATA", 0, 0, 1, 0), ("none", "NO_DATA", 0, 0, 0, 0),
    }
    facts = {(r["document_id"], r["employee_name"], r["employee_id"], r["department"]) for r in store.facts().collect()}
    assert facts == {(d, "Ann Lee", "E1", "Sales") for d in ("v", "cap", "mail")}
    # a first name is enough where one person has it; the day is what the covering text states
    assert {(r["task_date"], "covering text" in r["data_quality_notes"]) for r in store.facts().where("document_id = 'mail'").collect()} == {(datetime.date(2026, 3, 9), True)} and ("mail", 3) in found
    assert store.outcomes().where("document_id = 'v'").count() == 2


def test_a_document_that_cannot_be_read_fails_alone(spark, tmp_path):
    rows = spark.createDataFrame([("ok", report("2026-03-09 | Ann Lee | filed the claims | done"), None), ("bad", None, "<table><tr><td colspan='²'>x</td></tr></table>")], "document_id string, text string, html string")
    assert {r["document_id"] for r in grids.read_grids(rows, failures=True).where("table_index < 0").collect()} == {"bad"}
    store = Store(spark, str(tmp_path))
    store.ingest(rows, 0)
    assert {(r["document_id"], r["status"], r["inserted"]) for r in store.outcomes().collect()} == {("ok", "SUCCESS", 1), ("bad", "FAILED", 0)}
    run = store.runs().first()
    assert (run["documents"], run["failed"], run["inserted"]) == (2, 1, 1)


def test_rebuild_writes_touched_owners_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    day = lambda d, who, what: f"2026-03-{d:02} | {who} | {what} | done"
    docs = [(o, f"d{o}", report(*(day(d, "Ann Lee", "checked the claims") for d in range(1, 5)))) for o in (1, 2)]
    schema = "owner_user_id int, document_id string, text string"
    store.ingest(spark.createDataFrame(docs, schema), 0)
    store.rebuild()
    files = lambda owner: sorted((p, os.stat(f"{tmp_path}/a/derived/{n}/owner_user_id={owner}/{p}").st_mtime_ns) for n in ("facts", "groups") for p in os.listdir(f"{tmp_path}/a/derived/{n}/owner_user_id={owner}"))
    before = {o: files(o) for o in (1, 2)}
    store.ingest(spark.createDataFrame([(2, "more", report(*(day(d, "Bob Ray", "called the suppliers") for d in range(1, 4))))], schema), 1)
    assert store.touched([1]) == [2]
    store.rebuild(store.touched([1]))
    assert files(1) == before[1] and files(2) != before[2]
    derived = {n: sorted(map(str, store.derived(n).select(*sorted(store.derived(n).columns)).collect())) for n in ("facts", "groups")}
    store.rebuild()
    assert derived == {n: sorted(map(str, store.derived(n).select(*sorted(store.derived(n).columns)).collect())) for n in ("facts", "groups")}
    assert {(r["owner_user_id"], r["employee"], r["occurrence_count"]) for r in store.derived("groups").collect()} == {(1, "Ann Lee", 4), (2, "Ann Lee", 4), (2, "Bob Ray", 3)}
