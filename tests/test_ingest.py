"""Grids, headings, validation, routing and the report stream."""

from __future__ import annotations

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from workpulse.operators import evidence, headers, ingest
from workpulse.plans import registry
from workpulse.plans.facts import TABLES
from workpulse.sources import grids
from workpulse.streaming import reports

from .conftest import rows_of, rows_of_sql

HTML = """<table><tr><td>Layout</td><td><table>
<tr><th colspan=2>Daily report<th>x<th></tr>
<tr><th>Date<th>Employee Name<th>Task<th>Status<th>Link</tr>
<tr><td rowspan=2>9 March 2026<td>Ann Lee<td>Checked &amp; filed the claims<td>done<td><a href="https://x.example/1">open</a></tr>
<tr><td>Bob Ray<td>Called the <b>suppliers</b><td>on hold<td>-</tr>
<tr><td>31/02/2026<td>Ann Lee<td>Impossible day<td>done<td></tr>
<tr><td>9/3/2026<td>Ann Lee<td>Odd state<td>purple<td></tr>
<tr><td>9/3/2026<td><td>Nobody did this<td>done<td></tr>
<tr><td>Total<td><td>5<td><td></tr>
<tr><td><td>-<td><td><td></tr>
</table></td></tr></table><table><tr><td>Kind regards</td></tr></table>"""
PIPES = "Hello\n| Date | Employee | Task | Status |\n|---|---|---|---|\n| 2026-03-09 | Ann Lee | Checked and filed the claims | Completed |\n| 2026-03-10 | Ann Lee | Wrote the minutes | WIP |\n\nBye"
CSV = '﻿Date;Employee;Task;Status\n2026-03-11;Cy Poe;"Long; quoted\ntask";pending\n;;;\n'
SCHEMA = "document_id string, html string, text string, attachment_name string"
ROWS = [("d1", HTML, None, None), ("d2", None, PIPES, None), ("d3", None, CSV, "r.csv"), ("d4", None, "no table", None), ("d5", None, None, None)]


def test_html_grid():
    found = grids.tables_of(HTML, None)
    assert [len(t) for _, t in found] == [1, 9, 1]
    inner = found[1][1]
    assert [c[0] for c in inner[0]] == ["Daily report", "Daily report", "x", ""]
    assert inner[2] == [("9 March 2026", ""), ("Ann Lee", ""), ("Checked & filed the claims", ""), ("done", ""), ("open", "https://x.example/1")]
    assert inner[3][0][0] == "9 March 2026" and inner[3][2][0] == "Called the suppliers"


def test_text_grids():
    assert [[c[0] for c in r] for r in grids.piped("a|b|c\n-|-|-\n1||3")[0]] == [["a", "b", "c"], ["1", "", "3"]]
    assert grids.delimited(CSV)[1][2][0] == "Long; quoted\ntask"
    assert grids.tables_of(None, "a\tb\tc\n1\t2\t3")[0] == ("tab", [[("a", ""), ("b", ""), ("c", "")], [("1", ""), ("2", ""), ("3", "")]])
    assert grids.tables_of("", "") == [] and grids.tables_of(None, None) == []


def test_rows_and_reasons(spark):
    rows = ingest.validated(ingest.raw_rows(grids.read_grids(spark.createDataFrame(ROWS, SCHEMA)))).orderBy("document_id", "row_index").collect()
    assert [(r["document_id"], r["employee_name"], r["task_status"], r["reject_reason"]) for r in rows] == [
        ("d1", "Ann Lee", "Completed", None), ("d1", "Bob Ray", "Pending", None), ("d1", "Ann Lee", "Completed", "INVALID_DATE"),
        ("d1", "Ann Lee", None, "UNKNOWN_STATUS"), ("d1", None, "Completed", "MISSING_REQUIRED_FIELD"),
        ("d2", "Ann Lee", "Completed", None), ("d2", "Ann Lee", "In Progress", None), ("d3", "Cy Poe", "Pending", None),
    ]
    assert rows[0]["link"] == "https://x.example/1" and rows[0]["task_date"] == datetime.date(2026, 3, 9)


TEMPLATE = """Daily work report
| DWR: 001 | Emp Name: Asha Rao | Designation | Date: 28/09/2026 | Day: Monday | Full Day | | |
| Sr. No. | Company | Category | What was I supposed to do today? | What did I do? | Did I do | Time taken (Minutes) | Comments / Links |
| 1 | Adhoc | Calls | Call the vendors | Called the vendors | All | 45 | - |
| 2 | Adhoc | Forms | Check the forms | | No | 1h 30m | late |
| 3 | Adhoc | Plans | | Review of the plans | Partly | 90 | |
| 4 | Adhoc | | | | All | | |
| 5 | Adhoc | | | | All | | |"""


def test_template_with_title_line(spark):
    docs = spark.createDataFrame([("t", None, TEMPLATE, None)], SCHEMA)
    rows = ingest.validated(ingest.raw_rows(grids.read_grids(docs))).orderBy("row_index").collect()
    assert [(r["employee_name"], r["task"], r["task_status"], r["actual_duration"], r["reject_reason"]) for r in rows] == [
        ("Asha Rao", "Called the vendors", "Completed", 0.75, None), ("Asha Rao", "Check the forms", "Pending", 1.5, None), ("Asha Rao", "Review of the plans", "In Progress", 1.5, None),
    ]
    assert {r["task_date"] for r in rows} == {datetime.date(2026, 9, 28)} and rows[0]["notes"] == "Planned: Call the vendors" and rows[1]["notes"] == "late"


def test_headings_in_two_rows_and_by_values(spark):
    two = "Date | Employee Information | Work | \n | Name | Task | Status\n9/3/2026 | A1 | wrote minutes | done\n9/3/2026 | B2 | filed claims | to be done"
    free = "When | Who | Particulars | Stand\n" + "\n".join(f"{i}/3/2026 | {p} | {t} number {i} | {s}" for i, (p, t, s) in enumerate([("Ann Lee", "wrote the minutes", "done"), ("Bob Ray", "called the suppliers", "WIP"), ("Ann Lee", "checked the claims", "done/pending"), ("Bob Ray", "filed the forms", "open")], 1))
    other = "Item | Price | Amount\nbolt | 3 | 4\nnut | 5 | 6\nscrew | 7 | 8"
    docs = spark.createDataFrame([("two", None, two, None), ("free", None, free, None), ("other", None, other, None)], SCHEMA)
    cells = grids.read_grids(docs)
    found = {r["document_id"]: (r["header_row"], dict(r["fields"])) for r in ingest.header_maps(cells).collect()}
    columns = {"date": 0, "employee": 1, "task": 2, "status": 3}
    assert found == {"two": (1, columns), "free": (0, columns)}
    rows = ingest.validated(ingest.raw_rows(cells)).orderBy("document_id", "row_index").collect()
    assert [(r["task_status"], r["work_kind"]) for r in rows] == [("Completed", "REPORTED"), ("In Progress", "REPORTED"), ("Ambiguous", "REPORTED"), ("Pending", "REPORTED"), ("Completed", "REPORTED"), ("Not Started", "PLANNED")]


def test_headings_mean_fields(spark):
    from workpulse.operators import headers

    cases = {
        "Dated": "date", "Handled By Staff": "employee", "Name of Employee": "employee", "Task Name": "task", "Current State": "status", "Unit Price": None, "Sr. No.": None, "S/N": None, "Tomorrow's Plan": "task",
        "Business Unit": "department", "Planned Hours": "expectedDuration", "Hours Spent": "actualDuration", "Remarks": "notes", "Where": None, "Time taken (Minutes)": "actualDuration", "Did I do?": "status",
    }
    rows = headers.heading_fields(spark.createDataFrame([(h,) for h in cases], "heading string")).collect()
    assert {r["heading"]: r["field"] for r in rows} == cases
    kinds = {"Tomorrow's Plan": "PLANNED", "Yesterday": "PREVIOUS_DAY", "What was done today": "COMPLETED_TODAY", "Task": "REPORTED"}
    frame = spark.createDataFrame([(h,) for h in kinds], "h string")
    assert {r["h"]: r["k"] for r in frame.select("h", headers.work_kind(F.col("h")).alias("k")).collect()} == kinds


def test_row_cap(spark):
    docs = spark.createDataFrame([("d", None, "Date | Employee | Task | Status\n" + "\n".join(f"2026-01-01 | A B | task number {i} | done" for i in range(9)), None)], SCHEMA)
    assert ingest.raw_rows(grids.read_grids(docs), ingest.IngestConfig(max_rows_per_document=4)).count() == 4
    assert [tuple(r) for r in ingest.rows_over_cap(grids.read_grids(docs), ingest.IngestConfig(max_rows_per_document=4)).collect()] == [("d", 5)]


@pytest.mark.parametrize("name", ["ingest_reports", "ingest_rejections"])
def test_queries_read_long_documents_whole(spark, small, tmp_path, name):
    """A person with more rows in a month than the cap on documents of the store."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        rows = f"SELECT * FROM read_parquet('{small}/{t}.parquet')"
        if t == "orders":
            rows = f"SELECT * REPLACE (o_orderkey + i * 600000 AS o_orderkey, 1 AS o_custkey, TIMESTAMP '1996-03-09' AS o_orderdate) FROM ({rows}), range(2) r(i)"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    facts = con.execute(f"SELECT count(*) FROM ({registry.SQL['ingest_reports']})").fetchone()[0]
    assert facts > ingest.IngestConfig().max_rows_per_document
    assert rows_of(registry.QUERIES[name](spark, str(tmp_path))) == rows_of_sql(con, registry.SQL[name])


def test_stream_is_idempotent_and_rejects_other_documents(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(ROWS[:1], SCHEMA).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    reports.ingest_stream(stream(), folder).awaitTermination()
    assert reports.stored(spark, f"{folder}/facts", reports.FACTS_SQL).count() == 2
    again = [("d1", HTML, None, None), ("d9", None, PIPES.replace("Checked and", "Checked"), None)]
    spark.createDataFrame(again, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    reports.ingest_stream(stream(), folder).awaitTermination()
    facts = reports.stored(spark, f"{folder}/facts", reports.FACTS_SQL)
    before = sorted(map(tuple, facts.collect()))
    assert facts.groupBy("fingerprint").count().where("count > 1").count() == 0
    # the second batch once more, as after a failure
    reports.ingest_batch(spark.createDataFrame(again, SCHEMA), 1, folder)
    assert sorted(map(tuple, reports.stored(spark, f"{folder}/facts", reports.FACTS_SQL).collect())) == before


def test_streamed_counts_equal_batch(spark, small, tmp_path):
    path = str(tmp_path / "events")
    events = spark.read.parquet(f"{small}/events.parquet")
    events.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    query = reports.event_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    plain = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, plain.collect()))


def test_a_document_twice_in_a_batch_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([ROWS[1], ROWS[1]], SCHEMA)
    reports.ingest_batch(docs, 0, str(tmp_path))
    assert reports.stored(spark, f"{tmp_path}/facts", reports.FACTS_SQL).count() == 2


def test_made_up_people_who_share_an_id(spark):
    """The hashes of both names begin with 1f5377."""
    day = datetime.date(2026, 3, 9)
    rows = [(f"Customer#{n:09d}", "EMP-1F5377", "Ops", True, "accepted", True, day, f"d{n}", 0, i) for n, many in ((2103, 1), (13743, 2)) for i in range(many)]
    found = evidence.made_up_people(spark.createDataFrame(rows, "employee_name string, employee_id string, department string, looks_like_person boolean, outcome string, employee_new boolean, task_date date, document_id string, table_index int, row_index int"))
    assert {(r["employee_name"], r["employee_id"], r["tasks"]) for r in found.collect()} == {("Customer#000002103", "EMP-1F5377", 1), ("Customer#000013743", "EMP-1F5377", 2)}


def test_frequent_headings_are_read_ahead(spark, monkeypatch):
    """Whether a table's first line is among those that are read ahead makes no difference; of many tables with one
    heading it is read once."""
    head = "Dated | Handled By Staff | Work Performed | Current Stand"
    docs = spark.createDataFrame([(f"d{i}", None, f"{head if i else 'Date | Employee | Task | Status'}\n2026-03-09 | Ann Lee | filed the claims | done\n2026-03-10 | Bob Ray | swept | open", None) for i in range(4)], SCHEMA)
    cells = grids.read_grids(docs)
    maps = lambda: {(r["document_id"], r["header_row"], tuple(sorted(r["fields"].items()))) for r in ingest.header_maps(cells).collect()}
    ahead = maps()
    assert len(ahead) == 4
    monkeypatch.setattr(headers, "OFTEN", 1)
    assert maps() == ahead
    monkeypatch.setattr(headers, "LONG_LINE", 0)
    assert maps() == ahead


def test_settled_tables_are_not_shuffled(spark):
    easy, others = headers.headed_tables(grids.read_tables(spark.createDataFrame(ROWS[1:2], SCHEMA)), ingest.IngestConfig().status_aliases)
    assert [r["document_id"] for r in easy.collect()] == ["d2"] and others.isEmpty()
    assert "Exchange hashpartitioning" not in easy._jdf.queryExecution().executedPlan().toString()


def test_each_source_is_worked_out_once(spark):
    rows = spark.createDataFrame([("a", "b"), ("", "B"), ("b", "B"), (None, None)], "x string, y string")
    said = rows.select("x", "y", evidence.first_by_rank([("one", F.reverse("x")), ("two", F.reverse("y"))]).alias("s"))
    assert [(r["s"]["first"] and r["s"]["first"]["source"], [o["value"] for o in r["s"]["others"]]) for r in said.collect()] == [("one", ["b"]), ("two", []), ("one", []), (None, [])]
    assert said._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 2
    known = spark.createDataFrame([(f"Team {i}", [], [], i) for i in range(9)], "department_name string, aliases array<string>, sender_domains array<string>, ordinal int")
    sent = evidence.document_evidence(spark.createDataFrame([("d", "team 3 and team 5 <x@y.z>")], "document_id string, sender string"), evidence.Masters(departments=known))
    assert [(r["hint"], r["hint_source"]) for r in sent.collect()] == [("Team 3", "sender")]
    assert sent._jdf.queryExecution().optimizedPlan().toString().count("contains(") < 9
