"""Messages with several parts: from landed JSON to facts, skipped parts and outcomes."""

from __future__ import annotations

import base64
import json
import shutil

import pytest
from pyspark.sql import functions as F

from workpulse.operators import parts
from workpulse.plans import registry
from workpulse.sources import grids
from workpulse.sources.mail import read_messages
from workpulse.streaming.store import Store

from .test_sources import workbook

HEAD = "Date,Employee,Task,Status\n"
SHEET = "https://docs.google.com/spreadsheets/d/"
SHARED, CLOSED = "S" * 30, "C" * 30


def message(key, text="", attachments=(), html=None):
    encoded = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    held = [{"mimeType": kind, "filename": name, "body": {"attachmentId": str(i), "size": size}} for i, (name, kind, size) in enumerate(attachments)]
    payload = {"mimeType": "multipart/mixed", "headers": [{"name": "Subject", "value": f"About {key}"}, {"name": "From", "value": "Ann <ann@x.example>"}], "parts": [{"mimeType": "text/plain", "body": {"data": encoded(text)}}, *held]}
    if html:
        payload["parts"].append({"mimeType": "text/html", "body": {"data": encoded(html)}})
    return json.dumps({"id": key, "threadId": f"t-{key}", "internalDate": "1773100800000", "payload": payload})


PIPED = "Date | Employee | Task | Status\n2026-03-09 | Ann Lee | {} | done"
MESSAGES = [
    message("body", PIPED.format("called the suppliers") + f"\n\nalso {SHEET}{SHARED}/edit#gid=0", html="<p>Dear all</p>"),
    message("files", "see files", [("work.csv", "text/csv", 90), ("book.xlsx", "", 90), ("prices.csv", "text/csv", 90), ("gone.csv", "text/csv", 9), ("empty.csv", "text/csv", 0), ("huge.csv", "text/csv", 1 << 30), ("logo.png", "image/png", 90)]),
    message("sheets", f"my work: {SHEET}{SHARED}/edit#gid=0 and {SHEET}{CLOSED}"),
    message("closed", f"my work: {SHEET}{CLOSED}"),
    message("scan", "enclosed", [("scan.pdf", "application/pdf", 900)]),
    message("shot", "enclosed", [("shot.png", "image/png", 90_000), ("other.png", "image/png", 90_000)]),
    message("odd", "enclosed", [("prices.csv", "text/csv", 90)]),
    message("news", "nothing of note"),
    message("wrong", PIPED.replace("done", "odd").format("called at random")),
    "no json",
]
PRICES = b"Item,Price,Amount\nbolt,3,4\nnut,5,6\n"


@pytest.fixture(scope="module")
def landed(spark):
    files = [
        ("files", "0", (HEAD + '2026-03-09,Bob Ray,"filed, and sorted, the claims",WIP\n').encode("utf-16")), ("files", "1", workbook()), ("files", "2", PRICES), ("files", "4", b""), ("odd", "0", PRICES),
    ]
    sheets = [(SHARED, "0", "OK", (HEAD + "2026-03-09,Cy Dow,wrote the minutes,done\n").encode()), (CLOSED, "", "NOT_SHARED", None)]
    cell = lambda s: {"text": s, "confidence": 0.99}
    row = [cell(s) for s in ("2026-03-09", "Dee Poe", "packed the parcels", "done")]
    drawn = [("shot", "0", 1, 4, ["Date", "Employee", "Task", "Status"], [row]), ("shot", "1", 2, 4, ["Date", "Employee", "Task", "Status"], [row])]
    return (
        spark.createDataFrame(files, "message_id string, attachment_id string, content binary"), spark.createDataFrame(sheets, "sheet_id string, gid string, status string, content binary"),
        spark.createDataFrame(drawn, "message_id string, attachment_id string, declared_rows int, declared_columns int, headers array<string>, rows array<array<struct<text:string,confidence:double>>>"),
    )


SKIPPED = {
    ("files", "prices.csv", "ATTACHMENT_NOT_A_REPORT"), ("files", "gone.csv", "ATTACHMENT_FAILED"), ("files", "empty.csv", "ATTACHMENT_UNREADABLE"), ("files", "huge.csv", "ATTACHMENT_TOO_LARGE"),
    ("closed", "Google Sheet CCCCCCCCCCCC…", "GOOGLE_SHEET_ACCESS_REQUIRED"), ("sheets", "Google Sheet CCCCCCCCCCCC…", "GOOGLE_SHEET_ACCESS_REQUIRED"), ("scan", "scan.pdf", "ATTACHMENT_FORMAT_UNSUPPORTED"),
    ("shot", "other.png", "IMAGE_REVIEW_REQUIRED"), ("odd", "prices.csv", "ATTACHMENT_NOT_A_REPORT"),
}
CLASSES = {
    ("body", 1, 1, "DEPARTMENTAL_REPORT"), ("files", 2, 2, "DEPARTMENTAL_REPORT"), ("sheets", 1, 1, "DEPARTMENTAL_REPORT"), ("closed", 0, 0, "REVIEW_REQUIRED"), ("scan", 0, 0, "UNSUPPORTED_FORMAT"),
    ("shot", 1, 1, "DEPARTMENTAL_REPORT"), ("odd", 0, 0, "NON_REPORT"), ("news", 0, 0, "NON_REPORT"), ("wrong", 1, 0, "REVIEW_REQUIRED"),
}


def test_messages_to_facts_and_outcomes(spark, tmp_path, landed):
    files, sheets, drawn = landed
    raw = spark.createDataFrame([(m,) for m in MESSAGES], "value string")
    pasted = spark.createDataFrame([("Date | Task | Status\n2026-03-09 | swept the floor | done", None, "Eve Fox", None)], "content string, subject string, employee string, date string")
    store = Store(spark, str(tmp_path))
    units = parts.message_parts(read_messages(raw), files, sheets, drawn, pasted, store.config)
    store.stage(units, 0, drawn)
    preview = sorted(map(str, store.message_preview(0).collect()))
    store.commit(0)
    assert preview == sorted(map(str, store.messages().drop("batch").collect()))
    facts = {(r["document_id"].split(":", 1)[-1], r["employee_name"], r["task"]) for r in store.facts().where("document_id like 'gmail%'").collect()}
    assert facts == {
        ("body", "Ann Lee", "called the suppliers"), ("files:work.csv", "Bob Ray", "filed, and sorted, the claims"), ("files:book.xlsx", "Ann Lee", "Filed claims"), (f"sheets:sheet:{SHARED}:0", "Cy Dow", "wrote the minutes"), ("shot:shot.png", "Dee Poe", "packed the parcels"),
    }
    assert [(r["employee_name"], r["task"]) for r in store.facts().where("document_id like 'PASTE%'").collect()] == [("Eve Fox", "swept the floor")]
    skipped = store.skipped().collect()
    assert {(r["report_id"][3:], r["document_id"].split(":", 2)[2], r["rejection_reason"]) for r in skipped} == SKIPPED and len(skipped) == len(SKIPPED)
    assert sorted(r["row_index"] for r in skipped if r["report_id"] == "GM-files") == [0, 1, 2, 3]
    assert "differ from what was declared" in next(r["rejection_detail"] for r in skipped if r["report_id"] == "GM-shot")
    found = {(r["message_id"], r["documents"], r["inserted"], r["classification"]): r for r in store.messages().collect()}
    assert set(found) == CLASSES
    told = {k[0]: r["evidence"] for k, r in found.items()}
    assert told["body"] is None and "prices.csv" in told["odd"] and told["news"] and "scan.pdf" in told["scan"]
    # the sheet that a report cites is no document, and no part without a reason is one
    assert store.outcomes().where("document_id like '%body%'").count() == 1
    assert store.rejected().select("document_id", "reason").collect() == [("gmail:wrong", "UNKNOWN_STATUS")]


def test_streamed_messages_equal_one_batch(spark, tmp_path, landed):
    files, sheets, _ = landed
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(0, len(MESSAGES), 5):
        (folder / f"{i:03}.json").write_text("\n".join(MESSAGES[i : i + 5]))
    rows = lambda store: sorted(tuple(r) for r in store.messages().drop("batch").collect())
    whole, bits = Store(spark, str(tmp_path / "whole")), Store(spark, str(tmp_path / "bits"))
    whole.ingest(parts.message_parts(read_messages(spark.read.text(str(folder))), files, sheets), 0)
    bits.stream(bits.landed_messages(str(folder), 1), lambda raw: parts.message_parts(read_messages(raw), files, sheets)).awaitTermination()
    assert bits.runs().count() == 2 and rows(bits) == rows(whole)
    names = lambda store: sorted(tuple(r) for r in store.facts().select("document_id", "fingerprint").collect())
    assert names(bits) == names(whole) and len(names(whole)) == 4
    # sent again, a message gives no rows twice, and is a report still
    whole.ingest(parts.message_parts(read_messages(spark.createDataFrame([(MESSAGES[1],)], "value string")), files, sheets), 1)
    again = whole.messages().where("batch = 1").first()
    assert (again["inserted"], again["skipped"], again["classification"]) == (0, 2, "DEPARTMENTAL_REPORT") and len(names(whole)) == 4


def test_files_of_odd_content(spark):
    rows = spark.createDataFrame([("zip", b"PK no workbook"), ("zero", b"a,b\0c"), ("latin", "Date,Täsk\n1,2".encode("latin-1")), ("none", None), ("empty", b"")], "document_id string, content binary")
    found = {r["document_id"]: r["cells"][1]["text"] for r in grids.read_grids(rows, failures=True).where("row_index = 0").collect()}
    assert found == {"latin": "Täsk"}
    nothing = parts.message_parts(read_messages(spark.createDataFrame([], "value string")))
    cells = parts.part_grids(nothing)
    maps = spark.createDataFrame([], "document_id string, table_index int, header_row int, partial boolean")
    judged = parts.judged_parts(nothing, cells, maps)
    assert (cells.count(), judged.count(), parts.skipped_parts(judged).count()) == (0, 0, 0)
    counted = spark.createDataFrame([], "document_id string, inserted long, skipped long, rejected long")
    assert parts.message_rollup(judged.withColumn("extra", F.lit(1)), counted).count() == 0


def test_facts_and_messages_are_read_once(spark, small, tmp_path, monkeypatch):
    """Bodies, attachments and links come from messages that were gathered and parsed before."""

    class Given(Exception):
        pass

    def given(messages, *others):
        raise Given(messages, *others)

    monkeypatch.setattr(parts, "message_parts", given)
    with pytest.raises(Given) as found:
        registry.QUERIES["message_facts"](spark, shutil.copytree(small, str(tmp_path / "tables")))
    for rows in found.value.args:
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "Aggregate" not in plan and "Join" not in plan
