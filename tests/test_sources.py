"""Messages, attachments, links, workbooks, staff lists, settings, scoring and transcriptions."""

from __future__ import annotations

import base64
import datetime
import io
import json
import zipfile
from dataclasses import dataclass

from pyspark.sql import functions as F

from workpulse.functions import evidence
from workpulse.functions.text import STATUS_ALIASES
from workpulse.operators import detection, ingest
from workpulse.sources import mail, rosters, workbooks

D = datetime.date


def encoded(text: str) -> str:
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def test_message_parts_of_any_depth(spark):
    deep = {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": encoded("plain ü")}}, {"mimeType": "text/html", "body": {"data": encoded("<p>rich</p>")}}]}
    payload = {"mimeType": "multipart/mixed", "headers": [{"name": "Subject", "value": "EOD"}, {"name": "From", "value": "A <a@x.example>"}], "parts": [deep, {"mimeType": "text/csv", "filename": "r.csv", "body": {"attachmentId": "9", "size": 5}}]}
    rows = mail.read_messages(spark.createDataFrame([(json.dumps({"id": "m1", "threadId": "t", "internalDate": "86400000", "payload": payload}),), ("no json",), (None,)], "value string")).collect()
    assert [(r["message_id"], r["subject"], r["html"], r["text"], r["attachments"][0]["filename"]) for r in rows] == [("m1", "EOD", "<p>rich</p>", "plain ü", "r.csv")]


def test_attachments_links_and_pastes(spark):
    cases = {("a.XLSX", "", 1): "workbook", ("a.xls", "", 1): "unreadable", ("r.csv", "", 1): "text table", ("d.pdf", "", 9): "unreadable", ("s.png", "", 50_000): "picture", ("logo.png", "", 900): None, ("x", "text/csv", 1): "text table"}
    frame = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, name string, mime string, size long")
    assert [r["k"] for r in frame.select("i", mail.attachment_kind(F.col("name"), F.col("mime"), F.col("size")).alias("k")).orderBy("i").collect()] == list(cases.values())
    sheet = "https://docs.google.com/spreadsheets/d/" + "A" * 30
    links = spark.createDataFrame([("m", f'<a href="{sheet}/edit#gid=7">x</a>', f"see {sheet}/edit#gid=7 and {sheet}")], "message_id string, html string, text string")
    assert sorted((r["gid"], r["export_url"]) for r in mail.sheet_links(links).collect()) == [("", f"{sheet}/export?format=csv"), ("7", f"{sheet}/export?format=csv&gid=7")]
    pasted = spark.createDataFrame([("<table><tr><td>x", None, "Ann Lee", "9/3/2026"), ("a | b", "S", None, None)], "content string, subject string, employee string, date string")
    rows = mail.pasted_documents(pasted).collect()
    assert rows[0]["html"] and rows[0]["text"] is None and rows[0]["stated_date"] == D(2026, 3, 9) and rows[0]["document_id"].startswith("PASTE-")
    assert rows[1]["html"] is None and rows[1]["stated_employee"] is None and rows[0]["document_id"] != rows[1]["document_id"]
    inbox = spark.createDataFrame([("A <a@x.example>", "Daily Report", ["INBOX"]), ("b@y.example", "sale", ["CATEGORY_PROMOTIONS"])], "sender string, subject string, labels array<string>")
    assert mail.allowed(inbox, domains=("@x.example",), subjects=("report",)).count() == 1 and mail.allowed(inbox).count() == 2


def workbook() -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="HR" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>Date</t></si><si><r><t>Emp</t></r><r><t>loyee</t></r></si><si><t>Task</t></si><si><t>Status</t></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}" xmlns:r="{rel}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="s"><v>3</v></c></row><row r="2"/>'
        '<row r="3"><c r="A3" s="1"><v>46090</v></c><c r="B3" t="inlineStr"><is><t>Ann Lee</t></is></c><c r="C3" t="str"><f>x</f><v>Filed claims</v></c><c r="D3" t="inlineStr"><is><t>done</t></is></c><c r="F3"><v>5</v></c></row></sheetData>'
        '<hyperlinks><hyperlink ref="C3" r:id="l1"/></hyperlinks></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": '<Relationships><Relationship Id="l1" Target="https://x.example/1"/></Relationships>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{main}"><sheetData/></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbooks(spark):
    files = spark.createDataFrame([("w.xlsx", workbook()), ("bad.xlsx", b"no zip"), ("none", None)], "path string, content binary")
    grid = workbooks.read_workbooks(files)
    rows = grid.orderBy("row_index").collect()
    assert [(r["sheet"], [c["text"] for c in r["cells"]]) for r in rows] == [("HR", ["Date", "Employee", "Task", "Status"]), ("HR", ["2026-03-09", "Ann Lee", "Filed claims", "done", "", "5"])]
    facts = ingest.validated(ingest.raw_rows(grid)).collect()
    assert [(r["task_date"], r["employee_name"], r["task_status"], r["link"]) for r in facts] == [(D(2026, 3, 9), "Ann Lee", "Completed", "https://x.example/1")]


def test_staff_lists_and_settings(spark):
    text = "ACME TEAM LIST 2026\nManager Email,Team,Full Name,Reports to,Email,Also known as\nm@x.example,HR,ann LEE,Mo,ann@x.example,A. Lee and Annie\n,HR,,Mo,,\n,,Bob,,,\n,IT,Cy,,not an address,\n"
    rows = rosters.read_rosters(spark.createDataFrame([("d", text), ("e", None)], "document_id string, text string")).orderBy("row").collect()
    assert [(r["employee_name"], r["department"], r["reason"]) for r in rows] == [("Ann LEE", "HR", None), (None, "HR", None), ("Bob", None, "no department"), ("Cy", "IT", "no valid address")]
    assert rows[0]["aliases"] == ["A. Lee", "Annie"] and rows[0]["manager"] == "Mo" and rows[0]["manager_email"] == "m@x.example"

    @dataclass(frozen=True)
    class Settings:
        days: int = 30
        share: float = 0.5
        strict: bool = True
        senders: tuple[str, ...] = ()
        zone: str = "UTC"

    assert rosters.coerced(Settings(), {"DAYS": "7", "share": "", "strict": "no", "senders": "a, b,", "unknown": "1", "zone": None}) == Settings(7, 0.5, False, ("a", "b"), "")


def test_scores_of_messages(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>"
    schema = "subject string, sender string, text string, html string, header_names array<string>, labels array<string>, attachments array<struct<filename:string,mime_type:string>>, tenant_domains array<string>, roster_keys array<string>, own_address string, thread_produced boolean"
    rows = [("EOD report", "Ann <ann@x.example>", "task task task", html, ["List-Unsubscribe"], ["INBOX"], [("r.xlsx", "")], ["x.example"], ["ann"], "me@x.example", True), ("Sale", "shop@y.example", None, None, ["List-Unsubscribe"], ["CATEGORY_PROMOTIONS"], None, ["x.example"], [], "", False)]
    rules = [
        detection.Rule("spreadsheet", "attachment", r"\.xlsx", 3), detection.Rule("table", "structure", "table>=3x2", 3), detection.Rule("words", "body", "task|status", 1, 2), detection.Rule("subject", "subject", r"\beod\b", 2),
        detection.Rule("promotion", "header", "category_promotions", -4), detection.Rule("list", "header", "list-unsubscribe", -2), detection.Rule("tenant", "sender", "tenant-domain", 2), detection.Rule("thread", "sender", "thread-history", 2),
    ]
    found = detection.scored_messages(spark.createDataFrame(rows, schema), rules).select("score", "band", "signals").collect()
    assert (found[0]["score"], found[0]["band"], found[0]["signals"][:2], len(found[0]["signals"])) == (12, "FORCE", ["spreadsheet (+3)", "table (+3)"], 6)
    assert tuple(found[1])[:2] == (-6, "DROP") and found[1]["signals"][0] == "promotion (-4)"
    assert {r["band"] for r in detection.scored_messages(spark.createDataFrame(rows, schema), []).collect()} == {"FORCE"}


def test_transcriptions(spark):
    cell = lambda t, c=0.9: (t, c)
    good = [[cell("9/3/2026"), cell("Ann Lee"), cell("filed claims"), cell("done")]]
    head = ["Date", "Employee", "Task", "Status"]
    rows = [
        ("ok", 1, 4, head, good), ("rows", 2, 4, head, good), ("columns", 1, 3, head, good), ("uneven", 1, 4, head, [good[0][:3]]), ("unclear", 1, 4, head, [good[0][:3] + [cell("done", 0.5)]]),
        ("status", 1, 4, head, [good[0][:3] + [cell("purple")]]), ("none", 0, 0, [], []), ("banner", 2, 4, ["Daily report", "", "", ""], [[cell(h) for h in head], good[0]]),
    ]
    frame = spark.createDataFrame(rows, "document_id string, declared_rows int, declared_columns int, headers array<string>, rows array<array<struct<text:string,confidence:double>>>")
    found = {r["document_id"]: r["failed"] for r in detection.verified_transcriptions(frame, STATUS_ALIASES).collect()}
    assert found == {
        "ok": None, "rows": "rows differ from what was declared", "columns": "columns differ from what was declared", "uneven": "uneven rows", "unclear": "a cell is unclear", "status": "an unknown status", "none": "no table",
        "banner": None,
    }
    grid = detection.transcribed_grids(frame.where("document_id in ('ok', 'banner')"))
    maps = ingest.header_maps(grid)
    seen = {r["document_id"]: (r["is_report"], r["data_rows"], r["confidence"]) for r in detection.detected_reports(grid, maps).collect()}
    assert seen == {"ok": (True, 1, 0.95), "banner": (True, 1, 0.95)}


def test_stated_days(spark):
    received = datetime.datetime(2026, 3, 10, 9)
    cases = {"report for 9 Mar 2026": D(2026, 3, 9), "Yesterday's update": D(2026, 3, 9), "Today's work below": D(2026, 3, 10), "tomorrow's plan": None, "we met yesterday": None}
    frame = spark.createDataFrame([(i, c, received) for i, c in enumerate(cases)], "i int, body string, at timestamp")
    days = frame.select("i", evidence.report_day(F.col("body"), F.lit(None), F.col("at"))["date"].alias("d"), evidence.looks_planned(F.col("body")).alias("p")).orderBy("i").collect()
    assert [r["d"] for r in days] == list(cases.values()) and [r["p"] for r in days] == [False, False, False, True, False]
    titles = spark.createDataFrame([(0, "DAILY UPDATE — 30 AUGUST 2026"), (1, "Aug. 3, 2026"), (2, "none")], "i int, t string")
    assert [r["d"] for r in titles.select("i", evidence.day_of_title(F.col("t")).alias("d")).orderBy("i").collect()] == [D(2026, 8, 30), D(2026, 8, 3), None]
