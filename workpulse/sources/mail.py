"""Messages and pasted documents as they land: parts, attachments and links.

Fetching them from a mailbox is outside the engine; it reads what was landed as JSON, one message a row.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import clean_whitespace, sender_address, sender_domain, short_hash

# Endings of names of attachments by what they hold, and the size from which a picture may be of a report.
SPREADSHEETS = (".xlsx", ".xlsm", ".xls")
TEXT_TABLES = (".csv", ".tsv", ".txt")
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".heic")
UNREADABLE = (".pdf", ".doc", ".docx", ".ods", ".numbers")
REPORT_IMAGE_BYTES = 40_000

MESSAGE_SQL = "message_id string, thread_id string, subject string, sender string, received_at timestamp, html string, text string, labels array<string>, header_names array<string>, attachments array<struct<filename:string,mime_type:string,attachment_id:string,size:long>>"
_ATTACHMENT = pa.struct([("filename", pa.string()), ("mime_type", pa.string()), ("attachment_id", pa.string()), ("size", pa.int64())])
_MESSAGE = pa.schema([
    ("message_id", pa.string()), ("thread_id", pa.string()), ("subject", pa.string()), ("sender", pa.string()), ("received_at", pa.timestamp("us", tz="UTC")), ("html", pa.string()), ("text", pa.string()),
    ("labels", pa.list_(pa.string())), ("header_names", pa.list_(pa.string())), ("attachments", pa.list_(_ATTACHMENT)),
])


def body_of(data: str) -> str:
    padded = data + "=" * (-len(data) % 4)
    return base64.urlsafe_b64decode(padded.replace("+", "-").replace("/", "_")).decode("utf-8", "replace")


def message_row(raw: str | None) -> dict | None:
    """A landed message as a row: bodies of all its parts, whatever their depth, and its attachments; None if it is no
    message."""
    try:
        message = json.loads(raw or "")
        waiting = [message["payload"]]
        headers = message["payload"].get("headers") or []
        key, stamp = message["id"], int(message.get("internalDate") or 0) * 1000
    except (ValueError, KeyError, TypeError):
        return None
    bodies: dict[str, list[str]] = {"text/html": [], "text/plain": []}
    attachments = []
    while waiting:
        part = waiting.pop(0)
        kind, body, name = (part.get("mimeType") or "").lower(), part.get("body") or {}, part.get("filename") or ""
        if name and body.get("attachmentId"):
            attachments.append({"filename": name, "mime_type": kind, "attachment_id": body["attachmentId"], "size": body.get("size") or 0})
        elif kind in bodies and body.get("data"):
            bodies[kind].append(body_of(body["data"]))
        waiting[:0] = part.get("parts") or []
    named = {h["name"].lower(): h["value"] for h in reversed(headers)}
    return {
        "message_id": key, "thread_id": message.get("threadId"), "subject": named.get("subject", ""), "sender": named.get("from", ""), "received_at": stamp,
        "html": "\n".join(bodies["text/html"]), "text": "\n".join(bodies["text/plain"]), "labels": message.get("labelIds") or [], "header_names": [h["name"] for h in headers], "attachments": attachments,
    }


def read_messages(landed: DataFrame, column: str = "value") -> DataFrame:
    """Rows of messages from landed JSON, a message a row; what is no message gives none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in map(message_row, batch.column(0).to_pylist()) if r]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _MESSAGE], schema=_MESSAGE)

    return landed.select(column).mapInArrow(read, MESSAGE_SQL)


def _ends(name: Column, endings: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    found = F.lit(False)
    for e in endings:
        found = found | low.endswith(e)
    return found


def attachment_kind(name: Column, mime: Column, size: Column) -> Column:
    """``workbook``, ``text table``, ``unreadable`` (may be the report, can't be read), ``picture`` (may be of a report),
    or null for what is neither."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    old = _ends(name, (".xls",))
    return (
        F.when((_ends(name, SPREADSHEETS) | kind.rlike("spreadsheetml|ms-excel")) & ~old, "workbook")
        .when(_ends(name, TEXT_TABLES) | kind.rlike("text/csv|text/tab-separated"), "text table")
        .when(_ends(name, UNREADABLE) | old | kind.contains("pdf") | kind.contains("wordprocessing"), "unreadable")
        .when((kind.startswith("image/") | _ends(name, IMAGES)) & (size >= REPORT_IMAGE_BYTES), "picture")
    )


def sheet_links(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """(key, sheet_id, gid, place): the different sheets that a message's bodies link to, in order, and where to get each."""
    hay = F.concat_ws("\n", F.coalesce("html", F.lit("")), F.coalesce("text", F.lit("")))
    whole = F.regexp_extract_all(hay, F.lit(r"docs\.google\.com/spreadsheets/(?:u/\d+/)?d/[A-Za-z0-9_-]{20,}[^\s\"'<>]*"), F.lit(0))
    rows = messages.select(key, F.posexplode(whole).alias("at", "link"))
    rows = rows.select(key, "at", F.regexp_extract("link", "/d/([A-Za-z0-9_-]+)", 1).alias("sheet_id"), F.regexp_extract("link", r"[#&?]gid=(\d+)", 1).alias("gid"))
    first = rows.groupBy(key, "sheet_id", "gid").agg(F.min("at").alias("place"))
    url = F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), "sheet_id", F.lit("/export?format=csv"), F.when(F.col("gid") != "", F.concat(F.lit("&gid="), "gid")).otherwise(F.lit("")))
    return first.withColumn("export_url", url)


def pasted_documents(pasted: DataFrame, order: str = "DMY", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents of pasted content (content, subject, employee, date): an id made of what was pasted, HTML told from text,
    and what the form states of the author and the day. Columns to ``keep`` go along."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    employee, date = F.substring(clean_whitespace(text("employee")), 1, 80), parse_date(F.col("date"), order)
    stated = F.when((employee != "") | date.isNotNull(), F.concat(F.lit("|"), employee, F.lit("|"), F.coalesce(date.cast("string"), F.lit("")))).otherwise(F.lit(""))
    subject = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("Pasted report"))
    is_html = text("content").rlike(r"(?i)<\s*(table|tr|td|div|p)\b")
    key = F.concat(F.lit("PASTE-"), short_hash(F.concat(subject, F.lit("|"), text("content"), stated), 16))
    return pasted.select(
        *keep, key.alias("document_id"), subject.alias("subject"), F.when(is_html, F.col("content")).alias("html"), F.when(~is_html, F.col("content")).alias("text"),
        F.lit(None).cast("string").alias("attachment_name"), F.nullif(employee, F.lit("")).alias("stated_employee"), date.alias("stated_date"),
    )


def allowed(messages: DataFrame, senders: tuple[str, ...] = (), domains: tuple[str, ...] = (), subjects: tuple[str, ...] = ()) -> DataFrame:
    """Messages of allowed senders and domains whose subject holds one of some words; an empty list allows all."""
    if senders:
        messages = messages.where(sender_address(F.col("sender")).isin(*(s.lower() for s in senders)))
    if domains:
        messages = messages.where(sender_domain(F.col("sender")).isin(*(d.lower().removeprefix("@") for d in domains)))
    if subjects:
        low = F.lower(F.coalesce("subject", F.lit("")))
        messages = messages.where(F.exists(F.array(*map(F.lit, subjects)), lambda w: F.contains(low, F.lower(w))))
    return messages


def searched(messages: DataFrame, since: Column, excluded: tuple[str, ...] = ("CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL")) -> DataFrame:
    """Messages since a day without labels of mass mail; the day reaches the scan as a pushed filter."""
    return messages.where((F.col("received_at") >= since) & ~F.arrays_overlap(F.coalesce("labels", F.array().cast("array<string>")), F.array(*map(F.lit, excluded))))
