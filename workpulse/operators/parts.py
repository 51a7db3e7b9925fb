"""The parts of messages as one stream of documents: body, attachments, pictures, linked sheets and what was pasted.

Every branch gives rows of the same columns, so markup, workbooks and delimited files are read by one map and headings are
looked for once. A part is a document, or says why it is none; what became of a message is made of its parts. What was
fetched is landed beside the messages: ``files`` (message_id, attachment_id, content), ``sheets`` (sheet_id, gid, status,
content) and ``transcripts`` (message_id, attachment_id and the columns of ``detection.verified_transcriptions``).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_whitespace
from ..plans.facts import once, written
from ..sources.grids import grid_rows, read_tables
from ..sources.mail import attachment_kind, pasted_documents, read_messages, sheet_links
from . import detection
from .ingest import IngestConfig, header_maps, numbered_rows, report_lines, validated
from .messages import classified

# Bytes of the largest attachment that is read, and characters of a covering text that count as evidence.
MOST_ATTACHMENT_BYTES = 8 * 1024 * 1024
CONTEXT_CHARS = 2000

PART_SQL = (
    "owner_user_id int, message_id string, thread_id string, subject string, sender string, received_at timestamp, context_text string, document_id string, branch string, place int, attachment_name string, "
    "html string, text string, content binary, attachment_id string, reason string, detail string, stated_employee string, stated_date date"
)
MESSAGE = ("owner_user_id", "message_id")


def _part(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with the columns of ``PART_SQL``, null where neither they nor ``columns`` have them."""
    kinds = [c.split() for c in PART_SQL.split(", ")]
    value = lambda name: columns[name] if name in columns else F.col(name) if name in rows.columns else F.lit(None)
    return rows.select(*(value(name).cast(kind).alias(name) for name, kind in kinds))


def message_parts(messages: DataFrame, files: DataFrame | None = None, sheets: DataFrame | None = None, transcripts: DataFrame | None = None, pasted: DataFrame | None = None, config: IngestConfig = IngestConfig(), most_bytes: int = MOST_ATTACHMENT_BYTES) -> DataFrame:
    """Rows of ``PART_SQL``: one for each body, attachment that may hold a report, linked sheet, and pasted document.

    A part that can't become a document already has its reason: a format that isn't read, a picture that nobody
    transcribed or whose transcription fails a check, a file that is too large or wasn't landed, a sheet that isn't
    shared or wasn't landed. A message gives its body's row whatever it holds; logos and the like give none. Files meet
    attachments by message and attachment, and only those that are to be read. Where ``files`` has a received_date, it is
    a key, too, so that folders by day are pruned. A file landed twice gives two parts of the same content.
    """
    rows = messages if "owner_user_id" in messages.columns else messages.withColumn("owner_user_id", F.lit(1))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    covering = clean_whitespace(F.concat_ws(" ", blank("text"), F.regexp_replace(blank("html"), "<[^>]+>", " ")))
    rows = rows.withColumns({"context_text": F.substring(covering, 1, CONTEXT_CHARS), "document_id": F.concat(F.lit("gmail:"), "message_id")})
    body = _part(rows.withColumns({"html": F.nullif(F.col("html"), F.lit("")), "text": F.nullif(F.col("text"), F.lit(""))}), branch=F.lit("body"), place=F.lit(0))

    held = rows.drop("html", "text").select("*", F.posexplode("attachments").alias("place", "a")).select("*", "a.*").drop("a", "attachments")
    held = held.withColumns({"kind": attachment_kind(F.col("filename"), F.col("mime_type"), F.col("size")), "received_date": F.to_date("received_at")}).where("kind is not null")
    name = F.col("filename")
    too_large = F.coalesce(F.col("size"), F.lit(0)) > most_bytes
    reason = F.when(F.col("kind") == "unreadable", "ATTACHMENT_FORMAT_UNSUPPORTED").when(F.col("kind") == "picture", "IMAGE_REVIEW_REQUIRED").when(too_large, "ATTACHMENT_TOO_LARGE")
    detail = (
        F.when(F.col("kind") == "unreadable", F.concat(name, F.lit(": a report in this format isn't read; .xlsx, .csv, a table in the message or a shared sheet are")))
        .when(F.col("kind") == "picture", F.concat(name, F.lit(": may be a picture of a report; nothing was taken from it")))
        .when(too_large, F.concat(name, F.lit(": "), F.round(F.col("size") / 1024).cast("long").cast("string"), F.lit(f" KB, more than the {most_bytes // 1024} KB that are read")))
    )
    held = held.withColumns({"reason": reason, "detail": detail})
    if files is None:
        held = held.withColumn("content", F.lit(None).cast("binary"))
    else:
        keys = [c for c in ("message_id", "attachment_id", "received_date") if c in files.columns]
        asked = files.select(*(F.col(c).alias(f"_{c}") for c in keys), "content")
        held = held.join(asked, functools.reduce(Column.__and__, (F.col(c) == F.col(f"_{c}") for c in keys), F.col("reason").isNull()), "left")
    gone = F.col("reason").isNull() & F.col("content").isNull()
    held = held.withColumns({"detail": F.when(gone, F.concat(name, F.lit(": wasn't landed"))).otherwise(F.col("detail")), "reason": F.when(gone, "ATTACHMENT_FAILED").otherwise(F.col("reason"))})
    if transcripts is not None:
        checked = detection.verified_transcriptions(transcripts, config.status_aliases).select(F.col("message_id").alias("_m"), F.col("attachment_id").alias("_a"), F.coalesce("failed", F.lit("")).alias("failed"))
        held = held.join(checked, (F.col("message_id") == F.col("_m")) & (F.col("attachment_id") == F.col("_a")), "left")
        read = (F.col("kind") == "picture") & (F.col("failed") == "")
        wrong = (F.col("kind") == "picture") & (F.col("failed") != "")
        said = F.when(wrong, F.concat(F.lit("A report was detected in "), name, F.lit(" and not imported: "), F.col("failed"))).when(~F.coalesce(read, F.lit(False)), F.col("detail"))
        held = held.withColumns({"detail": said, "reason": F.when(~F.coalesce(read, F.lit(False)), F.col("reason"))})
    branch = F.when(F.col("kind") == "picture", "picture").otherwise("attachment")
    titled = F.concat(blank("subject"), F.lit(" ["), name, F.lit("]"))
    attachments = _part(held, branch=branch, document_id=F.concat_ws(":", "document_id", name), subject=titled, attachment_name=name)

    links = sheet_links(rows.withColumn("_key", F.struct(*MESSAGE)), "_key").select("_key.*", "sheet_id", "gid", "place")
    if sheets is None:
        links = links.withColumns({"status": F.lit(None).cast("string"), "content": F.lit(None).cast("binary")})
    else:
        links = links.join(sheets.select("sheet_id", F.coalesce("gid", F.lit("")).alias("gid"), "status", "content"), ["sheet_id", "gid"], "left")
    links = links.join(rows.drop("html", "text", "attachments"), list(MESSAGE))
    state = F.coalesce("status", F.lit("FAILED"))
    title = F.concat(F.lit("Google Sheet "), F.substring("sheet_id", 1, 12), F.lit("…"))
    reason = F.when(state == "NOT_SHARED", "GOOGLE_SHEET_ACCESS_REQUIRED").when(state != "OK", F.concat(F.lit("SHEET_"), state)).when(F.coalesce(F.length("content"), F.lit(0)) == 0, "SHEET_EMPTY")
    linked = _part(
        links, branch=F.lit("link"), document_id=F.concat_ws(":", "document_id", F.lit("sheet"), "sheet_id", F.nullif(F.col("gid"), F.lit(""))), attachment_name=title,
        subject=F.concat(blank("subject"), F.lit(" [Google Sheet]")), reason=reason, detail=F.when(reason.isNotNull(), F.concat(title, F.lit(": "), F.lower(state))),
    )
    parts = body.unionByName(attachments).unionByName(linked)
    if pasted is not None:
        owner = F.col("owner_user_id") if "owner_user_id" in pasted.columns else F.lit(1)
        parts = parts.unionByName(_part(pasted_documents(pasted.withColumn("owner_user_id", owner), config.date_order, ("owner_user_id",)), branch=F.lit("paste"), place=F.lit(0)))
    return parts


def part_tables(parts: DataFrame) -> DataFrame:
    """The tables of the parts that have no reason yet, but for pictures, as ``read_tables`` gives them."""
    return read_tables(parts.where("reason is null and coalesce(branch, '') <> 'picture'"), failures=True)


def part_grids(parts: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """Grid rows of the parts that have no reason yet, of all branches in one; a part that can't be read gives a row of
    table -1 that says why. ``parts``: document_id tells them apart."""
    open_parts = parts.where("reason is null")
    grids = grid_rows(part_tables(parts))
    if transcripts is None:
        return grids
    pictures = open_parts.where("branch = 'picture'").select("document_id", "message_id", "attachment_id")
    drawn = detection.transcribed_grids(transcripts.drop("document_id").join(pictures, ["message_id", "attachment_id"])).withColumn("source", F.lit("transcription"))
    return grids.unionByName(drawn.select("document_id", "table_index", "row_index", "source", "cells"))


def judged_parts(parts: DataFrame, grids: DataFrame, maps: DataFrame) -> DataFrame:
    """``parts`` without what they hold, with is_document, reason and detail. ``maps``: ``header_maps`` of the grids.

    A sheet that a message links to counts only where nothing else of the message is a report; otherwise it is no
    document and has no reason. A part of no branch, or a pasted one, is always a document.
    """
    found = detection.detected_reports(grids.where("table_index >= 0"), maps).select("document_id", "is_report", F.col("reason").alias("seen"), "confidence")
    broken = grids.where("table_index < 0").select("document_id", F.col("source").alias("error"))
    rows = parts.drop("html", "text", "content", "context_text").join(found, "document_id", "left").join(broken, "document_id", "left")
    branch = F.coalesce("branch", F.lit("paste"))
    file = F.when(branch == "link", "SHEET").when(branch == "picture", "IMAGE").otherwise("ATTACHMENT")
    late = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("error").isNotNull(), F.concat(file, F.lit("_FAILED")))
        .when(F.col("is_report").isNull(), F.when(branch == "link", "SHEET_EMPTY").otherwise(F.concat(file, F.lit("_UNREADABLE"))))
        .when(~F.col("is_report"), F.concat(file, F.lit("_NOT_A_REPORT")))
    )
    said = F.coalesce("detail", F.concat_ws(": ", "attachment_name", F.coalesce("error", "seen", F.lit("holds no table that can be read"))))
    always = branch == "paste"
    reports = always | F.coalesce(F.col("is_report"), F.lit(False))
    elsewhere = F.max((reports & (branch != "link")).cast("int")).over(Window.partitionBy("owner_user_id", F.coalesce("message_id", "document_id")))
    unused = (branch == "link") & (elsewhere == 1)
    rows = rows.withColumn("unused", unused)
    body = branch == "body"
    silent = always | body | F.col("unused")
    return rows.withColumns({
        "is_document": reports & ~F.col("unused"), "reason": F.when(~silent, late), "detail": F.when(~silent & late.isNotNull(), said).when(body & ~reports, F.coalesce("error", "seen", F.lit("No table found in the message body"))),
    }).drop("is_report", "seen", "error", "unused")


def skipped_parts(parts: DataFrame) -> DataFrame:
    """Judged parts that became no document, each an entry beside the rejected rows; a message's are numbered from 0."""
    place = F.row_number().over(Window.partitionBy(*MESSAGE).orderBy("branch", "place", "document_id")) - 1
    raw = F.to_json(F.struct(F.col("attachment_name").alias("attachment"), "subject", F.col("sender").alias("from")))
    return parts.where("reason is not null").select(
        "owner_user_id", F.concat(F.lit("GM-"), "message_id").alias("report_id"), F.concat(F.lit("gmail:"), "message_id", F.lit(":"), "attachment_name").alias("document_id"), F.lit(0).alias("table_index"), place.cast("int").alias("row_index"),
        F.col("reason").alias("rejection_reason"), F.substring("detail", 1, 500).alias("rejection_detail"), raw.alias("raw_row"),
    )


def message_rollup(parts: DataFrame, counted: DataFrame) -> DataFrame:
    """What became of each message: its parts, documents and rows, a class and the evidence for it.

    ``parts``: judged ones; ``counted``: document_id, inserted, skipped, rejected. A message with documents is a report
    if rows of any were taken, to be reviewed if rows were only rejected, else a possible one; one without is classed by
    the reasons of its parts.
    """
    rows = parts.where("message_id is not null").join(counted, "document_id", "left")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("is_document"), F.col(c))), F.lit(0)).cast("long").alias(c)
    entry = F.when(F.col("reason").isNotNull(), F.struct("branch", "place", "document_id", "reason", "detail"))
    seen = lambda c: F.any_value(c).alias(c)
    found = rows.groupBy(*MESSAGE).agg(
        F.count("*").alias("parts"), F.count_if("is_document").alias("documents"), *(total(c) for c in ("inserted", "skipped", "rejected")), F.array_sort(F.collect_list(entry)).alias("without"),
        F.max(F.when((F.col("branch") == "body") & ~F.col("is_document"), F.col("detail"))).alias("of_body"), *(seen(c) for c in ("thread_id", "sender", "received_at")),
        F.max(F.when(F.col("branch") == "body", F.col("subject"))).alias("subject"),
    )
    reasons, details = F.transform("without", lambda x: x["reason"]), F.transform("without", lambda x: x["detail"])
    none = classified(reasons, details)
    kind = F.when(F.col("inserted") + F.col("skipped") > 0, "DEPARTMENTAL_REPORT").when(F.col("rejected") > 0, "REVIEW_REQUIRED").otherwise("POSSIBLE_REPORT")
    evidence = F.when(F.size("without") > 0, none["evidence"]).otherwise(F.coalesce("of_body", none["evidence"]))
    return found.select(
        *MESSAGE, "thread_id", "subject", "sender", "received_at", "parts", "documents", "inserted", "skipped", "rejected", F.size("without").cast("long").alias("parts_skipped"),
        F.when(F.col("documents") > 0, kind).otherwise(none["classification"]).alias("classification"), F.when(F.col("documents") == 0, evidence).alias("evidence"),
    )


# --- the driver's tables as landed messages ---------------------------------------------------------------------------


def _landed(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Landed messages, files and sheets: reports of facts (``report_lines``) sent in the ways that reports are sent, by
    their month."""
    rows = lines.withColumns({"way": F.substring("document_id", -2, 2).cast("int") % 5, "sheet": F.sha1("document_id")})
    piped = F.concat(F.lit("Date | Employee | Task | Status\n"), "body")
    tabbed = F.encode(F.regexp_replace(piped, r" \| ", "\t"), "UTF-8")
    text = F.when(F.col("way") == 0, piped).when(F.col("way") == 2, F.concat(F.lit("My work: https://docs.google.com/spreadsheets/d/"), "sheet", F.lit("/edit#gid=0"))).otherwise("Please find it attached.")
    plain = F.struct(F.lit("text/plain").alias("mimeType"), F.lit("").alias("filename"), F.struct(F.base64(F.encode(text, "UTF-8")).alias("data"), F.lit(None).cast("string").alias("attachmentId"), F.lit(0).cast("long").alias("size")).alias("body"))
    held = lambda name, kind, size: F.struct(F.lit(kind).alias("mimeType"), F.lit(name).alias("filename"), F.struct(F.lit(None).cast("string").alias("data"), F.lit("1").alias("attachmentId"), F.lit(size).cast("long").alias("size")).alias("body"))
    parts = F.when(F.col("way") == 1, F.array(plain, held("work.tsv", "text/tab-separated-values", 999))).when(F.col("way") == 3, F.array(plain, held("work.pdf", "application/pdf", 999))).when(F.col("way") == 4, F.array(plain, held("work.png", "image/png", 50_000))).otherwise(F.array(plain))
    payload = F.struct(F.lit("multipart/mixed").alias("mimeType"), parts.alias("parts"))
    messages = rows.select(F.to_json(F.struct(F.col("document_id").alias("id"), F.col("document_id").alias("threadId"), F.lit("86400000").alias("internalDate"), payload.alias("payload"))).alias("value"))
    files = rows.where("way = 1").select(F.col("document_id").alias("message_id"), F.lit("1").alias("attachment_id"), tabbed.alias("content"))
    sheets = rows.where("way = 2").select(F.col("sheet").alias("sheet_id"), F.lit("0").alias("gid"), F.lit("OK").alias("status"), tabbed.alias("content"))
    return messages, files, sheets


def register_all(register, with_facts, tasks) -> None:
    """A round trip: facts sent as messages, landed as JSON, and read again to facts and outcomes of messages."""

    def read(spark, sf_dir):
        def parts():
            # facts are gathered once and messages read once, for the body, the attachments and the links alike
            lines = once(spark, sf_dir, "report-lines", lambda: report_lines(tasks(spark, sf_dir)))
            messages, files, sheets = _landed(lines)
            return message_parts(written(read_messages(messages), "messages"), files, sheets)

        kept = once(spark, sf_dir, "message-parts", parts)
        grids = once(spark, sf_dir, "message-tables", lambda: part_tables(kept))
        maps = once(spark, sf_dir, "message-maps", lambda: header_maps(grids.where("table_index >= 0")))
        judged = judged_parts(kept, grids, maps)
        reports = maps.join(judged.where("is_document").select("document_id"), "document_id", "left_semi")
        return judged, validated(numbered_rows(grids, maps=reports))

    sent = "SELECT *, CAST(task_date + INTERVAL 30 YEAR AS DATE) AS day, concat(employee_name, '/', strftime(task_date + INTERVAL 30 YEAR, '%Y-%m')) AS message_id, month(task_date) % 5 AS way FROM tasks WHERE task_status <> 'Ambiguous'"

    @register("message_facts", with_facts(f"SELECT message_id, CASE way WHEN 0 THEN 'body' WHEN 1 THEN 'attachment' ELSE 'link' END AS branch, day AS task_date, employee_name, task, task_status FROM ({sent}) WHERE way < 3 AND work_kind <> 'PLANNED'"))
    def _(spark, sf_dir):
        judged, rows = read(spark, sf_dir)
        return rows.where("reject_reason is null").select("document_id", "task_date", "employee_name", "task", "task_status").join(judged.select("document_id", "message_id", "branch"), "document_id").drop("document_id")

    @register("message_rollup", with_facts(f"""SELECT message_id, CASE WHEN way < 3 THEN 1 ELSE 0 END AS documents, CASE WHEN way < 3 THEN taken ELSE 0 END AS inserted, CASE WHEN way < 3 THEN n - taken ELSE 0 END AS rejected, CASE WHEN way < 3 THEN 0 ELSE 1 END AS parts_skipped,
      CASE way WHEN 3 THEN 'UNSUPPORTED_FORMAT' WHEN 4 THEN 'REVIEW_REQUIRED' ELSE CASE WHEN taken > 0 THEN 'DEPARTMENTAL_REPORT' ELSE 'REVIEW_REQUIRED' END END AS classification
      FROM (SELECT message_id, way, count(*) AS n, count(*) FILTER (WHERE work_kind <> 'PLANNED') AS taken FROM ({sent}) GROUP BY 1, 2)"""))
    def _(spark, sf_dir):
        judged, rows = read(spark, sf_dir)
        counted = rows.groupBy("document_id").agg(F.count_if(F.col("reject_reason").isNull()).alias("inserted"), F.lit(0).cast("long").alias("skipped"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))
        return message_rollup(judged, counted).select("message_id", "documents", "inserted", "rejected", "parts_skipped", "classification")
