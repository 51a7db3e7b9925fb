"""Which messages are worth opening, which of their tables are reports, and which transcriptions can be trusted."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_status, sender_domain, status_is_ambiguous, status_means_planned
from . import headers

DROP_BELOW, FORCE_ABOVE, MOST_SIGNALS = 3, 6, 6
LEAST_CONFIDENCE = 0.75
# What subjects of reports say.
SUBJECT_HINTS = ("daily report", "department report", "eod", "end of day", "work report", "status report", "progress report", "daily update", "dsr", "mis")


@dataclass(frozen=True)
class Rule:
    """A signal of a message: where it looks, for what, and what it weighs. With a cap, every occurrence counts up to it."""

    signal: str
    kind: str  # attachment, structure, body, subject, header, sender
    pattern: str
    weight: int
    cap: int | None = None


def subject_hints(subject: Column) -> Column:
    low = F.lower(F.coalesce(subject, F.lit("")))
    return F.exists(F.array(*map(F.lit, SUBJECT_HINTS)), lambda h: F.contains(low, h))


def has_table(html: Column, rows: int, columns: int) -> Column:
    """Whether a table has so many rows, and so many cells in its first."""
    tables = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<table.*?</table>"), F.lit(0))
    lines = lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr.*?</tr>"), F.lit(0))
    cells = lambda t: F.regexp_count(F.coalesce(F.get(lines(t), F.lit(0)), F.lit("")), F.lit(r"(?i)<t[hd]\b"))
    return F.exists(tables, lambda t: (F.size(lines(t)) >= rows) & (cells(t) >= columns))


def times(rule: Rule) -> Column:
    """How often a rule's signal is in a message: 0 or 1, or the number of its words where the rule has a cap."""
    c = lambda name: F.lower(F.coalesce(F.col(name), F.lit("")))
    once = lambda condition: F.coalesce(condition, F.lit(False)).cast("int")
    pattern = f"(?i)({rule.pattern})"
    words = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
    everything = F.concat_ws("\n", c("subject"), c("text"), F.regexp_replace(c("html"), "<[^>]+>", " "))
    if rule.kind == "attachment":
        return once(F.exists(F.coalesce("attachments", F.array().cast("array<struct<filename:string,mime_type:string>>")), lambda a: F.concat_ws(" ", a["filename"], a["mime_type"]).rlike(pattern)))
    if rule.kind == "structure":
        rows, columns = re.fullmatch(r"table>=(\d+)x(\d+)", rule.pattern).groups()
        return once(has_table(F.col("html"), int(rows), int(columns)))
    if rule.kind == "body":
        if rule.cap is None:
            return once(everything.rlike(pattern))
        return sum((F.regexp_count(everything, F.lit(rf"(?i)\b{re.escape(token)}")) for token in rule.pattern.split("|")), F.lit(0))
    if rule.kind == "subject":
        return once(c("subject").rlike(pattern))
    if rule.kind == "header":
        if rule.pattern.startswith("category_"):
            return once(F.exists(words("labels"), lambda x: F.upper(x) == rule.pattern.upper()))
        return once(F.exists(words("header_names"), lambda x: F.lower(x) == rule.pattern))
    named = {
        "tenant-domain": lambda: F.array_contains(words("tenant_domains"), sender_domain(F.col("sender"))), "self": lambda: F.contains(c("sender"), F.nullif(c("own_address"), F.lit(""))),
        "roster": lambda: F.exists(words("roster_keys"), lambda k: (k != "") & F.contains(c("sender"), k)), "thread-history": lambda: F.col("thread_produced"),
    }
    return once(named[rule.pattern]() if rule.pattern in named else c("sender").rlike(pattern))


def scored_messages(messages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``messages`` with score, band (DROP, CANDIDATE, FORCE) and signals, the strongest first, six at most.

    Without rules nothing is decided, so every message is opened. The rules are settings, some twenty, and become one
    expression: a map over messages, with nothing joined."""
    if not rules:
        return messages.withColumns({"score": F.lit(FORCE_ABOVE + 1), "band": F.lit("FORCE"), "signals": F.array(F.lit("no prefilter rules configured — every message is opened"))})

    def hit(rule: Rule) -> Column:
        delta = times(rule) * rule.weight
        if rule.cap is not None:
            delta = F.least(delta, F.lit(rule.cap)) if rule.weight > 0 else F.greatest(delta, F.lit(rule.cap))
        return F.struct((-F.abs(delta)).alias("order"), F.lit(rules.index(rule)).alias("place"), delta.alias("delta"), F.lit(rule.signal).alias("signal"))

    rows = messages.withColumn("hits", F.filter(F.array(*map(hit, rules)), lambda h: h["delta"] != 0))
    score = F.aggregate("hits", F.lit(0), lambda a, h: a + h["delta"])
    text = F.transform(F.slice(F.array_sort("hits"), 1, MOST_SIGNALS), lambda h: F.concat(h["signal"], F.lit(" ("), F.when(h["delta"] > 0, "+").otherwise(""), h["delta"].cast("string"), F.lit(")")))
    rows = rows.withColumn("score", score)
    band = F.when(F.col("score") > FORCE_ABOVE, "FORCE").when(F.col("score") < DROP_BELOW, "DROP").otherwise("CANDIDATE")
    signals = F.when(F.size("hits") > 0, text).otherwise(F.array(F.lit("nothing in this message resembles a report")))
    return rows.withColumns({"band": band, "signals": signals}).drop("hits")


def detected_reports(grids: DataFrame, maps: DataFrame) -> DataFrame:
    """Per document with a grid: is_report, the first table that maps to a report, its data rows, and a confidence.
    ``maps``: ``header_maps`` of the grids."""
    whole = "rows" in grids.columns  # tables of ``read_tables``, or else rows
    sizes = grids.where(F.size("rows") > 0).select(*headers.TABLE, (F.size("rows") - 1).alias("last")) if whole else grids.groupBy(*headers.TABLE).agg(F.max("row_index").alias("last"))
    rows = sizes.join(maps.select(*headers.TABLE, "header_row", "partial"), list(headers.TABLE), "left").withColumn("data_rows", F.col("last") - F.col("header_row"))
    mapped = F.when(F.col("header_row").isNotNull(), F.col("table_index"))
    found = rows.groupBy("document_id").agg(F.count("*").alias("tables"), F.min(mapped).alias("mapped_table"), F.min_by(F.struct("data_rows", "partial"), mapped).alias("first"))
    n = F.when(F.col("mapped_table").isNotNull(), F.col("first.data_rows"))
    sure = F.when(F.col("mapped_table").isNull(), 0.0).when(F.col("first.partial"), 0.7).otherwise(0.95)
    reason = (
        F.when(n > 0, F.concat(F.lit("Table "), (F.col("mapped_table") + 1).cast("string"), F.lit(" has report columns and "), n.cast("string"), F.lit(" data row(s)")))
        .when(n == 0, F.lit("report headers but no data rows"))
        .otherwise(F.concat(F.col("tables").cast("string"), F.lit(" table(s) found, none with report columns")))
    )
    return found.select("document_id", F.coalesce(n > 0, F.lit(False)).alias("is_report"), "mapped_table", n.alias("data_rows"), sure.alias("confidence"), reason.alias("reason"))


def verified_transcriptions(tables: DataFrame, aliases: dict[str, str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Transcribed tables (document_id, declared_rows, declared_columns, headers, rows of (text, confidence)) with the
    first check that they fail, or null: a table, as many rows and columns as declared, even rows, clear cells, and
    statuses that are known."""
    c = F.col
    cells = F.flatten("rows")
    lowest = F.array_min(F.transform(cells, lambda x: x["confidence"]))
    status_at = F.array_position(F.transform("headers", lambda h: h.rlike("(?i)status|state|progress")), True)
    said = F.transform("rows", lambda r: F.trim(F.coalesce(F.get(r, (status_at - 1).cast("int"))["text"], F.lit(""))))
    known = lambda s: (s == "") | normalize_status(s, aliases).isNotNull() | status_means_planned(s) | status_is_ambiguous(s)
    failed = (
        F.when((F.size("headers") == 0) | (F.size("rows") == 0), "no table")
        .when(c("declared_rows") != F.size("rows"), "rows differ from what was declared")
        .when(c("declared_columns") != F.size("headers"), "columns differ from what was declared")
        .when(F.exists("rows", lambda r: F.size(r) != F.size("headers")), "uneven rows")
        .when(lowest < least, "a cell is unclear")
        .when((status_at > 0) & F.exists(said, lambda s: ~known(s)), "an unknown status")
    )
    return tables.withColumns({"failed": failed, "lowest_confidence": lowest})


def transcribed_grids(tables: DataFrame) -> DataFrame:
    """Grid rows of transcribed tables; a heading that is one cell over several columns is a title, and goes."""
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    banner = (width > 1) & (F.size(F.filter("headers", lambda h: F.trim(h) != "")) <= 1)
    body = F.transform("rows", lambda r: F.transform(r, lambda x: F.struct(x["text"].alias("text"), F.lit("").alias("href"))))
    head = F.transform("headers", lambda h: F.struct(h.alias("text"), F.lit("").alias("href")))
    lines = F.when(banner, body).otherwise(F.concat(F.array(head), body))
    return tables.select("document_id", F.lit(0).alias("table_index"), F.posexplode(lines).alias("row_index", "cells"))


def register_all(register, mailbox, table) -> None:
    rules = [Rule("says report", "subject", "report", 2), Rule("purchase", "body", "purchase", 3), Rule("words", "body", "view|click", 2, 3), Rule("mass mail", "sender", "^u1", -4), Rule("known", "sender", "tenant-domain", 2)]

    @register("message_scores", mailbox.with_mail("""SELECT report_id, score, CASE WHEN score > 6 THEN 'FORCE' WHEN score < 3 THEN 'DROP' ELSE 'CANDIDATE' END AS band FROM (SELECT report_id, CASE WHEN subject IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN subject LIKE '%purchase%' THEN 3 ELSE 0 END
      + CASE WHEN subject LIKE '%view%' OR subject LIKE '%click%' THEN 2 ELSE 0 END + CASE WHEN sender LIKE 'u1%' THEN -4 ELSE 0 END + 2 AS score FROM mail)"""))
    def _(spark, sf_dir):
        rows = mailbox.mail(spark, sf_dir).withColumns({"text": F.lit(None).cast("string"), "html": F.lit(None).cast("string"), "tenant_domains": F.array(F.lit("example.com"))})
        return scored_messages(rows, rules).select("report_id", "score", "band")

    from ..functions.evidence import report_day

    @register("inferred_days", mailbox.with_mail("""SELECT report_id, CASE WHEN received_at IS NULL THEN NULL WHEN n % 3 = 0 THEN DATE '2026-03-09' WHEN n % 3 = 1 THEN received_at::DATE - 1 END AS day FROM (SELECT *, CAST(substr(report_id, 5) AS BIGINT) AS n FROM mail)"""))
    def _(spark, sf_dir):
        rows = mailbox.mail(spark, sf_dir).withColumn("n", F.substring("report_id", 5, 20).cast("long"))
        body = F.when(F.col("n") % 3 == 0, "Dear all, report for 9 Mar 2026 below").when(F.col("n") % 3 == 1, "Yesterday's work:").otherwise("Tomorrow's plan")
        return rows.select("report_id", report_day(body, F.col("subject"), F.col("received_at"))["date"].alias("day"))
