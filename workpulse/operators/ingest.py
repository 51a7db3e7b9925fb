"""From grids to facts: headings to fields, rows to raw fields, raw fields to accepted or rejected tasks.

All of it is expressions and windows over grid rows. A table's rows meet only where a window needs them together, and
each table belongs to one document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import duration_hours, duration_in_hours, parse_date, parse_time
from ..functions.text import STATUS_ALIASES, clean_whitespace, keyify, normalize_priority, normalize_status, normalize_task, status_from_answer, status_is_ambiguous, status_means_planned
from ..plans.facts import EngineConfig, once, tasks
from ..sources.grids import read_tables
from . import headers
from .joins import occurrence_fingerprints, route

# A row that begins a field with one of these sums others up.
SUMMARY_WORDS = r"(?i)^[\s\u00a0]*(total|grand total|sum|subtotal|overall|summary|count)\b"
TABLE = ("document_id", "table_index")


@dataclass(frozen=True)
class IngestConfig(EngineConfig):
    min_task_length: int = 3
    header_rows: int = 6
    header_fields: int = 3
    headings: dict[str, tuple[str, ...]] = field(default_factory=lambda: headers.HEADINGS)
    status_aliases: dict[str, str] = field(default_factory=lambda: STATUS_ALIASES)


def header_maps(grids: DataFrame, config: IngestConfig = IngestConfig(), documents: DataFrame | None = None) -> DataFrame:
    """The headings of tables, by ``headers.header_maps`` with the settings of ``config``."""
    return headers.header_maps(grids, config.status_aliases, config.headings, config.header_rows, config.header_fields, config.date_order, stated=documents)


def numbered_rows(grids: DataFrame, config: IngestConfig = IngestConfig(), documents: DataFrame | None = None, maps: DataFrame | None = None) -> DataFrame:
    """Rows under a header as ``raw`` (field to text) with what the table says of all of them, and ``place``: their number
    in the document. Blank rows, sums, and unused lines of a template, which name no work, person or day, are left out.
    ``grids``: rows of ``read_grids``, or tables of ``read_tables``.

    Cells of dashes alone are blank. A link is the target of its cell, else of the first cell that has one. Tables
    without a header give no rows. ``maps``: their ``header_maps``, if they are known already.
    """
    whole = "rows" in grids.columns
    if maps is None and whole:
        # tables that their first line settles are read as they are scanned
        easy, others = headers.headed_tables(grids, config.status_aliases, config.headings, config.header_rows, config.header_fields, config.date_order, stated=documents)
        rows = easy.unionByName(grids.select(*TABLE, "rows").join(others, list(TABLE)))
    else:
        maps = header_maps(grids, config, documents) if maps is None else maps
        rows = grids.join(maps, list(TABLE))
    if "heading_kind" not in rows.columns:  # maps that were written before they had it
        rows = rows.withColumn("heading_kind", headers.work_kind(F.try_element_at("headings", F.lit("task"))))
    if whole:
        rows = rows.select("*", F.posexplode("rows").alias("row_index", "cells")).drop("rows")
    rows = rows.where(F.col("row_index") > F.col("header_row"))
    # judged by the cells themselves, so that the filter doesn't work out all of a row's fields
    cell = lambda f: F.coalesce(F.get("cells", F.try_element_at("fields", F.lit(f)))["text"], F.lit(""))
    blank = r"^[\s\u00a0\-–—.]*$"
    named = F.lit(False)
    for f in ("task", "plannedTask", "employee", "date"):
        named = named | ~cell(f).rlike(blank)
    summed = F.lit(False)
    for f in ("task", "employee", "date", "department", "status"):
        summed = summed | cell(f).rlike(SUMMARY_WORDS)
    rows = rows.where(named & ~summed)
    text = lambda at: F.coalesce(clean_whitespace(F.get("cells", at)["text"]), F.lit(""))
    raw = F.transform_values("fields", lambda _, at: F.when(F.get("cells", at)["text"].rlike(blank), F.lit("")).otherwise(text(at)))
    target = F.nullif(F.get("cells", F.try_element_at("fields", F.lit("link")))["href"], F.lit(""))
    any_target = F.get(F.filter(F.transform("cells", lambda c: c["href"]), lambda h: h != ""), F.lit(0))
    rows = rows.select(*TABLE, "row_index", "headings", "heading_kind", "title_employee", "title_date", "title_department", raw.alias("raw"), F.coalesce(target, any_target).alias("target"))
    rows = rows.withColumn("link", F.coalesce("target", F.try_element_at("raw", F.lit("link")), F.lit(""))).drop("target")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("table_index", "row_index")))


def raw_rows(grids: DataFrame, config: IngestConfig = IngestConfig(), documents: DataFrame | None = None) -> DataFrame:
    """``numbered_rows`` up to the cap on rows of a document; ``rows_over_cap`` counts the others. The queries have no cap
    and read ``numbered_rows``."""
    return numbered_rows(grids, config, documents).where(F.col("place") <= config.max_rows_per_document).drop("place")


def rows_over_cap(grids: DataFrame, config: IngestConfig = IngestConfig(), documents: DataFrame | None = None) -> DataFrame:
    """Documents with more rows than the cap, and how many aren't read, so that none goes unsaid."""
    rows = numbered_rows(grids, config, documents).where(F.col("place") > config.max_rows_per_document)
    return rows.groupBy("document_id").agg(F.count("*").alias("rows_over_cap"))


#: What documents may state of all their rows, beside document_id; what a caller doesn't have is null.
STATED = {"stated_employee": "string", "stated_date": "date", "sender_employee": "string", "inferred_date": "date"}


def validated(raw: DataFrame, documents: DataFrame | None = None, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Each raw row as a task with ``reject_reason``, the first rule that it breaks, or null if it is accepted.

    A row without a day takes the one that its table's title states, or else ``documents`` (document_id and any of
    ``STATED``): on the form, or in the covering text. One without a person takes the form's, the title's or the
    sender, if the table has no column of people at all.
    """
    given = [c for c in STATED if documents is not None and c in documents.columns]
    if given:
        raw = raw.join(documents.select("document_id", *given), "document_id", "left")
    raw = raw.withColumns({c: F.lit(None).cast(kind) for c, kind in STATED.items() if c not in given})
    also = [c for c in ("place",) if c in raw.columns]
    value = lambda f: F.coalesce(F.try_element_at("raw", F.lit(f)), F.lit(""))
    heading = lambda f: F.try_element_at("headings", F.lit(f))
    # each text once, so that what is worked out from it refers to a column rather than repeats the lookup
    texts = raw.select(
        *TABLE, "row_index", "link", "raw", "title_department", *also,
        F.coalesce("title_date", "stated_date", "inferred_date").alias("given_date"), F.coalesce(F.nullif(F.col("stated_employee"), F.lit("")), "title_employee", F.nullif(F.col("sender_employee"), F.lit(""))).alias("given_employee"),
        F.map_contains_key("raw", F.lit("employee")).alias("has_employee"), *(value(f).alias(f"_{f}") for f in ("date", "employee", "department", "task", "plannedTask", "status", "category", "priority", "notes", "startDate", "startTime", "completionDate", "completionTime")),
        heading("status").alias("status_heading"), F.col("heading_kind") if "heading_kind" in raw.columns else headers.work_kind(heading("task")).alias("heading_kind"), duration_in_hours(value("actualDuration"), heading("actualDuration")).alias("reported_hours"),
        duration_in_hours(value("expectedDuration"), heading("expectedDuration")).alias("expected_duration"),
    )
    c = F.col
    named = normalize_status(c("_status"), config.status_aliases)
    texts = texts.withColumn("known_status", F.coalesce(named, status_from_answer(c("_status"), c("status_heading"))))
    planned = c("known_status").isNull() & status_means_planned(c("_status"))
    ambiguous = c("known_status").isNull() & status_is_ambiguous(c("_status"))
    day = lambda f: parse_date(c(f), config.date_order)
    rows = texts.select(
        *TABLE, "row_index", "link", "raw", *also, c("_department").alias("department_text"), "title_department",
        c("_date").alias("date_text"), F.when(c("_date") == "", c("given_date")).otherwise(day("_date")).alias("task_date"),
        F.when(c("_employee") != "", c("_employee")).when(~c("has_employee"), c("given_employee")).alias("employee_name"),
        F.coalesce(F.nullif(c("_department"), F.lit("")), "title_department", F.lit(config.default_department)).alias("department"),
        F.coalesce(F.nullif(c("_task"), F.lit("")), "_plannedTask").alias("task"), c("_status").alias("status_text"),
        F.coalesce("known_status", F.when(planned, "Not Started").when(ambiguous, "Ambiguous")).alias("task_status"),
        F.when(planned, "PLANNED").otherwise(c("heading_kind")).alias("work_kind"),
        F.nullif(c("_category"), F.lit("")).alias("task_category"), normalize_priority(c("_priority")).alias("priority"), "expected_duration", "reported_hours",
        day("_startDate").alias("start_date"), parse_time(c("_startTime")).alias("start_time"), day("_completionDate").alias("completion_date"), parse_time(c("_completionTime")).alias("completion_time"),
        F.concat_ws(" · ", F.when((c("_task") != "") & (c("_plannedTask") != "") & (keyify(c("_task")) != keyify(c("_plannedTask"))), F.concat(F.lit("Planned: "), "_plannedTask")), F.nullif(c("_notes"), F.lit(""))).alias("notes"),
    )
    begun = F.coalesce("start_date", F.when(c("start_time").isNotNull(), c("task_date")))
    ended = F.coalesce("completion_date", F.when(c("completion_time").isNotNull(), c("task_date")))
    rows = rows.withColumn("actual_duration", duration_hours(c("reported_hours"), begun, c("start_time"), ended, c("completion_time"))).drop("reported_hours")
    rows = rows.withColumn("task_normalized", normalize_task(F.col("task")))
    reason = (
        F.when((F.col("date_text") == "") & F.col("task_date").isNull(), "MISSING_REQUIRED_FIELD")
        .when(F.col("task_date").isNull(), "INVALID_DATE")
        .when(F.coalesce("employee_name", F.lit("")) == "", "MISSING_REQUIRED_FIELD")
        .when(F.col("task") == "", "MISSING_REQUIRED_FIELD")
        .when(F.length("task") < config.min_task_length, "TASK_TOO_SHORT")
        .when(F.col("task_normalized") == "", "TASK_NOT_MEANINGFUL")
        .when(F.col("status_text") == "", "MISSING_REQUIRED_FIELD")
        .when(F.col("task_status").isNull(), "UNKNOWN_STATUS")
    )
    return rows.withColumn("reject_reason", reason)


def routed(rows: DataFrame, known: DataFrame, owner: int = 1) -> DataFrame:
    """Validated rows with a fingerprint and a route: ``insert``, ``skip`` (its document again) or ``reject``.

    ``known``: owner_user_id, fingerprint, document_id of the stored facts. A row that is one of several equal ones in
    its document has a fingerprint of its own.
    """
    sound = rows.where("reject_reason is null").withColumn("owner_user_id", F.lit(owner))
    printed = occurrence_fingerprints(sound.withColumn("person", keyify(F.col("employee_name"))), ["task_date", "person", "task_normalized"], ["table_index", "row_index"])
    routes = route(printed.select("owner_user_id", "fingerprint", "document_id"), known)
    return printed.join(routes, ["owner_user_id", "fingerprint", "document_id"])


def report_lines(tasks: DataFrame) -> DataFrame:
    """Facts as lines of reports, one for each person and month, 30 years later since reports before 2000 aren't accepted."""
    rows = tasks.where("task_status != 'Ambiguous'").withColumn("task_date", F.add_months("task_date", 360))
    line = F.concat_ws(" | ", F.col("task_date").cast("string"), "employee_name", "task", F.when(F.col("work_kind") == "PLANNED", "???").otherwise(F.col("task_status")))
    return rows.groupBy(F.concat_ws("/", "employee_name", F.date_format("task_date", "yyyy-MM")).alias("document_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))


def reports_of(tasks: DataFrame) -> DataFrame:
    """``report_lines`` with headings, a sum and a closing line."""
    return report_lines(tasks).select("document_id", F.concat(F.lit("Report\nDate | Employee | Task | Status\n-----|---|---|---\n"), "body", F.lit("\nTotal | | | \n\nRegards")).alias("text"))


def read_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables are written before headings are looked for, so that markup is read once."""
    return once(spark, sf_dir, "report-tables", lambda: read_tables(reports_of(tasks(spark, sf_dir))))


def register_all(register, with_facts, tasks, table) -> None:
    """A round trip over the driver's tables: facts written as reports, read again as grids and validated, all rows of all
    documents however long one is."""
    facts = "SELECT concat(employee_name, '/', strftime(task_date, '%Y-%m')) AS document_id, * FROM (SELECT * REPLACE (CAST(task_date + INTERVAL 30 YEAR AS DATE) AS task_date) FROM tasks WHERE task_status <> 'Ambiguous')"

    @register("ingest_reports", with_facts(f"SELECT document_id, task_date, employee_name, task, CASE WHEN work_kind = 'PLANNED' THEN NULL ELSE task_status END AS task_status, CASE WHEN work_kind = 'PLANNED' THEN 'UNKNOWN_STATUS' END AS reject_reason FROM ({facts})"))
    def _(spark, sf_dir):
        return validated(numbered_rows(read_reports(spark, sf_dir))).select("document_id", "task_date", "employee_name", "task", "task_status", "reject_reason")

    @register("ingest_rejections", with_facts(f"SELECT document_id, 'UNKNOWN_STATUS' AS reject_reason, count(*) AS n FROM ({facts}) WHERE work_kind = 'PLANNED' GROUP BY 1"))
    def _(spark, sf_dir):
        rows = validated(numbered_rows(read_reports(spark, sf_dir)))
        # counted, then filtered: a filter on the reason would go below what rows are made of, and work it out twice
        return rows.groupBy("document_id", "reject_reason").agg(F.count("reject_reason").alias("n")).where("n > 0")
