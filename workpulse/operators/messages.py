"""What became of messages: visibility, lists, totals, health and what needs attention.

Tables: ``mail`` (a row for each body, attachment or paste that was read), ``rejections``, ``runs``, ``accounts``. Lists
are cut for each owner by a window, totals are one pass of conditional aggregates; a message's parts meet by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measures import NOT_PLANNED

# How urgent a message's class is in the inbox, and a finding in the list of what needs attention.
CLASS_ORDER = {"DEPARTMENTAL_REPORT": 0, "REVIEW_REQUIRED": 1, "UNSUPPORTED_FORMAT": 2, "POSSIBLE_REPORT": 3}
SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "info": 3}
FAILED_RUNS = ("FAILED", "REAUTH_REQUIRED", "GMAIL_AUTH_ERROR")
REAUTH = ("REAUTH_REQUIRED", "GMAIL_AUTH_ERROR")


def is_report(prefix: str = "") -> Column:
    """Whether a row of ``mail`` is a report that may be shown; never null."""
    c = lambda name: F.col(f"{prefix}{name}")
    text = lambda name: F.coalesce(c(name), F.lit(""))
    return (
        ~text("source").isin("email", "attachment")
        | (F.coalesce(c("tables_found"), F.lit(0)) > 0)
        | (F.coalesce(c("rows_inserted"), F.lit(0)) > 0)
        | ((text("classification") == "REVIEW_REQUIRED") & F.lower(text("evidence")).contains("a report was detected"))
    )


def visible_rejections(rejections: DataFrame, mail: DataFrame) -> DataFrame:
    """Rejected rows of reports; entries about a message only if it was a report, or for pictures to be looked at."""
    direct = F.col("report_id").isNull() | ~F.col("report_id").startswith("GM-") | (F.col("rejection_reason") == "IMAGE_REVIEW_REQUIRED")
    found = mail.where((F.coalesce("tables_found", F.lit(0)) > 0) | (F.coalesce("rows_inserted", F.lit(0)) > 0)).where("message_id is not null")
    keys = found.select("owner_user_id", F.concat(F.lit("GM-"), "message_id").alias("report_id")).distinct()
    return rejections.where(direct).unionByName(rejections.where(~direct).join(keys, ["owner_user_id", "report_id"], "left_semi").select(rejections.columns))


def newest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each owner in an order."""
    place = F.row_number().over(Window.partitionBy("owner_user_id").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def rejection_list(rejections: DataFrame, mail: DataFrame, n: int = 300) -> DataFrame:
    return newest(visible_rejections(rejections, mail), n, F.desc("logged_at"), F.desc("rejection_id"))


def document_list(mail: DataFrame, n: int = 25) -> DataFrame:
    return newest(mail.where(is_report()), n, F.desc("processed_at"), F.desc("report_id"))


def recent_imports(mail: DataFrame, n: int = 8) -> DataFrame:
    return newest(mail.where(is_report() & (F.col("processing_status") != "NO_DATA")), n, F.desc("processed_at"), F.desc("report_id"))


def latest(reports: DataFrame, stamp: str = "generated_at", key: str = "report_id") -> DataFrame:
    """Each owner's newest report."""
    return newest(reports, 1, F.desc(stamp), F.desc(key))


def productive(mail: DataFrame) -> DataFrame:
    return mail.where("rows_inserted > 0 and message_id is not null")


def message_outcomes(mail: DataFrame, n: int = 50) -> DataFrame:
    """Messages that are reports of a kind but gave no facts, in none of their parts."""
    rows = mail.where(is_report() & (F.coalesce("classification", F.lit("NON_REPORT")) != "DEPARTMENTAL_REPORT"))
    rows = rows.join(productive(mail).select("owner_user_id", "message_id").distinct(), ["owner_user_id", "message_id"], "left_anti")
    return newest(rows.select(mail.columns), n, F.desc_nulls_last("received_at"), F.desc("processed_at"), F.desc("report_id"))


def inbox(mail: DataFrame, n: int = 15) -> DataFrame:
    """Reports but those that another part of their message stands for; unfinished business first.

    Another part is known by a count and a name, so that a message's parts aren't paired with each other."""
    parts = productive(mail).groupBy("owner_user_id", "message_id").agg(F.countDistinct("report_id").alias("parts"), F.min("report_id").alias("part"))
    rows = mail.where(is_report()).join(parts, ["owner_user_id", "message_id"], "left")
    other = (F.col("parts") > 1) | (F.col("part") != F.col("report_id"))
    rank = F.coalesce(*(F.when(F.col("classification") == k, v) for k, v in CLASS_ORDER.items()), F.lit(4))
    rows = rows.where(~F.coalesce(other, F.lit(False))).withColumn("rank", rank)
    return newest(rows, n, "rank", F.desc_nulls_last("received_at"), F.desc("processed_at"), F.desc("report_id")).select(*mail.columns, "rank")


def other_messages(mail: DataFrame) -> DataFrame:
    """Per owner: how many messages are no reports in any part, and how many of these could not be read."""
    reports = mail.where(is_report() & F.col("message_id").isNotNull()).select("owner_user_id", "message_id").distinct()
    rows = mail.where(F.col("source").isin("email", "attachment") & ~is_report()).join(reports, ["owner_user_id", "message_id"], "left_anti")
    key = F.coalesce("message_id", "report_id")
    unread = F.col("classification").isin("REVIEW_REQUIRED", "UNSUPPORTED_FORMAT")
    return rows.groupBy("owner_user_id").agg(F.countDistinct(key).alias("total"), F.countDistinct(F.when(unread, key)).alias("unreadable"))


def coverage(mail: DataFrame) -> DataFrame:
    """Per owner: what was scanned, detected, processed, left for review, ignored and imported."""
    no_data, kind = F.col("processing_status") == "NO_DATA", F.col("classification")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return mail.groupBy("owner_user_id").agg(
        F.count("*").alias("scanned"), F.count_if(~no_data).alias("detected"), F.count_if(F.col("rows_inserted") > 0).alias("processed"),
        F.count_if((kind == "REVIEW_REQUIRED") | (~no_data & (F.col("rows_inserted") == 0))).alias("review"),
        F.count_if((kind == "NON_REPORT") | (kind.isNull() & no_data)).alias("ignored"), F.count_if(kind == "UNSUPPORTED_FORMAT").alias("unsupported"),
        total("rows_extracted").alias("extracted"), total("rows_inserted").alias("imported"), total("rows_rejected").alias("rejected"), total("rows_skipped").alias("duplicates"),
    )


def processing_totals(mail: DataFrame) -> DataFrame:
    return mail.groupBy("owner_user_id").agg(F.count_if(F.col("processing_status") != "NO_DATA").alias("reports"), F.count("*").alias("scanned"), F.coalesce(F.sum("rows_inserted"), F.lit(0)).cast("bigint").alias("imported"))


def bi_messages(mail: DataFrame) -> DataFrame:
    """Reports for other tools, without nulls where a name is meant."""
    return mail.where(is_report()).select(
        "owner_user_id", "report_id", F.coalesce("message_id", "report_id").alias("message"), F.to_date("received_at").alias("received_date"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("department", F.lit("Not identified")).alias("department"), F.coalesce("classification", F.lit("NON_REPORT")).alias("classification"),
        (F.coalesce("rows_inserted", F.lit(0)) > 0).alias("gave_rows"), F.coalesce("rows_inserted", F.lit(0)).alias("rows_inserted"),
    )


def classified(reasons: Column, details: Column) -> Column:
    """(classification, evidence) of a message without facts, from the reasons for which its parts were skipped."""
    has = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    quiet = F.array(*map(F.lit, ("ATTACHMENT_NOT_A_REPORT", "SHEET_NOT_A_REPORT", "SHEET_EMPTY")))
    kind = (
        F.when(has("IMAGE_REVIEW_REQUIRED"), "REVIEW_REQUIRED")
        .when(has("GOOGLE_SHEET_ACCESS_REQUIRED", "SHEET_FAILED"), "REVIEW_REQUIRED")
        .when(has("ATTACHMENT_FORMAT_UNSUPPORTED"), "UNSUPPORTED_FORMAT")
        .when(F.size(F.array_except(reasons, quiet)) > 0, "REVIEW_REQUIRED")
        .otherwise("NON_REPORT")
    )
    evidence = F.when(F.size(reasons) > 0, F.substring(F.array_join(details, "; "), 1, 500)).otherwise(F.lit("No table found in the message body"))
    return F.struct(kind.alias("classification"), evidence.alias("evidence"))


def unread_words(notes: DataFrame, column: str, most: int = 8) -> DataFrame:
    """Per owner: the first ``most`` different status words, quoted in notes, that weren't understood."""
    word = F.regexp_extract(column, 'Unrecognised status "([^"]*)"', 1)
    rows = notes.select("owner_user_id", word.alias("word")).where("word != ''").distinct()
    return newest(rows, most, "word")


def attention(tasks: DataFrame, mail: DataFrame, rejections: DataFrame, runs: DataFrame, accounts: DataFrame, groups: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """(owner_user_id, severity, finding, count): what management should look at, most urgent first. One aggregate for
    each table; ``tasks`` has slow_task_flag, ``groups`` classification."""
    owner = "owner_user_id"
    work = tasks.where(NOT_PLANNED)
    status, slow = F.col("task_status"), F.col("slow_task_flag")
    of_tasks = tasks.groupBy(owner).agg(F.count_if(status == "Ambiguous").alias("ambiguous"))
    of_work = work.groupBy(owner).agg(
        F.count_if(status == "Blocked").alias("blocked"), F.count_if(slow == "TRUE").alias("slow"),
        F.count_if((slow == "INSUFFICIENT_DATA") & F.col("actual_duration").isNull()).alias("no_duration"),
        F.count_if(F.coalesce("department", F.lit("")).isin("", "Unassigned")).alias("unattributed"),
    )
    shown = mail.where(is_report()).groupBy(owner).agg(F.count_if(F.col("classification") == "REVIEW_REQUIRED").alias("review"), F.count_if(F.col("classification") == "UNSUPPORTED_FORMAT").alias("unsupported"))
    open_rows = visible_rejections(rejections, mail).groupBy(owner).agg(F.count_if(F.col("resolution_status") == "Open").alias("open_rows"))
    failures = runs.groupBy(owner).agg(F.count_if(F.col("status").isin(*FAILED_RUNS) & (F.col("started_at") > now - F.expr(f"INTERVAL {days} DAYS"))).alias("failures"))
    reauth = accounts.groupBy(owner).agg(F.count_if(F.col("active") & F.col("last_sync_status").isin(*REAUTH)).alias("reauth"))
    repeats = groups.groupBy(owner).agg(F.count_if(F.col("classification").isin("Needs Review", "Potential Duplication")).alias("repeats"))
    every = of_tasks
    for part in (of_work, shown, open_rows, failures, reauth, repeats):
        every = every.join(part, owner, "left")
    findings = (
        ("critical", "reauth", None), ("high", "failures", "reauth"), ("high", "review", None), ("high", "blocked", None), ("medium", "ambiguous", None), ("medium", "open_rows", None),
        ("medium", "repeats", None), ("medium", "slow", None), ("info", "unsupported", None), ("info", "unattributed", None), ("info", "no_duration", None),
    )
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    items = F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(name).alias("finding"), F.when(count(hides) > 0, 0).otherwise(count(name)).cast("bigint").alias("count") if hides else count(name).cast("bigint").alias("count")) for s, name, hides in findings))
    rows = every.select(owner, F.explode(F.filter(items, lambda x: x["count"] > 0)).alias("item")).select(owner, "item.*")
    rank = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in SEVERITY_ORDER.items()))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(rank, F.desc("count"), "finding")).cast("int"))


def run_history(runs: DataFrame, accounts: DataFrame, n: int = 20) -> DataFrame:
    """Each owner's newest runs with the account's address, if it is known."""
    named = runs.join(accounts.select("owner_user_id", "account_id", "address"), ["owner_user_id", "account_id"], "left")
    return newest(named, n, F.desc("started_at"), F.desc("run_id"))


def sync_health(runs: DataFrame, n: int = 20) -> DataFrame:
    """Per owner: last good run, runs and sums over the newest ``n``, the newest failure's place and the good runs since."""
    last_ok = runs.groupBy("owner_user_id").agg(F.max(F.when(F.col("status") == "OK", F.col("started_at"))).alias("last_ok"), F.count("*").alias("runs"))
    place = F.row_number().over(Window.partitionBy("owner_user_id").orderBy(F.desc("started_at"), F.desc("run_id")))
    recent = runs.withColumn("place", place).where(F.col("place") <= n)
    fail = F.min(F.when(F.col("status") != "OK", F.col("place")))
    totals = recent.groupBy("owner_user_id").agg(F.sum("messages_scanned").alias("scanned"), F.sum("reports_found").alias("found"), F.coalesce(fail, F.lit(n + 1)).alias("first_failure"), F.count("*").alias("shown"))
    since = F.least(F.col("first_failure") - 1, F.col("shown")).cast("bigint").alias("good_since")
    return last_ok.join(totals, "owner_user_id").select("owner_user_id", "last_ok", "runs", "scanned", "found", F.col("first_failure").cast("bigint").alias("first_failure"), since)


def summarised_error(message: Column) -> Column:
    """The different parts of an error message, in order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(message, ";"), lambda x: F.trim(x)), lambda x: x != "")), "; ")


def fresh_messages(found: DataFrame, mail: DataFrame, detector: int) -> DataFrame:
    """Found messages (owner_user_id, message_id) that aren't final: a message is final if it gave data or was judged
    by the current detector."""
    final = mail.where((F.col("processing_status") != "NO_DATA") | (F.coalesce("detector_version", F.lit(0)) >= detector)).where("message_id is not null")
    return found.join(final.select("owner_user_id", "message_id").distinct(), ["owner_user_id", "message_id"], "left_anti")


def productive_threads(mail: DataFrame) -> DataFrame:
    return productive(mail).select("owner_user_id", F.col("message_id").alias("thread")).distinct()


def register_all(register, mailbox, with_flags, flagged, groups_of) -> None:
    report = """(coalesce({0}source, '') NOT IN ('email', 'attachment') OR coalesce({0}tables_found, 0) > 0 OR coalesce({0}rows_inserted, 0) > 0
      OR (coalesce({0}classification, '') = 'REVIEW_REQUIRED' AND coalesce({0}evidence, '') ILIKE '%a report was detected%'))"""
    shown = report.format("")
    visible = """(q.report_id IS NULL OR q.report_id NOT LIKE 'GM-%' OR q.rejection_reason = 'IMAGE_REVIEW_REQUIRED' OR EXISTS (SELECT 1 FROM mail s WHERE s.owner_user_id = q.owner_user_id AND s.message_id IS NOT NULL
      AND q.report_id = 'GM-' || s.message_id AND (coalesce(s.tables_found, 0) > 0 OR coalesce(s.rows_inserted, 0) > 0)))"""
    top = lambda order, n: f"QUALIFY row_number() OVER (PARTITION BY owner_user_id ORDER BY {order}) <= {n}"
    made = mailbox.with_mail
    lists = {
        "rejection_list": (lambda s, d: rejection_list(mailbox.rejections(s, d), mailbox.mail(s, d)), f"SELECT * FROM rejections q WHERE {visible} {top('logged_at DESC, rejection_id DESC', 300)}"),
        "document_list": (lambda s, d: document_list(mailbox.mail(s, d)), f"SELECT * FROM mail WHERE {shown} {top('processed_at DESC, report_id DESC', 25)}"),
        "recent_imports": (lambda s, d: recent_imports(mailbox.mail(s, d)), f"SELECT * FROM mail WHERE {shown} AND processing_status <> 'NO_DATA' {top('processed_at DESC, report_id DESC', 8)}"),
        "latest_report": (lambda s, d: latest(mailbox.mail(s, d), "processed_at"), f"SELECT * FROM mail {top('processed_at DESC, report_id DESC', 1)}"),
        "message_outcomes": (lambda s, d: message_outcomes(mailbox.mail(s, d)), f"""SELECT * FROM mail d WHERE {shown} AND coalesce(classification, 'NON_REPORT') <> 'DEPARTMENTAL_REPORT' AND NOT EXISTS (SELECT 1 FROM mail s WHERE s.owner_user_id = d.owner_user_id
          AND s.message_id = d.message_id AND s.rows_inserted > 0) {top('received_at DESC NULLS LAST, processed_at DESC, report_id DESC', 50)}"""),
        "inbox_messages": (lambda s, d: inbox(mailbox.mail(s, d)), f"""SELECT *, CASE coalesce(classification, 'NON_REPORT') WHEN 'DEPARTMENTAL_REPORT' THEN 0 WHEN 'REVIEW_REQUIRED' THEN 1 WHEN 'UNSUPPORTED_FORMAT' THEN 2 WHEN 'POSSIBLE_REPORT' THEN 3 ELSE 4 END AS rank
          FROM mail d WHERE {shown} AND NOT EXISTS (SELECT 1 FROM mail s WHERE s.owner_user_id = d.owner_user_id AND s.message_id = d.message_id AND s.rows_inserted > 0 AND s.report_id <> d.report_id)
          {top('rank, received_at DESC NULLS LAST, processed_at DESC, report_id DESC', 15)}"""),
        "other_messages": (lambda s, d: other_messages(mailbox.mail(s, d)), f"""SELECT owner_user_id, count(DISTINCT coalesce(message_id, report_id)) AS total, count(DISTINCT coalesce(message_id, report_id)) FILTER (WHERE classification IN ('REVIEW_REQUIRED', 'UNSUPPORTED_FORMAT')) AS unreadable
          FROM mail d WHERE source IN ('email', 'attachment') AND NOT {shown} AND NOT EXISTS (SELECT 1 FROM mail s WHERE s.owner_user_id = d.owner_user_id AND s.message_id = d.message_id AND {report.format('s.')}) GROUP BY 1"""),
        "coverage": (lambda s, d: coverage(mailbox.mail(s, d)), """SELECT owner_user_id, count(*) AS scanned, count(*) FILTER (WHERE processing_status <> 'NO_DATA') AS detected, count(*) FILTER (WHERE rows_inserted > 0) AS processed,
          count(*) FILTER (WHERE classification = 'REVIEW_REQUIRED' OR (processing_status <> 'NO_DATA' AND rows_inserted = 0)) AS review, count(*) FILTER (WHERE classification = 'NON_REPORT' OR (classification IS NULL AND processing_status = 'NO_DATA')) AS ignored,
          count(*) FILTER (WHERE classification = 'UNSUPPORTED_FORMAT') AS unsupported, coalesce(sum(rows_extracted), 0)::BIGINT AS extracted, coalesce(sum(rows_inserted), 0)::BIGINT AS imported,
          coalesce(sum(rows_rejected), 0)::BIGINT AS rejected, coalesce(sum(rows_skipped), 0)::BIGINT AS duplicates FROM mail GROUP BY 1"""),
        "processing_totals": (lambda s, d: processing_totals(mailbox.mail(s, d)), "SELECT owner_user_id, count(*) FILTER (WHERE processing_status <> 'NO_DATA') AS reports, count(*) AS scanned, coalesce(sum(rows_inserted), 0)::BIGINT AS imported FROM mail GROUP BY 1"),
        "bi_messages": (lambda s, d: bi_messages(mailbox.mail(s, d)), f"""SELECT owner_user_id, report_id, coalesce(message_id, report_id) AS message, received_at::DATE AS received_date, coalesce(source, '') AS source, coalesce(department, 'Not identified') AS department,
          coalesce(classification, 'NON_REPORT') AS classification, coalesce(rows_inserted, 0) > 0 AS gave_rows, coalesce(rows_inserted, 0) AS rows_inserted FROM mail WHERE {shown}"""),
        "unread_words": (lambda s, d: unread_words(mailbox.rejections(s, d), "rejection_detail", 3), f"""SELECT * FROM (SELECT DISTINCT owner_user_id, regexp_extract(rejection_detail, 'Unrecognised status "([^"]*)"', 1) AS word FROM rejections) {top('word', 3)}"""),
        "run_history": (lambda s, d: run_history(mailbox.runs(s, d), mailbox.accounts(s, d)), f"SELECT r.*, a.address FROM runs r LEFT JOIN accounts a ON a.owner_user_id = r.owner_user_id AND a.account_id = r.account_id QUALIFY row_number() OVER (PARTITION BY r.owner_user_id ORDER BY started_at DESC, run_id DESC) <= 20"),
        "sync_health": (lambda s, d: sync_health(mailbox.runs(s, d)), """SELECT o.owner_user_id, o.last_ok, o.runs, p.scanned, p.found, p.first_failure, least(p.first_failure - 1, p.shown) AS good_since FROM (SELECT owner_user_id, max(started_at) FILTER (WHERE status = 'OK') AS last_ok, count(*) AS runs FROM runs GROUP BY 1) o
          JOIN (SELECT owner_user_id, sum(messages_scanned)::BIGINT AS scanned, sum(reports_found)::BIGINT AS found, coalesce(min(place) FILTER (WHERE status <> 'OK'), 21) AS first_failure, count(*) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY owner_user_id ORDER BY started_at DESC, run_id DESC) AS place FROM runs)
          WHERE place <= 20 GROUP BY 1) p ON p.owner_user_id = o.owner_user_id"""),
        "run_errors": (lambda s, d: mailbox.runs(s, d).where("error_message is not null").select("run_id", summarised_error(F.col("error_message")).alias("error")), "SELECT run_id, 'timeout; ' || split_part(error_message, '; ', 2) AS error FROM runs WHERE error_message IS NOT NULL"),
        "fresh_messages": (lambda s, d: fresh_messages(mailbox.mail(s, d).where("message_id is not null").select("owner_user_id", "message_id").distinct(), mailbox.mail(s, d), 7), """SELECT DISTINCT owner_user_id, message_id FROM mail d WHERE message_id IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM mail s WHERE s.owner_user_id = d.owner_user_id AND s.message_id = d.message_id AND (s.processing_status <> 'NO_DATA' OR coalesce(s.detector_version, 0) >= 7))"""),
        "productive_threads": (lambda s, d: productive_threads(mailbox.mail(s, d)), "SELECT DISTINCT owner_user_id, message_id AS thread FROM mail WHERE rows_inserted > 0 AND message_id IS NOT NULL"),
        "unprocessed_messages": (lambda s, d: unprocessed(mailbox.rejections(s, d)), """SELECT owner_user_id, message, CASE WHEN list_contains(reasons, 'IMAGE_REVIEW_REQUIRED') THEN 'REVIEW_REQUIRED' WHEN len(list_filter(reasons, lambda x: x <> 'ATTACHMENT_NOT_A_REPORT')) > 0 THEN 'REVIEW_REQUIRED' ELSE 'NON_REPORT' END AS classification, len(reasons) AS n_reasons
          FROM (SELECT owner_user_id, report_id AS message, list(DISTINCT rejection_reason) AS reasons FROM rejections WHERE report_id LIKE 'GM-%' GROUP BY 1, 2)"""),
    }
    for name, (build, sql) in lists.items():
        register(name, made(sql))(build)

    parts = {
        "ambiguous": "SELECT owner_user_id, 'medium' AS severity, 'ambiguous' AS finding, count(*) FILTER (WHERE task_status = 'Ambiguous') AS n FROM tasks GROUP BY 1",
        "blocked": "SELECT owner_user_id, 'high', 'blocked', count(*) FILTER (WHERE task_status = 'Blocked') FROM flagged WHERE work_kind <> 'PLANNED' GROUP BY 1",
        "slow": "SELECT owner_user_id, 'medium', 'slow', count(*) FILTER (WHERE slow_task_flag = 'TRUE') FROM flagged WHERE work_kind <> 'PLANNED' GROUP BY 1",
        "no_duration": "SELECT owner_user_id, 'info', 'no_duration', count(*) FILTER (WHERE slow_task_flag = 'INSUFFICIENT_DATA' AND actual_duration IS NULL) FROM flagged WHERE work_kind <> 'PLANNED' GROUP BY 1",
        "unattributed": "SELECT owner_user_id, 'info', 'unattributed', count(*) FILTER (WHERE coalesce(department, '') IN ('', 'Unassigned')) FROM flagged WHERE work_kind <> 'PLANNED' GROUP BY 1",
        "review": f"SELECT owner_user_id, 'high', 'review', count(*) FILTER (WHERE classification = 'REVIEW_REQUIRED') FROM mail WHERE {shown} GROUP BY 1",
        "unsupported": f"SELECT owner_user_id, 'info', 'unsupported', count(*) FILTER (WHERE classification = 'UNSUPPORTED_FORMAT') FROM mail WHERE {shown} GROUP BY 1",
        "open_rows": f"SELECT owner_user_id, 'medium', 'open_rows', count(*) FROM rejections q WHERE resolution_status = 'Open' AND {visible} GROUP BY 1",
        "repeats": "SELECT owner_user_id, 'medium', 'repeats', count(*) FILTER (WHERE classification IN ('Needs Review', 'Potential Duplication')) FROM groups GROUP BY 1",
        "reauth": "SELECT * FROM reauth",
        "failures": "SELECT r.owner_user_id, 'high', 'failures', count(*) FROM runs r LEFT JOIN reauth a ON a.owner_user_id = r.owner_user_id WHERE coalesce(a.n, 0) = 0 AND status IN ('FAILED', 'REAUTH_REQUIRED', 'GMAIL_AUTH_ERROR') AND started_at > (SELECT max(started_at) FROM runs) - INTERVAL 3 DAY GROUP BY 1",
    }
    sql = f""", mail AS ({mailbox.MAIL_SQL}), rejections AS ({mailbox.REJECTIONS_SQL}), runs AS ({mailbox.RUNS_SQL}), accounts AS ({mailbox.ACCOUNTS_SQL}),
      reauth AS (SELECT owner_user_id, 'critical' AS severity, 'reauth' AS finding, count(*) FILTER (WHERE active AND last_sync_status = 'REAUTH_REQUIRED') AS n FROM accounts GROUP BY 1)
      SELECT owner_user_id, severity, finding, n AS count, row_number() OVER (PARTITION BY owner_user_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, n DESC, finding)::INT AS place
      FROM ({' UNION ALL '.join(parts.values())}) WHERE n > 0"""

    @register("attention", with_flags(sql))
    def _(spark, sf_dir):
        runs = mailbox.runs(spark, sf_dir)
        now = runs.agg(F.max("started_at")).scalar()
        return attention(flagged(spark, sf_dir), mailbox.mail(spark, sf_dir), mailbox.rejections(spark, sf_dir), runs, mailbox.accounts(spark, sf_dir), groups_of(spark, sf_dir), now)


def unprocessed(skipped: DataFrame) -> DataFrame:
    """Messages (``GM-`` entries of ``skipped``) with the class that the reasons for skipping their parts give. A
    message's different reasons are few."""
    rows = skipped.where(F.col("report_id").startswith("GM-")).groupBy("owner_user_id", F.col("report_id").alias("message")).agg(F.collect_set("rejection_reason").alias("reasons"), F.min("rejection_detail").alias("detail"))
    kind = classified(F.col("reasons"), F.array("detail"))
    return rows.select("owner_user_id", "message", kind["classification"].alias("classification"), F.size("reasons").cast("bigint").alias("n_reasons"))
