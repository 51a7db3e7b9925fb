"""A period's report in words: its lines, a gate for what somebody else wrote about it, its fingerprint and its archive.

A commentary is a JSON text about an owner's dataset. Nothing of it is believed: each sentence is a row, its numbers meet
the dataset's numbers in a join, and what it speaks of (a department, a slow task, a repeated task) meets the dataset's
names in another. The gate says of each sentence what became of it. A report is made again only where the fingerprint of
its dataset changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import pp_change, rate
from ..functions.text import keyify, normalize_task
from .digests import comparison, plural
from .measures import counted
from .merges import upsert

#: What a commentary may hold: the array's name, the fields that name what an entry is about, and its sentences. The
#: first sentence carries its entry where the entry is about nothing by name.
PARTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "department_observations": (("department",), ("observation", "interpretation")),
    "attention_items": ((), ("item", "why_it_matters", "supporting_data", "suggested_action")),
    "slow_tasks": (("task_id",), ("comment",)),
    "repeated_tasks": (("employee", "task"), ("comment",)),
    "trends": ((), ()),
    "data_quality": ((), ()),
}
#: Entries of these parts beyond so many go.
MOST = {"attention_items": 10, "trends": 10, "data_quality": 10}
#: Whole numbers up to this are counting words; those between the years are years.
COUNTING, YEARS = 12, (1900, 2200)
#: An advice isn't a claim.
UNCHECKED = ("suggested_action",)


# --- reading ---------------------------------------------------------------------------------------------------------


def loose_json(text: Column) -> Column:
    """A text as a variant: the text itself, or what stands between its first and last brace; null if neither is JSON.
    A null or empty text is null."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1))
    return F.coalesce(F.try_parse_json(F.trim(text)), F.try_parse_json(inner))


def _text(value: Column, path: str = "$") -> Column:
    """A string of a variant without outer blanks; empty where it is missing or something else than a string."""
    found = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.when(F.schema_of_variant(found) == "STRING", F.trim(F.try_variant_get(value, path, "string"))), F.lit(""))


def _subject(part: str, entry: Column) -> Column:
    names = PARTS[part][0]
    if part == "repeated_tasks":
        return repeat_subject(_text(entry, "$.employee"), _text(entry, "$.task"))
    return _text(entry, f"$.{names[0]}") if names else F.lit(None).cast("string")


def repeat_subject(employee: Column, task: Column) -> Column:
    return F.concat(keyify(employee), F.lit("||"), normalize_task(task))


def sentences(commentaries: DataFrame) -> DataFrame:
    """(owner_user_id, report_id, part, position, field, subject, text) of ``commentaries`` (owner_user_id, report_id,
    reply): a row for each sentence, empty ones left out but for an entry's first and the summary. A reply that is no
    JSON object has one row, of part ``reply``. One pass, whatever the number of parts."""
    rows = commentaries.withColumn("json", loose_json(F.col("reply")))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("json"), F.lit("OBJECT")), F.lit(False))

    def row(part: str, position: Column, field: str, subject: Column, text: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), position.cast("int").alias("position"), F.lit(field).alias("field"), subject.cast("string").alias("subject"), text.alias("text"))

    def entries(part: str) -> Column:
        fields = PARTS[part][1]

        def each(entry: Column, i: Column) -> Column:
            if not fields:
                return F.array(row(part, i, "", F.lit(None), _text(entry)))
            return F.array(*(row(part, i, f, _subject(part, entry), _text(entry, f"$.{f}")) for f in fields))

        return F.flatten(F.transform(F.coalesce(F.try_variant_get("json", f"$.{part}", "array<variant>"), F.array().cast("array<variant>")), each))

    lone = F.array(row("reply", F.lit(0), "", F.lit(None), F.lit("")))
    summary = F.array(row("summary", F.lit(0), "", F.lit(None), _text(F.col("json"), "$.summary")))
    every = F.when(is_object, F.concat(summary, *(entries(p) for p in PARTS))).otherwise(lone)
    firsts = F.col("part").isin("summary", "reply") | F.col("field").isin([f[0] for _, f in PARTS.values() if f])
    return rows.select("owner_user_id", "report_id", F.inline(every)).where(firsts | (F.col("text") != ""))


def stated_rate(commentaries: DataFrame) -> DataFrame:
    """(owner_user_id, report_id, stated): the completion rate that a commentary gives, null where it gives none."""
    return commentaries.select("owner_user_id", "report_id", F.try_variant_get(loose_json(F.col("reply")), "$.overall_completion_rate", "double").alias("stated"))


# --- numbers ---------------------------------------------------------------------------------------------------------


def plain(number: Column) -> Column:
    """A number's text without needless zeros."""
    return F.regexp_replace(number.try_cast("decimal(28,6)").cast("string"), r"\.?0+$", "")


def _one_decimal(number: Column) -> Column:
    return F.round(number.try_cast("decimal(28,6)"), 1).cast("decimal(27,1)").cast("string")


def figures(*frames: tuple[DataFrame, list[str]]) -> DataFrame:
    """Distinct (owner_user_id, figure): the texts under which the numbers of some columns may be quoted: as they are,
    whole, or to one decimal, the first two also without their sign."""
    out = None
    for rows, names in frames:
        found = rows.select("owner_user_id", F.explode(F.array(*(F.col(c).cast("double") for c in names))).alias("n")).where("n IS NOT NULL").distinct()
        out = found if out is None else out.unionByName(found)
    n, size = F.col("n"), F.abs("n")
    return out.select("owner_user_id", F.explode(F.array(plain(n), plain(F.floor(n + 0.5)), _one_decimal(n), plain(size), plain(F.floor(size + 0.5)))).alias("figure")).where("figure IS NOT NULL").distinct()


def unsupported(rows: DataFrame, key: list[str], known: DataFrame) -> DataFrame:
    """(key, unsupported): for the rows whose ``text`` quotes numbers that ``known`` (``figures``) doesn't have, these
    numbers in ascending order of their text. ``key`` begins with owner_user_id."""
    number = F.col("number").cast("double")
    whole = number == F.floor(number)
    quoted = rows.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))).alias("number"))
    quoted = quoted.where(~(whole & ((number <= COUNTING) | number.between(*YEARS))))
    spelt = quoted.select(*key, "number", F.explode(F.array(F.coalesce(plain(number), F.col("number")), F.coalesce(_one_decimal(number), F.col("number")))).alias("figure"))
    matched = spelt.join(known.withColumn("known", F.lit(1)), ["owner_user_id", "figure"], "left")
    missing = matched.groupBy(*key, "number").agg(F.max("known").alias("known")).where("known IS NULL")
    return missing.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("number")), ", ").alias("unsupported"))


# --- the gate --------------------------------------------------------------------------------------------------------


def gate(commentaries: DataFrame, known: DataFrame, subjects: DataFrame) -> DataFrame:
    """(owner_user_id, report_id, part, position, field, subject, text, verdict, unsupported) of each sentence.

    ``known`` are the dataset's ``figures``; ``subjects`` (owner_user_id, part, subject) what it names. Verdicts:
    ``invalid`` (no JSON object), ``missing`` (an empty summary), ``dropped`` (about something that the dataset doesn't
    have, or of an entry whose first sentence went), ``removed`` (quotes a number that it doesn't have), ``over_limit``
    (beyond the entries that a part may have, counted in what remains where each entry is a sentence), else ``kept``.
    Null replies are invalid; repeated commentaries must differ by report_id.
    """
    key = ["owner_user_id", "report_id", "part", "position", "field"]
    rows = sentences(commentaries)
    claims = rows.where(~F.col("field").isin(*UNCHECKED) & (F.col("text") != ""))
    rows = rows.join(unsupported(claims, key, known), key, "left")
    rows = rows.join(subjects.select("owner_user_id", "part", "subject").distinct().withColumn("named", F.lit(True)), ["owner_user_id", "part", "subject"], "left")
    bad = F.col("unsupported").isNotNull()
    heads = [(p, f[0]) for p, (s, f) in PARTS.items() if not s and f]
    is_head = F.lit(False)
    for part, field in heads:
        is_head |= (F.col("part") == part) & (F.col("field") == field)
    entry = Window.partitionBy("owner_user_id", "report_id", "part", "position")
    lost = F.max(is_head & (bad | (F.col("text") == ""))).over(entry)
    verdict = (
        F.when(F.col("part") == "reply", "invalid")
        .when((F.col("part") == "summary") & (F.col("text") == ""), "missing")
        .when(F.col("part").isin([p for p, (s, _) in PARTS.items() if s]) & F.col("named").isNull(), "dropped")
        .when(bad, "removed").when(lost | (F.col("text") == ""), "dropped").otherwise("kept")
    )
    rows = rows.withColumn("verdict", verdict)
    left = F.sum((F.col("verdict") == "kept").cast("int")).over(Window.partitionBy("owner_user_id", "report_id", "part").orderBy("position", "field"))
    limit, over = F.lit(None).cast("int"), F.lit(False)
    for part, most in MOST.items():
        limit = F.when(F.col("part") == part, most).otherwise(limit)
    over = F.when(F.col("field") == "", left > limit).otherwise(F.col("position") >= limit)
    return rows.withColumn("verdict", F.when(F.coalesce(over, F.lit(False)) & (F.col("verdict") == "kept"), "over_limit").otherwise(F.col("verdict"))).select(*key, "subject", "text", "verdict", "unsupported")


def outcomes(checked: DataFrame) -> DataFrame:
    """(owner_user_id, report_id, status, kept, lost): ``OK`` if all of a commentary was kept, ``UNAVAILABLE`` if it
    couldn't be read, else ``PARTIAL``."""
    lost = F.count_if(F.col("verdict") != "kept")
    status = F.when(F.count_if(F.col("verdict") == "invalid") > 0, "UNAVAILABLE").when(lost > 0, "PARTIAL").otherwise("OK")
    return checked.groupBy("owner_user_id", "report_id").agg(status.alias("status"), F.count_if(F.col("verdict") == "kept").alias("kept"), lost.alias("lost"))


def named(departments: DataFrame, slow: DataFrame, repeated: DataFrame) -> DataFrame:
    """What a dataset names, for ``gate``: departments (department), slow tasks (task_id), repeated ones (employee, task)."""
    row = lambda df, part, subject: df.select("owner_user_id", F.lit(part).alias("part"), subject.alias("subject"))
    return row(departments, "department_observations", F.col("department")).unionByName(row(slow, "slow_tasks", F.col("task_id"))).unionByName(row(repeated, "repeated_tasks", repeat_subject(F.col("employee"), F.col("task"))))


# --- the report's lines ----------------------------------------------------------------------------------------------


def department_figures(flagged: DataFrame, first: str, last: str) -> DataFrame:
    """Per owner and department of a period: tasks by status, rate and people."""
    rows = counted(flagged).where(F.col("task_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    status = lambda *names: F.count_if(F.col("task_status").isin(*names))
    out = rows.groupBy("owner_user_id", F.coalesce("department", F.lit("Unassigned")).alias("department")).agg(
        F.count("*").alias("total"), status("Completed").alias("completed"), status("Pending").alias("pending"), status("In Progress").alias("in_progress"), status("Blocked").alias("blocked"), F.countDistinct("employee_name").alias("people"),
    )
    return out.withColumn("completion_rate", rate(F.col("completed"), F.col("total")))


def totals(flagged: DataFrame, first: str, last: str) -> DataFrame:
    """Per owner that has work in a period: its totals and those of the period of the same length before it."""
    before, end = comparison(first, last)
    inside = F.col("task_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    earlier = F.col("task_date").between(before, end)
    done = F.col("task_status") == "Completed"
    out = counted(flagged).where(inside | earlier).groupBy("owner_user_id").agg(
        F.count_if(inside).alias("total"), F.count_if(inside & done).alias("completed"), F.count_if(earlier).alias("previous_total"), F.count_if(earlier & done).alias("previous_completed"),
        F.countDistinct(F.when(inside, F.col("employee_name"))).alias("people"), F.countDistinct(F.when(inside, F.coalesce("department", F.lit("Unassigned")))).alias("departments"),
        F.count_if(inside & (F.col("slow_task_flag") == "TRUE")).alias("slow"), F.count_if(inside & (F.col("slow_task_flag") == "INSUFFICIENT_DATA")).alias("untimed"),
    )
    now, then = rate(F.col("completed"), F.col("total")), rate(F.col("previous_completed"), F.col("previous_total"))
    return out.where("total > 0").withColumns({"completion_rate": now, "previous_rate": then, "change_pp": F.when(F.col("previous_total") > 0, pp_change(now, then))})


def signed(number: Column) -> Column:
    return F.concat(F.when(number > 0, "+").otherwise(""), plain(number))


def report_lines(sums: DataFrame, departments: DataFrame, slow: DataFrame, repeated: DataFrame, low_rate: float = 50, low_base: int = 5, many_blocked: int = 3, most: int = 15) -> DataFrame:
    """(owner_user_id, section, place, line): a report by rules alone, for each owner of ``sums`` (``totals``).

    Sections: 1 summary, 2 departments, 3 what needs attention, 4 the ``most`` slowest tasks, 5 the ``most`` repeated
    ones, 6 trends. ``slow`` has owner_user_id, task_id, task, employee, actual, expected, variance; ``repeated`` has
    owner_user_id, repeat_key, employee, task, occurrence_count, distinct_dates, classification. Lists are cut by a
    window that keeps their first rows before the shuffle; no owner's tasks come together.
    """
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    n = lambda c: plain(F.col(c))
    line = lambda df, section, place, words: df.select("owner_user_id", F.lit(section).alias("section"), place.cast("int").alias("place"), words.alias("line")).where("line IS NOT NULL")
    has_before = F.col("previous_total") > 0
    groups = repeated.groupBy("owner_user_id").agg(F.count_if(F.col("classification") == "Needs Review").alias("review"), F.count_if(F.col("classification") == "Highly Repetitive").alias("repetitive"))
    top = departments.groupBy("owner_user_id").agg(F.min_by(F.struct("department", F.col("total").alias("n")), F.struct(-F.col("total"), "department")).alias("top"))
    head = sums.join(groups, "owner_user_id", "left").join(top, "owner_user_id", "left")
    head = head.select("owner_user_id", F.inline(F.filter(F.array(*(
        F.struct(F.lit(section).alias("section"), F.lit(place).alias("place"), words.alias("line")) for section, place, words in (
            (1, 1, text(plural(F.col("total"), "task"), " by ", plural(F.col("people"), "person", "people"), " in ", plural(F.col("departments"), "department"), "; ", n("completed"), " completed (", n("completion_rate"), "%).")),
            (1, 2, F.when(has_before, text("The period before had ", plural(F.col("previous_total"), "task"), ", ", n("previous_rate"), "% completed: ", signed(F.col("change_pp")), " points.")).otherwise("No earlier period to compare with.")),
            (1, 3, F.when(F.col("slow") > 0, text(plural(F.col("slow"), "task"), " over the expected time.")).otherwise(text("No task over the expected time; ", n("untimed"), " can't be judged."))),
            (3, 2_000_000_001, F.when(F.col("slow") > 0, text("Slow: ", plural(F.col("slow"), "task"), "."))),
            (3, 2_000_000_002, F.when(F.col("review") > 0, text("Repeated on one day: ", plural(F.col("review"), "group"), " to be looked at."))),
            (6, 1, F.when(has_before, text("Tasks: ", n("previous_total"), " to ", n("total"), " (", signed(F.col("total") - F.col("previous_total")), ")."))),
            (6, 2, F.when(has_before, text("Rate: ", n("previous_rate"), "% to ", n("completion_rate"), "%."))),
            (6, 3, text("Most work: ", F.col("top.department"), " with ", plural(F.col("top.n"), "task"), ".")),
            (6, 4, F.when(F.col("repetitive") > 0, text("Highly repetitive: ", plural(F.col("repetitive"), "group"), "."))),
        ))), lambda x: x["line"].isNotNull())))
    place = F.row_number().over(Window.partitionBy("owner_user_id").orderBy(F.desc("total"), "department"))
    listed = departments.withColumn("place", place)
    each = line(listed, 2, F.col("place"), text(F.col("department"), ": ", n("completion_rate"), "% (", n("completed"), " of ", n("total"), " completed, ", n("pending"), " pending, ", n("in_progress"), " in progress, ", plural(F.col("people"), "person", "people"), ")."))
    low = line(listed, 3, 2 * F.col("place") - 1, F.when((F.col("total") >= low_base) & (F.col("completion_rate") < low_rate), text(F.col("department"), ": only ", n("completion_rate"), "% completed.")))
    blocked = line(listed, 3, 2 * F.col("place"), F.when(F.col("blocked") >= many_blocked, text(F.col("department"), ": ", n("blocked"), " blocked.")))
    ranked = lambda df, *order: df.withColumn("place", F.row_number().over(Window.partitionBy("owner_user_id").orderBy(*order))).where(F.col("place") <= most)
    late = line(ranked(slow, F.desc("variance"), "task_id"), 4, F.col("place"), text(F.col("task"), " (", F.col("employee"), "): ", n("actual"), " h for ", n("expected"), " h, ", signed(F.col("variance")), " h."))
    again = line(ranked(repeated, F.desc("occurrence_count"), "repeat_key"), 5, F.col("place"), text(F.col("task"), " (", F.col("employee"), "): ", n("occurrence_count"), " times on ", plural(F.col("distinct_dates"), "day"), ", ", F.col("classification"), "."))
    owners = sums.select("owner_user_id")
    lists = each.unionByName(low).unionByName(blocked).unionByName(late).unionByName(again).join(owners, "owner_user_id", "left_semi")
    return head.unionByName(lists)


def assembled(lines: DataFrame) -> DataFrame:
    """(owner_user_id, report): an owner's lines as one text, in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "place", "line")))
    return lines.groupBy("owner_user_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("report"))


# --- fingerprints and the archive ------------------------------------------------------------------------------------


def fingerprints(rows: DataFrame, key: str = "owner_user_id") -> DataFrame:
    """(key, fingerprint): a hash of a key's rows that doesn't depend on their order or partitions but on each value and
    on how often a row comes. Rows are hashed where they are and summed, so nothing is gathered. Columns count by name."""
    names = sorted(c for c in rows.columns if c != key)
    spelt = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in names]
    digest = F.md5(F.concat(*spelt))
    half = lambda start: F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return rows.groupBy(key).agg(F.sha1(F.concat_ws("/", F.count("*").cast("string"), half(1), half(16))).alias("fingerprint"))


def due(current: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``current`` (keys, fingerprint) that the archive doesn't have with that fingerprint."""
    return current.join(archive.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


def refreshed(archive: DataFrame, current: DataFrame, reports: DataFrame, report_id: str) -> DataFrame:
    """The next version of ``archive`` (report_id, owner_user_id, fingerprint, status, report): reports whose dataset is
    as it was stay, with status ``cached``; others are taken from ``reports`` (owner_user_id, report), ``made``. Filters
    of ``reports`` aren't needed: only owners that are due are joined to it. Other reports of the archive stay as they are."""
    mine = F.concat(F.lit(f"{report_id}-u"), F.col("owner_user_id").cast("string"))
    now = current.select(mine.alias("report_id"), "owner_user_id", "fingerprint")
    keys = ["report_id", "owner_user_id"]
    made = due(now, archive, keys).join(reports, "owner_user_id").withColumn("status", F.lit("made"))
    cached = archive.join(now, [*keys, "fingerprint"], "left_semi").withColumn("status", F.lit("cached"))
    fresh = made.select(*archive.columns).unionByName(cached.select(*archive.columns))
    return upsert(archive, fresh, keys, {})


# --- queries ---------------------------------------------------------------------------------------------------------


def register_all(register, with_flags, flagged, groups_of) -> None:
    first, last = "1997-01-01", "1997-06-30"
    counted_sql = "work_kind <> 'PLANNED' AND task_status <> 'Ambiguous'"
    inside, earlier = f"task_date BETWEEN DATE '{first}' AND DATE '{last}'", "task_date BETWEEN DATE '1996-07-04' AND DATE '1996-12-31'"
    spelt = lambda x: f"regexp_replace(({x})::DECIMAL(28,6)::VARCHAR, '[.]?0+$', '')"
    many = lambda x, one, more=None: f"{x} || CASE {x} WHEN 1 THEN ' {one}' ELSE ' {more or one + 's'}' END"
    plus = lambda x: f"CASE WHEN {x} > 0 THEN '+' ELSE '' END || {spelt(x)}"
    percent = lambda a, b: f"coalesce(round(100.0 * {a} / nullif({b}, 0), 1), 0)::DOUBLE"

    def status(*names):
        return "count(*) FILTER (WHERE task_status IN (" + ", ".join(f"'{x}'" for x in names) + "))"

    data = f""", sums0 AS (SELECT owner_user_id, count(*) FILTER (WHERE {inside}) AS total, count(*) FILTER (WHERE {inside} AND task_status = 'Completed') AS completed, count(*) FILTER (WHERE {earlier}) AS previous_total,
      count(*) FILTER (WHERE {earlier} AND task_status = 'Completed') AS previous_completed, count(DISTINCT employee_name) FILTER (WHERE {inside}) AS people, count(DISTINCT coalesce(department, 'Unassigned')) FILTER (WHERE {inside}) AS departments,
      count(*) FILTER (WHERE {inside} AND slow_task_flag = 'TRUE') AS slow, count(*) FILTER (WHERE {inside} AND slow_task_flag = 'INSUFFICIENT_DATA') AS untimed FROM flagged WHERE {counted_sql} GROUP BY 1),
      sums1 AS (SELECT *, {percent('completed', 'total')} AS completion_rate, {percent('previous_completed', 'previous_total')} AS previous_rate FROM sums0 WHERE total > 0),
      sums AS (SELECT *, CASE WHEN previous_total > 0 THEN floor((completion_rate - previous_rate) * 10 + 0.5) / 10 END AS change_pp FROM sums1),
      depts AS (SELECT *, {percent('completed', 'total')} AS completion_rate FROM (SELECT owner_user_id, coalesce(department, 'Unassigned') AS department, count(*) AS total, {status('Completed')} AS completed, {status('Pending')} AS pending,
        {status('In Progress')} AS in_progress, {status('Blocked')} AS blocked, count(DISTINCT employee_name) AS people FROM flagged WHERE {counted_sql} AND {inside} GROUP BY 1, 2)),
      late AS (SELECT owner_user_id, task_id, task, employee_name AS employee, actual_duration AS actual, floor(expected * 100 + 0.5) / 100 AS expected, slow_variance_hours AS variance FROM flagged WHERE {counted_sql} AND {inside} AND slow_task_flag = 'TRUE')"""
    lines_sql = f"""{data}, top AS (SELECT owner_user_id, department AS d, total AS n FROM depts QUALIFY row_number() OVER (PARTITION BY owner_user_id ORDER BY total DESC, department) = 1),
      listed AS (SELECT *, row_number() OVER (PARTITION BY owner_user_id ORDER BY total DESC, department) AS p FROM depts),
      kinds AS (SELECT owner_user_id, count(*) FILTER (WHERE classification = 'Needs Review') AS review, count(*) FILTER (WHERE classification = 'Highly Repetitive') AS repetitive FROM groups GROUP BY 1),
      lines AS (SELECT owner_user_id, 1 AS section, 1 AS place, {many('total', 'task')} || ' by ' || {many('people', 'person', 'people')} || ' in ' || {many('departments', 'department')} || '; ' || completed || ' completed (' || {spelt('completion_rate')} || '%).' AS line FROM sums
      UNION ALL SELECT owner_user_id, 1, 2, CASE WHEN previous_total > 0 THEN 'The period before had ' || {many('previous_total', 'task')} || ', ' || {spelt('previous_rate')} || '% completed: ' || {plus('change_pp')} || ' points.' ELSE 'No earlier period to compare with.' END FROM sums
      UNION ALL SELECT owner_user_id, 1, 3, CASE WHEN slow > 0 THEN {many('slow', 'task')} || ' over the expected time.' ELSE 'No task over the expected time; ' || untimed || ' can''t be judged.' END FROM sums
      UNION ALL SELECT owner_user_id, 2, p, department || ': ' || {spelt('completion_rate')} || '% (' || completed || ' of ' || total || ' completed, ' || pending || ' pending, ' || in_progress || ' in progress, ' || {many('people', 'person', 'people')} || ').' FROM listed
      UNION ALL SELECT owner_user_id, 3, 2 * p - 1, department || ': only ' || {spelt('completion_rate')} || '% completed.' FROM listed WHERE total >= 5 AND completion_rate < 50
      UNION ALL SELECT owner_user_id, 3, 2 * p, department || ': ' || blocked || ' blocked.' FROM listed WHERE blocked >= 3
      UNION ALL SELECT owner_user_id, 3, 2000000001, 'Slow: ' || {many('slow', 'task')} || '.' FROM sums WHERE slow > 0
      UNION ALL SELECT owner_user_id, 3, 2000000002, 'Repeated on one day: ' || {many('review', 'group')} || ' to be looked at.' FROM kinds WHERE review > 0
      UNION ALL SELECT owner_user_id, 4, p, task || ' (' || employee || '): ' || {spelt('actual')} || ' h for ' || {spelt('expected')} || ' h, ' || {plus('variance')} || ' h.' FROM (SELECT *, row_number() OVER (PARTITION BY owner_user_id ORDER BY variance DESC, task_id) AS p FROM late) WHERE p <= 15
      UNION ALL SELECT owner_user_id, 5, p, task || ' (' || employee || '): ' || occurrence_count || ' times on ' || {many('distinct_dates', 'day')} || ', ' || classification || '.' FROM (SELECT *, row_number() OVER (PARTITION BY owner_user_id ORDER BY occurrence_count DESC, repeat_key) AS p FROM groups) WHERE p <= 15
      UNION ALL SELECT owner_user_id, 6, 1, 'Tasks: ' || previous_total || ' to ' || total || ' (' || {plus('(total - previous_total)')} || ').' FROM sums WHERE previous_total > 0
      UNION ALL SELECT owner_user_id, 6, 2, 'Rate: ' || {spelt('previous_rate')} || '% to ' || {spelt('completion_rate')} || '%.' FROM sums WHERE previous_total > 0
      UNION ALL SELECT owner_user_id, 6, 3, 'Most work: ' || d || ' with ' || {many('n', 'task')} || '.' FROM top
      UNION ALL SELECT owner_user_id, 6, 4, 'Highly repetitive: ' || {many('repetitive', 'group')} || '.' FROM kinds WHERE repetitive > 0)"""

    def late(spark, sf_dir):
        rows = counted(flagged(spark, sf_dir)).where(F.col("task_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("slow_task_flag") == "TRUE"))
        return rows.select("owner_user_id", "task_id", "task", F.col("employee_name").alias("employee"), F.col("actual_duration").alias("actual"), (F.floor(F.col("expected") * 100 + 0.5) / 100).alias("expected"), F.col("slow_variance_hours").alias("variance"))

    def parts_of(spark, sf_dir):
        facts = flagged(spark, sf_dir)
        return totals(facts, first, last), department_figures(facts, first, last), late(spark, sf_dir), groups_of(spark, sf_dir)

    @register("report_lines", with_flags(f"{lines_sql} SELECT owner_user_id, section::INT AS section, place::INT AS place, line FROM lines"))
    def _(spark, sf_dir):
        return report_lines(*parts_of(spark, sf_dir))

    # A commentary for each department and each slow task of an owner: some in fences, some amid prose, some broken.
    replies_sql = """, subjects AS (SELECT owner_user_id, department AS name, total AS n, completed AS k FROM depts UNION ALL SELECT owner_user_id, task_id, 100000 + length(task), 3 FROM late),
      bodies AS (SELECT owner_user_id, name AS report_id, n, '{"summary": "' || name || ' had ' || n || ' tasks in 1997.", "overall_completion_rate": 50.5, "department_observations": [{"department": "' || name || '", "observation": "' || k || ' were completed."}, {"department": "Nowhere", "observation": "12 tasks."}], "slow_tasks": [{"task_id": "'
        || name || '", "comment": "It took 98765.4 hours."}], "trends": ["Up by ' || n * 7 + 50000 || '.", "One in 3.", 4]}' AS body FROM subjects),
      replies AS (SELECT owner_user_id, report_id, CASE n % 4 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || body || ' - done.' ELSE substr(body, 1, length(body) - 3) END AS reply, n % 4 AS shape, body FROM bodies)"""
    figure_list = "total completed pending in_progress blocked people completion_rate".split()
    sum_list = "total completed previous_total previous_completed people departments slow untimed completion_rate previous_rate change_pp".split()
    known_sql = f""", raw AS ({' UNION '.join([f'SELECT owner_user_id, {c}::DOUBLE AS n FROM depts' for c in figure_list] + [f'SELECT owner_user_id, {c}::DOUBLE FROM sums' for c in sum_list] + [f'SELECT owner_user_id, {c}::DOUBLE FROM late' for c in ('actual', 'expected', 'variance')])}),
      known AS (SELECT DISTINCT owner_user_id, unnest([{spelt('n')}, {spelt('floor(n + 0.5)')}, round(n::DECIMAL(28,6), 1)::DECIMAL(27,1)::VARCHAR, {spelt('abs(n)')}, {spelt('floor(abs(n) + 0.5)')}]) AS figure FROM raw WHERE n IS NOT NULL)"""
    gate_sql = f"""{data}{replies_sql}{known_sql}, said AS (SELECT owner_user_id, report_id, 'reply' AS part, 0 AS position, '' AS field, NULL AS subject, '' AS text FROM replies WHERE shape = 3
      UNION ALL SELECT owner_user_id, report_id, 'summary', 0, '', NULL, body::JSON ->> '$.summary' FROM replies WHERE shape < 3
      UNION ALL SELECT owner_user_id, report_id, 'department_observations', i, 'observation', body::JSON ->> ('$.department_observations[' || i || '].department'), body::JSON ->> ('$.department_observations[' || i || '].observation') FROM replies, (SELECT unnest([0, 1]) AS i) WHERE shape < 3
      UNION ALL SELECT owner_user_id, report_id, 'slow_tasks', 0, 'comment', body::JSON ->> '$.slow_tasks[0].task_id', body::JSON ->> '$.slow_tasks[0].comment' FROM replies WHERE shape < 3
      UNION ALL SELECT owner_user_id, report_id, 'trends', i, '', NULL, body::JSON ->> ('$.trends[' || i || ']') FROM replies, (SELECT unnest([0, 1]) AS i) WHERE shape < 3),
      found AS (SELECT *, list_filter(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')), lambda x: NOT (x::DOUBLE = floor(x::DOUBLE) AND (x::DOUBLE <= 12 OR x::DOUBLE BETWEEN 1900 AND 2200))) AS numbers FROM said),
      bad AS (SELECT owner_user_id, report_id, part, position, string_agg(x, ', ' ORDER BY x) AS unsupported FROM (SELECT owner_user_id, report_id, part, position, unnest(numbers) AS x FROM found) q
        WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.owner_user_id = q.owner_user_id AND k.figure IN ({spelt('x::DOUBLE')}, round(x::DOUBLE::DECIMAL(28,6), 1)::DECIMAL(27,1)::VARCHAR)) GROUP BY ALL),
      checked AS (SELECT f.* EXCLUDE (numbers), CASE WHEN part = 'reply' THEN 'invalid' WHEN part = 'department_observations' AND NOT EXISTS (SELECT 1 FROM depts d WHERE d.owner_user_id = f.owner_user_id AND d.department = subject) THEN 'dropped'
        WHEN part = 'slow_tasks' AND NOT EXISTS (SELECT 1 FROM late l WHERE l.owner_user_id = f.owner_user_id AND l.task_id = subject) THEN 'dropped' WHEN unsupported IS NOT NULL THEN 'removed' ELSE 'kept' END AS verdict, unsupported
        FROM found f LEFT JOIN bad USING (owner_user_id, report_id, part, position))"""

    def replies(spark, sf_dir):
        _, departments, slow, _ = parts_of(spark, sf_dir)
        about = departments.select("owner_user_id", F.col("department").alias("name"), F.col("total").alias("n"), F.col("completed").alias("k"))
        about = about.unionByName(slow.select("owner_user_id", F.col("task_id").alias("name"), (F.length("task") + 100000).cast("bigint").alias("n"), F.lit(3).cast("bigint").alias("k")))
        body = F.format_string(
            '{"summary": "%1$s had %2$d tasks in 1997.", "overall_completion_rate": 50.5, "department_observations": [{"department": "%1$s", "observation": "%3$d were completed."}, {"department": "Nowhere", "observation": "12 tasks."}], '
            '"slow_tasks": [{"task_id": "%1$s", "comment": "It took 98765.4 hours."}], "trends": ["Up by %4$d.", "One in 3.", 4]}',
            "name", "n", "k", F.col("n") * 7 + 50000,
        )
        shape = F.col("n") % 4
        reply = F.when(shape == 0, body).when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(shape == 2, F.concat(F.lit("Here it is: "), body, F.lit(" - done."))).otherwise(F.substring(body, F.lit(1), F.length(body) - 3))
        return about.select("owner_user_id", F.col("name").alias("report_id"), reply.alias("reply"))

    def checked(spark, sf_dir):
        sums, departments, slow, repeated = parts_of(spark, sf_dir)
        known = figures((departments, figure_list), (sums, sum_list), (slow, ["actual", "expected", "variance"]))
        return gate(replies(spark, sf_dir), known, named(departments, slow, repeated))

    # The third trend is no string: an empty sentence, left out as such.
    @register("commentary_gate", with_flags(f"{gate_sql} SELECT owner_user_id, report_id, part, position::INT AS position, field, subject, text, verdict, unsupported FROM checked"))
    def _(spark, sf_dir):
        return checked(spark, sf_dir)

    @register("commentary_outcomes", with_flags(f"""{gate_sql} SELECT owner_user_id, report_id, CASE WHEN count(*) FILTER (WHERE verdict = 'invalid') > 0 THEN 'UNAVAILABLE' WHEN count(*) FILTER (WHERE verdict <> 'kept') > 0 THEN 'PARTIAL' ELSE 'OK' END AS status,
      count(*) FILTER (WHERE verdict = 'kept') AS kept, count(*) FILTER (WHERE verdict <> 'kept') AS lost FROM checked GROUP BY 1, 2"""))
    def _(spark, sf_dir):
        return outcomes(checked(spark, sf_dir))

    hashed = lambda names, source, where="true": "SELECT owner_user_id, sha1(concat_ws('/', count(*), sum(('0x' || substr(h, 1, 15))::BIGINT)::HUGEINT, sum(('0x' || substr(h, 16, 15))::BIGINT)::HUGEINT)) AS fingerprint FROM (SELECT owner_user_id, md5(" + " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in sorted(names)) + f") AS h FROM {source} WHERE {where}) GROUP BY 1"
    content = ["department", "total", "completed", "pending", "in_progress", "blocked", "people"]

    @register("dataset_fingerprints", with_flags(f"{data} {hashed(content, 'depts')}"))
    def _(spark, sf_dir):
        return fingerprints(department_figures(flagged(spark, sf_dir), first, last).select("owner_user_id", *content))

    # The archive holds every owner's report; those of even owners were made from other figures, and one is of another month.
    @register("report_archive", with_flags(f"""{lines_sql}, now AS ({hashed(content, 'depts')}), texts AS (SELECT owner_user_id, string_agg(line, chr(10) ORDER BY section, place) AS report FROM lines GROUP BY 1)
      SELECT 'HALF-{first}-u' || owner_user_id AS report_id, owner_user_id, fingerprint, CASE owner_user_id % 2 WHEN 0 THEN 'made' ELSE 'cached' END AS status, CASE owner_user_id % 2 WHEN 0 THEN report ELSE 'kept as it was' END AS report FROM now JOIN texts USING (owner_user_id)
      UNION ALL SELECT 'HALF-1996-07-01-u' || owner_user_id, owner_user_id, 'older', 'made', 'an earlier half' FROM now"""))
    def _(spark, sf_dir):
        sums, departments, slow, repeated = parts_of(spark, sf_dir)
        now = fingerprints(departments.select("owner_user_id", *content))
        owner = F.col("owner_user_id").cast("string")
        kept = now.select(F.concat(F.lit(f"HALF-{first}-u"), owner).alias("report_id"), "owner_user_id", F.when(F.col("owner_user_id") % 2 == 0, "stale").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit("made").alias("status"), F.lit("kept as it was").alias("report"))
        older = now.select(F.concat(F.lit("HALF-1996-07-01-u"), owner).alias("report_id"), "owner_user_id", F.lit("older").alias("fingerprint"), F.lit("made").alias("status"), F.lit("an earlier half").alias("report"))
        return refreshed(kept.unionByName(older), now, assembled(report_lines(sums, departments, slow, repeated)), f"HALF-{first}")
