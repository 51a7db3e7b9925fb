"""What a department's day, a report's period and a claim about it come to.

A department's day is a row: sums by group, then short ordered lists (people of a department on a day, three categories,
four tasks) from windows. A report's dataset is a table of rows by kind and name; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import pp_change, rate
from ..functions.text import keyify, normalize_task
from .measures import counted

# Departments that stand for none.
UNPLACED = ("", "unassigned", "unknown")


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def list_names(names: Column, most: int = 5) -> Column:
    """Names in a sentence; those over ``most`` as a number."""
    more = F.size(names) - most
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def department_days(tasks: DataFrame, roster: DataFrame, is_person: str = "is_person") -> DataFrame:
    """A row for each owner, day and department with its counts, people, categories, tasks that need attention, who of
    the roster (department, employee_name) is silent, a headline, and the place among the day's departments."""
    key = ["owner_user_id", "task_date", "department"]
    rows = tasks.withColumn("department", F.coalesce(F.nullif(F.col("department"), F.lit("")), F.lit("Unassigned")))
    work = counted(rows)
    planned = rows.groupBy(*key).agg(F.count_if(F.col("work_kind") == "PLANNED").alias("planned"))
    status = lambda *names: F.count_if(F.col("task_status").isin(*names))
    timed = F.col("actual_duration") > 0
    totals = work.groupBy(*key).agg(
        F.count("*").alias("total"), status("Completed").alias("completed"), status("In Progress").alias("in_progress"), status("Pending", "Not Started").alias("not_done"),
        status("Blocked").alias("blocked"), status("Cancelled").alias("cancelled"), F.count_if(~F.col(is_person)).alias("unattributed"), F.count_if(timed).alias("hours_tasks"),
        F.round(F.sum(F.when(timed, F.col("actual_duration").cast("decimal(18,4)"))), 1).cast("double").alias("hours"),
    )
    each = work.where(F.col(is_person)).groupBy(*key, "employee_name").agg(F.count("*").alias("tasks"), status("Completed").alias("done"))
    people = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("employee_name").alias("name"), "tasks", "done"))).alias("people"))  # a department's people on a day
    kinds = work.where("trim(coalesce(task_category, '')) != '' and lower(task_category) not rlike '^uncategori[sz]ed$'").groupBy(*key, F.trim("task_category").alias("name")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "name"))
    top = kinds.withColumn("place", place).where("place <= 3").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "name", "n"))).alias("top"))
    urgent = work.where("task_status in ('Blocked', 'Pending', 'Not Started')").withColumn("rank", F.when(F.col("task_status") == "Blocked", 0).otherwise(1))
    urgent = urgent.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("rank", "task_id"))).where("place <= 4")
    urgent = urgent.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "task_id"))).alias("urgent"))
    here = roster.groupBy(F.lower("department").alias("place_key")).agg(F.count("*").alias("roster_size"))
    spoke = each.select("owner_user_id", "task_date", F.lower("department").alias("place_key"), F.lower("employee_name").alias("name_key")).distinct()
    on_roster = roster.select(F.lower("department").alias("place_key"), F.lower("employee_name").alias("name_key")).distinct()
    heard = spoke.join(on_roster, ["place_key", "name_key"], "left_semi").groupBy("owner_user_id", "task_date", "place_key").agg(F.count("*").alias("heard"))
    out = totals
    for part in (people, top, urgent, planned):
        out = out.join(part, key, "left")
    out = out.withColumn("place_key", F.lower("department")).join(here, "place_key", "left").join(heard, ["owner_user_id", "task_date", "place_key"], "left")
    placed, size = ~F.col("place_key").isin(*UNPLACED), F.coalesce("roster_size", F.lit(0))
    spoken = F.coalesce(F.size("people"), F.lit(0))
    spoken = F.when(F.col("people").isNull(), 0).otherwise(spoken)
    percent = rate(F.col("completed"), F.col("total"))
    who = F.when((size > 0) & placed, F.concat(spoken.cast("string"), F.lit(" of "), plural(size, "person", "people"), F.lit(" reported "))).otherwise(F.concat(plural(spoken, "person", "people"), F.lit(" reported ")))
    headline = F.concat(who, plural(F.col("total"), "task"), F.lit("; "), F.col("completed").cast("string"), F.lit(" completed ("), F.regexp_replace(percent.cast("string"), r"\.0$", ""), F.lit("%)."))
    order = F.row_number().over(Window.partitionBy("owner_user_id", "task_date").orderBy(placed.cast("int").desc(), F.desc("total"), "department"))
    silent = F.when(placed, size - F.coalesce("heard", F.lit(0))).otherwise(0)
    return out.select(
        *key, "total", "completed", "in_progress", "not_done", "blocked", "cancelled", percent.alias("completion_rate"), "hours", "hours_tasks", "people", spoken.cast("bigint").alias("n_people"), silent.cast("bigint").alias("not_reported"),
        F.array_join(F.transform("top", lambda x: F.concat(x["name"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("top_categories"),
        F.array_join(F.transform("urgent", lambda x: x["task_id"]), ",").alias("attention"), F.coalesce("planned", F.lit(0)).alias("planned"), "unattributed", headline.alias("headline"), order.cast("int").alias("place"),
    )


def silent_people(tasks: DataFrame, roster: DataFrame, day: Column) -> DataFrame:
    """For each owner, people of the roster (employee_name, department, and owner_user_id if owners have rosters of their
    own) who didn't report to that owner on a day in their department."""
    spoke = counted(tasks).where(F.col("task_date") == day).select("owner_user_id", F.lower("department").alias("d"), F.lower("employee_name").alias("e")).distinct()
    rows = roster.where(~F.lower(F.coalesce("department", F.lit(""))).isin(*UNPLACED))
    if "owner_user_id" not in roster.columns:
        owners = tasks.agg(F.collect_set("owner_user_id").alias("owners"))  # accounts of the engine, one row
        rows = rows.select("*", F.explode(owners.scalar()).alias("owner_user_id"))
    rows = rows.select("owner_user_id", "department", "employee_name", F.lower("department").alias("d"), F.lower("employee_name").alias("e"))
    return rows.join(spoke, ["owner_user_id", "d", "e"], "left_anti").select("owner_user_id", "department", "employee_name")


def day_text(days: DataFrame) -> DataFrame:
    """A line for each department's day, as pasted into a message."""
    return days.select("owner_user_id", "task_date", "place", F.concat("department", F.lit(": "), "headline", F.when(F.col("top_categories") != "", F.concat(F.lit(" Most work went to "), "top_categories", F.lit("."))).otherwise(F.lit(""))).alias("line"))


def comparison(first: str, last: str) -> tuple[Column, Column]:
    """The period of the same length that ends the day before ``first``."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    end = F.date_sub(a, 1)
    return F.date_sub(end, F.datediff(b, a)), end


def period_totals(tasks: DataFrame, first: str, last: str) -> DataFrame:
    """Per owner: totals of a period and of the one before it, from one pass over both."""
    before, end = comparison(first, last)
    inside = F.col("task_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    earlier = F.col("task_date").between(before, end)
    done = F.col("task_status") == "Completed"
    rows = counted(tasks).where(inside | earlier)
    out = rows.groupBy("owner_user_id").agg(
        F.count_if(inside).alias("total"), F.count_if(inside & done).alias("completed"), F.count_if(earlier).alias("previous_total"), F.count_if(earlier & done).alias("previous_completed"),
        F.countDistinct(F.when(inside, F.col("employee_name"))).alias("people"), F.count_if(inside & F.coalesce("task_category", F.lit("")).isin("")).alias("uncategorised"),
        F.count_if(inside & (F.col("slow_task_flag") == "INSUFFICIENT_DATA")).alias("untimed"),
    )
    now, then = rate(F.col("completed"), F.col("total")), rate(F.col("previous_completed"), F.col("previous_total"))
    change = F.when(F.col("previous_total") > 0, pp_change(now, then))
    return out.withColumns({"completion_rate": now, "previous_rate": then, "change_pp": change, "verdict": compared(F.col("total"), F.col("previous_total"))})


def compared(now: Column, before: Column, least: int = 5) -> Column:
    """How a count stands to an earlier one; ``weak`` where the earlier one is too small to say."""
    return F.when(before < least, "weak").when(now > before, "up").when(now < before, "down").otherwise("same")


def report_rows(tasks: DataFrame, first: str, last: str) -> DataFrame:
    """(owner_user_id, kind, name, total, completed, slow, repeated): a period's figures by department, person and
    category, from one pass by grouping sets."""
    rows = counted(tasks).where(F.col("task_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    rows = rows.select(
        "owner_user_id", F.coalesce("department", F.lit("Unassigned")).alias("department"), F.col("employee_name").alias("employee"), F.coalesce(F.nullif(F.col("task_category"), F.lit("")), F.lit("Uncategorised")).alias("category"),
        (F.col("task_status") == "Completed").alias("done"), (F.col("slow_task_flag") == "TRUE").alias("slow"), F.col("repeated_task_flag").alias("repeated"),
    )
    o = F.col("owner_user_id")
    names = ("department", "employee", "category")
    sets = rows.groupingSets([[o, F.col(n)] for n in names], o, *(F.col(n) for n in names))
    out = sets.agg(F.count("*").alias("total"), F.count_if("done").alias("completed"), F.count_if("slow").alias("slow"), F.count_if("repeated").alias("repeated"))
    kind = F.coalesce(*(F.when(F.col(n).isNotNull(), n) for n in names))
    return out.select("owner_user_id", kind.alias("kind"), F.coalesce(*names).alias("name"), "total", "completed", "slow", "repeated")


def grounded(claims: DataFrame, dataset: DataFrame) -> DataFrame:
    """``claims`` (claim_id, owner_user_id, kind, name, total) with a verdict against ``dataset`` (``report_rows``):
    dropped if it has no such row, corrected if the figure is another, and the right figure."""
    known = dataset.select("owner_user_id", "kind", keyify(F.col("name")).alias("key"), F.col("total").alias("right_total"))
    rows = claims.withColumn("key", keyify(F.col("name"))).join(known, ["owner_user_id", "kind", "key"], "left")
    verdict = F.when(F.col("right_total").isNull(), "dropped").when(F.col("right_total") != F.col("total"), "corrected").otherwise("kept")
    return rows.select("claim_id", verdict.alias("verdict"), "right_total")


def grounded_numbers(text: Column, allowed: Column) -> Column:
    """Whether every number in a text is among ``allowed`` (an array of their texts)."""
    return F.size(F.array_except(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), allowed)) == 0


def insight_points(totals: DataFrame, most: int = 6) -> DataFrame:
    """Per owner: sentences on a period's totals (``period_totals``), the first ``most`` that apply."""
    number = lambda c: F.col(c).cast("string")
    points = F.array(
        F.concat(number("total"), F.lit(" tasks by "), plural(F.col("people"), "person", "people"), F.lit(".")),
        F.concat(number("completed"), F.lit(" completed.")),
        F.when(F.col("change_pp").isNotNull() & (F.col("verdict") != "weak"), F.concat(F.lit("Work went "), "verdict", F.lit("."))),
        F.when(F.col("untimed") > 0, F.concat(number("untimed"), F.lit(" without usable times."))),
        F.when(F.col("uncategorised") > 0, F.concat(number("uncategorised"), F.lit(" without a category."))),
    )
    return totals.select("owner_user_id", F.array_join(F.slice(F.filter(points, lambda p: p.isNotNull()), 1, most), " ").alias("insight"))


def shares(rows: DataFrame, by: str, value: str = "total") -> DataFrame:
    """Each name's share of its owner's sum, in per cent."""
    whole = F.sum(value).over(Window.partitionBy("owner_user_id"))
    return rows.select("owner_user_id", by, value, F.round(F.lit(100) * F.col(value).cast("decimal(18,0)") / whole, 1).cast("double").alias("share"))


def dominant(rows: DataFrame, group: list[str], column: str) -> DataFrame:
    """The most frequent value of a group, the first by name among equals."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), column))
    return counts.withColumn("place", place).where("place = 1").drop("place")


def document_rollup(tasks: DataFrame, document: str) -> DataFrame:
    """Per owner and document: its rows, newest day, number of departments, and the department if it is the only one."""
    n = F.size(F.array_distinct(F.array(F.min("department"), F.max("department"))))
    return tasks.groupBy("owner_user_id", document).agg(F.count("*").alias("rows"), F.max("task_date").alias("report_date"), F.countDistinct("department").alias("departments"), F.when(n == 1, F.min("department")).alias("department"))


def register_all(register, with_facts, with_flags, tasks, table, flagged, groups_of) -> None:
    counted_sql = "work_kind <> 'PLANNED' AND task_status <> 'Ambiguous'"
    roster = lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("department"), F.col("c_name").alias("employee_name"))
    roster_sql = "roster AS (SELECT n_name AS department, c_name AS employee_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"
    base = f""", {roster_sql}, work AS (SELECT *, coalesce(nullif(department, ''), 'Unassigned') AS dept FROM tasks WHERE {counted_sql}),
      sums AS (SELECT owner_user_id, task_date, dept, count(*) AS total, count(*) FILTER (WHERE task_status = 'Completed') AS completed, count(*) FILTER (WHERE task_status = 'In Progress') AS in_progress, count(*) FILTER (WHERE task_status IN ('Pending', 'Not Started')) AS not_done,
        count(*) FILTER (WHERE task_status = 'Blocked') AS blocked, count(*) FILTER (WHERE task_status = 'Cancelled') AS cancelled, count(*) FILTER (WHERE NOT is_person) AS unattributed, count(*) FILTER (WHERE actual_duration > 0) AS hours_tasks,
        round(sum(actual_duration::DECIMAL(18,4)) FILTER (WHERE actual_duration > 0), 1)::DOUBLE AS hours, count(DISTINCT employee_name) FILTER (WHERE is_person) AS n_people,
        count(DISTINCT lower(employee_name)) FILTER (WHERE is_person AND EXISTS (SELECT 1 FROM roster r WHERE lower(r.department) = lower(dept) AND lower(r.employee_name) = lower(work.employee_name))) AS heard FROM work GROUP BY 1, 2, 3),
      kinds AS (SELECT owner_user_id, task_date, dept, string_agg(name || ' (' || n || ')', ', ' ORDER BY place) AS top_categories FROM (SELECT *, row_number() OVER (PARTITION BY owner_user_id, task_date, dept ORDER BY n DESC, name) AS place FROM (
        SELECT owner_user_id, task_date, dept, task_category AS name, count(*) AS n FROM work GROUP BY 1, 2, 3, 4)) WHERE place <= 3 GROUP BY 1, 2, 3),
      urgent AS (SELECT owner_user_id, task_date, dept, string_agg(task_id, ',' ORDER BY place) AS attention FROM (SELECT *, row_number() OVER (PARTITION BY owner_user_id, task_date, dept ORDER BY CASE task_status WHEN 'Blocked' THEN 0 ELSE 1 END, task_id) AS place FROM work
        WHERE task_status IN ('Blocked', 'Pending', 'Not Started')) WHERE place <= 4 GROUP BY 1, 2, 3),
      plans AS (SELECT owner_user_id, task_date, coalesce(nullif(department, ''), 'Unassigned') AS dept, count(*) FILTER (WHERE work_kind = 'PLANNED') AS planned FROM tasks GROUP BY 1, 2, 3),
      sizes AS (SELECT lower(department) AS k, count(*) AS roster_size FROM roster GROUP BY 1),
      days AS (SELECT s.owner_user_id, s.task_date, s.dept AS department, total, completed, in_progress, not_done, blocked, cancelled, coalesce(round(100.0 * completed / nullif(total, 0), 1), 0)::DOUBLE AS completion_rate, hours, hours_tasks, n_people,
        CASE WHEN lower(s.dept) IN ('', 'unassigned', 'unknown') THEN 0 ELSE coalesce(roster_size, 0) - heard END AS not_reported, top_categories, coalesce(attention, '') AS attention, coalesce(planned, 0) AS planned, unattributed,
        CASE WHEN roster_size > 0 AND lower(s.dept) NOT IN ('', 'unassigned', 'unknown') THEN n_people || ' of ' || roster_size || CASE roster_size WHEN 1 THEN ' person' ELSE ' people' END ELSE n_people || CASE n_people WHEN 1 THEN ' person' ELSE ' people' END END
          || ' reported ' || total || CASE total WHEN 1 THEN ' task' ELSE ' tasks' END || '; ' || completed || ' completed (' || regexp_replace(coalesce(round(100.0 * completed / nullif(total, 0), 1), 0)::DOUBLE::VARCHAR, '[.]0$', '') || '%).' AS headline,
        row_number() OVER (PARTITION BY s.owner_user_id, s.task_date ORDER BY CASE WHEN lower(s.dept) IN ('', 'unassigned', 'unknown') THEN 1 ELSE 0 END, total DESC, s.dept)::INT AS place
        FROM sums s LEFT JOIN kinds USING (owner_user_id, task_date, dept) LEFT JOIN urgent USING (owner_user_id, task_date, dept) LEFT JOIN plans USING (owner_user_id, task_date, dept) LEFT JOIN sizes ON k = lower(s.dept))"""

    @register("department_days", with_facts(f"{base} SELECT * REPLACE (coalesce(attention, '') AS attention) FROM days"))
    def _(spark, sf_dir):
        out = department_days(tasks(spark, sf_dir), roster(spark, sf_dir))
        return out.drop("people").withColumn("attention", F.coalesce("attention", F.lit("")))

    @register("department_day_text", with_facts(f"{base} SELECT owner_user_id, task_date, place, department || ': ' || headline || ' Most work went to ' || top_categories || '.' AS line FROM days"))
    def _(spark, sf_dir):
        return day_text(department_days(tasks(spark, sf_dir), roster(spark, sf_dir)))

    @register("silent_people", with_facts(f", {roster_sql} SELECT owner_user_id, department, employee_name FROM roster r, (SELECT DISTINCT owner_user_id FROM tasks) o WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE {counted_sql} AND t.owner_user_id = o.owner_user_id AND task_date = DATE '1998-01-15' AND lower(t.department) = lower(r.department) AND t.employee_name = r.employee_name)"))
    def _(spark, sf_dir):
        return silent_people(tasks(spark, sf_dir), roster(spark, sf_dir), F.lit("1998-01-15").cast("date"))

    first, last = "1997-01-01", "1997-06-30"
    inside, earlier = f"task_date BETWEEN DATE '{first}' AND DATE '{last}'", "task_date BETWEEN DATE '1996-07-04' AND DATE '1996-12-31'"
    totals_sql = f""", sums AS (SELECT owner_user_id, count(*) FILTER (WHERE {inside}) AS total, count(*) FILTER (WHERE {inside} AND task_status = 'Completed') AS completed, count(*) FILTER (WHERE {earlier}) AS previous_total,
      count(*) FILTER (WHERE {earlier} AND task_status = 'Completed') AS previous_completed, count(DISTINCT employee_name) FILTER (WHERE {inside}) AS people, count(*) FILTER (WHERE {inside} AND coalesce(task_category, '') = '') AS uncategorised,
      count(*) FILTER (WHERE {inside} AND slow_task_flag = 'INSUFFICIENT_DATA') AS untimed FROM slow WHERE {counted_sql} AND ({inside} OR {earlier}) GROUP BY 1),
      rates AS (SELECT *, coalesce(round(100.0 * completed / nullif(total, 0), 1), 0)::DOUBLE AS completion_rate, coalesce(round(100.0 * previous_completed / nullif(previous_total, 0), 1), 0)::DOUBLE AS previous_rate FROM sums),
      totals AS (SELECT *, CASE WHEN previous_total > 0 THEN floor((completion_rate - previous_rate) * 10 + 0.5) / 10 END AS change_pp, CASE WHEN previous_total < 5 THEN 'weak' WHEN total > previous_total THEN 'up' WHEN total < previous_total THEN 'down' ELSE 'same' END AS verdict FROM rates)"""

    @register("period_totals", with_flags(f"{totals_sql} SELECT * FROM totals"))
    def _(spark, sf_dir):
        return period_totals(flagged(spark, sf_dir), first, last)

    @register("insight_points", with_flags(f"""{totals_sql} SELECT owner_user_id, total || ' tasks by ' || people || CASE people WHEN 1 THEN ' person. ' ELSE ' people. ' END || completed || ' completed.' || CASE WHEN change_pp IS NOT NULL AND verdict <> 'weak' THEN ' Work went ' || verdict || '.' ELSE '' END
      || CASE WHEN untimed > 0 THEN ' ' || untimed || ' without usable times.' ELSE '' END || CASE WHEN uncategorised > 0 THEN ' ' || uncategorised || ' without a category.' ELSE '' END AS insight FROM totals"""))
    def _(spark, sf_dir):
        return insight_points(period_totals(flagged(spark, sf_dir), first, last))

    figures = "count(*) AS total, count(*) FILTER (WHERE task_status = 'Completed') AS completed, count(*) FILTER (WHERE slow_task_flag = 'TRUE') AS slow, count(*) FILTER (WHERE repeated_task_flag) AS repeated"
    parts = " UNION ALL ".join(f"SELECT owner_user_id, '{kind}' AS kind, {name} AS name, {figures} FROM flagged WHERE {counted_sql} AND {inside} GROUP BY 1, 3" for kind, name in (("department", "coalesce(department, 'Unassigned')"), ("employee", "employee_name"), ("category", "task_category")))

    @register("report_dataset", with_flags(parts))
    def _(spark, sf_dir):
        return report_rows(flagged(spark, sf_dir), first, last)

    @register("grounded_claims", with_flags(f""", dataset AS ({parts}), claims AS (SELECT n_nationkey * 10 + k AS claim_id, k + 1 AS owner_user_id, 'department' AS kind, n_name AS name, n_nationkey * 2 AS total FROM nation, (SELECT unnest(range(5)) AS k))
      SELECT claim_id, CASE WHEN d.total IS NULL THEN 'dropped' WHEN d.total <> c.total THEN 'corrected' ELSE 'kept' END AS verdict, d.total AS right_total FROM claims c LEFT JOIN dataset d ON d.owner_user_id = c.owner_user_id AND d.kind = c.kind AND d.name = c.name"""))
    def _(spark, sf_dir):
        nation = table(spark, sf_dir, "nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
        claims = nation.select((F.col("n_nationkey") * 10 + F.col("k")).cast("bigint").alias("claim_id"), (F.col("k") + 1).alias("owner_user_id"), F.lit("department").alias("kind"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 2).alias("total"))
        return grounded(claims, report_rows(flagged(spark, sf_dir), first, last))

    @register("status_shares", with_facts(f"SELECT owner_user_id, task_status, count(*) AS total, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY owner_user_id), 1)::DOUBLE AS share FROM tasks WHERE {counted_sql} GROUP BY 1, 2"))
    def _(spark, sf_dir):
        return shares(counted(tasks(spark, sf_dir)).groupBy("owner_user_id", "task_status").agg(F.count("*").alias("total")), "task_status")

    @register("dominant_departments", with_facts("SELECT owner_user_id, employee_name, department, n FROM (SELECT owner_user_id, employee_name, department, count(*) AS n FROM tasks WHERE department IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY owner_user_id, employee_name ORDER BY n DESC, department) = 1"))
    def _(spark, sf_dir):
        return dominant(tasks(spark, sf_dir), ["owner_user_id", "employee_name"], "department")

    @register("document_rollup", with_facts("SELECT owner_user_id, team, count(*) AS rows, max(task_date) AS report_date, count(DISTINCT department) AS departments, CASE WHEN min(department) = max(department) OR count(department) = 0 THEN min(department) END AS department FROM tasks GROUP BY 1, 2"))
    def _(spark, sf_dir):
        return document_rollup(tasks(spark, sf_dir), "team")
