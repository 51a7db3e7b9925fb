"""Every query by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard, detection, digests, evidence, headers, ingest, joins, merges, messages, narratives, parts, recordsets, repeats, slow, summaries
from ..operators.measures import completion_rate, counted, total
from . import mailbox
from .facts import FACTS_SQL, EngineConfig, once, table, tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Repeats are looked for over two years and by team, so that every class occurs in the driver's data.
REPEATS = EngineConfig(repeat_lookback_days=720)
PERSON = "team"

_KEYIFY = "trim(regexp_replace(regexp_replace(lower({0}), '[.]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'))"

_MIDDLES = """
m_{key} AS (SELECT owner_user_id, {key}, max(n) AS n, max(CASE WHEN rn = n // 2 THEN actual_duration END) AS low, max(CASE WHEN rn = n // 2 + 1 THEN actual_duration END) AS middle,
  max(CASE WHEN rn = n // 2 + 2 THEN actual_duration END) AS high FROM (SELECT owner_user_id, {key}, actual_duration, row_number() OVER (PARTITION BY owner_user_id, {key} ORDER BY actual_duration) AS rn,
  count(*) OVER (PARTITION BY owner_user_id, {key}) AS n FROM tasks WHERE actual_duration > 0 AND {key} IS NOT NULL) GROUP BY 1, 2)"""
_OTHERS = "CASE WHEN {0}.n - 1 >= 3 THEN CASE WHEN {0}.n % 2 = 0 THEN CASE WHEN {0}.low < t.actual_duration THEN {0}.low ELSE {0}.middle END ELSE ((CASE WHEN {0}.low < t.actual_duration THEN {0}.low ELSE {0}.middle END) + (CASE WHEN {0}.middle < t.actual_duration THEN {0}.middle ELSE {0}.high END)) / 2 END END"
_KEYS = ("task_normalized", "task_category", "department")
SLOW_CTE = ",".join(_MIDDLES.format(key=k) for k in _KEYS) + """,
expected_of AS (SELECT t.*, CASE WHEN t.actual_duration > 0 THEN CASE WHEN t.expected_duration > 0 THEN t.expected_duration WHEN a.n > 3 THEN {a} WHEN b.n > 3 THEN {b} WHEN c.n > 3 THEN {c} END END AS expected,
  CASE WHEN t.expected_duration > 0 THEN 'configured' WHEN a.n > 3 THEN 'task history' WHEN b.n > 3 THEN 'category history' WHEN c.n > 3 THEN 'department history' END AS baseline_source,
  CASE WHEN t.expected_duration > 0 THEN 0 WHEN a.n > 3 THEN a.n - 1 WHEN b.n > 3 THEN b.n - 1 WHEN c.n > 3 THEN c.n - 1 END AS baseline_sample_size
  FROM tasks t LEFT JOIN m_task_normalized a ON a.owner_user_id = t.owner_user_id AND a.task_normalized = t.task_normalized
  LEFT JOIN m_task_category b ON b.owner_user_id = t.owner_user_id AND b.task_category = t.task_category
  LEFT JOIN m_department c ON c.owner_user_id = t.owner_user_id AND c.department = t.department),
slow AS (SELECT * EXCLUDE (baseline_source, baseline_sample_size), CASE WHEN expected IS NOT NULL THEN baseline_source END AS baseline_source, CASE WHEN expected IS NOT NULL THEN baseline_sample_size::BIGINT END AS baseline_sample_size,
  floor((actual_duration - expected) * 100 + 0.5) / 100 AS slow_variance_hours, CASE WHEN expected IS NULL THEN 'INSUFFICIENT_DATA' WHEN actual_duration > expected * 1.5 THEN 'TRUE' ELSE 'FALSE' END AS slow_task_flag FROM expected_of)
""".format(a=_OTHERS.format("a"), b=_OTHERS.format("b"), c=_OTHERS.format("c"))
REPEATS_CTE = f"""
newest AS (SELECT owner_user_id, max(task_date) AS newest FROM tasks GROUP BY 1),
keyed AS (SELECT t.*, {_KEYIFY.format('t.team')} AS person, task_normalized AS wording, t.task_date >= n.newest - 720 AS inside FROM tasks t JOIN newest n USING (owner_user_id)),
by_day AS (SELECT owner_user_id, person, wording, task_date, count(*) AS n FROM keyed WHERE inside GROUP BY ALL),
sized AS (SELECT k.owner_user_id, k.person, k.wording, count(*) AS occurrence_count, count(DISTINCT task_date) AS distinct_dates, min(task_date) AS first_date, max(task_date) AS last_date,
  count(*) FILTER (WHERE task_status = 'Completed') AS completed_count, min(team) AS employee, arg_min(coalesce(department, chr(0)), (task_date, task_id)) AS department,
  string_agg(DISTINCT task_date::VARCHAR, ',' ORDER BY task_date::VARCHAR) AS dates FROM keyed k WHERE inside GROUP BY ALL HAVING count(*) >= 2),
groups AS (SELECT s.owner_user_id, substr(sha1(s.person || '||' || s.wording), 1, 12) AS repeat_key, s.employee, nullif(s.department, chr(0)) AS department, s.wording AS task, s.wording AS normalized_task, s.person,
  s.occurrence_count, s.distinct_dates, d.n AS max_same_day_count, s.first_date, s.last_date, s.dates, s.completed_count, s.occurrence_count - s.completed_count AS open_count,
  CASE WHEN d.n >= 3 THEN 'Needs Review' WHEN s.occurrence_count >= 8 THEN 'Highly Repetitive' WHEN s.distinct_dates >= 3 THEN 'Recurring / Legitimate' WHEN s.occurrence_count > s.distinct_dates THEN 'Potential Duplication' ELSE 'Recurring / Legitimate' END AS classification
  FROM sized s JOIN (SELECT owner_user_id, person, wording, max(n) AS n FROM by_day GROUP BY ALL) d USING (owner_user_id, person, wording)),
flagged AS (SELECT s.*, coalesce(g.repeat_key IS NOT NULL AND k.inside, FALSE) AS repeated_task_flag FROM slow s JOIN keyed k USING (task_id) LEFT JOIN groups g ON g.owner_user_id = k.owner_user_id AND g.person = k.person AND g.normalized_task = k.wording)
"""


def with_facts(sql: str) -> str:
    return f"WITH tasks AS ({FACTS_SQL}) {sql}"


def with_slow(sql: str) -> str:
    return f"WITH tasks AS ({FACTS_SQL}),{SLOW_CTE} {sql}"


def with_flags(sql: str) -> str:
    return f"WITH tasks AS ({FACTS_SQL}),{SLOW_CTE},{REPEATS_CTE} {sql}"


def counts(*names: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE task_status = '{n}') AS {n.lower().replace(' ', '_')}" for n in names)


RATE = "coalesce(round(100.0 * count(*) FILTER (WHERE task_status = 'Completed') / nullif(count(*), 0), 1), 0)::DOUBLE AS completion_rate"
COUNTED = "work_kind <> 'PLANNED' AND task_status <> 'Ambiguous'"
SIX = ("Completed", "In Progress", "Pending", "Blocked", "Cancelled", "Not Started")
FLAGS = "count(*) FILTER (WHERE slow_task_flag = 'TRUE') AS slow_tasks, count(*) FILTER (WHERE repeated_task_flag) AS repeated_tasks"


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def kept_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tasks`` with the keys of repeats, joined and written once: the analyses go over them several times, each time for
    some of their columns."""
    return once(spark, sf_dir, "facts", lambda: repeats.keyed(tasks(spark, sf_dir), PERSON))


def wordings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "merged-wordings", lambda: repeats.merged_wordings(kept_tasks(spark, sf_dir), REPEATS, PERSON))


def groups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "repeat-groups", lambda: repeats.repeat_groups(kept_tasks(spark, sf_dir), REPEATS, PERSON, wordings_of(spark, sf_dir)))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with what the analyses say of them."""

    def build() -> DataFrame:
        analysed = slow.slow_analysis(kept_tasks(spark, sf_dir))
        return repeats.with_repeat_flag(analysed, wordings_of(spark, sf_dir), groups_of(spark, sf_dir), REPEATS, PERSON).drop("person", "wording")

    return once(spark, sf_dir, "analysed-facts", build)


def managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departments and who leads them: the nation's supplier with the smallest key."""
    found = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("manager"))
    return table(spark, sf_dir, "nation").join(found, F.col("n_nationkey") == F.col("s_nationkey")).select(F.upper("n_name").alias("department_name"), "manager")


MANAGERS_SQL = "managers AS (SELECT lower(n_name) AS key, arg_min(s_name, s_suppkey) AS manager FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)"


# --- dashboard -------------------------------------------------------------------------------------------------------


@register("kpis", with_flags(f"""SELECT f.owner_user_id, count(*) AS total, {counts('Completed', 'Pending', 'In Progress', 'Blocked')}, {RATE}, {FLAGS}, count(DISTINCT department) AS departments_reporting,
  count(DISTINCT employee_name) FILTER (WHERE is_person) AS employees_reporting, count(*) FILTER (WHERE slow_task_flag = 'INSUFFICIENT_DATA') AS insufficient_duration,
  count(*) FILTER (WHERE slow_task_flag = 'INSUFFICIENT_DATA' AND actual_duration IS NULL) AS untimed, min(task_date) AS first_date, max(task_date) AS last_date,
  (SELECT count(*) FROM groups g WHERE g.owner_user_id = f.owner_user_id) AS repeat_groups, (SELECT count(*) FROM groups g WHERE g.owner_user_id = f.owner_user_id AND classification IN ('Needs Review', 'Potential Duplication')) AS repeat_attention
  FROM flagged f WHERE {COUNTED} GROUP BY 1"""))
def _kpis(spark, sf_dir):
    return dashboard.kpis(flagged(spark, sf_dir), groups_of(spark, sf_dir))


for _grain in ("day", "week", "month"):

    @register(f"period_series_{_grain}", with_facts(f"""SELECT *, total - completed - cancelled AS backlog FROM (SELECT date_trunc('{_grain}', task_date)::DATE AS period, count(*) AS total, {counts(*SIX)}, {RATE},
      count(DISTINCT employee_name) FILTER (WHERE is_person) AS employees, count(DISTINCT department) AS departments FROM tasks WHERE {COUNTED} GROUP BY 1 ORDER BY 1 DESC LIMIT 60)"""))
    def _series(spark, sf_dir, grain=_grain):
        return dashboard.period_series(tasks(spark, sf_dir), grain)


@register("period_series_scoped", with_facts(f"""SELECT *, total - completed - cancelled AS backlog FROM (SELECT date_trunc('month', task_date)::DATE AS period, count(*) AS total, {counts(*SIX)}, {RATE},
  count(DISTINCT employee_name) FILTER (WHERE is_person) AS employees, count(DISTINCT department) AS departments FROM tasks WHERE {COUNTED} AND owner_user_id = 2 AND department = 'NATION_6' AND task_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1 ORDER BY 1 DESC LIMIT 12)"""))
def _series_scoped(spark, sf_dir):
    return dashboard.period_series(tasks(spark, sf_dir), "month", 12, owner=2, department="NATION_6", first="1996-01-01", last="1999-12-31")


@register("department_breakdown", with_flags(f""", {MANAGERS_SQL} SELECT d.*, coalesce(m.manager, '') AS manager FROM (SELECT coalesce(department, 'Unknown') AS department, count(*) AS total, {counts('Completed', 'Pending', 'In Progress', 'Blocked')}, {RATE}, {FLAGS},
  count(DISTINCT employee_name) FILTER (WHERE is_person) AS employees FROM flagged WHERE {COUNTED} GROUP BY 1) d LEFT JOIN managers m ON m.key = lower(d.department)"""))
def _breakdown(spark, sf_dir):
    return dashboard.department_breakdown(flagged(spark, sf_dir), managers(spark, sf_dir))


@register("status_distribution", with_facts(f"SELECT task_status AS name, count(*) AS value FROM tasks WHERE {COUNTED} GROUP BY 1"))
def _status(spark, sf_dir):
    return dashboard.status_distribution(tasks(spark, sf_dir))


_ACTIVITY = f"SELECT employee_name AS employee, max(department) AS department, bool_or(is_person) AS p, count(*) AS total, {counts('Completed')}, {RATE}, count(DISTINCT task_date) AS days FROM tasks WHERE {COUNTED} GROUP BY 1"


@register("employee_activity", with_facts(f"SELECT * EXCLUDE (p) FROM ({_ACTIVITY}) WHERE p ORDER BY total DESC, employee LIMIT 12"))
def _activity(spark, sf_dir):
    return dashboard.employee_activity(tasks(spark, sf_dir))


@register("hidden_names", with_facts(f"SELECT count(*) AS hidden_names, coalesce(sum(total), 0)::BIGINT AS hidden_tasks FROM ({_ACTIVITY}) WHERE NOT p"))
def _hidden(spark, sf_dir):
    return dashboard.hidden_names(tasks(spark, sf_dir))


@register("filter_options", with_facts("SELECT DISTINCT * FROM (SELECT 'department' AS kind, department AS name FROM tasks UNION ALL SELECT 'employee', employee_name FROM tasks UNION ALL SELECT 'employee', c_name FROM customer) WHERE name IS NOT NULL"))
def _options(spark, sf_dir):
    return dashboard.filter_options(tasks(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_name").alias("employee_name")))


@register("date_bounds", with_facts("SELECT owner_user_id, min(task_date) AS min_date, max(task_date) AS max_date FROM tasks GROUP BY 1"))
def _bounds(spark, sf_dir):
    return dashboard.date_bounds(tasks(spark, sf_dir))


@register("work_days", with_facts(f"SELECT DISTINCT task_date FROM tasks WHERE {COUNTED} ORDER BY task_date DESC LIMIT 45"))
def _work_days(spark, sf_dir):
    return dashboard.work_days(tasks(spark, sf_dir))


@register("latest_and_previous", with_facts(f"""SELECT period, total, previous_total, total - previous_total AS change, completion_rate FROM (SELECT period, total, lag(total) OVER (ORDER BY period) AS previous_total, completion_rate
  FROM (SELECT date_trunc('month', task_date)::DATE AS period, count(*) AS total, {RATE} FROM tasks WHERE {COUNTED} GROUP BY 1)) ORDER BY period DESC LIMIT 1"""))
def _latest(spark, sf_dir):
    return dashboard.latest_and_previous(dashboard.period_series(tasks(spark, sf_dir), "month"))


# --- summaries -------------------------------------------------------------------------------------------------------

_START = {"daily": "task_date", "weekly": "date_trunc('week', task_date)::DATE", "monthly": "date_trunc('month', task_date)::DATE"}
_END = {"daily": "period_start", "weekly": "period_start + 6", "monthly": "last_day(period_start)"}


def view_sql(grain: str) -> str:
    return f"""view_{grain} AS (SELECT *, ({_END[grain]})::DATE AS period_end FROM (SELECT owner_user_id, period_start, CASE WHEN grouping(department) = 1 THEN 'ALL' ELSE coalesce(department, 'Unassigned') END AS department, count(*) AS total_tasks, {counts(*SIX)}, {RATE}, {FLAGS},
      count(DISTINCT employee_name) AS employees_reporting FROM (SELECT *, {_START[grain]} AS period_start FROM flagged) GROUP BY GROUPING SETS ((owner_user_id, period_start, department), (owner_user_id, period_start))))"""


for _grain in ("daily", "weekly", "monthly"):

    @register(f"{_grain}_summary", with_flags(f", {view_sql(_grain)} SELECT * FROM view_{_grain}"))
    def _view(spark, sf_dir, grain=_grain):
        return summaries.period_view(flagged(spark, sf_dir), grain)


@register("daily_trend", with_flags(f", {view_sql('daily')} SELECT * FROM view_daily WHERE department = 'ALL' QUALIFY row_number() OVER (PARTITION BY owner_user_id ORDER BY period_start DESC) <= 14"))
def _trend(spark, sf_dir):
    return summaries.daily_trend(summaries.period_view(flagged(spark, sf_dir), "daily"))


@register("period_changes", with_flags(f""", {view_sql('monthly')} SELECT *, floor((completion_rate - prev_completion_rate) * 10 + 0.5) / 10 AS completion_rate_pp_change FROM (SELECT owner_user_id, department, period_start, completion_rate,
  lag(completion_rate) OVER (PARTITION BY owner_user_id, department ORDER BY period_start) AS prev_completion_rate FROM view_monthly)"""))
def _changes(spark, sf_dir):
    return summaries.period_changes(summaries.period_view(flagged(spark, sf_dir), "monthly"))


_ANCHORED = "anchored AS (SELECT *, date_diff('day', task_date, max(task_date) OVER (PARTITION BY owner_user_id)) AS age FROM flagged)"
_WINDOW_RATE = "coalesce(round(100.0 * count(*) FILTER (WHERE {0} AND task_status = 'Completed') / nullif(count(*) FILTER (WHERE {0}), 0), 1), 0)::DOUBLE"


@register("department_summary", with_flags(f""", {_ANCHORED} SELECT *, CASE WHEN prev_7d_tasks > 0 THEN floor((last_7d_completion_rate - prev_7d_completion_rate) * 10 + 0.5) / 10 END AS wow_pp_change FROM (
  SELECT owner_user_id, coalesce(department, 'Unassigned') AS department, count(*) AS total_tasks, {counts(*SIX)}, {RATE}, {FLAGS}, count(DISTINCT employee_name) AS employees_reporting, min(task_date) AS first_date, max(task_date) AS last_date,
  count(*) FILTER (WHERE age BETWEEN 0 AND 6) AS last_7d_tasks, count(*) FILTER (WHERE age BETWEEN 7 AND 13) AS prev_7d_tasks, {_WINDOW_RATE.format('age BETWEEN 0 AND 6')} AS last_7d_completion_rate, {_WINDOW_RATE.format('age BETWEEN 7 AND 13')} AS prev_7d_completion_rate
  FROM anchored GROUP BY 1, 2)"""))
def _departments(spark, sf_dir):
    return summaries.department_summary(flagged(spark, sf_dir))


@register("employee_summary", with_flags(f""", {_ANCHORED} SELECT owner_user_id, employee_name AS employee, max(department) AS department, nullif(arg_min(coalesce(department, chr(0)), (task_date, task_id)), chr(0)) AS first_department, count(*) AS total_tasks, {counts('Completed', 'Pending')}, {RATE}, {FLAGS},
  count(DISTINCT task_date) AS distinct_days_reported, count(*) FILTER (WHERE age BETWEEN 0 AND 6) AS last_7d_tasks, count(*) FILTER (WHERE age BETWEEN 7 AND 13) AS prev_7d_tasks, count(*) FILTER (WHERE age BETWEEN 0 AND 29) AS last_30d_tasks, count(*) FILTER (WHERE age BETWEEN 30 AND 59) AS prev_30d_tasks,
  CASE WHEN count(*) >= 30 AND count(DISTINCT task_date) >= 10 THEN 'Sufficient for trend' WHEN count(*) >= 10 THEN 'Indicative only' ELSE 'Insufficient — do not rank' END AS data_sufficiency FROM anchored GROUP BY 1, 2"""))
def _employees(spark, sf_dir):
    return summaries.employee_summary(flagged(spark, sf_dir))


_BI = f"""bi AS (SELECT owner_user_id, task_id, task_date, date_trunc('week', task_date)::DATE AS week_start, date_trunc('month', task_date)::DATE AS month_start, strftime(task_date, '%Y-%m') AS month_label, coalesce(nullif(department, ''), 'Not identified') AS department,
  employee_name AS employee, task, task_category AS category, task_status AS status, work_kind, {COUNTED} AS counted, {COUNTED} AND task_status = 'Completed' AS completed, {COUNTED} AND task_status NOT IN ('Completed', 'Cancelled') AS open_work,
  actual_duration, expected_duration, slow_task_flag = 'TRUE' AS is_slow, repeated_task_flag AS is_repeated FROM flagged)"""


@register("bi_tasks", with_flags(f", {_BI} SELECT * FROM bi"))
def _bi_tasks(spark, sf_dir):
    return summaries.bi_tasks(flagged(spark, sf_dir))


@register("bi_daily_by_department", with_flags(f""", {_BI} SELECT owner_user_id, task_date, department, count(*) FILTER (WHERE counted) AS tasks, count(*) FILTER (WHERE completed) AS completed, count(*) FILTER (WHERE open_work) AS open_work,
  coalesce(round(100.0 * count(*) FILTER (WHERE completed) / nullif(count(*) FILTER (WHERE counted), 0), 1), 0)::DOUBLE AS completion_rate, count(DISTINCT employee) FILTER (WHERE counted) AS employees FROM bi GROUP BY 1, 2, 3"""))
def _bi_daily(spark, sf_dir):
    return summaries.bi_daily_by_department(summaries.bi_tasks(flagged(spark, sf_dir)))


_SPAN = f"(SELECT min(period) FROM (SELECT DISTINCT date_trunc('month', task_date)::DATE AS period FROM tasks WHERE {COUNTED} AND owner_user_id = 2 ORDER BY 1 DESC LIMIT 12))"


@register("aligned_totals", with_flags(f"""SELECT (SELECT count(*) FROM tasks WHERE {COUNTED} AND owner_user_id = 2 AND task_date >= {_SPAN}) AS shown, department, count(*) AS total, {RATE}, {FLAGS} FROM flagged WHERE {COUNTED} AND owner_user_id = 2 AND task_date >= {_SPAN} GROUP BY 2"""))
def _aligned_totals(spark, sf_dir):
    facts = tasks(spark, sf_dir)
    rows = counted(dashboard.aligned(facts, flagged(spark, sf_dir), "month", 12, owner=2))
    shown = dashboard.period_series(facts, "month", 12, owner=2).agg(F.sum("total").alias("shown"))
    panel = rows.groupBy("department").agg(total().alias("total"), completion_rate().alias("completion_rate"), F.count_if(F.col("slow_task_flag") == "TRUE").alias("slow_tasks"), F.count_if("repeated_task_flag").alias("repeated_tasks"))
    return panel.withColumn("shown", shown.scalar())


# --- slow and repeated work ------------------------------------------------------------------------------------------


@register("slow_analysis", with_slow("SELECT task_id, expected, baseline_source, baseline_sample_size, slow_variance_hours, slow_task_flag FROM slow"))
def _slow_analysis(spark, sf_dir):
    return slow.slow_analysis(tasks(spark, sf_dir)).select("task_id", "expected", "baseline_source", "baseline_sample_size", "slow_variance_hours", "slow_task_flag")


_SLOW_LIST = """SELECT owner_user_id, task_id, task_date, department, employee_name AS employee, task, task_category, task_status, floor(expected * 100 + 0.5) / 100 AS expected_duration, actual_duration, slow_variance_hours AS variance_hours,
  floor(100 * (actual_duration - expected) / expected * 10 + 0.5) / 10 AS variance_pct, baseline_source, baseline_sample_size FROM slow WHERE slow_task_flag = 'TRUE'"""


@register("slow_tasks", with_slow(_SLOW_LIST))
def _slow_tasks(spark, sf_dir):
    return slow.slow_tasks(slow.slow_analysis(tasks(spark, sf_dir)))


@register("slow_tasks_top25", with_slow(f"{_SLOW_LIST} AND task ILIKE '%re%' ORDER BY variance_hours DESC, task_id LIMIT 25"))
def _slow_top(spark, sf_dir):
    return slow.slow_tasks(slow.slow_analysis(tasks(spark, sf_dir)), 25, "re")


@register("repeat_groups", with_flags("SELECT * FROM groups"))
def _groups(spark, sf_dir):
    return groups_of(spark, sf_dir)


@register("repeat_groups_listed", with_flags("SELECT * FROM groups WHERE last_date >= DATE '2001-01-01' AND first_date <= DATE '2001-03-31' AND task ILIKE '%bolt%'"))
def _listed(spark, sf_dir):
    return repeats.list_groups(groups_of(spark, sf_dir), first="2001-01-01", last="2001-03-31", search="bolt")


joins.register_all(register, with_facts, tasks, table)
ingest.register_all(register, with_facts, tasks, table)
parts.register_all(register, with_facts, tasks)
evidence.register_all(register, with_facts, table)
messages.register_all(register, mailbox, with_flags, flagged, groups_of)
merges.register_all(register, with_facts, tasks, table, mailbox)
digests.register_all(register, with_facts, with_flags, tasks, table, flagged, groups_of)
narratives.register_all(register, with_flags, flagged, groups_of)
recordsets.register_all(register, with_facts, tasks, table)
headers.register_all(register, table)
detection.register_all(register, mailbox, table)
