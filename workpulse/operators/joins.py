"""Lookups, semi and anti joins, fuzzy matches and set operations over facts and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyify, let, short_hash


def resolve_people(names: DataFrame, roster: DataFrame) -> DataFrame:
    """``names`` (name) with employee_id: by key of the name or an alias, else by a first name that one person has.

    ``roster``: employee_id, employee_name, aliases (array).
    """
    keys = roster.select("employee_id", F.explode(F.concat(F.array("employee_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("known"))
    exact = keys.groupBy(keyify(F.col("known")).alias("key")).agg(F.min("employee_id").alias("by_name"))
    first = roster.groupBy(F.get(F.split(keyify(F.col("employee_name")), " "), F.lit(0)).alias("first")).agg(F.min("employee_id").alias("by_first"), F.count("*").alias("n")).where("n = 1").drop("n")
    key = keyify(F.col("name"))
    out = names.withColumn("key", key).join(exact, "key", "left")
    out = out.withColumn("first", F.when(~F.col("key").contains(" "), F.col("key"))).join(first, "first", "left")
    return out.select(*names.columns, F.coalesce("by_name", "by_first").alias("employee_id"))


def mention(text: Column, names: list[tuple[str, str]]) -> Column:
    """The name whose keyword, as whole words, is the longest that a text holds (ties: by keyword and name), else null.

    ``names`` is a dimension of some hundreds at most: (name, keyword); it becomes part of the expression.
    """
    found: Column | None = None
    for _, keyword, name in sorted((-len(k), k, n) for n, k in names):
        hit = lambda hay, keyword=keyword: F.contains(hay, F.lit(f" {keyword} "))
        found = _when(found, hit, name)
    return let(F.concat(F.lit(" "), keyify(text), F.lit(" ")), found) if found else F.lit(None).cast("string")


def _when(so_far, hit, name):
    """A function of a text: ``so_far`` and one more case."""
    if so_far is None:
        return lambda hay: F.when(hit(hay), F.lit(name))
    return lambda hay: so_far(hay).when(hit(hay), F.lit(name))


def mentioned(texts: DataFrame, key_col: str, text_col: str, names: list[tuple[str, str]]) -> DataFrame:
    """``texts`` with what each mentions; see ``mention``."""
    return texts.select(F.col(key_col), mention(F.col(text_col), names).alias("mentioned"))


def misspelt(names: DataFrame, roster: DataFrame, most: int = 2) -> DataFrame:
    """``names`` (name) that aren't on the roster with the nearest roster name: same number of words, same initials,
    eight letters or more, edit distance of at most ``most``. Candidates meet by an equi-join on words and initials."""

    def sided(df: DataFrame, column: str, alias: str) -> DataFrame:
        low = F.lower(F.trim(F.col(column)))
        initials = F.array_join(F.transform(F.split(low, " "), lambda w: F.substring(w, 1, 1)), "")
        return df.select(F.col(column).alias(alias), low.alias(f"{alias}_low"), initials.alias("initials")).where(F.length(f"{alias}_low") >= 8)

    left, right = sided(names, "name", "name"), sided(roster, "employee_name", "suggestion")
    pairs = left.join(right, "initials").withColumn("distance", F.levenshtein("name_low", "suggestion_low", most)).where(F.col("distance").between(1, most))
    return pairs.groupBy("name").agg(F.min(F.struct("distance", "suggestion")).alias("best")).select("name", F.col("best.suggestion").alias("suggestion"), F.col("best.distance").alias("distance"))


def route(new: DataFrame, known: DataFrame, order: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """``new`` (owner_user_id, fingerprint, document_id) with its route against the stored owners of fingerprints:
    ``insert``, ``skip`` (the same document again) or ``reject`` (another document has it). Of rows of one batch with
    the same fingerprint the first by ``order`` (columns of ``new``, such as when a document arrived) is the owner."""
    first = F.first("document_id").over(Window.partitionBy("owner_user_id", "fingerprint").orderBy(*order))
    out = new.withColumn("first", first).join(known.withColumnRenamed("document_id", "owner_document"), ["owner_user_id", "fingerprint"], "left")
    owner = F.coalesce("owner_document", "first")
    label = F.when(owner != F.col("document_id"), "reject").when(F.col("owner_document").isNotNull(), "skip").otherwise("insert")
    return out.select(*new.columns, label.alias("route"))


def occurrence_fingerprints(rows: DataFrame, base: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their ordinal among rows of the same document and base key, and a fingerprint over both."""
    ordinal = F.row_number().over(Window.partitionBy("document_id", *base).orderBy(*order))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in base]
    return rows.withColumn("ordinal", ordinal).withColumn("fingerprint", short_hash(F.concat_ws("|", *parts, F.col("ordinal").cast("string")), 40))


def register_all(register, with_facts, tasks, table) -> None:
    """The queries of this module over the driver's tables."""

    @register("people_activity", with_facts("SELECT c.c_name AS employee, count(t.task_id) AS tasks, min(t.task_date) AS first_date, max(t.task_date) AS last_date FROM customer c LEFT JOIN tasks t ON t.employee_name = c.c_name GROUP BY 1"))
    def _(spark, sf_dir):
        people = table(spark, sf_dir, "customer").select(F.col("c_name").alias("employee"))
        rows = people.join(tasks(spark, sf_dir), F.col("employee") == F.col("employee_name"), "left")
        return rows.groupBy("employee").agg(F.count("task_id").alias("tasks"), F.min("task_date").alias("first_date"), F.max("task_date").alias("last_date"))

    @register("people_without_work", with_facts("SELECT c_name AS employee FROM customer c WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.employee_name = c.c_name AND t.task_status = 'Completed' AND t.work_kind <> 'PLANNED')"))
    def _(spark, sf_dir):
        people = table(spark, sf_dir, "customer").select(F.col("c_name").alias("employee"))
        done = tasks(spark, sf_dir).where("task_status = 'Completed' and work_kind <> 'PLANNED'")
        return people.join(done, F.col("employee") == F.col("employee_name"), "left_anti")

    @register("silent_departments", with_facts("SELECT n_name AS department FROM nation WHERE lower(n_name) NOT IN (SELECT lower(department) FROM tasks WHERE department IS NOT NULL AND task_date = (SELECT max(task_date) FROM tasks))"))
    def _(spark, sf_dir):
        rows = tasks(spark, sf_dir)
        last = rows.agg(F.max("task_date").alias("last"))
        spoke = rows.join(F.broadcast(last), F.col("task_date") == F.col("last")).select(F.lower("department").alias("key"))  # one row
        return table(spark, sf_dir, "nation").select(F.col("n_name").alias("department")).join(spoke, F.lower("department") == F.col("key"), "left_anti")

    @register("messages_without_work_sibling", "SELECT event_id, user_id, event_type FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase' AND s.event_id <> e.event_id AND s.ts::DATE = e.ts::DATE)")
    def _(spark, sf_dir):
        events = table(spark, sf_dir, "events")
        left = events.where("event_type = 'error'").alias("e")
        right = events.where("event_type = 'purchase'").alias("s")
        same = (F.col("s.user_id") == F.col("e.user_id")) & (F.to_date("s.ts") == F.to_date("e.ts")) & (F.col("s.event_id") != F.col("e.event_id"))
        return left.join(right, same, "left_anti").select("event_id", "user_id", "event_type")

    @register("purchasers_errors", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
    def _(spark, sf_dir):
        events = table(spark, sf_dir, "events")
        return events.where("event_type = 'error'").select("event_id", "user_id").join(events.where("event_type = 'purchase'").select("user_id"), "user_id", "left_semi")

    names = [("Widgets", "widget"), ("Red widgets", "red widget"), ("Bolts", "bolt"), ("Gears", "gear"), ("Hot goods", "hot")]
    listed = ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(names))

    @register("task_category_by_keyword", f"""SELECT p_partkey, arg_min(name, (-length(keyword), keyword, name)) AS mentioned FROM part LEFT JOIN (VALUES {listed}) k(no, name, keyword) ON contains(' ' || lower(p_name) || ' ', ' ' || keyword || ' ') GROUP BY 1""")
    def _(spark, sf_dir):
        return mentioned(table(spark, sf_dir, "part"), "p_partkey", "p_name", names)

    @register("manager_of_task", with_facts("SELECT t.task_id, s.manager FROM tasks t LEFT JOIN (SELECT n_name, min(s_name) AS manager FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) s ON s.n_name = t.department"))
    def _(spark, sf_dir):
        led = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.min("s_name").alias("manager"))
        return tasks(spark, sf_dir).join(led, F.col("n_name") == F.col("department"), "left").select("task_id", "manager")

    @register("fingerprint_routes", with_facts("""SELECT document_id, fingerprint, CASE WHEN coalesce(owner_document, first) <> document_id THEN 'reject' WHEN owner_document IS NOT NULL THEN 'skip' ELSE 'insert' END AS route FROM (
      SELECT n.document_id, n.fingerprint, min(n.document_id) OVER (PARTITION BY n.owner_user_id, n.fingerprint) AS first, k.document_id AS owner_document FROM (SELECT owner_user_id, employee_name AS document_id, sha1(concat_ws('|', team, task, CAST(task_date AS VARCHAR))) AS fingerprint FROM tasks) n
      LEFT JOIN (SELECT owner_user_id, sha1(concat_ws('|', team, task, CAST(task_date AS VARCHAR))) AS fingerprint, min(employee_name) AS document_id FROM tasks WHERE task_status = 'Completed' GROUP BY 1, 2) k ON k.owner_user_id = n.owner_user_id AND k.fingerprint = n.fingerprint)"""))
    def _(spark, sf_dir):
        rows = tasks(spark, sf_dir).withColumn("fingerprint", F.sha1(F.concat_ws("|", "team", "task", F.col("task_date").cast("string")).cast("binary"))).withColumn("document_id", F.col("employee_name"))
        known = rows.where("task_status = 'Completed'").groupBy("owner_user_id", "fingerprint").agg(F.min("document_id").alias("document_id"))
        return route(rows.select("owner_user_id", "fingerprint", "document_id"), known).select("document_id", "fingerprint", "route")

    @register("occurrence_fingerprints", with_facts("SELECT task_id, ordinal, sha1(concat_ws('|', coalesce(department, ''), task, CAST(ordinal AS VARCHAR))) AS fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY employee_name, department, task ORDER BY task_date, task_id)::INT AS ordinal FROM tasks)"))
    def _(spark, sf_dir):
        rows = tasks(spark, sf_dir).withColumn("document_id", F.col("employee_name"))
        return occurrence_fingerprints(rows, ["department", "task"], ["task_date", "task_id"]).select("task_id", "ordinal", "fingerprint")
