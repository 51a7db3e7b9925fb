"""Merges of new rows into stored tables, roster rules, re-filing, and what leaves the engine.

A stored table is never changed in place: a merge gives the table's next version, which the caller writes (by overwriting
a folder, or the partitions of an owner). So a merge that runs again after a failure gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, keyify, short_hash

Rule = Callable[[Column, Column], Column]

#: How a merge makes a column of a row that both sides have, from its old and its new value.
RULES: dict[str, Rule] = {
    "new": lambda old, new: new,
    "old": lambda old, new: old,
    "fill": lambda old, new: F.coalesce(new, old),
    "filled": lambda old, new: F.coalesce(F.nullif(new, F.lit("")), old),
    "sum": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
    "greatest": lambda old, new: F.greatest(old, new),
    "union": lambda old, new: F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))),
}


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str | Rule], key: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The next version of ``stored``: its rows, merged column by column with the rows of ``new`` that have their keys,
    and the other rows of ``new``. Columns without a rule take the new value; keys are compared by ``key`` and keep the
    stored spelling. ``new`` has a row for each key at most."""
    a = stored.select(F.struct(*stored.columns).alias("a"), *(key(F.col(k)).alias(f"_{k}") for k in keys))
    b = new.select(F.struct(*stored.columns).alias("b"), *(key(F.col(k)).alias(f"_{k}") for k in keys))
    both = a.join(b, [f"_{k}" for k in keys], "full_outer")

    def merged(name: str) -> Column:
        old, fresh = F.col(f"a.{name}"), F.col(f"b.{name}")
        rule = rules.get(name, "old" if name in keys else "new")
        found = (RULES[rule] if isinstance(rule, str) else rule)(old, fresh)
        return F.when(F.col("b").isNull(), old).when(F.col("a").isNull(), fresh).otherwise(found).alias(name)

    return both.select(*(merged(c) for c in stored.columns))


def insert_if_absent(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of ``new`` whose keys ``stored`` doesn't have, one of each, the first by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = new.withColumn("place", place).where(F.col("place") == 1).drop("place")
    return first.join(stored.select(*keys).distinct(), keys, "left_anti").select(new.columns)


def update_from(stored: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``stored`` with the columns of ``values`` written over where it has a row of that key."""
    names = [c for c in values.columns if c != key]
    given = values.select(key, F.struct(*names).alias("given"))
    rows = stored.join(given, key, "left")
    keep = [F.when(F.col("given").isNotNull(), F.col(f"given.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in stored.columns]
    return rows.select(*keep, *(F.col(f"given.{c}") for c in names if c not in stored.columns))


def replace_owners(stored: DataFrame, fresh: DataFrame, owner: str = "owner_user_id") -> DataFrame:
    """``stored`` with all rows of the owners in ``fresh`` replaced; what a dynamic overwrite of owner partitions does."""
    return stored.join(fresh.select(owner).distinct(), owner, "left_anti").select(stored.columns).unionByName(fresh.select(stored.columns))


def keep_newest(log: DataFrame, n: int, stamp: str, key: str) -> DataFrame:
    """The newest ``n`` rows of each owner's log; older ones go."""
    place = F.row_number().over(Window.partitionBy("owner_user_id").orderBy(F.desc(stamp), F.desc(key)))
    return log.withColumn("place", place).where(F.col("place") <= n).drop("place")


# --- rosters ---------------------------------------------------------------------------------------------------------


def roster_names(roster: DataFrame) -> DataFrame:
    """(key, employee_name, department): names and aliases of people, by key; of people with one key the first by name."""
    every = F.concat(F.array("employee_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = roster.select("employee_name", "department", F.explode(every).alias("known")).select(keyify(F.col("known")).alias("key"), "employee_name", "department").where("key != ''")
    return rows.groupBy("key").agg(F.min(F.struct("employee_name", "department")).alias("who")).select("key", "who.*")


def refiled(tasks: DataFrame, roster: DataFrame, document: str = "source_document_id") -> DataFrame:
    """Facts under the names and departments that the roster gives their people, with fingerprints made anew: ordinals
    count equal rows of an owner's document by task_id. Unknown people keep what they had. New columns: ``moved``,
    ``old_department``. ``roster`` (employee_name, department, aliases) is joined by key, broadcast if it is small."""
    people = roster.where("coalesce(department, '') != ''")
    for flag, wanted in (("active", True), ("auto_created", False)):  # people who left, or whom the importer made up, say nothing
        if flag in roster.columns:
            people = people.where(F.coalesce(F.col(flag), F.lit(wanted)) == wanted)
    names = roster_names(people).select("key", F.col("employee_name").alias("right_name"), F.col("department").alias("right_department"))
    rows = tasks.withColumn("key", keyify(F.col("employee_name"))).join(names, "key", "left").drop("key")
    name, department = F.coalesce("right_name", "employee_name"), F.coalesce("right_department", "department", F.lit(""))
    moved = (name != F.col("employee_name")) | (department != F.coalesce("department", F.lit("")))
    rows = rows.withColumns({"moved": moved, "old_department": F.col("department")})
    rows = rows.withColumns({"employee_name": name, "department": department})
    parts = [F.col("task_date"), keyify(F.col("employee_name")), keyify(F.col("department")), F.col("task_normalized"), F.col("task_status")]
    ordinal = F.row_number().over(Window.partitionBy("owner_user_id", F.coalesce(document, F.lit("")), *parts).orderBy("task_id"))
    return rows.withColumn("task_fingerprint", fingerprint(*parts, ordinal)).select(*(c for c in tasks.columns if c != "task_fingerprint"), "task_fingerprint", "moved", "old_department")


def moves(rows: DataFrame) -> DataFrame:
    """How many of an owner's facts in ``refiled`` moved from which department to which."""
    return rows.where("moved").groupBy("owner_user_id", F.coalesce(F.nullif(F.col("old_department"), F.lit("")), F.lit("Unassigned")).alias("from"), F.col("department").alias("to")).agg(F.count("*").alias("tasks"))


def still_unassigned(rows: DataFrame) -> DataFrame:
    return rows.where("department = ''").groupBy("owner_user_id", "employee_name").agg(F.count("*").alias("tasks"))


def orphans(people: DataFrame, tasks: DataFrame) -> DataFrame:
    """People whom the importer made up and who have no facts any more."""
    return people.where("auto_created").join(tasks.select("employee_name").distinct(), "employee_name", "left_anti").select(people.columns)


def created_people(tasks: DataFrame, roster: DataFrame, default_department: str = "Unassigned") -> DataFrame:
    """People in facts whom the roster doesn't know, as the records that the importer makes up for them."""
    key = keyify(F.col("employee_name"))
    unknown = tasks.withColumn("key", key).where("key != ''").join(roster_names(roster).select("key"), "key", "left_anti")
    first = unknown.groupBy("key").agg(F.min("employee_name").alias("employee_name"), F.min_by("department", F.struct("task_date", "task_id")).alias("department"))
    return first.select(F.concat(F.lit("EMP-"), F.upper(short_hash(F.col("key"), 6))).alias("employee_id"), "employee_name", F.coalesce("department", F.lit(default_department)).alias("department"), F.lit(True).alias("auto_created"))


def departments_by_alias(names: DataFrame, departments: DataFrame) -> DataFrame:
    """``names`` (name) with the department that has this name or alias."""
    every = F.concat(F.array("department_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    known = departments.select("department_name", F.explode(every).alias("known")).groupBy(keyify(F.col("known")).alias("key")).agg(F.min("department_name").alias("department"))
    return names.withColumn("key", keyify(F.col("name"))).join(known, "key", "left").drop("key")


def sender_people(senders: DataFrame, roster: DataFrame) -> DataFrame:
    """``senders`` (address) with the roster's person of this address."""
    known = roster.where("email is not null").groupBy(F.lower("email").alias("address_key")).agg(F.min("employee_name").alias("employee_name"))
    return senders.withColumn("address_key", F.lower(F.trim("address"))).join(known, "address_key", "left").drop("address_key")


def sender_departments(senders: DataFrame, departments: DataFrame) -> DataFrame:
    """``senders`` (domain) with the first department (by ``ordinal``) that lists this domain."""
    known = departments.select("department_name", "ordinal", F.explode("sender_domains").alias("d")).groupBy(F.lower("d").alias("domain_key")).agg(F.min_by("department_name", "ordinal").alias("department"))
    return senders.withColumn("domain_key", F.lower("domain")).join(known, "domain_key", "left").drop("domain_key")


# --- what leaves -----------------------------------------------------------------------------------------------------


def export(rows: DataFrame, order: list[str], most: int = 50_000) -> DataFrame:
    """The first ``most`` rows by ``order`` with ``truncated``: whether there were more. The limit is the export's."""
    first = rows.orderBy(*order).limit(most + 1)
    place = F.row_number().over(Window.orderBy(*order))  # over most + 1 rows
    marked = first.withColumn("place", place).withColumn("truncated", F.max("place").over(Window.partitionBy()) > most)
    return marked.where(F.col("place") <= most).drop("place")


def csv_field(c: Column) -> Column:
    """A value as a field of a CSV line: in quotes if it holds a comma, a quote or a line break."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.array_join(F.array(*(csv_field(F.col(c)) for c in rows.columns)), ",").alias("line"))


def register_all(register, with_facts, tasks, table, mailbox) -> None:
    made = mailbox.with_mail
    even = "report_id LIKE '%0' OR report_id LIKE '%3'"
    columns = ("owner_user_id", "report_id", "processing_status", "rows_extracted", "rows_inserted", "evidence", "department")

    def halves(spark, sf_dir):
        """A stored table of some messages, and a batch that sends some of them again, changed, with others."""
        rows = mailbox.mail(spark, sf_dir).select(*columns)
        again = rows.where("rows_extracted % 2 = 0").withColumns({"rows_inserted": F.col("rows_extracted"), "evidence": F.nullif(F.concat(F.lit("again "), F.col("report_id")), F.lit("")), "department": F.when(F.col("rows_extracted") % 4 == 0, "").otherwise(F.lit("MOVED"))})
        return rows.where(even), again

    sides = f"""old AS (SELECT {', '.join(columns)} FROM mail WHERE {even}), new AS (SELECT owner_user_id, report_id, processing_status, rows_extracted, rows_extracted AS rows_inserted, 'again ' || report_id AS evidence,
      CASE WHEN rows_extracted % 4 = 0 THEN '' ELSE 'MOVED' END AS department FROM mail WHERE rows_extracted % 2 = 0)"""
    merged = """SELECT coalesce(o.owner_user_id, n.owner_user_id) AS owner_user_id, coalesce(o.report_id, n.report_id) AS report_id, coalesce(n.processing_status, o.processing_status) AS processing_status, coalesce(n.rows_extracted, o.rows_extracted) AS rows_extracted,
      CASE WHEN n.report_id IS NULL THEN o.rows_inserted WHEN o.report_id IS NULL THEN n.rows_inserted ELSE {0} END AS rows_inserted, coalesce(n.evidence, o.evidence) AS evidence,
      CASE WHEN n.report_id IS NULL THEN o.department WHEN o.report_id IS NULL THEN n.department ELSE coalesce(nullif(n.department, ''), o.department) END AS department FROM old o FULL JOIN new n ON n.owner_user_id = o.owner_user_id AND n.report_id = o.report_id"""
    for name, rule, sql in (("document_upsert", "sum", "coalesce(o.rows_inserted, 0) + coalesce(n.rows_inserted, 0)"), ("mail_upsert", "greatest", "greatest(o.rows_inserted, n.rows_inserted)")):

        @register(name, made(f", {sides} {merged.format(sql)}"))
        def _(spark, sf_dir, rule=rule):
            old, new = halves(spark, sf_dir)
            return upsert(old, new, ["owner_user_id", "report_id"], {"rows_inserted": rule, "department": "filled"})

    @register("rejections_inserted", made("SELECT * FROM (SELECT * FROM rejections WHERE rejection_id % 2 = 0) n WHERE NOT EXISTS (SELECT 1 FROM rejections s WHERE s.rejection_id % 3 = 0 AND s.document_id = n.document_id AND s.owner_user_id = n.owner_user_id AND s.rejection_reason = n.rejection_reason)"))
    def _(spark, sf_dir):
        rows = mailbox.rejections(spark, sf_dir)
        sent = rows.where("rejection_id % 2 = 0")
        return insert_if_absent(rows.where("rejection_id % 3 = 0"), sent.unionAll(sent.where("rejection_id % 4 = 0")), ["owner_user_id", "document_id", "rejection_reason"], "rejection_id")

    @register("owners_replaced", made("SELECT owner_user_id, report_id, rows_extracted FROM mail WHERE owner_user_id > 2 UNION ALL SELECT owner_user_id, report_id, rows_extracted + 1000 FROM mail WHERE owner_user_id <= 2 AND rows_extracted > 5"))
    def _(spark, sf_dir):
        rows = mailbox.mail(spark, sf_dir).select("owner_user_id", "report_id", "rows_extracted")
        return replace_owners(rows, rows.where("owner_user_id <= 2 and rows_extracted > 5").withColumn("rows_extracted", F.col("rows_extracted") + 1000))

    @register("log_trimmed", made("SELECT run_id, owner_user_id FROM runs QUALIFY row_number() OVER (PARTITION BY owner_user_id ORDER BY started_at DESC, run_id DESC) <= 50"))
    def _(spark, sf_dir):
        return keep_newest(mailbox.runs(spark, sf_dir), 50, "started_at", "run_id").select("run_id", "owner_user_id")

    def roster(spark, sf_dir, table=table):
        """Two of three customers under the name that they are called, with the name in facts as an alias."""
        rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("c_custkey % 3 != 0")
        return rows.select(
            F.concat(F.lit("Person "), F.col("c_custkey").cast("string")).alias("employee_name"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("TEAM "), F.col("n_name"))).alias("department"),
            F.array("c_name").alias("aliases"), F.concat(F.lit("U"), F.col("c_custkey").cast("string"), F.lit("@Example.com")).alias("email"),
        )

    people = "roster AS (SELECT 'Person ' || c_custkey AS employee_name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'TEAM ' || n_name END AS department, c_name AS alias, 'U' || c_custkey || '@Example.com' AS email FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0)"
    key = "trim(regexp_replace(regexp_replace(lower({0}), '[.]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'))"
    filed = f""", {people}, filed AS (SELECT *, row_number() OVER (PARTITION BY owner_user_id, doc, task_date, {key.format('right_name')}, {key.format('right_department')}, task_normalized, task_status ORDER BY task_id) AS ordinal FROM (
      SELECT t.*, strftime(task_date, '%Y-%m') AS doc, coalesce(r.employee_name, t.employee_name) AS right_name, coalesce(r.department, t.department, '') AS right_department FROM tasks t LEFT JOIN roster r ON r.alias = t.employee_name AND r.department <> ''))"""
    documents = lambda s, d: tasks(s, d).withColumn("source_document_id", F.date_format("task_date", "yyyy-MM"))
    refile_sql = lambda rest: with_facts(filed + rest)

    @register("refiled_tasks", refile_sql(f""" SELECT task_id, right_name AS employee_name, right_department AS department, (right_name <> employee_name OR right_department <> coalesce(department, '')) AS moved,
      sha1(concat_ws('|', CAST(task_date AS VARCHAR), {key.format('right_name')}, {key.format('right_department')}, task_normalized, task_status, CAST(ordinal AS VARCHAR))) AS task_fingerprint FROM filed"""))
    def _(spark, sf_dir):
        return refiled(documents(spark, sf_dir), roster(spark, sf_dir)).select("task_id", "employee_name", "department", "moved", "task_fingerprint")

    @register("refile_moves", refile_sql(" SELECT owner_user_id, coalesce(department, 'Unassigned') AS \"from\", right_department AS \"to\", count(*) AS tasks FROM filed WHERE right_name <> employee_name OR right_department <> coalesce(department, '') GROUP BY 1, 2, 3"))
    def _(spark, sf_dir):
        return moves(refiled(documents(spark, sf_dir), roster(spark, sf_dir)))

    @register("still_unassigned", refile_sql(" SELECT owner_user_id, right_name AS employee_name, count(*) AS tasks FROM filed WHERE right_department = '' GROUP BY 1, 2"))
    def _(spark, sf_dir):
        return still_unassigned(refiled(documents(spark, sf_dir), roster(spark, sf_dir)))

    @register("created_people", with_facts(f""", {people} SELECT 'EMP-' || upper(substr(sha1(key), 1, 6)) AS employee_id, min(employee_name) AS employee_name, coalesce(nullif(arg_min(coalesce(department, chr(0)), (task_date, task_id)), chr(0)), 'Unassigned') AS department, TRUE AS auto_created
      FROM (SELECT *, {key.format('employee_name')} AS key FROM tasks) t WHERE NOT EXISTS (SELECT 1 FROM roster r WHERE r.alias = t.employee_name) GROUP BY key"""))
    def _(spark, sf_dir):
        return created_people(tasks(spark, sf_dir), roster(spark, sf_dir))

    @register("orphan_people", with_facts("SELECT c_name AS employee_name, c_custkey % 2 = 0 AS auto_created FROM customer WHERE c_custkey % 2 = 0 AND c_name NOT IN (SELECT employee_name FROM tasks WHERE task_status = 'Completed')"))
    def _(spark, sf_dir):
        made_up = table(spark, sf_dir, "customer").select(F.col("c_name").alias("employee_name"), (F.col("c_custkey") % 2 == 0).alias("auto_created"))
        return orphans(made_up, tasks(spark, sf_dir).where("task_status = 'Completed'"))

    @register("roster_upsert", f"WITH {people} SELECT coalesce(o.c_name, n.alias) AS employee_name, CASE WHEN n.alias IS NULL THEN o.c_mktsegment ELSE n.department END AS department, n.alias IS NULL AS auto_created, CASE WHEN n.alias IS NULL THEN o.c_name ELSE concat_ws(',', o.c_name, n.employee_name) END AS aliases FROM customer o LEFT JOIN roster n ON lower(n.alias) = lower(o.c_name)")
    def _(spark, sf_dir):
        stored = table(spark, sf_dir, "customer").select(F.col("c_name").alias("employee_name"), F.col("c_mktsegment").alias("department"), F.lit(True).alias("auto_created"), F.array("c_name").alias("aliases"))
        new = roster(spark, sf_dir).select(F.upper(F.col("aliases")[0]).alias("employee_name"), "department", F.lit(False).alias("auto_created"), F.array("employee_name", F.lit("")).alias("aliases"))
        return upsert(stored, new, ["employee_name"], {"aliases": "union"}, F.lower).withColumn("aliases", F.array_join("aliases", ","))

    @register("sender_people", made(f", {people} SELECT m.report_id, m.sender AS address, r.employee_name FROM mail m LEFT JOIN roster r ON lower(r.email) = m.sender"))
    def _(spark, sf_dir):
        return sender_people(mailbox.mail(spark, sf_dir).select("report_id", F.col("sender").alias("address")), roster(spark, sf_dir))

    @register("department_lookup", "SELECT s_name AS name, n_name AS department FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND s_suppkey % 2 = 0")
    def _(spark, sf_dir):
        nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
        known = supplier.where("s_suppkey % 2 = 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.collect_list("s_name").alias("aliases"))
        return departments_by_alias(supplier.select(F.col("s_name").alias("name")), known.withColumnRenamed("n_name", "department_name"))

    @register("sender_departments", made("SELECT report_id, split_part(sender, '@', 1) AS domain, (SELECT min(n_name) FROM nation WHERE lower(mail.sender) = 'u' || n_nationkey || '@example.com') AS department FROM mail"))
    def _(spark, sf_dir):
        known = table(spark, sf_dir, "nation").select(F.col("n_name").alias("department_name"), F.col("n_nationkey").alias("ordinal"), F.array(F.concat(F.lit("U"), F.col("n_nationkey").cast("string"))).alias("sender_domains"))
        return sender_departments(mailbox.mail(spark, sf_dir).select("report_id", F.substring_index("sender", "@", 1).alias("domain")), known)

    @register("export_csv", with_facts("SELECT concat_ws(',', task_id, CAST(task_date AS VARCHAR), coalesce(department, ''), '\"' || employee_name || ', \"\"' || task_status || '\"\"\"') AS line FROM tasks ORDER BY task_date, task_id LIMIT 500"))
    def _(spark, sf_dir):
        rows = export(tasks(spark, sf_dir), ["task_date", "task_id"], 500)
        return csv_lines(rows.select("task_id", "task_date", "department", F.concat("employee_name", F.lit(', "'), "task_status", F.lit('"')).alias("who")))
