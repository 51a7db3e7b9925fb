"""Who did a row's work and for which department, from all that states it: the roster, the row, the table's title, the
covering texts and the sender.

What states a thing is an array of ranked sources on the row; the first by rank settles it, and others that say
something else are kept beside it. Departments and categories are dimensions of some hundreds and become expressions;
the roster is joined by key. Nobody's rows come together in one task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import looks_planned, report_day
from ..functions.people import looks_like_person
from ..functions.text import clean_whitespace, keyify, let, sender_address, sender_domain, short_hash, title_case
from .ingest import IngestConfig
from .joins import mention

#: Departments, and categories, that become part of an expression, at most; more is an error rather than a slow plan.
MOST_NAMES = 2000


@dataclass(frozen=True)
class Masters:
    """The organisation's own records; any may be missing.

    ``roster``: employee_id, employee_name, aliases (array), department, email, on_roster (boolean), active.
    ``departments``: department_name, aliases (array), sender_domains (array), ordinal. ``categories``: category_name,
    keywords (array), expected_duration, ordinal.
    """

    roster: DataFrame | None = None
    departments: DataFrame | None = None
    categories: DataFrame | None = None
    roster_only: bool = False
    create_people: bool = True


def _rows(dimension: DataFrame | None, *order: str) -> list:
    if dimension is None:
        return []
    found = dimension.orderBy(*order).limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} rows in a dimension that becomes part of an expression")
    return found


def _key(text: str) -> str:
    """``keyify`` for the names of a dimension on the driver."""
    kept = "".join(c if c.isascii() and c.isalnum() or c == " " else "" if c in ".'’" else " " for c in (text or "").lower())
    return " ".join(kept.split())


def _lookup(pairs: dict[str, object], value_sql: str) -> Column:
    return F.from_json(F.lit(json.dumps(pairs)), f"map<string,{value_sql}>")


def first_by_rank(sources: list[tuple[str, Column]]) -> Column:
    """Of sources (name, value), strongest first: (first, others), the (source, value) of the first that says anything and
    those of others that say something else. Each source is worked out once."""
    each = F.array(*(F.struct(F.lit(name).alias("source"), v.alias("value")) for name, v in sources))
    listed = F.filter(each, lambda x: F.coalesce(x["value"], F.lit("")) != "")
    first = lambda found: F.get(found, F.lit(0))
    return let(listed, lambda found: F.struct(first(found).alias("first"), F.filter(found, lambda x: F.lower(x["value"]) != F.lower(first(found)["value"])).alias("others")))


def document_evidence(documents: DataFrame, masters: Masters, config: IngestConfig = IngestConfig()) -> DataFrame:
    """``documents`` (document_id and any of subject, context_text, attachment_name, sheet_name, sender, received_at) with
    hint, hint_source and hint_others (what their texts and the sender say of the department), sender_employee,
    inferred_date and date_basis, and planned: whether the covering text speaks of work ahead.

    Only known departments are ever found in texts. The day a document arrived is no evidence of the day of its work.
    """
    has = lambda c, kind="string": F.col(c).cast(kind) if c in documents.columns else F.lit(None).cast(kind)
    known = _rows(masters.departments, "ordinal", "department_name")
    placeholder = _key(config.default_department)
    words = [(d["department_name"], _key(x)) for d in known for x in (d["department_name"], *(d["aliases"] or []))]
    words = [(name, key) for name, key in words if key and key != placeholder]
    domains: dict[str, str] = {}
    for d in known:
        for x in d["sender_domains"] or []:
            domains.setdefault(x.lower(), d["department_name"])
    sender = F.coalesce(has("sender"), F.lit(""))
    by_domain = F.try_element_at(_lookup(domains, "string"), sender_domain(sender)) if domains else F.lit(None).cast("string")
    named_in = F.array(*(F.struct(F.lit(_key(d["department_name"])).alias("key"), F.lit(d["department_name"]).alias("name")) for d in known))
    in_sender = let(keyify(sender), lambda key: F.get(F.filter(named_in, lambda d: F.contains(key, d["key"])), F.lit(0))["name"]) if known else None
    sources = [(name, mention(F.coalesce(has(c), F.lit("")), words)) for name, c in (("body", "context_text"), ("subject", "subject"), ("attachment name", "attachment_name"), ("sheet name", "sheet_name"))]
    sources += [("sender domain", by_domain)] + ([("sender", in_sender)] if in_sender is not None else [])
    day = report_day(has("context_text"), has("subject"), has("received_at", "timestamp"), config.date_order)
    out = documents.withColumns({"_said": first_by_rank(sources), "_day": day, "planned": looks_planned(has("context_text")), "_address": sender_address(sender)})
    if masters.roster is not None:
        by_address = masters.roster.where("coalesce(email, '') != ''").groupBy(F.lower(F.trim("email")).alias("_address")).agg(F.min("employee_name").alias("_of_address"))
        out = out.join(by_address, "_address", "left")
    else:
        out = out.withColumn("_of_address", F.lit(None).cast("string"))
    shown = F.trim(F.regexp_replace(F.regexp_replace(sender, "<.*", ""), '"', ""))
    local = title_case(F.trim(F.regexp_replace(F.substring_index("_address", "@", 1), r"[._\-\d]+", " ")))
    named = F.when(F.col("_address").endswith("@local"), "").otherwise(F.coalesce("_of_address", F.when((shown != "") & ~F.contains(shown, F.lit("@")), shown).otherwise(local)))
    return out.select(*documents.columns, F.col("_said.first.value").alias("hint"), F.col("_said.first.source").alias("hint_source"), F.col("_said.others").alias("hint_others"), named.alias("sender_employee"), F.col("_day.date").alias("inferred_date"), F.col("_day.basis").alias("date_basis"), "planned")


def people_by_key(roster: DataFrame) -> DataFrame:
    """(key, who): active people by name or alias, and by a first name that one person alone has."""
    people = roster.where("coalesce(active, true)")
    who = F.struct("employee_id", "employee_name", "department", F.coalesce("on_roster", F.lit(False)).alias("on_roster"))
    every = F.concat(F.array("employee_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    whole = people.select(F.explode(every).alias("known"), who.alias("who")).select(keyify(F.col("known")).alias("key"), F.lit(0).alias("rank"), "who")
    first = people.groupBy(F.get(F.split(keyify(F.col("employee_name")), " "), F.lit(0)).alias("key")).agg(F.count("*").alias("n"), F.min(who).alias("who"))
    rows = whole.unionByName(first.where("n = 1").select("key", F.lit(1).alias("rank"), "who")).where("key != ''")
    return rows.groupBy("key").agg(F.min(F.struct("rank", "who"))["who"].alias("who"))


def resolved(rows: DataFrame, masters: Masters, documents: DataFrame | None = None, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Validated rows under the organisation's own names, each with an ``outcome``: accepted, rejected or outside.

    People: by name or alias, else by a first name that one person has; unknown ones are made up (``employee_new``), or
    rejected as UNKNOWN_EMPLOYEE. With ``roster_only``, and a roster, rows of others are outside: neither accepted nor
    wrong. Departments, strongest first: the roster, the row, the table's title, ``documents`` (of
    ``document_evidence``), the default; ``department_others`` keeps what disagrees. Categories come from the row, else
    from the longest keyword in the task, and give the duration that is expected where the row gives none. Notes say
    what was inferred or overruled.
    """
    c = F.col
    departments = _rows(masters.departments, "ordinal", "department_name")
    by_name: dict[str, str] = {}
    for d in departments:
        for x in (d["department_name"], *(d["aliases"] or [])):
            by_name.setdefault(_key(x), d["department_name"])
    listed = (lambda text: F.try_element_at(_lookup(by_name, "string"), keyify(text))) if by_name else (lambda text: F.lit(None).cast("string"))
    hints = ["hint", "hint_source", "hint_others", "planned", "date_basis"]
    if documents is not None and "hint" in documents.columns:
        rows = rows.join(documents.select("document_id", *hints), "document_id", "left")
    else:
        rows = rows.withColumns({"hint": F.lit(None).cast("string"), "hint_source": F.lit(None).cast("string"), "planned": F.lit(False), "date_basis": F.lit(None).cast("string")})

    said = clean_whitespace(F.coalesce("employee_name", F.lit("")))
    name = F.regexp_replace(F.regexp_replace(said, r"\s*\([^()]*\)\s*$", ""), r"(?i)^(mr|mrs|ms|dr)\.?\s+", "")
    rows = rows.withColumns({"_name": name, "_key": keyify(name)})
    if masters.roster is not None:
        rows = rows.join(people_by_key(masters.roster).withColumnRenamed("key", "_key"), "_key", "left")
        strict = masters.roster_only and not masters.roster.where("on_roster").isEmpty()
    else:
        rows = rows.withColumn("who", F.lit(None).cast("struct<employee_id:string,employee_name:string,department:string,on_roster:boolean>"))
        strict = False
    known = c("who").isNotNull()
    of_row = F.when(c("department_text") != "", F.coalesce(listed(c("department_text")), F.initcap(clean_whitespace(c("department_text")))))
    of_roster = F.when(F.lower("who.department") != config.default_department.lower(), c("who.department"))
    said = first_by_rank([("roster", of_roster), ("row", of_row), ("title", listed(F.coalesce("title_department", F.lit("")))), ("document", c("hint")), ("default", F.lit(config.default_department))])
    rows = rows.withColumn("_said", said).withColumns({"_department": F.col("_said.first"), "department_others": F.filter("_said.others", lambda x: x["source"] != "default")}).drop("_said")

    categories = _rows(masters.categories, "ordinal", "category_name")
    expected = {x["category_name"]: float(x["expected_duration"]) for x in categories if x["expected_duration"] is not None}
    keywords = sorted(((-len(k), i, k.lower(), x["category_name"]) for i, x in enumerate(categories) for k in x["keywords"] or [] if k))
    by_keyword: Column | None = None
    for _, _, keyword, category in keywords:
        hit = F.contains("task_normalized", F.lit(keyword))
        by_keyword = F.when(hit, category) if by_keyword is None else by_keyword.when(hit, category)
    category = F.coalesce("task_category", F.lit(None).cast("string") if by_keyword is None else by_keyword)
    rows = rows.withColumn("task_category", category)
    by_category = F.try_element_at(_lookup(expected, "double"), c("task_category")) if expected else F.lit(None).cast("double")

    # a row without a day or a person is wrong before it can be out of scope
    undecided = c("task_date").isNull() | (c("_key") == "")
    outside = ~undecided & ~F.coalesce(c("who.on_roster"), F.lit(False)) if strict else F.lit(False)
    reason = F.when(undecided, F.coalesce("reject_reason", F.lit("MISSING_REQUIRED_FIELD")))
    if not (masters.create_people or strict):
        reason = reason.when(~known, "UNKNOWN_EMPLOYEE")
    reason = F.when(~outside, F.coalesce(reason, "reject_reason"))
    overruled = (c("_department.source") == "roster") & of_row.isNotNull() & (of_row != of_roster)
    notes = F.concat_ws(
        "; ",
        F.when((c("date_text") == "") & c("date_basis").isNotNull(), F.concat(F.lit("Date taken from the covering text, "), "date_basis")),
        F.when(~known & (c("_key") != ""), "Employee made up from this document"),
        F.when(overruled, F.concat(F.lit("The row says "), of_row, F.lit(", the roster "), of_roster, F.lit("; the roster was used"))),
        F.when((c("work_kind") == "PLANNED") & (c("task_status") == "Not Started"), "Planned work, left out of completion figures"),
        F.when(c("task_status") == "Ambiguous", "More than one status, left out of completion figures"),
        F.when(c("actual_duration").isNull(), "No times, so no duration"),
    )
    made_up = F.concat(F.lit("EMP-"), F.upper(short_hash(c("_key"), 6)))
    dropped = {"_name", "_key", "_department", "who", "hint", "hint_source", "hint_others", "planned", "date_basis", "employee_name", "department", "reject_reason", "expected_duration", "work_kind"}
    return rows.select(
        *(x for x in rows.columns if x not in dropped),
        F.when(c("_key") != "", F.coalesce("who.employee_name", title_case(c("_name")))).alias("employee_name"), F.coalesce("who.employee_id", F.when(c("_key") != "", made_up)).alias("employee_id"),
        (~known & (c("_key") != "")).alias("employee_new"), looks_like_person(c("_name")).alias("looks_like_person"), c("_department.value").alias("department"), c("_department.source").alias("department_source"),
        F.coalesce("expected_duration", by_category).alias("expected_duration"), F.when(c("planned") & (c("work_kind") == "REPORTED"), "PLANNED").otherwise(c("work_kind")).alias("work_kind"),
        reason.alias("reject_reason"), F.when(outside, "outside").when(reason.isNotNull(), "rejected").otherwise("accepted").alias("outcome"), notes.alias("data_quality_notes"), F.when(notes == "", "OK").otherwise("Partial").alias("data_quality_status"),
    )


def outside_roster(rows: DataFrame) -> DataFrame:
    """How many rows of each document are of whom outside the roster."""
    return rows.where("outcome = 'outside'").groupBy("document_id", "employee_name").agg(F.count("*").alias("rows"))


def made_up_people(rows: DataFrame) -> DataFrame:
    """People whom accepted rows made up, with the department of their first row. Told apart by the key of their name: an
    employee_id holds six digits of its hash, which two of some thousand people share."""
    new = rows.where("outcome = 'accepted' and employee_new")
    first = F.min_by(F.struct("employee_id", "employee_name", "department", "looks_like_person"), F.struct("task_date", "document_id", "table_index", "row_index"))
    return new.groupBy(keyify(F.col("employee_name")).alias("key")).agg(first.alias("x"), F.count("*").alias("tasks")).select("x.*", "tasks")


def register_all(register, with_facts, table) -> None:
    """Reports of the driver's facts, with covering texts and senders, against a roster made from customers."""
    from .ingest import numbered_rows, validated

    def masters(spark, sf_dir, strict: bool) -> Masters:
        n = F.col("c_custkey")
        people = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(
            F.concat(F.lit("E"), n.cast("string")).alias("employee_id"), F.col("c_name").alias("employee_name"), F.array().cast("array<string>").alias("aliases"), F.when(n % 4 != 1, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("department"),
            F.lit(None).cast("string").alias("email"), (n % 5 != 0).alias("on_roster"), F.lit(True).alias("active"),
        )
        key = F.col("n_nationkey")
        named = F.concat(F.lit("NATION_"), key.cast("string"))
        departments = table(spark, sf_dir, "nation").select(named.alias("department_name"), F.array().cast("array<string>").alias("aliases"), F.when(key < 3, F.array(F.concat(F.lit("d"), key.cast("string"), F.lit(".example")))).alias("sender_domains"), key.alias("ordinal"))
        sizes = table(spark, sf_dir, "part").groupBy(F.element_at(F.split("p_name", " "), -1).alias("category_name")).agg(F.min("p_partkey").alias("ordinal"), F.min("p_size").cast("double").alias("expected_duration"))
        return Masters(people, departments, sizes.withColumn("keywords", F.array("category_name")), strict)

    def outcomes(spark, sf_dir, strict: bool) -> DataFrame:
        from .ingest import read_reports

        known = masters(spark, sf_dir, strict)
        rows = validated(numbered_rows(read_reports(spark, sf_dir)))
        documents = read_reports(spark, sf_dir).select("document_id").distinct()
        who, month = F.substring_index("document_id", "/", 1), F.substring("document_id", -2, 2).cast("int")
        k = F.substring_index(who, "#", -1).cast("long")
        documents = documents.select(
            "document_id", F.when(month % 3 == 0, F.concat(F.lit("Update from NATION_"), (k % 25).cast("string"), F.lit(" today"))).alias("subject"), F.when(month % 3 == 1, "Here is the work of the nation 4 team").alias("context_text"),
            F.concat(F.lit("someone@d"), (k % 7).cast("string"), F.lit(".example")).alias("sender"),
        )
        return resolved(rows, known, document_evidence(documents, known))

    def with_outcomes(strict: bool, sql: str) -> str:
        on_roster = "k % 3 <> 0 AND k % 5 <> 0" if strict else "TRUE"
        return with_facts(f"""made AS (SELECT t.*, concat(t.employee_name, '/', strftime(t.task_date, '%Y-%m')) AS document_id, c.c_custkey AS k, c.c_nationkey AS n, month(t.task_date) AS m FROM (SELECT * REPLACE (CAST(task_date + INTERVAL 30 YEAR AS DATE) AS task_date) FROM tasks WHERE task_status <> 'Ambiguous') t JOIN customer c ON c.c_name = t.employee_name),
          sizes AS (SELECT string_split(p_name, ' ')[-1] AS category, min(p_size)::DOUBLE AS expected FROM part GROUP BY 1),
          found AS (SELECT document_id, task_date, employee_name, task, CASE WHEN k % 3 <> 0 AND k % 4 <> 1 THEN 'NATION_' || n WHEN m % 3 = 1 THEN 'NATION_4' WHEN m % 3 = 0 THEN 'NATION_' || (k % 25) WHEN k % 7 < 3 THEN 'NATION_' || (k % 7) ELSE 'Unassigned' END AS department,
            CASE WHEN k % 3 <> 0 AND k % 4 <> 1 THEN 'roster' WHEN m % 3 < 2 OR k % 7 < 3 THEN 'document' ELSE 'default' END AS department_source, sizes.category AS task_category, sizes.expected AS expected_duration,
            CASE WHEN NOT ({on_roster}) THEN 'outside' WHEN work_kind = 'PLANNED' THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN ({on_roster}) AND work_kind = 'PLANNED' THEN 'UNKNOWN_STATUS' END AS reject_reason, k % 3 = 0 AS employee_new
            FROM made LEFT JOIN sizes ON string_split(made.task, ' ')[-1] = sizes.category) {sql}""").replace(") made AS", "), made AS", 1)

    @register("ingest_with_roster", with_outcomes(True, "SELECT * FROM found"))
    def _(spark, sf_dir):
        return outcomes(spark, sf_dir, True).select("document_id", "task_date", "employee_name", "task", "department", "department_source", "task_category", "expected_duration", "outcome", "reject_reason", "employee_new")

    @register("outside_roster", with_outcomes(True, "SELECT document_id, employee_name, count(*) AS rows FROM found WHERE outcome = 'outside' GROUP BY 1, 2"))
    def _(spark, sf_dir):
        return outside_roster(outcomes(spark, sf_dir, True))

    @register("people_made_up", with_outcomes(False, "SELECT employee_name, count(*) AS tasks, arg_min(department, (task_date, document_id, department)) AS department FROM found WHERE outcome = 'accepted' AND employee_new GROUP BY 1"))
    def _(spark, sf_dir):
        return made_up_people(outcomes(spark, sf_dir, False)).select("employee_name", "tasks", "department")
