"""Filter interaction audit: what each filter removes at each place of each order.

1. One pass over the texts writes narrow rows: which filters a document fails, and a digest of its text. Digests that
   repeat find identical texts; labels are joined by id.
2. Orders of filters form a trie. It is walked depth-first; a node's survivors are a DataFrame persisted for as long as
   its branches need it, made from its parent's by applying one filter. Prefixes with the same filters in another order
   leave the same survivors, so each set of filters is visited once: 2^n - 1 states rather than n! orders.
3. At each state one aggregate counts what every filter still open removes there: the edges of the trie, written as they
   are counted. Orders and steps, redundant failures, unique ones and Shapley sums are read off the edges.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .mixing import WORD

#: Filters that read a text alone: each gives whether it fails.
ODD_SIGNS = "[#$%&*|]"
#: A digest of more than this part of all rows is broadcast; there are fewer than its inverse.
HOT = 1000

_EDGES = "part string, state string, filter string, survivors long, removed long, good_lost long, toxic_lost long"


def text_filters(text: Column) -> dict[str, Column]:
    """A: under 200 words. B: under half of the words are different. C: over 3 % capitals. D: holds an odd sign."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    # worked out once for both filters
    n = F.get(F.transform(F.array(found), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("different"))), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"words": n, "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), "D": text.rlike(ODD_SIGNS)}


def same_as_earlier(rows: DataFrame) -> DataFrame:
    """``rows`` (id, digest and more) with ``repeated``: whether a row with a smaller id has its digest. Null ids are
    neither smaller nor larger than others.

    Digests of over a thousandth of all rows are under a thousand; they are broadcast, so no task gets such a group.
    """
    groups = common.written(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1 and first is not null"), "repeated")
    total = rows.count()
    hot, cold = (F.broadcast(groups.where(F.col("n") * HOT > total)), groups.where(F.col("n") * HOT <= total))
    flagged = (F.col("id") > F.col("first")).alias("repeated")
    columns = [F.col(c) for c in rows.columns if c != "digest"]
    of_hot = rows.join(hot, "digest").select(*columns, F.coalesce(flagged, F.lit(False)).alias("repeated"))
    others = rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest", "left")
    return of_hot.unionByName(others.select(*columns, F.coalesce(flagged, F.lit(False)).alias("repeated")))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", label_id_col: str = "doc_id") -> DataFrame:
    """Per document: part, what it fails (A to E, E: an identical text has a smaller id) and whether labels call it good or toxic.

    A null text is empty; a null part is the empty string. Of several labels of a document any decides. A repeated row
    is a document of its own and, having no smaller id, doesn't fail E by itself.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    checks = text_filters(F.col("text"))
    narrow = seen.select("id", "part", checks["words"].alias("words"), checks["C"].alias("C"), checks["D"].alias("D"), F.unhex(F.sha2("text", 256)).alias("digest"))
    narrow = narrow.select("id", "part", (F.col("words.all") < 200).alias("A"), (100 * F.col("words.different").cast("long") < 50 * F.col("words.all").cast("long")).alias("B"), "C", "D", "digest")
    judged = same_as_earlier(common.written(narrow, "verdicts")).withColumnRenamed("repeated", "E")
    marks = labels.select(F.col(label_id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("good or toxic").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # ids are spread evenly; rows without one meet no label and don't go to the join
    columns = ["part", *"ABCDE"]
    marked = judged.where("id is not null").join(marks, "id", "left").select(*columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return marked.unionByName(judged.where("id is null").select(*columns, F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def walk(judged: DataFrame, filters: str, path: str) -> None:
    """Writes the edges of the trie of ``filters`` (columns of one letter that say who fails) to ``path``."""
    visited: set[frozenset[str]] = set()

    # the same counts at every state, so that their code is compiled once; filters already applied remove nothing
    counts = [F.count("*").alias("survivors")]
    for f in filters:
        counts += [F.count_if(F.col(f)).alias(f), F.count_if(F.col(f) & F.col("good")).alias(f"{f}_good"), F.count_if(F.col(f) & F.col("toxic")).alias(f"{f}_toxic")]
    edges = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.col(f).alias("removed"), F.col(f"{f}_good").alias("good_lost"), F.col(f"{f}_toxic").alias("toxic_lost")) for f in filters))).alias("edge")

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        visited.add(state)
        still = [f for f in filters if f not in state]
        found = survivors.groupBy("part").agg(*counts).select("part", F.lit("".join(sorted(state))).alias("state"), "survivors", edges)
        found.select("part", "state", "edge.filter", "survivors", "edge.removed", "edge.good_lost", "edge.toxic_lost").write.mode("append").parquet(path)
        for f in still:
            below = state | {f}
            if len(still) == 1 or below in visited:
                continue
            rest = survivors.where(~F.col(f))
            if len(still) > 2:  # has branches of its own
                rest = rest.persist(StorageLevel.MEMORY_AND_DISK)
            visit(below, rest)
            rest.unpersist()

    visit(frozenset(), judged)


def read_off(edges: DataFrame, filters: str) -> DataFrame:
    """For each part, order of ``filters`` and step: what the edges say, zeros included."""
    n, every = len(filters), "".join(sorted(filters))
    steps = [{"filter_order": "".join(o), "step": i + 1, "filter": o[i], "state": "".join(sorted(o[:i]))} for o in itertools.permutations(filters) for i in range(n)]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:string,state:string>>")
    orders = F.lit(0).cast("long")
    for size in range(n):  # orders in which just the state's filters come before
        orders = F.when(F.length("state") == size, F.lit(math.factorial(size) * math.factorial(n - 1 - size)).cast("long")).otherwise(orders)
    at = F.map_from_entries(F.collect_list(F.struct("state", F.struct("survivors", "removed", "good_lost", "toxic_lost"))))
    by_filter = edges.where(~F.contains("state", F.col("filter"))).groupBy("part", "filter").agg(
        at.alias("at"), F.sum(F.col("removed") * orders).alias("shapley"), F.sum(F.when(F.col("state") == "", F.col("removed")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.length("state") == len(every) - 1, F.col("removed")).otherwise(0)).alias("unique_fails"),
    )
    spread = by_filter.select("*", F.explode(F.filter(listed, lambda s: s["filter"] == F.col("filter"))).alias("s"))
    edge = F.element_at("at", F.col("s.state"))
    count = lambda name: F.coalesce(edge[name], F.lit(0))  # noqa: E731  a state without survivors has no edges
    return spread.select(
        "part", "s.filter_order", "s.step", (count("survivors") - count("removed")).alias("kept"), count("removed").alias("removed"), (F.col("failing") - count("removed")).alias("redundant"),
        "unique_fails", count("good_lost").alias("good_lost"), count("toxic_lost").alias("toxic_lost"), "shapley",
    )


def audit(judged: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """The audit of ``filters``, boolean columns of ``judged`` beside part, good and toxic; see ``read_off``.

    n filters make n! orders of n steps for each part and 2^n - 1 states, so keep n to seven or so. Parts may be many and
    of any size: they are counted before they are shuffled. An empty table has no part and gives no row.
    """
    rows = common.written(judged, "judged")
    path = f"{common.shared_folder(judged.sparkSession)}/edges-{uuid.uuid4().hex}"
    walk(rows, filters, path)
    return read_off(judged.sparkSession.read.schema(_EDGES).parquet(path), filters)


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")))


def sql() -> str:
    """DuckDB SQL for the rows of ``op11_filter_interaction``."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
failing AS (SELECT c.part, coalesce(m.good, FALSE) AS good, coalesce(m.toxic, FALSE) AS toxic, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN c.doc_id > c.first THEN 'E' ELSE '' END AS fails
  FROM cut c LEFT JOIN marks m ON m.doc_id = c.doc_id),
sizes AS (SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM {letters} a(x), {letters} b(x), {letters} c(x), {letters} d(x), {letters} e(x) WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS prefix FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
judged AS (SELECT s.*, t.filter_order, t.step, t.f, length(regexp_replace(s.fails, '[' || t.prefix || '.]', '', 'g')) = length(s.fails) AS left_before, contains(s.fails, t.f) AS failing FROM sizes s, steps t),
summed AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE left_before AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE left_before AND failing), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE failing AND NOT left_before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (WHERE left_before AND failing AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE left_before AND failing AND toxic), 0)::BIGINT AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM summed
"""
