"""Mixing sources to target weights: every source gives an exact number of words.

1. One pass over the texts writes narrow rows: id, source, size, and a key drawn from the id by hashing.
2. Targets come from the sources' sizes: weights share the whole, a target stops at some times its source's size, and
   the excess is reshared. Of the lines "sources with the smallest size for their weight are full, the others share the
   rest", which running sums over the sources give, the one with the highest share for a unit of weight is the answer.
3. Rows are range-sorted by source and key, so that a source of any size is spread over tasks. Each task sums its part of
   a source; the sums of the parts before give where the part begins, a window within the part the rest.
4. A source repeats as a whole as often as its target holds its size. What is left goes to the rows in order of their
   keys; the row at the cut gives the words up to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix"
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """How many words a text has; a null one has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(ids: Column, seed: str) -> Column:
    """60 bits drawn from an id by MD5. A null id counts as the empty string."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def running_sums(rows: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Range-sorted rows, each with the sums over the rows before it in its part, and the sums before each part.

    ``sums`` has names of columns by the names of their running sums. Rows have a column ``part``; parts (part, group,
    ``<sum>_before``) are as many as tasks and groups together. A row's whole sum is the one of its part and its own.
    """
    ranged = common.written(rows.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = ranged.groupBy("part", *group).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    parts = by_part.select("part", *group, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums))
    here = Window.partitionBy("part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumns({n: F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()}), parts


def with_targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sources`` (source, source_size) with ``target``. Sources weigh ``weights`` in order of their code points."""
    placed, parts = running_sums(sources.withColumn("one", F.lit(1).cast("long")), [], ["source"], {"place": "one"})
    place = F.col("place") + F.col("place_before")
    weighed = placed.join(F.broadcast(parts), "part").select(
        "source", "source_size", F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * most).alias("full"),
    )
    weighed = weighed.withColumn("ratio", F.col("full") / F.col("weight"))
    of_all = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, heavy = int(of_all["size"] or 0), int(of_all["weight"] or 1)
    lined, parts = running_sums(weighed, [], ["ratio", "source"], {"fulls": "full", "weights": "weight"})
    lined = lined.join(F.broadcast(parts), "part")
    rest, left = F.lit(total) - F.col("fulls") - F.col("fulls_before"), F.lit(heavy) - F.col("weights") - F.col("weights_before")
    share = lined.agg(F.max(rest / left)).first()[0] or 0.0  # the weight left is above 0: it holds the row's own
    return lined.select("source", "source_size", F.least(F.col("full").cast("double"), F.col("weight") * F.lit(share)).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per document: id, source, size (words), source_size, target (its source's) and taken (words the mix takes, repeats counted).

    The words taken of a source sum to its target, rounded; no document gives more than ``most`` times its size. Null
    and empty texts have size 0 and give nothing. A null source is one source, after all others. A repeated row is
    a document of its own; among rows of one key those of smaller size come first, and equal ones are alike, so any of
    them may be the one at the cut. Reruns give the same rows. An empty table gives none. Very long texts are counted in
    a row; one may be cut anywhere. No source is held by one task.
    """
    named = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source_col).cast("string")))
    sized = docs.select(
        F.col(id_col).alias("id"), named.alias("source"), words(F.col(text_col).cast("string")).alias("size"),
        random_key(F.col(id_col), seed).alias("key"), F.monotonically_increasing_id().alias("tie"),
    )
    sized = common.written(sized, "sizes")
    sources = common.written(with_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    ranged, parts = running_sums(sized, ["source"], ["key", "id", "size", "tie"], {"before": "size"})
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0))
    parts = parts.join(sources, "source").select("part", "source", "before_before", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    before = F.col("before") + F.col("before_before")
    taken = F.col("epochs") * F.col("size") + F.least(F.greatest(F.col("rest") - before, F.lit(0)), F.col("size"))
    return ranged.join(parts, ["part", "source"]).select(
        F.col("id").alias(id_col), F.when(F.col("source") != "n", F.substr("source", F.lit(2))).alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).drop("source")


def sql() -> str:
    """DuckDB SQL for the rows of ``op12_source_mix``."""
    key = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT"
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, {key} AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight FROM sized GROUP BY 1),
lined AS (SELECT *, sum(3 * source_size) OVER w AS fulls, sum(weight) OVER w AS weights FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT max(((SELECT sum(source_size) FROM sources) - coalesce(fulls, 0))::DOUBLE / ((SELECT sum(weight) FROM sources) - coalesce(weights, 0))::DOUBLE) AS share FROM lined),
targets AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * share.share) AS target FROM sources, share),
cut AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
placed AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized)
SELECT p.doc_id, p.size, c.source_size, c.target, (c.epochs * p.size + least(greatest(c.budget - c.epochs * c.source_size - p.before, 0), p.size))::BIGINT AS taken
FROM placed p JOIN cut c ON c.source IS NOT DISTINCT FROM p.source
"""
