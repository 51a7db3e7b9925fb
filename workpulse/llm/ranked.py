"""Ranked lexical search by variable-block-max WAND: the k best documents of each item, exactly.

1. One pass over the documents writes, for each, its number of terms and how often it holds each term that is asked
   for. Document frequencies and the collection's length are aggregates of that table.
2. A task gathers its documents into shards of a bounded number of postings. In a shard each term has a posting list,
   in order of document ids, with what each posting adds to a score.
3. Dynamic programming cuts every list into blocks of varying length: of all cuts it takes the one with the least
   sum, over postings, of the block's maximum less the posting's own value, plus a price for each block.
4. The blocks' boundaries cut the shard into intervals. In an interval no cursor leaves its block, so the sum of the
   blocks' maxima bounds every document in it: WAND's test of a pivot's blocks, made for all intervals of an item at once.
   Intervals are taken from the highest bound down and scored exactly; when no bound left reaches the k-th best score so
   far (or the k-th largest value of one list, which k documents reach), the rest is skipped. Within an interval only documents from the pivot list on are scored: lists whose maxima
   together don't reach that score bring none by themselves. A task keeps its best from shard to shard, so thresholds
   start high.
5. The best of all tasks are merged by a window that leaves at most k rows of an item in each task before its shuffle.

No posting is shuffled. Items are taken in blocks of bounded text, one round of passes each.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, decontam

K = 10
#: Item text, in bytes, whose terms are searched together: the broadcast of a round.
ITEM_BYTES = 1 << 20
#: Postings and documents of one shard, some 60 bytes of memory a posting.
SHARD_POSTINGS, SHARD_DOCS = 1 << 21, 1 << 16
#: Boundaries are looked for between groups of postings: of at least this many, and at most so many groups in a list.
GROUP, GROUPS = 4, 256
#: Groups that a block has at most.
LONGEST = 64
#: A block costs as much as this many postings with an error of one standard deviation of their list.
PRICE = 32.0

_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
_LAST = np.iinfo(np.int64).max  # stands for a null id, which is after all others


def cut_lists(values: np.ndarray, starts: np.ndarray, price: float = PRICE, group: int = GROUP, groups: int = GROUPS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of posting lists: (the place of each block's first posting, the number of blocks before each list).

    List i has ``values[starts[i]:starts[i + 1]]``. Boundaries are chosen by dynamic programming for all lists together,
    one group of postings after another.
    """
    sizes = np.diff(starts)
    lists = len(sizes)
    if not lists:
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    width = np.maximum(group, -(-sizes // groups))
    many = -(-sizes // width)
    order = np.argsort(-many, kind="stable")
    steps = int(many.max())
    # the first posting of every group, and what groups hold
    of = np.repeat(np.arange(lists), many)
    number = common.ranges(np.zeros(lists, dtype=np.int64), many)
    at = starts[:-1][of] + number * width[of]
    most = np.maximum.reduceat(values, at).astype(np.float64)
    sums = np.add.reduceat(values.astype(np.float64), at)
    counts = np.diff(np.append(at, starts[-1])).astype(np.float64)
    row = np.empty(lists, dtype=np.int64)
    row[order] = np.arange(lists)
    high = np.zeros((lists, steps))
    total, size = np.zeros((lists, steps + 1)), np.zeros((lists, steps + 1))
    high[row[of], number] = most
    total[row[of], number + 1] = sums
    size[row[of], number + 1] = counts
    total, size = np.cumsum(total, axis=1), np.cumsum(size, axis=1)
    mean = np.add.reduceat(values.astype(np.float64), starts[:-1]) / sizes
    spread = np.sqrt(np.maximum(np.add.reduceat(values.astype(np.float64) ** 2, starts[:-1]) / sizes - mean**2, 0))
    cost_of_block = (np.maximum(spread, 1) * price)[order]
    lengths = many[order]
    cost, back = np.zeros((lists, steps + 1)), np.zeros((lists, steps + 1), dtype=np.int64)
    for j in range(1, steps + 1):
        a = int(np.searchsorted(-lengths, -j, side="right"))  # lists of at least j groups
        w = min(j, longest)
        seen = slice(j - w, j)
        top = np.maximum.accumulate(high[:a, seen][:, ::-1], axis=1)
        error = top * (size[:a, j : j + 1] - size[:a, seen][:, ::-1]) - (total[:a, j : j + 1] - total[:a, seen][:, ::-1])
        whole = cost[:a, seen][:, ::-1] + error
        best = np.argmin(whole, axis=1)
        cost[:a, j] = whole[np.arange(a), best] + cost_of_block[:a]
        back[:a, j] = best + 1
    begins = np.zeros((lists, steps), dtype=bool)
    place, open_rows = lengths.copy(), np.arange(lists)
    while len(open_rows):
        place[open_rows] -= back[open_rows, place[open_rows]]
        begins[open_rows, place[open_rows]] = True
        open_rows = open_rows[place[open_rows] > 0]
    chosen = begins[row[of], number]
    return at[chosen], np.concatenate([[0], np.cumsum(np.bincount(of[chosen], minlength=lists))])


class Shard:
    """Posting lists of some documents, in blocks."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, many: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, docs_total: int, terms_total: int):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(place, many)
        m = 25 + (75 * n * docs_total) // terms_total
        values = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, many)))
        by_list = np.argsort(terms * len(ids) + doc, kind="stable")
        terms, self.docs, self.values = terms[by_list], doc[by_list], values[by_list]
        self.terms, firsts = np.unique(terms, return_index=True)
        self.starts = np.append(firsts, len(terms)).astype(np.int64)
        begins, self.first_block = cut_lists(self.values, self.starts)
        ends = np.append(begins[1:], len(terms))
        self.low, self.high = (self.docs[begins], self.docs[ends - 1] + 1) if len(begins) else (begins, begins)
        self.most = np.maximum.reduceat(self.values, begins) if len(begins) else begins
        self.list_most = np.maximum.reduceat(self.values, self.starts[:-1]) if len(self.terms) else begins
        self.kth: dict[tuple[int, int], int] = {}
        self.scored = 0  # postings that searches touched

    def _kth(self, i: int, k: int) -> int:
        """The k-th largest value of a list, 0 if it is shorter: k documents score at least that."""
        if (i, k) not in self.kth:
            values = self._list(i)[1]
            self.kth[i, k] = int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0
        return self.kth[i, k]

    def _list(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[i], self.starts[i + 1])
        return self.docs[part], self.values[part]

    def intervals(self, blocks: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, bound) of the intervals between the boundaries of some blocks; those that no block covers are left out."""
        edge = np.concatenate([self.low[blocks], self.high[blocks]])
        change = self.most[blocks] * times
        order = np.argsort(edge, kind="stable")
        edge, bound = edge[order], np.cumsum(np.concatenate([change, -change])[order])
        last = np.append(edge[1:] != edge[:-1], True)
        edge, bound = edge[last], bound[last]
        covered = bound[:-1] > 0
        return edge[:-1][covered], edge[1:][covered], bound[:-1][covered]

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the documents given by ``ids`` and ``scores`` and of the shard's, best first."""
        if not len(self.terms):
            return ids, scores
        at = np.searchsorted(self.terms, terms)
        here = self.terms[np.minimum(at, len(self.terms) - 1)] == terms
        at, times = at[here], times[here]
        if not len(at):
            return ids, scores
        first, last = self.first_block[at], self.first_block[at + 1]
        low, high, bound = self.intervals(common.ranges(first, last), np.repeat(times, last - first))
        order = np.argsort(-bound, kind="stable")
        low, high, bound = low[order], high[order], bound[order]
        covered = np.cumsum(high - low)
        done, batch = 0, 16 * k
        least = max(1, *(self._kth(i, k) * t for i, t in zip(at.tolist(), times.tolist())))
        while done < len(bound):
            threshold = max(least, scores[k - 1]) if len(scores) >= k else least
            reach = int(np.searchsorted(-bound, -threshold, side="right"))  # those whose bound reaches the threshold
            stop = min(reach, int(np.searchsorted(covered, (covered[done - 1] if done else 0) + batch)) + 1)
            if stop <= done:
                break
            ids, scores = self._scored(at, times, low[done:stop], high[done:stop], threshold, k, ids, scores)
            done, batch = stop, batch * 4
        return ids, scores

    def _scored(self, at, times, low, high, threshold, k, ids, scores):
        by_place = np.argsort(low, kind="stable")
        low, high = low[by_place], high[by_place]
        apart = np.append(True, low[1:] != high[:-1])
        low, high = low[apart], high[np.append(apart[1:], True)]
        # the pivot of the lists: those with the smallest maxima, which together don't reach the threshold, bring no
        # document by themselves and are asked only about documents of the other lists
        most = self.list_most[at] * times
        order = np.argsort(most, kind="stable")
        alone = int(np.searchsorted(np.cumsum(most[order]), threshold))
        sums = np.zeros(len(self.ids), dtype=np.int64)
        for i in order[alone:]:
            docs, values = self._list(at[i])
            where = common.ranges(np.searchsorted(docs, low), np.searchsorted(docs, high))
            sums[docs[where]] += values[where] * times[i]  # a list has a document once
            self.scored += len(where)
        some = np.nonzero(sums)[0]
        for i in order[:alone]:
            docs, values = self._list(at[i])
            where = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
            sums[some] += np.where(docs[where] == some, values[where], 0) * times[i]
            self.scored += min(len(some), len(docs))
        found = some[sums[some] >= threshold]
        ids, scores = np.concatenate([ids, self.ids[found]]), np.concatenate([scores, sums[found]])
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def asked_items(items: DataFrame, item_col: str, text_col: str, item_bytes: int) -> tuple[DataFrame, int]:
    """Different items (item, text) with an id and a text, and into how many blocks they go."""
    found = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    total = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return found, -(-total // item_bytes)


def count_terms(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, n (its terms) and, for those of ``terms`` that it holds, their places and frequencies."""
    spark = docs.sparkSession
    shared, token = spark.sparkContext.broadcast(terms), uuid.uuid4().hex

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = common.once(token, lambda: {w: i for i, w in enumerate(shared.value)}).get
        for batch in batches:
            for part in common.byte_slices(batch):
                ns, many, held, often = [], [0], [], []
                for text in part.column(1).to_pylist():
                    n, counts = 0, Counter()
                    for words in decontam.word_lists(text):
                        n += len(words)
                        counts.update(map(place, words))
                    counts.pop(None, None)
                    ns.append(n)
                    held.extend(counts)
                    often.extend(counts.values())
                    many.append(len(held))
                lists = (pa.ListArray.from_arrays(pa.array(many, pa.int32()), pa.array(x, pa.int32())) for x in (held, often))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ns, pa.int64()), *lists], schema=_COUNTED)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n long, terms array<int>, tfs array<int>")


def shards(batches: Iterator[pa.RecordBatch], postings: int, docs: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, n, number of terms, terms, frequencies) of one shard after another."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = rows = 0

    def flat(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False)

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts))

    for batch in batches:
        ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
        many = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        parts.append((ids, batch.column(1).to_numpy(zero_copy_only=False), many, flat(batch.column(2)), flat(batch.column(3))))
        held, rows = held + len(parts[-1][3]), rows + len(ids)
        if held >= postings or rows >= docs:
            yield joined()
            parts, held, rows = [], 0, 0
    if parts:
        yield joined()


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES, shard_postings: int = SHARD_POSTINGS, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """Each item's k documents of highest score above 0 (all, if fewer): item, rank (int, from 1), document id (long) and score (long).

    Equal scores are ranked by ascending id, null ids last; rows that repeat an id are documents of their own. Null texts
    and texts of separators have no terms: they are in no result and in no count. An item without an id or a term gives
    no rows; an item row that repeats counts once, and different texts of one id are one item, all of whose terms count.
    Very long texts are counted in stretches of a megabyte. Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked, blocks = asked_items(items, item_col, item_text_col, item_bytes)
    item_sql = asked.schema["item"].dataType.simpleString()
    schema = f"{item_col} {item_sql}, rank int, {id_col} long, score long"
    found: DataFrame | None = None
    for block in range(blocks):
        terms_of: dict = {}
        for row in (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)).collect():
            for words in decontam.word_lists(row["text"]):
                terms_of.setdefault(row["item"], Counter()).update(words)
        names = sorted(item for item, counts in terms_of.items() if counts)
        if not names:
            continue
        words = sorted(set().union(*(terms_of[x] for x in names)))
        with common.small_batches(spark):
            counted = common.written(count_terms(docs, words, id_col, text_col), "term-counts")
        of_all = counted.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not of_all["docs"]:
            continue
        df = np.zeros(len(words), dtype=np.int64)
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # at most a row for each asked term
            df[row["term"]] = row["df"]
        n_docs, n_terms = int(of_all["docs"]), int(of_all["terms"])
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        place = {w: i for i, w in enumerate(words)}
        queries = [(np.array(t := sorted(place[w] for w in terms_of[x]), dtype=np.int64), np.array([terms_of[x][words[i]] for i in t], dtype=np.int64)) for x in names]
        shared = spark.sparkContext.broadcast((weights, queries))

        def searched(batches: Iterator[pa.RecordBatch], shared=shared, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            weights, queries = shared.value
            none = np.zeros(0, dtype=np.int64)
            best = [(none, none)] * len(queries)
            for parts in shards(batches, shard_postings, shard_docs):
                shard = Shard(*parts, weights, n_docs, n_terms)
                best = [shard.best(terms, times, k, *kept) for (terms, times), kept in zip(queries, best)]
            item = np.repeat(np.arange(len(best), dtype=np.int32), [len(ids) for ids, _ in best])
            ids, scores = (np.concatenate([x[i] for x in best] or [none]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _LAST), pa.array(scores)], schema=_FOUND)

        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        rows = counted.where("size(terms) > 0").mapInArrow(searched, "item int, doc_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        numbered = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"item int, name {item_sql}"))  # ids of at most a block of items
        rows = rows.join(numbered, "item").select(F.col("name").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
        found = rows if found is None else found.unionByName(common.written(rows, "ranked") if blocks > 1 else rows)
    return spark.createDataFrame([], schema) if found is None else found


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def sql() -> str:
    """DuckDB SQL for the rows of ``op13_ranked_search``."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH docs AS (SELECT doc_id, unnest({terms}) AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
counts AS (SELECT doc_id, term, count(*) AS tf FROM docs GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts GROUP BY 1),
scored AS (SELECT a.item_id, c.doc_id, sum(a.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (25 + ((75 * l.n * t.docs) // t.terms)))))::BIGINT AS score
  FROM asked a JOIN counts c USING (term) JOIN weights w USING (term) JOIN lengths l USING (doc_id), whole t GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
