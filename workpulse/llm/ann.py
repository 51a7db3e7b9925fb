"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: the vectors are centred and turned by rotations fitted to a bounded sample, so that the signs of the turned
components lose little (iterative quantisation); ``ROTATIONS`` fits from different starts give ``ROTATIONS`` signs a
component. The code is cut into substrings of eight bits. If two codes of m substrings differ in at most r bits,
r = m a + b, then one of the first b + 1 substrings differs in at most a bits or one of the others in at most a - 1;
so an index by substring, probed with every value that near, retrieves every code within the radius. Here the index
holds, for each substring and value, the bitmap of the rows whose substring lies in the value's ball: a probe is one
row of bits, and a query's candidates are the union of one probe for each substring. Candidates are held to the radius
and then ranked by their exact inner products.

Probes are selective where neighbours are near: among vectors in clusters. Where the nearest vectors are hardly nearer
than others, as among random ones of many dimensions, the radius that holds them takes in most substrings, and the codes
then save exact products rather than probes.

Spark deals index rows and queries to a grid of cells of bounded size, each cell searched by one task, and merges the
best of each. A query that finds too few within the radius probes again with a larger one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that the rotations and the radius are fitted to, at most.
SAMPLE_VECTORS = 4096
ROTATIONS, ITERATIONS = 4, 25
#: Share of the sample's true neighbours that the radius takes in.
COVERED = 0.95
#: Rows of an index block, and of a block of queries: an index row is copied once for each block of queries.
INDEX_ROWS, QUERY_ROWS = 16384, 16384
CHUNK = 64

_COUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_APART = _COUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


class Coder:
    """Centre, rotations and radius."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.centre = sample.mean(axis=0)
        centred = sample - self.centre
        d = sample.shape[1]
        turned = []
        for _ in range(ROTATIONS):
            turn = np.linalg.qr(draw.normal(size=(d, d)))[0]
            for _ in range(ITERATIONS):
                u, _, v = np.linalg.svd(np.sign(centred @ turn).T @ centred)
                turn = (u @ v).T
            turned.append(turn)
        self.turn = np.concatenate(turned, axis=1)
        self.bits = -(-self.turn.shape[1] // 8) * 8
        codes = self.codes(sample)
        asked = np.arange(min(256, len(sample)))
        scores = sample[asked] @ sample.T
        scores[asked, asked] = -np.inf
        near = np.argpartition(-scores, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > 1 else asked[:, None]
        apart = _COUNT[codes[asked][:, None, :] ^ codes[near]].sum(axis=2, dtype=np.int64)
        self.radius = int(np.quantile(apart, COVERED))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.centre) @ self.turn > 0, axis=1)


class Index:
    """The substring index of some codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, {}

    def balls(self, substring: int, radius: int) -> np.ndarray:
        """For each value of the substring, the bitmap of rows within ``radius`` bits of it."""
        key = (substring, radius)
        if key not in self.tables:
            self.tables[key] = np.packbits((_APART <= radius)[:, self.codes[:, substring]], axis=1)
        return self.tables[key]

    def probed(self, codes: np.ndarray, radius: int) -> np.ndarray:
        """Per query the bitmap of rows that the probes for ``radius`` retrieve: all within it, and others."""
        m = self.codes.shape[1]
        a, b = divmod(min(radius, 8 * m), m)
        found = np.zeros((len(codes), -(-len(self.codes) // 8)), dtype=np.uint8)
        for s in range(m):
            if (reach := a if s <= b else a - 1) >= 0:
                found |= self.balls(s, reach)[codes[:, s]]
        return found

    def within(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every row within ``radius`` bits of a query."""
        m = self.codes.shape[1]
        query, row = np.nonzero(np.unpackbits(self.probed(codes, radius), axis=1, count=len(self.codes)))
        words = -(-m // 8) * 8
        wide = lambda c: np.pad(c, ((0, 0), (0, words - m))).view(np.uint64)
        apart = np.bitwise_count(wide(codes)[query] ^ wide(self.codes)[row]).sum(axis=1, dtype=np.int64)
        return query[apart <= radius], row[apart <= radius]


def best(index: Index, coder: Coder, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """(query id, id, score) of the k best of each query among the rows of the index, its own id left out."""
    out_query, out_id, out_score = [], [], []
    for at in range(0, len(queries), CHUNK):
        chunk, chunk_ids = queries[at : at + CHUNK], query_ids[at : at + CHUNK]
        codes = coder.codes(chunk)
        waiting, radius = np.arange(len(chunk)), coder.radius
        while len(waiting):
            query, row = index.within(codes[waiting], radius)
            query = waiting[query]
            other = ids[row] != chunk_ids[query]
            query, row = query[other], row[other]
            full = np.bincount(query, minlength=len(chunk)) >= k
            done = waiting if radius >= coder.bits else waiting[full[waiting]]
            take = np.isin(query, done)
            query, row = query[take], row[take]
            score = np.concatenate([(chunk[query[i : i + 65536]] * vectors[row[i : i + 65536]]).sum(axis=1) for i in range(0, len(query), 65536)] or [np.empty(0)])
            order = np.lexsort((ids[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            top = rank < k
            out_query.append(chunk_ids[query[top]])
            out_id.append(ids[row[top]])
            out_score.append(score[top])
            waiting = np.setdiff1d(waiting, done)
            radius += max(1, coder.bits // 16)
    return (np.concatenate(x) if x else np.empty(0) for x in (out_query, out_id, out_score))


def matrix(table: pa.Table, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, a row for each id (of repeated ids the first by its components)."""
    ids = table.column("id").to_numpy()
    vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], vectors[first]


def search(
    embeddings: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Per query (rows where ``is_query``): query_id, rank (from 1), vec_id and score, the ``k`` largest inner products
    found among all rows but those of the query's own id; all of them if there are fewer.

    Rows with a null id, or a vector that is null, empty, zero, of another length than most, or that holds null or
    non-finite components, take no part. Ties go to the smaller id. Repeated ids count once. An empty table, or one
    without a usable vector, gives no rows.
    """
    spark = embeddings.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dimension, n, q = sizes[0]["d"], sizes[0]["n"], sizes[0]["q"]
    rows = rows.where(F.size("vector") == dimension)
    sample = common.bounded_sample(rows.select("id", "vector"), "id", SAMPLE_VECTORS).collect()
    coder = spark.sparkContext.broadcast(Coder(np.array([r["vector"] for r in sample], dtype=np.float64), k))

    index_blocks, query_blocks = -(-n // index_rows), max(1, -(-q // query_rows))
    block = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    kept = rows.withColumn("vector", F.col("vector").cast("array<float>")) if embeddings.schema[vector_col].dataType.simpleString() == "array<float>" else rows
    index = kept.select("id", "vector", block(index_blocks).alias("i"), every(query_blocks).alias("j"))
    queries = kept.where("asked").select("id", "vector", block(query_blocks).alias("j"), every(index_blocks).alias("i"))

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            ids, vectors = matrix(left, dimension)
            query_ids, asked = matrix(right, dimension)
            found = best(Index(coder.value.codes(vectors)), coder.value, vectors, ids, asked, query_ids, k)
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    cells = index.groupBy("i", "j").cogroup(queries.groupBy("i", "j")).applyInArrow(searched, "query_id long, vec_id long, score double")
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
