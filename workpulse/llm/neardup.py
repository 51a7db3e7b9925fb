"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

Weights: a shingle of five words weighs its count in the document times the mean inverse document frequency of its
words. Document frequencies are counted over all documents in a table of fixed size, by a hash of the word.

1. Exact copies fold into one row per text before anything else, in the tasks that read them.
2. Each text gets ``BANDS * ROWS`` consistent samples; ``ROWS`` of them make a band, and texts that share a band meet.
3. Texts of a bucket are verified against one of them, another one in each band, not against each other: as many pairs
   as texts. Weighted Jaccard similarity is worked out from the whole texts.
4. Texts that a bucket holds together but that are not linked yet are compared too, in blocks of bounded size and
   over different components only, after a sketch of the samples has ruled out the pairs that can't be similar. So
   every colliding pair of similar texts ends in one class, and only links leave a task.
5. Connected components of the links are the classes; labels travel by joins until nothing changes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as hashed

from . import common, decontam

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
#: Cells of the document-frequency table: words share one by the first bits of their numbers.
CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: Least share of equal sketch bytes: 0.8 less over three standard deviations of 48 samples.
SKETCH_LEAST = 0.58
#: Shingles that are sampled together; bounds memory for very long texts.
CHUNK = 4096
WORDS_KEPT = 200_000
#: Texts of a block of a bucket, and bytes of them.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Digests (16 bytes each) of texts that met another one, up to which they are broadcast rather than shuffled.
BROADCAST_ROWS = 500_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which close ones land far apart."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Numbers of words, 64-bit hashes, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = hashed(word)
        return h

    def hashes(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words, in order, without a list of all of them."""
        parts = []
        for words in decontam.word_lists(text):
            parts.append(np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words)))
            if len(self) > WORDS_KEPT:
                self.clear()
        return np.concatenate(parts)


def shingles(hashes: np.ndarray, idf: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles, sorted, and their weights. A text of fewer words, but some, is one shingle."""
    n = len(hashes)
    if not n:
        return hashes, np.empty(0)
    width = min(width, n)
    m = n - width + 1
    total = np.zeros(m, dtype=np.uint64)
    weight = np.zeros(m)
    each = idf[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m]
        weight += each[i : i + m]
    total = mixed(total + np.uint64(width))
    order = np.argsort(total, kind="stable")
    total = total[order]
    first = np.concatenate([[True], total[1:] != total[:-1]])
    return total[first], np.bincount(np.cumsum(first) - 1, weight[order] / width)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of smaller weights over the sum of larger ones."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    shared = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the gamma distribution of shape 2: logarithms at 2^16 points, values at 2^12 points."""

    def quantiles(n: int) -> np.ndarray:
        p = (np.arange(n) + 0.5) / n
        low, high = np.zeros(n), np.full(n, 60.0)
        for _ in range(60):
            middle = (low + high) / 2
            over = 1 - (1 + middle) * np.exp(-middle) > p
            low, high = np.where(over, low, middle), np.where(over, middle, high)
        return (low + high) / 2

    return np.log(quantiles(1 << 16)).astype(np.float32), quantiles(1 << 12).astype(np.float32)


@functools.cache
def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def samples(keys: np.ndarray, weights: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Consistent weighted samples of (key, weight) as ``n`` hashes of (key, level).

    For each sample and key: r and c from gamma distributions of shape 2, b uniform, all from one hash of the key;
    t = floor(ln(weight) / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the key with the smallest a is drawn.
    """
    log_c, gamma = tables()
    factor = multipliers(n)[:, None]
    logs = np.log(weights).astype(np.float32)
    best = np.full(n, np.inf, dtype=np.float32)
    drawn, level = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.float32)
    every = np.arange(n)
    for at in range(0, len(keys), CHUNK):
        k = keys[at : at + CHUNK]
        x = k[None, :] * factor
        x ^= x >> np.uint64(29)
        x *= _M1
        x ^= x >> np.uint64(32)
        r = gamma[((x >> np.uint64(20)) & np.uint64(0xFFF)).astype(np.uint16)]
        b = (x & np.uint64(0xFFFF)).astype(np.float32)
        b *= np.float32(2**-16)
        t = logs[at : at + CHUNK] / r
        t += b
        np.floor(t, out=t)
        a = log_c[(x >> np.uint64(48)).astype(np.uint16)]
        b -= t
        b -= np.float32(1)
        b *= r
        a += b
        least = a.argmin(axis=1)
        value = a[every, least]
        better = value < best
        best[better] = value[better]
        drawn[better] = k[least[better]]
        level[better] = t[every[better], least[better]]
    return mixed(drawn ^ mixed(level.astype(np.int64).astype(np.uint64) + np.uint64(77)))


def bands_of(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    total = np.zeros(bands, dtype=np.uint64)
    for i in range(rows):
        total = mixed(total + found[i * bands : (i + 1) * bands] + np.uint64(i))
    return (total + np.arange(bands, dtype=np.uint64)).view(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with a word of each cell, and documents, over all rows of ``texts`` (text, n: how many have it)."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        words = Words()
        total = np.zeros(CELLS, dtype=np.int64)
        docs = 0
        for batch in batches:
            for part in common.byte_slices(batch):
                for text, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    docs += n
                    total[np.unique((words.hashes(text) >> np.uint64(64 - CELL_BITS)).astype(np.int64))] += n
        rows = np.nonzero(total)[0].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(rows, np.int32(-1)), pa.int32()), pa.array(np.append(total[rows], docs))], schema=schema)

    summed = texts.mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros(CELLS + 1, dtype=np.int64)
    found = summed.toArrow()  # at most CELLS + 1 rows of two numbers
    total[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return total[:CELLS], int(total[-1])


def inverse(frequencies: np.ndarray, docs: int) -> np.ndarray:
    return (np.log((docs + 1) / (np.minimum(frequencies, docs) + 1)) + 1).astype(np.float32)


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """``pairs`` (a, b: digests) that are similar. The texts come by two joins on digests; a text that many pairs share
    is split over tasks by the skew join, and worked out once for each run of pairs that hold it."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        words, weights = Words(), idf.value
        held: tuple = (None, None)
        for batch in batches:
            for part in common.byte_slices(batch):
                keep = []
                for b, text_a, text_b in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    if held[0] != b:
                        held = (b, shingles(words.hashes(text_b), weights))
                    keep.append(similarity(shingles(words.hashes(text_a), weights), held[1]) >= threshold)
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    first = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compared, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component, for the nodes of ``edges`` (a, b)."""
    both = common.written(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        best = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(best, "node").select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = step.join(jump, "near").select("node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
        after = common.written(step, "labels")
        moved = after.agg(F.max("moved")).first()[0]
        common.remove_written(labels)
        labels = after.select("node", "label")
        if not moved:
            common.remove_written(both)
            return labels


def sketch_filter(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sketches have enough equal bytes."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(n, -1) for i in (2, 3))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= SKETCH_LEAST)).select(["a", "b"]) if n else batch.select(["a", "b"])

    both = pairs.join(sketches.select(F.col("digest").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    both = both.join(sketches.select(F.col("digest").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(near, "a binary, b binary")


def close_pairs(group: pa.Table) -> list[tuple[float, int, int]]:
    """(-share of equal sketch bytes, row, row) of the pairs of a group that aren't of one component, that no earlier
    band holds together, and that the sketches don't rule out."""
    n, band = group.num_rows, group.column("band")[0].as_py()
    bands = np.array(group.column("bands").to_pylist(), dtype=np.int64)[:, :band]
    sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(n, -1)
    label = np.unique(np.array([x.hex() for x in group.column("label").to_pylist()]), return_inverse=True)[1]
    block = np.array(group.column("block").to_pylist())
    inner = (block == block[0]).all()
    found: list[tuple[float, int, int]] = []
    for x in range(n - 1) if label.any() else ():
        rest = slice(x + 1, n)
        share = (sketches[rest] == sketches[x]).mean(axis=1)
        close = (share >= SKETCH_LEAST) & (label[rest] != label[x]) & (inner | (block[rest] != block[x]))
        if close.any():
            close &= ~(bands[rest] == bands[x]).any(axis=1)
            found += [(-share[k], x, x + 1 + k) for k in np.nonzero(close)[0].tolist()]
    return found


def block_links(rows: DataFrame, sampled: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) between the components of each bucket in ``rows`` (band, bucket, a, label, n, bytes).

    A bucket is cut into blocks, and each two blocks are one group of about ``2 * BLOCK`` texts or ``2 * BLOCK_BYTES`` of
    them at most, whatever the bucket's size. Groups see samples first; only texts that are in a pair which the samples
    leave are fetched. A group emits links that join components, never its pairs: the likeliest pairs are verified first,
    and pairs that are joined by then are passed over.
    """
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("a"), blocks).cast("int")})
    rows = rows.join(sampled.select(F.col("digest").alias("a"), "bands", "sketch"), "a")
    rows = rows.select("band", "bucket", "a", "label", "bands", "sketch", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    keys = ["band", "bucket", "i", "j"]

    def asked(group: pa.Table) -> pa.Table:
        at = sorted({i for _, x, y in close_pairs(group) for i in (x, y)})
        return group.take(pa.array(at, pa.int64()))

    def linked(group: pa.Table) -> pa.Table:
        digests, labels, texts = (group.column(c).to_pylist() for c in ("a", "label", "text"))
        words, weights, known, parent = Words(), idf.value, {}, {}

        def root(x: bytes) -> bytes:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        def vector(x: int):
            if x not in known:
                known[x] = shingles(words.hashes(texts[x]), weights)
            return known[x]

        found = []
        for _, x, y in sorted(close_pairs(group)):
            p, q = root(labels[x]), root(labels[y])
            if p != q and similarity(vector(x), vector(y)) >= threshold:
                parent[p] = q
                found.append((digests[x], digests[y]))
        return pa.table([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["a", "b"])

    left = common.written(rows.groupBy(*keys).applyInArrow(asked, rows.schema), "asked")
    return left.join(texts.withColumnRenamed("digest", "a"), "a").groupBy(*keys).applyInArrow(linked, "a binary, b binary")


def labelled_texts(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``rows`` (id, text): the different texts (digest, id, n, text), the samples of those with words (digest, bands,
    sketch), and the components (node, label) of similar ones."""
    spark = rows.sparkSession
    folded = rows.where("text is not null").groupBy(digest_of("text").alias("digest")).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("text").alias("text"))
    texts = common.written(folded, "texts")
    idf = spark.sparkContext.broadcast(inverse(*document_frequencies(texts.select("text", "n"))))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        words, weights = Words(), idf.value
        for part in (part for batch in batches for part in common.byte_slices(batch)):
            digests, bands, sketches, sizes = [], [], [], []
            for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                keys, w = shingles(words.hashes(text), weights)
                if len(keys):
                    found = samples(keys, w)
                    digests.append(d)
                    bands.append(bands_of(found))
                    sketches.append(found.astype(np.uint8).tobytes())
                    sizes.append(len(text))
            lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(bands) + 1, BANDS, dtype=np.int32), np.concatenate(bands) if bands else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), lists, pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64())], ["digest", "bands", "sketch", "size"])

    sampled = common.written(texts.select("digest", "text").mapInArrow(signed, "digest binary, bands array<long>, sketch binary, size long"), "samples")
    members = sampled.select("digest", F.posexplode("bands").alias("band", "bucket"))
    order = F.xxhash64("digest", "band")
    found = members.groupBy("band", "bucket").agg(F.count("*").alias("size"), F.min(F.struct(order.alias("o"), "digest")).alias("first")).where("size > 1")
    met = common.written(members.join(found, ["band", "bucket"]).select("band", "bucket", F.col("digest").alias("a"), F.col("first.digest").alias("b")), "buckets")
    involved = common.written(met.select(F.col("a").alias("digest")).distinct(), "involved")
    if involved.count() <= BROADCAST_ROWS:
        involved = F.broadcast(involved)
    near = common.written(texts.select("digest", "text").join(involved, "digest", "left_semi"), "near-texts")
    sketches = common.written(sampled.select("digest", "sketch").join(involved, "digest", "left_semi"), "sketches")
    star = common.written(met.where("a != b").select("a", "b").distinct(), "star")
    links = common.written(verified(sketch_filter(star, sketches), near, idf, threshold), "links")
    labels = common.written(components(links), "first-labels")

    # what a bucket holds together though it isn't linked: blocks of the buckets with several components
    named = met.join(labels.withColumnRenamed("node", "a"), "a", "left").select("band", "bucket", "a", F.coalesce("label", "a").alias("label"))
    named = named.join(sampled.select(F.col("digest").alias("a"), "size"), "a")
    sizes = named.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    open_rows = common.written(named.drop("size").join(sizes.select("band", "bucket", "n", "bytes"), ["band", "bucket"]), "open")
    more = common.written(block_links(open_rows, sampled, near, idf, threshold), "links")
    return texts, sampled, components(links.unionAll(more))


def digest_of(text: str | Column) -> Column:
    return F.unhex(F.md5((F.col(text) if isinstance(text, str) else text).cast("string").cast("binary")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep_digest: bool = False) -> DataFrame:
    """Per document row: id, class_id (the smallest id of its class) and n_texts, the different texts of the class.

    Words are runs of ASCII letters, digits and all other characters from U+0080, in lower case. A text of one to four
    words is one shingle. A text without a word, or null, is like nothing else: its class is its own id. Very long texts
    are compared whole. Exact copies and repeated rows share a class. Of equal candidates for a bucket's first text the
    smallest hash is taken, so results don't depend on partitions. An empty table gives no rows. A null id counts in its
    class, but names it only if all its ids are null.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with common.small_batches(docs.sparkSession):
        texts, sampled, final = labelled_texts(rows, threshold)

    ids = texts.select("digest", "id").join(sampled.select("digest"), "digest")
    named = ids.join(final.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "id", F.coalesce("label", "digest").alias("label"))
    classes = named.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("n_texts"))
    by_digest = common.written(named.join(classes, "label").select("digest", "label", "class_id", "n_texts"), "classes")
    keyed = rows.select("id", digest_of("text").alias("digest"))
    out = keyed.join(by_digest, "digest", "left")
    alone = F.col("n_texts").isNull()
    if keep_digest:  # and a key of the class that isn't null: texts without a word are by id and digest
        own = F.concat_ws("/", F.lit("own"), F.to_json(F.struct("id")), F.hex("digest"))
        return out.select("id", "digest", F.when(alone, own).otherwise(F.hex("label")).alias("class_key"))
    named_class = F.when(alone, F.col("id")).otherwise(F.col("class_id"))
    return out.select(F.col("id").alias(id_col), named_class.alias("class_id"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each class: of those with its smallest id, the one whose
    text has the smallest digest.

    Documents are told apart by id and text, and a null id is an id like others. A document without a word, or with a
    null text, is its own class. Of repeated rows of a document the smallest by all columns stays. An empty table gives
    no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    classes = near_duplicates(rows, "id", "text", threshold, keep_digest=True)
    document = F.struct(F.col("id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    kept = classes.groupBy("class_key", document.alias("document")).agg(F.count("*").alias("times"))
    kept = kept.groupBy("class_key").agg(F.min_by(F.struct("document", "times"), F.struct(F.col("document.kept_id").isNull(), "document")).alias("first"))
    kept = common.written(kept.select("first.document.*", "first.times"), "kept")
    same = lambda k: docs[id_col].eqNullSafe(k["kept_id"]) & digest_of(docs[text_col]).eqNullSafe(k["kept_digest"])
    once, often = kept.where("times = 1"), kept.where("times > 1")
    repeated = docs.join(often, same(often), "left_semi")
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    folded = repeated.groupBy(F.col(id_col).alias("k"), digest_of(text_col).alias("d")).agg(F.min_by(every, F.to_json(every)).alias("row")).select("row.*")
    return docs.join(once, same(once), "left_semi").unionByName(folded)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
