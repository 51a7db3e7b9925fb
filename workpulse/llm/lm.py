"""Language-model scoring by a hidden Markov model.

The base model is the smoothed unigram p(w) over the training words and one unknown word. The hidden Markov model
factors a state's emission through word classes: P(w | state) = E[state, class(w)] * p(w) / p(class(w)), where p of a
class is the sum over its words. It is a proper distribution over the same outcomes, and equals the base where the
states agree with it. Words of at least ``OWN_CLASS`` of all tokens are classed by a hash of the whole word, others by
a hash of their affixes, the unknown word by itself: the model's tables have a fixed size however large the vocabulary.

1. One pass numbers each block's words (a block is a bounded stretch of one task's rows) and writes the documents as
   word numbers, beside the block's vocabulary. Text isn't moved.
2. Counts by word are summed over blocks and joined back to the blocks' vocabularies: exact counts over all training
   documents, with rows for a block's different words rather than for its tokens.
3. A block's documents meet its vocabulary: base scores, class sequences.
4. Baum-Welch: each pass over all training documents, whole ones, sums expected counts by class in the tasks, then by
   Spark. Passes end when the likelihood hardly grows.
5. The scaled forward recursion gives each document's exact likelihood.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, crf

STATES = 6
#: Passes of Baum-Welch over all training documents, at most; it ends before where a pass gains so few nats a token.
PASSES, LEAST_GAIN = 3, 0.02
HASHES = 1 << 14
CLASSES = 2 * HASHES + 1
UNKNOWN_CLASS = 2 * HASHES
OWN_CLASS = 2e-6
SMOOTH = 0.1
#: A block ends after so many tokens or different words.
BLOCK_TOKENS, BLOCK_WORDS = 4_000_000, 600_000
#: Bytes of text that are cut into words together.
TEXT_BYTES = 1 << 20
#: Tokens that go through the recursion together. A longer sequence goes alone, in blocks with the state carried on.
SLICE_TOKENS = 1 << 19
#: Tokens of a class at which half its emission is its own and half the base's.
PRIOR_TOKENS = 20.0

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end of a text as a word; no word holds a space.
END = b" "
_SPACE = re.compile(rb"\s")

_NUMBERED = pa.schema([
    ("block", pa.int64()), ("key", pa.string()), ("train", pa.bool_()), ("words", pa.list_(pa.int32())),
    ("word", pa.binary()), ("local", pa.int32()), ("n", pa.int64()), ("whole", pa.int32()), ("affix", pa.int32()),
])
_NUMBERED_SQL = "block long, key string, train boolean, words array<int>, word binary, local int, n long, whole int, affix int"


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, about ``TEXT_BYTES`` bytes of it at a time, and its end as the last word."""
    body, at = (text or "").encode("utf-8", "replace").translate(_LOWER), 0
    while len(body) - at > TEXT_BYTES:
        gap = _SPACE.search(body, at + TEXT_BYTES)
        stop = gap.start() if gap else len(body)
        yield body[at:stop].split()
        at = stop
    yield [*body[at:].split(), END]


def words_of(text: str | None) -> list[bytes]:
    return [w for part in word_lists(text) for w in part]


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (key, train, text) as rows of two kinds, told apart by ``word``: documents as their block's word
    numbers, and each block's words with their training counts."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * 1_000_000
        known: dict[bytes, int] = {}
        counts = np.zeros(0, dtype=np.int64)
        tokens = 0

        def vocabulary() -> Iterator[pa.RecordBatch]:
            words = iter(known)
            for at in range(0, len(known), 20_000):
                part = list(itertools.islice(words, 20_000))
                n = len(part)
                whole = np.fromiter((zlib.crc32(w) % HASHES for w in part), dtype=np.int32, count=n)
                affix = np.fromiter((zlib.crc32(w[:1] + w[-3:]) % HASHES for w in part), dtype=np.int32, count=n)
                none = [pa.nulls(n, t) for t in (pa.string(), pa.bool_(), pa.list_(pa.int32()))]
                arrays = [pa.array(np.full(n, block)), *none, pa.array(part, pa.binary()), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(counts[at : at + n]), pa.array(whole), pa.array(affix)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_NUMBERED)

        def documents(keys: list[str], trains: list[bool], sequences: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal counts
            if len(counts) < len(known):
                counts = np.concatenate([counts, np.zeros(len(known), dtype=np.int64)])
            if learn := [s for s, t in zip(sequences, trains) if t]:
                counts[: len(known)] += np.bincount(np.concatenate(learn), minlength=len(known))
            n = len(sequences)
            flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sequences)]).astype(np.int32), np.concatenate(sequences))
            none = [pa.nulls(n, t) for t in (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(keys, pa.string()), pa.array(trains, pa.bool_()), flat, *none], schema=_NUMBERED)

        def numbers(text: str | None) -> np.ndarray:
            """Word numbers of a text, without a list of all its words."""
            parts = []
            for words in word_lists(text):
                found = list(map(known.get, words))
                if None in found:
                    found = [known.setdefault(w, len(known)) for w in words]
                parts.append(np.array(found, dtype=np.int32))
            return np.concatenate(parts)

        for batch in batches:
            for part in common.byte_slices(batch):
                keys, trains, sequences = [], [], []
                for key, train, text in zip(*(c.to_pylist() for c in part.columns)):
                    keys.append(key)
                    trains.append(train)
                    sequences.append(numbers(text))
                    tokens += len(sequences[-1])
                    if tokens > BLOCK_TOKENS or len(known) > BLOCK_WORDS:
                        yield from documents(keys, trains, sequences)
                        yield from vocabulary()
                        keys, trains, sequences = [], [], []
                        block, known, counts, tokens = block + 1, {}, counts[:0], 0
                if keys:
                    yield from documents(keys, trains, sequences)
        yield from vocabulary()

    return rows.mapInArrow(number, _NUMBERED_SQL)


class Model:
    """Log emissions (classes by states), log transitions and log begin probabilities."""

    def __init__(self, emissions: np.ndarray, transitions: np.ndarray, begin: np.ndarray):
        self.emissions, self.transitions, self.begin = emissions, transitions, begin
        self.emit, self.top = crf.emissions(emissions)

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of (class, state), (state, state) and first states over the sequences, none of them empty,
        and the sequences' log likelihood. Sequences are learnt from whole."""
        states = len(self.begin)
        emit, move, first, total = np.zeros((CLASSES, states)), np.zeros((states, states)), np.zeros(states), 0.0
        table, transitions, begin = (x.astype(np.float32) for x in (self.emit, self.transitions, self.begin))
        for part in sliced(sequences):
            tokens = np.concatenate(part)
            lengths = np.array([len(s) for s in part], dtype=np.int64)
            starts = np.zeros(len(tokens), dtype=bool)
            starts[np.cumsum(lengths) - lengths] = True
            totals: list[float] = []
            for at, found, pairs in crf.marginal_blocks(table, tokens, lengths, transitions, begin, totals):
                classes = tokens[at].astype(np.int64)
                for s in range(states):
                    emit[:, s] += np.bincount(classes, found[s], CLASSES)
                move += pairs
                first += found[:, starts[at]].sum(axis=1, dtype=np.float64)
            total += sum(totals) + float(self.top[tokens].sum())
        return emit, move, first, total

    def log_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms, by the scaled forward recursion in double precision."""
        out = np.empty(len(sequences))
        order = by_length(sequences)
        at = 0
        for part in sliced(sequences):
            tokens = np.concatenate(part)
            lengths = np.array([len(s) for s in part], dtype=np.int64)
            out[order[at : at + len(part)]] = crf.log_totals(self.emit, self.top, tokens, lengths, self.transitions, self.begin)
            at += len(part)
        return out


def by_length(sequences: list[np.ndarray]) -> np.ndarray:
    return np.argsort([-len(s) for s in sequences], kind="stable")


def sliced(sequences: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The sequences, longest first, about ``SLICE_TOKENS`` tokens at a time: sequences of like lengths take few steps."""
    part, tokens = [], 0
    for i in by_length(sequences):
        part.append(sequences[i])
        tokens += len(sequences[i])
        if tokens >= SLICE_TOKENS:
            yield part
            part, tokens = [], 0
    if part:
        yield part


def maximised(emit: np.ndarray, move: np.ndarray, first: np.ndarray, base: np.ndarray) -> Model:
    """The model of expected counts. A class of n tokens keeps n / (n + PRIOR_TOKENS) of its own division among the
    states; the rest is divided as all tokens are, so that rare classes stay near the base."""
    mass = emit.sum(axis=0)
    n = emit.sum(axis=1)
    own = (n / (n + PRIOR_TOKENS))[:, None]
    emit = own * emit + (1 - own) * n[:, None] * (mass / mass.sum()) + 1e-3 * base[:, None] * mass
    emit[UNKNOWN_CLASS] = base[UNKNOWN_CLASS] * mass
    move = move + 1.0
    first = first + 1.0
    with np.errstate(divide="ignore"):
        logs = np.log(emit / emit.sum(axis=0))
    return Model(np.maximum(logs, -700), np.log(move / move.sum(axis=1, keepdims=True)), np.log(first / first.sum()))


def tilted(base: np.ndarray, states: int) -> Model:
    """Where Baum-Welch starts: states are the base with random tilts and tend to stay."""
    tilt = np.exp(np.random.default_rng(5).normal(0, 0.5, (CLASSES, states)))
    sticky = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
    return maximised(base[:, None] * tilt * 1e6, sticky * 1e4, np.ones(states), base)


def baum_welch(sequences: DataFrame, model: Model, base: np.ndarray) -> tuple[Model, float]:
    """One pass over all training rows of ``sequences`` (classes): counts are summed by task, then over tasks by class,
    so that what reaches the driver has the size of the model. Returns also the log likelihood under ``model``."""
    states = len(model.begin)
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(states)]
    schema = pa.schema([("row", pa.int32())] + [(x, pa.float64()) for x in names])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in common.byte_slices(batch, 1 << 20, 8 << 20):
                found = shared.value.expected(from_bytes(part.column(0)))
                total = found if total is None else tuple(a + b for a, b in zip(total, found))
        if total is not None:
            every = np.concatenate([total[0], total[1], total[2][None], np.full((1, states), total[3])])
            rows = np.nonzero(every.any(axis=1))[0]
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32))] + [pa.array(every[rows, i]) for i in range(states)], schema=schema)

    rows = sequences.where("train").select("classes").mapInArrow(counted, "row int, " + ", ".join(f"{x} double" for x in names))
    every = np.zeros((CLASSES + states + 2, states))
    for r in rows.groupBy("row").agg(*(F.sum(x).alias(x) for x in names)).toPandas().to_numpy():
        every[int(r[0])] = r[1:]
    return maximised(every[:CLASSES], every[CLASSES : CLASSES + states], every[-2], base), float(every[-1, 0])


def trained(sequences: DataFrame, base: np.ndarray, states: int, passes: int, least_gain: float) -> Model:
    """Passes over all training documents until one gains less than ``least_gain`` nats a token, ``passes`` at most."""
    model, before = tilted(base, states), -np.inf
    tokens = sequences.where("train").agg(F.sum("n_tokens")).first()[0] or 0
    for _ in range(passes if tokens else 0):
        model, likelihood = baum_welch(sequences, model, base)
        if (likelihood - before) / tokens < least_gain:
            break
        before = likelihood
    return model


def from_bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=np.uint16) for v in column.to_pylist()]


def score_documents(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES
) -> DataFrame:
    """Per document: id, train, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    ``train`` says which rows are learnt from; a null counts as false. A null or empty text has one token, its end. A
    very long text is learnt from and scored whole, in blocks with the state carried on. A repeated row is a document of its own, in training too. An empty table gives no rows; without training rows every
    token is unknown and has probability 1. Ids come back as given, by their text.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.to_json(F.struct(F.col(id_col).alias("id"))).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    with common.small_batches(docs.sparkSession):
        both = common.written(numbered(rows), "numbered")
    vocabulary = both.where("word is not null").select("block", "local", "word", "n", "whole", "affix")
    totals = vocabulary.groupBy("word").agg(F.sum("n").alias("c"), F.first("whole").alias("whole"), F.first("affix").alias("affix"))
    size = vocabulary.agg(F.sum("n")).first()[0] or 0
    kind = F.when(F.col("c") == 0, UNKNOWN_CLASS).when(F.col("c") >= OWN_CLASS * size, F.col("whole")).otherwise(F.col("affix") + HASHES).cast("int")
    totals = totals.select("word", "c", kind.alias("class"))
    looked_up = common.written(vocabulary.select("block", "local", "word").join(totals, "word").select("block", "local", "c", "class"), "vocabulary")
    by_class = common.written(totals.where("c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")), "classes").collect()  # at most CLASSES rows
    different = sum(r["v"] for r in by_class)
    whole = size + SMOOTH * (different + 1)
    base = np.zeros(CLASSES)
    for r in by_class:
        base[r["class"]] = (r["c"] + SMOOTH * r["v"]) / whole
    base[UNKNOWN_CLASS] = SMOOTH / whole

    out = pa.schema([("key", pa.string()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within", pa.float64()), ("classes", pa.binary())])

    def met(documents: pa.Table, words: pa.Table) -> pa.Table:
        local = words.column("local").to_numpy()
        counts = np.zeros(len(local), dtype=np.int64)
        kinds = np.zeros(len(local), dtype=np.uint16)
        counts[local] = words.column("c").to_numpy()
        kinds[local] = words.column("class").to_numpy().astype(np.uint16)
        logs = np.log10((counts + SMOOTH) / whole)
        inside = logs - np.log10(base[kinds])
        inside = np.stack([logs, inside, counts > 0])
        out_classes, sums, lengths = [], [], []
        for batch in documents.select(["words"]).to_batches(max_chunksize=1024):
            lists = batch.column(0)
            tokens, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            starts = (edges[:-1] - edges[0]).astype(np.int64)
            tokens = tokens[edges[0] : edges[-1]]
            sums.append(np.add.reduceat(inside[:, tokens], starts, axis=1))  # no document is without a token
            lengths.append(np.diff(edges).astype(np.int64))
            out_classes += [c.tobytes() for c in np.split(kinds[tokens], starts[1:])]
        logs, inside, known = np.concatenate(sums, axis=1)
        arrays = [np.concatenate(lengths), known.astype(np.int64), logs, inside, pa.array(out_classes, pa.binary())]
        return pa.table([documents.column("key"), documents.column("train"), *(a if isinstance(a, pa.Array) else pa.array(a) for a in arrays)], schema=out)

    documents = both.where("word is null").select("block", "key", "train", "words")
    sequences = common.written(
        documents.groupBy("block").cogroup(looked_up.groupBy("block")).applyInArrow(met, "key string, train boolean, n_tokens long, n_known long, base_score double, within double, classes binary"),
        "sequences",
    )
    common.remove_written(looked_up)
    common.remove_written(both)

    model = trained(sequences, base, states, passes, LEAST_GAIN)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    schema = "key string, train boolean, n_tokens long, n_known long, base_score double, score double"

    def scored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.byte_slices(batch, 1 << 20, 8 << 20):
                found = shared.value.log_likelihoods(from_bytes(part.column(6))) / np.log(10) + part.column(5).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(5)] + [pa.array(found)], ["key", "train", "n_tokens", "n_known", "base_score", "score"])

    found = sequences.mapInArrow(scored_rows, schema)
    ids = F.from_json("key", f"id {id_type.simpleString()}")["id"]
    return found.select(ids.alias(id_col), "train", "n_tokens", "n_known", F.lit(size).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score_documents(docs, common.id_remainder(F.col("doc_id"), 10) != 0)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
