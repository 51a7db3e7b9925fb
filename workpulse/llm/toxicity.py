"""Toxicity by a linear-chain conditional random field that tags toxic words.

Only whole documents are labelled. Words, and beginnings of words, that stand in toxic documents far more often than
in others mark the toxic words of toxic documents; these marks train the field. Its marginals give each document the
expected number of toxic words and the surest one, from which a logistic curve, fitted to the documents' labels, makes
the score. Words with a marginal of a half or more are the offending spans.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, crf

#: Labelled documents of each class that the model is fitted on, at most; the ones with the smallest hashes of ids.
SAMPLE_DOCS = 1200
THRESHOLD = 0.3
#: Weight of a piece of text without a marked word, when the field is fitted.
UNMARKED = 0.25
#: Marginal from which a word counts among the expected toxic words.
LEAST_MARGINAL = 0.1


def copy_key(words: list[str]) -> int:
    """Near copies likely share it: the smallest hash of three words in a row."""
    return min(zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2)))


def cues(rows: list[tuple[str, int]], least_docs: int = 4, least_share: float = 0.015, least_odds: float = 3.0) -> set[str]:
    """Words and beginnings (four or five letters and ``*``) that mark toxic documents. Near copies count as one
    document, so that what one text says often, under a wrong label, isn't a mark."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    docs = [0, 0]
    held: dict[tuple[int, int], set[str]] = {}
    for text, toxic in rows:
        words = crf.words_of(text)
        held.setdefault((toxic, copy_key(words)), set()).update(words)
    for (toxic, _), words in held.items():
        counts[toxic].update(words | {w[:k] + "*" for w in words for k in (4, 5) if len(w) > k})
        docs[toxic] += 1
    least_docs = max(least_docs, math.ceil(least_share * docs[1]))
    odds = lambda c: math.log((counts[1][c] + 0.5) / (docs[1] + 1)) - math.log((counts[0][c] + 0.5) / (docs[0] + 1))
    return {c for c, n in counts[1].items() if n >= least_docs and odds(c) >= least_odds}


def marked(words: list[str], found: set[str]) -> list[int]:
    return [int(w in found or w[:4] + "*" in found or w[:5] + "*" in found) for w in words]


def document_features(toxic: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One, the log of one plus the expected toxic words, the largest marginal, by document. Words of small marginals
    count for nothing, so that a long text doesn't gather a toxic word from many harmless ones."""
    expected = np.add.reduceat(np.where(toxic >= LEAST_MARGINAL, toxic, 0), starts)
    return np.stack([np.ones(len(starts)), np.log1p(expected), np.maximum.reduceat(toxic, starts)], axis=1)


class Model:
    """A tagger and the logistic curve over its document features."""

    def __init__(self, tagger: crf.Crf, curve: np.ndarray):
        self.tagger, self.curve = tagger, curve

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve, -30, 30)))


def fit_curve(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method; the ridge keeps separable labels finite."""
    w = np.zeros(features.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        h = (features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        w += np.linalg.solve(h, features.T @ (labels - p) - ridge * w)
    return w


def fit_model(rows: list[tuple[str, int]]) -> Model | None:
    rows = [(t, y) for t, y in rows if crf.words_of(t)]
    if len({y for _, y in rows}) < 2:
        return None
    found = cues(rows)
    sequences, weight = [], []
    for text, toxic in rows:
        words = crf.words_of(text)
        marks = marked(words, found) if toxic else [0] * len(words)
        for at in range(0, len(words), 60):
            sequences.append((words[at : at + 60], marks[at : at + 60]))
            weight.append(1.0 if any(sequences[-1][1]) else UNMARKED)
    model = Model(crf.fit(sequences, [0, 1], steps=40, weight=weight), np.zeros(3))
    features = [document_features(found[:, 1].astype(np.float64), starts) for _, found, starts in model.tagger.tagged(t for t, _ in rows)]
    model.curve = fit_curve(np.concatenate(features), np.array([y for _, y in rows], dtype=float))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model of documents with a 0 or 1 in ``label_col``, or None unless both occur among texts with words.

    ``sample_docs`` rows of each class at most come to the driver; the sample is the same on each run.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = common.written(known, "labels")
    sample = common.bounded_sample(known.where("toxic = 1"), "id", sample_docs).unionAll(common.bounded_sample(known.where("toxic = 0"), "id", sample_docs))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(sample), "id")  # at most 2 * sample_docs rows
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return fit_model(sorted((r["text"], r["toxic"]) for r in rows.collect()))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """Per document: id and score; with ``with_spans``, the toxic words as (start, end, marginal), in code points of
    the text, end exclusive.

    A null or empty text, or one without a word, gets the curve's value at no toxic word; without a model every score
    is 0. A very long text is tagged whole, in blocks of words with the state carried on. A repeated row gives a row each; an empty table none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_arrow = to_arrow_type(rows.schema["id"].dataType)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])
    arrow = pa.schema([("id", id_arrow), ("score", pa.float64())] + [("spans", pa.list_(span))] * with_spans)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            if tagger is not None:
                scores[:] = tagger.score(np.array([[1.0, 0.0, 0.0]]))[0]
                for which, found, starts in tagger.tagger.tagged(common.texts_of(batch, 1)):
                    toxic = found[:, 1].astype(np.float64)
                    scores[which] = tagger.score(document_features(toxic, starts))
                    if with_spans:
                        for i, p in zip(which, np.split(toxic, starts[1:])):
                            if p.max() >= 0.5:
                                places = [m.span() for m in crf.WORD.finditer(crf.lowered(batch.column(1)[i].as_py()))]
                                spans[i] = [{"start": places[j][0], "end": places[j][1], "marginal": float(p[j])} for j in np.nonzero(p >= 0.5)[0]]
            arrays = [batch.column(0).cast(id_arrow), pa.array(scores)] + ([pa.array(spans, pa.list_(span))] if with_spans else [])
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    sql = f"id {rows.schema['id'].dataType.simpleString()}, score double" + ", spans array<struct<start:long,end:long,marginal:double>>" * with_spans
    return rows.mapInArrow(scored, sql).withColumnRenamed("id", id_col)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.id_remainder(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out), common.table(spark, sf_dir, "labels").where(~held_out))
    found = score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
