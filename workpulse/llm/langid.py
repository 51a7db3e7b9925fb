"""Language identification of code-switched text by a linear-chain conditional random field.

Each word gets a language by forward-backward; a document's language is the one with the largest mean marginal, and
its score is that mean. The model is fitted on the driver from a bounded sample of labelled documents; prediction is a
map over whole texts.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, crf

#: Labelled documents that the model is fitted on, at most; the ones with the smallest hashes of their ids.
SAMPLE_DOCS = 600
UNKNOWN = "und"


def training_sequences(rows: list[tuple[str, str]], seed: int = 7) -> tuple[list[tuple[list[str], list[int]]], list[str]]:
    """Pieces of 10 to 40 words, some of them joined with a piece of another document, so that transitions between
    languages are seen as well as those within one."""
    labels = sorted({lang for _, lang in rows})
    draw = random.Random(seed)
    pieces = []
    for text, lang in rows:
        words = crf.words_of(text)
        at = 0
        while part := words[at : at + draw.randint(10, 40)]:
            pieces.append((part, [labels.index(lang)] * len(part)))
            at += len(part)
    draw.shuffle(pieces)
    third = len(pieces) // 3
    mixed = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(pieces[:third], pieces[third : 2 * third])]
    return mixed + pieces[2 * third :], labels


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> crf.Crf | None:
    """A model of the labelled rows of ``docs`` (text with words and a language), or None if there are none.

    ``sample_docs`` bounds what comes to the driver. The sample is the same on each run, whatever the partitions.
    """
    rows = docs.select(F.col(key_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = common.bounded_sample(rows.where("text is not null and lang is not null"), "key", sample_docs)
    sequences, labels = training_sequences([(r["text"], r["lang"]) for r in rows.collect()])
    return crf.fit(sequences, labels, steps=40) if sequences else None


def languages_of(tagger: crf.Crf | None, texts: Iterable[str | None], n: int) -> tuple[list[str], np.ndarray, list[list[tuple[str, float]]]]:
    """The language of each of ``n`` texts, its score, and the mean marginals of all languages; ``und``, 0 and none where
    it has no word."""
    langs, scores, means = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
    for which, found, starts in tagger.tagged(texts) if tagger is not None else ():
        mean = np.add.reduceat(found, starts, axis=0, dtype=np.float64) / np.diff(np.append(starts, len(found)))[:, None]
        for i, best, m in zip(which, mean.argmax(axis=1), mean):
            langs[i], scores[i] = tagger.labels[best], min(1.0, float(m[best]))
            means[i] = list(zip(tagger.labels, map(float, m)))
    return langs, scores, means


def predict(docs: DataFrame, model: crf.Crf | None, id_col: str = "doc_id", text_col: str = "text", shares: bool = False) -> DataFrame:
    """Per document: id, lang_pred and score; with ``shares``, also each language's mean marginal as a map.

    A null or empty text, or one without a letter, is ``und`` with score 0, and so is every text where there is no
    model. A very long text is judged whole, in blocks of words with the state carried on. Of languages with equal means
    the first by name is taken. A repeated row gives a row each; an empty table none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_arrow = to_arrow_type(rows.schema["id"].dataType)
    fields = [("id", id_arrow), ("lang_pred", pa.string()), ("score", pa.float64())]
    arrow = pa.schema(fields + [("shares", pa.map_(pa.string(), pa.float64()))] * shares)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        tagger = shared.value
        for batch in batches:
            langs, scores, means = languages_of(tagger, common.texts_of(batch, 1), batch.num_rows)
            arrays = [batch.column(0).cast(id_arrow), pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(means, arrow.field("shares").type)] * shares if shares else arrays, schema=arrow)

    sql = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double" + ", shares map<string,double>" * shares
    return rows.mapInArrow(predicted, sql).withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: crf.Crf | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, for whose text ``predict`` names a language; where ``lang_col`` is null it gets
    that language. How evenly languages share a text doesn't matter: text that is in several of them stays.

    Texts that are null, empty or without a letter go, and all rows where there is no model. Very long texts are judged
    whole, in bounded memory. Of languages with equal means the first by name is taken. A repeated row stays as often as
    it is given; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)
    at_lang = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        tagger = shared.value
        for batch in batches:
            langs = pa.array(languages_of(tagger, common.texts_of(batch, at_text), batch.num_rows)[0], pa.string())
            if at_lang is not None:
                filled = pc.coalesce(batch.column(at_lang), langs.cast(batch.column(at_lang).type))
                batch = batch.set_column(at_lang, batch.schema.field(at_lang), filled)
            yield batch.filter(pc.not_equal(langs, UNKNOWN))

    return docs.mapInArrow(kept, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.where(common.id_remainder(F.col("doc_id"), 4) != 2))
    found = predict(docs, model)
    return found.select("doc_id", (common.id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
