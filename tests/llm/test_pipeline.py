"""The corpus pipeline, stage by stage, against brute force on the small tables."""

from __future__ import annotations

import itertools
import weakref
from types import SimpleNamespace

import corpus_pipeline
from workpulse.llm import common, crf, langid, neardup, packing, secrets

from .test_exact import classes_by_hand, leaks_by_hand, packed_rightly, texts_of


def test_no_document_with_a_language_is_lost(spark, small):
    docs = common.table(spark, small, "documents")
    mixed = mixed_texts(docs)
    model = langid.train(docs)
    given = spark.createDataFrame([(-i, t, None, "mixed", len(t)) for i, t in enumerate(mixed, 1)], docs.schema).unionByName(docs)
    found = {r["doc_id"]: r for r in langid.predict(given, model).collect()}
    assert {found[-i]["score"] < 0.5 for i in range(1, len(mixed) + 1)} == {True}
    kept = {r["doc_id"] for r in langid.keep_known(given, model).collect()}
    assert kept == {k for k, r in found.items() if r["lang_pred"] != langid.UNKNOWN}
    assert kept == {r["doc_id"] for r in given.collect() if crf.words_of(r["text"])}


def mixed_texts(docs, words: int = 60) -> list[str]:
    """Clean text in three languages, as much of each."""
    texts: dict[str, str] = {}
    for r in sorted(docs.where("lang is not null").collect(), key=lambda r: r["doc_id"]):
        if len(r["text"].split()) >= words:
            texts.setdefault(r["lang"], " ".join(r["text"].split()[:words]))
    assert len(texts) >= 3
    return [" ".join(part) for part in itertools.combinations(texts.values(), 3)]


def test_stages(spark, small):
    docs = common.table(spark, small, "documents")
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.written(stage(spark, before, small), f"stage-{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.schema.simpleString() == docs.schema.simpleString(), name
            given, kept = ({r["doc_id"]: r.asDict() for r in d.collect()} for d in (before, after))
            assert set(kept) <= set(given)
        if i == 0:
            assert all(crf.words_of(r["text"]) for r in kept.values())
            clean = [k for k, r in given.items() if r["lang"] and len(crf.words_of(r["text"])) >= 20]
            assert len(set(clean) - set(kept)) <= 0.02 * len(clean)
        if i == 1:
            folded = before.where("text is not null").groupBy("text").count().select("text", "count")
            classes = classes_by_hand({k: r["text"] for k, r in given.items()}, neardup.inverse(*neardup.document_frequencies(folded)))
            assert set(kept) == set(classes.values())
        if i == 2:
            items = texts_of(spark, small, "benchmark", "item_id")
            assert set(kept) == {k for k, r in given.items() if not leaks_by_hand(r["text"], items)[1]}
        if i == 3:
            assert set(kept) == set(given)
            for k, r in kept.items():
                text = given[k]["text"]
                assert not secrets.base_spans(r["text"] or "") or text != r["text"]
                assert r["n_chars"] == len(r["text"]) if r["text"] != text else r == given[k]
        before = after
    packed_rightly(after.collect(), {k: r["text"] for k, r in kept.items()})
    whole = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, small).collect())
    assert whole == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after.collect())


def test_stages_keep_one_of_repeated_rows_and_tell_texts_of_one_id_apart(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one text of some words", "en", "b", 22), (1, "one text of some words", "en", "a", 22), (1, "quite another text under the same id", "en", "a", 36), (2, "one text of some words", "en", "a", 22), (3, None, None, "a", None), (3, None, None, "a", None)]
    found = sorted(map(tuple, neardup.representatives(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert found == sorted([rows[1], rows[2], rows[4]], key=str)


def test_language_is_written_where_it_is_missing(spark, small):
    docs = common.table(spark, small, "documents")
    model = langid.train(docs)
    kept = langid.keep_known(docs, model).select("doc_id", "lang").collect()
    given = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert all(r["lang"] == (given[r["doc_id"]] or found[r["doc_id"]]) for r in kept)


def test_a_worker_drops_the_words_of_packing_when_another_stage_begins(monkeypatch):
    monkeypatch.setattr(common, "map_whole_rows", lambda docs, text_col, start: start)
    frame = SimpleNamespace(columns=["text"], schema=None, sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda model: SimpleNamespace(value=model))), mapInArrow=lambda f, schema: f)
    begin = {"language ID": lambda: list(langid.keep_known(frame, None)(iter(()))), "secret scans": lambda: secrets.redact_documents(frame)()}
    for stage in begin.values():
        held = weakref.ref(packing.encoder(common.tokenizer_path(None)))
        assert packing.encoder(common.tokenizer_path(None)) is held()
        stage()
        assert held() is None


def test_words_kept_for_packing_are_bounded(monkeypatch):
    own = packing.WordEncoder(common.tokenizer_path(None))
    texts = [" ".join(f"word{(7 * i + k) % 900}{'x' * (k % 5)}" for k in range(40)) for i in range(200)] + ["z" * 5000]
    plain = [b"".join(own._ids(own.tokenizer.encode(w, add_special_tokens=False).ids) for w in t.split()) for t in texts]
    for kept, chars in ((100, 1 << 20), (1 << 20, 600)):
        monkeypatch.setattr(packing, "WORDS_KEPT", kept)
        monkeypatch.setattr(packing, "CHARS_KEPT", chars)
        own = packing.WordEncoder(common.tokenizer_path(None))
        for text, ids in zip(texts, plain):
            assert own.encode(text) == ids
            assert len(own.known) <= kept + 40 and len(own.older) <= kept + 40
        assert len(own.known) + len(own.older) < 300
