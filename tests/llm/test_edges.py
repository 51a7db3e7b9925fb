"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from workpulse.llm import ann, decontam, htmltext, langid, licenses, lm, neardup, packing, secrets, toxicity

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
ROWS = [(1, None, "x"), (2, "", "x"), (3, LONG, None), (4, "same text here twice over", "x"), (4, "same text here twice over", "x"), (None, "no id at all", None), (5, "12 34 ... \n\t", "x"), (6, "Ünïcödé ﬁ 日本 😀", "y"), (7, "\x00\x01 control", "y")]
SCHEMA = "doc_id long, text string, lang string"
CLASHES = ("id", "key", "n", "words", "block", "digest", "bands", "label", "score", "vector", "html", "found", "matches", "held_out", "rank", "row", "item", "hits", "class_id", "length", "train")

OPERATORS = {
    "licenses": licenses.scan,
    "lm": lambda docs: lm.score_documents(docs, F.col("doc_id") > 2),
    "decontam": lambda docs: decontam.find_leaks(docs, docs.select(F.col("doc_id").alias("item_id"), "text")),
    "langid": lambda docs: langid.predict(docs, langid.train(docs)),
    "toxicity": lambda docs: toxicity.score(docs, toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))),
    "packing": lambda docs: packing.pack(docs.sparkSession, docs),
    "secrets": secrets.find_secrets,
    "neardup": neardup.near_duplicates,
    "neardup rows": neardup.representatives,
    "decontam rows": lambda docs: decontam.drop_leaks(docs, docs.select(F.col("doc_id").alias("item_id"), F.lit("same text here").alias("text"))),
    "langid rows": lambda docs: langid.keep_known(docs, langid.train(docs)),
    "secrets rows": secrets.redact_documents,
}
KEEPS_ALL = set(OPERATORS) - {"neardup rows", "decontam rows", "langid rows"}


def with_clashes(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = OPERATORS[name](with_clashes(docs).withColumn("n_chars", F.length("text").cast("long"))).collect()
    ids = [r["doc_id"] for r in rows]
    if name in KEEPS_ALL:
        assert set(ids) == {r[0] for r in ROWS}
        if name != "packing":
            assert len(rows) == len(ROWS)
    else:
        assert set(ids) <= {r[0] for r in ROWS}
    if name == "neardup":
        assert {r["doc_id"]: r["class_id"] for r in rows} == {r[0]: r[0] for r in ROWS}
    if name == "neardup rows":
        assert len(rows) == len({r[0] for r in ROWS})
    if name == "decontam rows":
        assert 4 not in ids and len(rows) == len(ROWS) - 2
    if name == "langid rows":
        assert not {1, 2, 5} & set(ids)


@pytest.fixture(scope="module")
def different():
    """Over a megabyte of text, so over several stretches in which texts are cut into words; no word twice."""
    return " ".join(f"w{i:x}z" for i in range(150_000))


@pytest.mark.parametrize("name", OPERATORS)
def test_long_text_of_different_words(spark, name, different):
    docs = spark.createDataFrame([(1, different, "x"), (2, "a short text of few words", "y"), (3, "another one, of other words", "x")], SCHEMA)
    rows = OPERATORS[name](docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3}
    if name == "lm":
        assert {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 150_001
    if name == "decontam":
        assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in rows}[1] == (150_000, 150_000)
    if name == "packing":
        assert sum(r["length"] for r in rows if r["doc_id"] == 1) > 150_000


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_untrained_predictions(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = langid.predict(docs, None).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_search_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, [None, 1.0]), (40, [0.0, 0.0]), (None, [1.0, 2.0])]
    vectors = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(vectors, F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0)]
    assert ann.search(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_grid_cells_give_the_same_neighbours(spark, small):
    from workpulse.llm import common

    vectors = common.table(spark, small, "embeddings")
    asked = F.col("vec_id") % 20 == 0
    # with so large a number of neighbours every candidate is found, whatever the cells
    every = lambda **x: sorted(map(tuple, ann.search(vectors, asked, k=10_000, **x).collect()))
    assert every() == every(index_rows=30, query_rows=3)


def test_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "https://h/", "<p>" + LONG), (4, "https://h/", "<div><b>unclosed &amp; <!-- never"), (4, "https://h/", "<div><b>unclosed &amp; <!-- never"), (None, "x", "<script>only")]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, body string").drop("html")).withColumn("html", F.col("body"))
    found = sorted(((r["page_id"] or 0, r["text"]) for r in htmltext.extract(pages).collect()))
    assert found == [(0, ""), (1, ""), (2, ""), (3, LONG.strip()), (4, "unclosed &"), (4, "unclosed &")]
    assert htmltext.extract(pages.limit(0)).collect() == []


def test_classes_of_tags_are_judged_once():
    from workpulse.llm import htmltext

    htmltext.is_marked.cache_clear()
    page = "<article>" + '<p class="related-posts list">gone</p><p class="related-work">kept</p>' * 50 + f'<p class="{"x " * 200}">long</p></article>'
    found, kinds = htmltext.blocks(page)
    assert found == ["gone", "kept"] * 50 + ["long"] and kinds == "h2" * 50 + "2"
    assert htmltext.is_marked.cache_info().misses == 2
