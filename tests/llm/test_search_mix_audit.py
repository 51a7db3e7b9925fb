"""Ranked search, mixing and the filter audit against brute force, and on odd rows."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from workpulse.llm import common, interaction, mixing, ranked

from ..conftest import rows_of, rows_of_sql
from .test_edges import LONG, ROWS, SCHEMA, with_clashes

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("module, name", [(interaction, "op11_filter_interaction"), (mixing, "op12_source_mix"), (ranked, "op13_ranked_search")])
def test_queries_equal_sql(spark, small, duck, module, name):
    assert rows_of(getattr(module, name)(spark, small)) == rows_of_sql(duck, module.sql())


def terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def best_by_hand(docs, items, k=10):
    """docs: (id, text); items: {id: text}. {item: [(score, id)]}, best first; null ids last."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    found = {}
    for item, text in items.items():
        asked = Counter(terms(text))
        df = {t: sum(t in c for _, c in held) for t in asked}
        scored = []
        for i, c in held:
            if c:
                m = 25 + 75 * sum(c.values()) * n // total
                score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
                if score > 0:
                    scored.append((score, i))
        if scored:
            found[item] = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    return found


def searched(docs, items, **how):
    rows = ranked.search(docs, items, **how).collect()
    by_item = {}
    for r in sorted(rows, key=lambda r: (r["item_id"], r["rank"])):
        by_item.setdefault(r["item_id"], []).append((r["score"], r["doc_id"]))
        assert r["rank"] == len(by_item[r["item_id"]])
    return by_item


def test_search_equals_brute_force_in_small_shards_and_blocks(spark, small):
    docs, items = common.table(spark, small, "documents").repartition(5), common.table(spark, small, "benchmark")
    expected = best_by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()], {r["item_id"]: r["text"] for r in items.collect()})
    assert searched(docs, items) == expected
    # many shards in a task, many rounds of items
    assert searched(docs, items, shard_postings=300, shard_docs=20, item_bytes=2_000) == expected


def test_search_on_odd_rows(spark):
    docs = with_clashes(spark.createDataFrame([*ROWS, (9, "same text here twice over", "x")], SCHEMA))
    items = spark.createDataFrame([(1, "SAME text, here!"), (1, "SAME text, here!"), (2, None), (3, "... "), (None, "text"), (4, "日本 id"), (5, "lorem lorem ipsum"), (6, "same text"), (6, "id")], "item_id long, text string")
    rows = [(i, t) for i, t, _ in [*ROWS, (9, "same text here twice over", "x")]]
    expected = best_by_hand(rows, {1: "same text here", 4: "日本 id", 5: "lorem lorem ipsum", 6: "same text id"})
    assert searched(docs, items) == expected
    assert [d for _, d in expected[1]] == [4, 4, 9] and expected[4][-1][1] in (None, 6)
    assert searched(docs, items, shard_docs=1) == expected
    assert searched(docs.limit(0), items) == {} == searched(docs, items.limit(0))
    assert searched(docs.where("doc_id = 2"), items) == {}
    assert LONG


def test_ties_beyond_k_go_to_smaller_ids(spark):
    docs = spark.createDataFrame([(i, "one and the same text") for i in range(500)] + [(i, f"other words {i}") for i in range(500, 600)], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "the same text"), (2, "words")], "item_id long, text string")
    found = searched(docs, items, shard_docs=16)
    assert [d for _, d in found[1]] == list(range(10)) and [d for _, d in found[2]] == list(range(500, 510))


def lists_of(draw_values):
    sizes = [len(v) for v in draw_values]
    return np.concatenate([np.array(v, dtype=np.int64) for v in draw_values]), np.concatenate([[0], np.cumsum(sizes)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1000), min_size=1, max_size=9), min_size=1, max_size=5), st.floats(0.1, 4))
def test_blocks_have_the_least_cost_of_all_cuts(values, price):
    flat, starts = lists_of(values)
    begins, before = ranked.cut_lists(flat, starts, price=price, group=1)
    for i, v in enumerate(values):
        per_block = max(float(np.std(v)), 1) * price

        def cost(cuts):
            edges = [0, *cuts, len(v)]
            return sum(max(v[a:b]) * (b - a) - sum(v[a:b]) + per_block for a, b in zip(edges, edges[1:]))

        least = min(cost(c) for n in range(len(v)) for c in itertools.combinations(range(1, len(v)), n))
        mine = [int(b - starts[i]) for b in begins[before[i] : before[i + 1]]]
        assert mine[0] == 0 and cost(mine[1:]) == pytest.approx(least, abs=1e-3)


def test_search_skips_most_blocks_of_common_terms():
    """One rare and one common term: only where the rare one is can a document be among the best."""
    rng = np.random.default_rng(1)
    n = 40_000
    many = np.full(n, 1)
    many[rng.choice(n, 20, replace=False)] = 2
    held = np.concatenate([[0] if m == 1 else [0, 1] for m in many])
    lengths = rng.integers(50, 400, n)
    shard = ranked.Shard(np.arange(n), lengths, many, held, np.ones(len(held), dtype=np.int64), np.array([1, 9000]), n, int(lengths.sum()))
    none = np.zeros(0, dtype=np.int64)
    ids, scores = shard.best(np.array([0, 1]), np.array([1, 1]), 10, none, none)
    m = 25 + 75 * lengths * n // lengths.sum()
    every = (1 + 9000 * (many == 2)) * (10**9 // (1000 + 8 * m))
    by_hand = np.lexsort((np.arange(n), -every))[:10]
    assert ids.tolist() == by_hand.tolist()
    assert shard.scored < 0.2 * len(held)


# --- mixing ----------------------------------------------------------------------------------------------------------


def targets_by_hand(sizes, weights=(1, 2, 3), most=3):
    """{source: target} by resharing until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_sources, rest = {}, set(order), sum(sizes.values())
    while open_sources:
        heavy = sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if rest * weight[s] / heavy > most * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / heavy for s in open_sources}
        for s in over:
            target[s] = most * sizes[s]
            rest -= most * sizes[s]
        open_sources -= over
    return target


def mixed(rows):
    found = [r.asDict() for r in rows.collect()]
    sizes = {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    expected = targets_by_hand(sizes)
    for source, size in sizes.items():
        mine = [r for r in found if r["source"] == source]
        assert {r["source_size"] for r in mine} == {size}
        assert all(r["target"] == pytest.approx(expected[source], rel=1e-12) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - expected[source]) <= 0.5 + 1e-6
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        epochs = int(round(expected[source]) // size) if size else 0
        assert all(r["taken"] >= epochs * r["size"] for r in mine)
        assert sum(epochs * r["size"] < r["taken"] < (epochs + 1) * r["size"] for r in mine) <= 1  # one cut
    return found


def test_mix_meets_targets_and_reruns_agree(spark, small):
    docs = common.table(spark, small, "documents")
    first = mixed(mixing.mix(docs))
    assert len(first) == docs.count()
    again = mixing.mix(docs.repartition(9)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_mix_of_odd_rows(spark):
    rows = [(i, "w " * (i % 7), s) for i in range(60) for s in ("big",)] + [(100, "a b c", "tiny"), (101, None, "empty"), (102, "x y", None), (103, "x y", None), (None, "n n n", "big"), (None, "n n n", "big"), (5, "w " * 5, "big"), (104, LONG, "é"), (105, "", "tiny")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("part", F.lit(7)).withColumn("before", F.lit(1))
    found = mixed(mixing.mix(docs))
    assert len(found) == len(rows)
    assert {r["source"] for r in found} == {"big", "tiny", "empty", None, "é"}
    assert mixing.mix(docs.limit(0)).collect() == []
    assert {r["taken"] for r in mixing.mix(docs.where("doc_id = 101")).collect()} == {0}


# --- filter audit ----------------------------------------------------------------------------------------------------


def audit_by_hand(rows, letters):
    """rows: (part, failing letters, good, toxic)."""
    found = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_of = Counter()
        for order in itertools.permutations(letters):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                found[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                removed_of[f] += len(gone)
        for key, value in found.items():
            if key[0] == part:
                value[-1] = removed_of[value[-1]]
    return {k: tuple(v) for k, v in found.items()}


def as_found(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_audit_of_four_filters_equals_all_orders(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[rng.integers(2)], *(bool(rng.random() < p) for p in (0.3, 0.5, 0.1, 0.2)), bool(rng.random() < 0.4), bool(rng.random() < 0.1)) for _ in range(400)] + [("only", True, True, True, True, True, False)]
    judged = spark.createDataFrame(rows, "part string, W boolean, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    by_hand = audit_by_hand([(r[0], {f for f, x in zip("WXYZ", r[1:5]) if x}, r[5], r[6]) for r in rows], "WXYZ")
    assert as_found(interaction.audit(judged, "WXYZ")) == by_hand
    assert interaction.audit(judged.limit(0), "WXYZ").collect() == []


def test_audit_of_odd_rows(spark):
    docs = [*ROWS, (10, None, "x"), (11, "same text here twice over", ""), (12, "A # B", "y"), (0, "1 2 3", "z")]
    labels = [(4, 1, 0), (4, 0, 1), (3, 1, None), (None, 1, 1), (12, None, 1), (99, 1, 1)]
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, lang in docs:
        text = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails = {f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > first[text])) if x}
        rows.append((lang or "", fails, any(a == i and q == 1 for a, q, _ in labels if a is not None), any(a == i and x == 1 for a, _, x in labels if a is not None)))
    found = interaction.audit(interaction.judge(with_clashes(spark.createDataFrame(docs, SCHEMA)).withColumn("part", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert as_found(found) == audit_by_hand(rows, "ABCDE")


def test_groups_of_identical_texts_of_any_size(spark):
    """A text of half of all rows and small groups beside it."""
    rows = [(i, b"hot" if i % 2 else f"t{i // 6}".encode()) for i in range(6000)] + [(None, b"hot"), (None, b"alone")]
    found = interaction.same_as_earlier(spark.createDataFrame(rows, "id long, digest binary")).collect()
    first = {}
    for i, d in rows:
        if i is not None:
            first[d] = min(first.get(d, i), i)
    assert sorted((r["id"] or -1, r["repeated"]) for r in found) == sorted((i or -1, i is not None and i > first[d]) for i, d in rows)
