"""Near duplicates, repeated passages, exact search and components against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import awkward_docs, near_components, prose, vocabulary, words
from tillbook.llm import graph, hamming, jaccard, suffixes


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_near_sets_are_those_of_all_pairs(docs, n, percent):
    got = as_rows(jaccard.near_sets(docs, n=n, percent=percent))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted(near_components(rows, n, percent), key=str)


def test_frequent_shingles_sign_in_combinations(spark, monkeypatch):
    """With every shingle frequent or very frequent all candidates come from combinations; no link may be lost."""
    rnd, vocab = random.Random(3), vocabulary()
    rows, base = [], [prose(rnd, n, vocab) for n in (8, 12, 20, 33, 70, 150)]
    for k in range(90):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for of_class in (2, 3):
        monkeypatch.setattr(jaccard, "classes", lambda counts, c=of_class: np.full(len(counts), c, np.uint8))
        assert as_rows(jaccard.near_sets(df, n=4, percent=85)) == sorted(near_components(rows, 4, 85), key=str)
    # A low bound makes all of these sets unsure, so they sign by single shingles.
    assert as_rows(jaccard.near_sets(df, n=4, percent=50)) == sorted(near_components(rows, 4, 50), key=str)


def kept_rows(rows, n=5, percent=80):
    """(doc_id, text) that stay: of each component the smallest named id, of the texts under it any one; rows alike once."""
    components = {}
    texts = {(d, t): c for (d, _, c), (d, t) in zip(near_components(rows, n, percent), rows)}
    sets = defaultdict(set)
    for (d, t), c in texts.items():
        if words(t):
            sets[c].add((d, t))
        else:
            components[("alone", d, t)] = {(d, t)}
    for c, members in sets.items():
        smallest = {m for m in members if m[0] == c}
        components[c] = smallest or members
    return components


def test_one_of_each_keeps_one_row_of_each_component(docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    # Rows without a named id make components of their own here, of one text each.
    want = kept_rows([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert len(got) == len(set(got)) == len(want)
    assert all(sum(g in some for g in got) == 1 for some in want.values())


def test_one_of_each_of_copies_under_one_id_and_none(spark):
    base = " ".join(vocabulary()[:40])
    rows = [(7, base), (7, base), (7, base + " end"), (3, base + " more"), (None, base), (None, base), (None, "other words"), (None, "other words"), (9, None), (9, None), (9, ""), (8, "")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, text_key int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()), key=str)
    assert got == sorted([(3, base + " more"), (None, "other words"), (9, None), (9, ""), (8, "")], key=str)


def test_near_sets_of_nothing(spark):
    assert jaccard.near_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_stars_chains_and_loops(spark):
    edges = [(1, k) for k in range(2, 30)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = dict(as_rows(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    assert {got[k] for k in range(1, 30)} == {1}
    assert {got[k] for k in range(100, 141)} == {100}
    assert {got[k] for k in (200, 201, 202)} == {200}


def covered(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return {k: v for k, v in out.items() if v}


def test_repeated_passages_are_those_of_all_windows(spark):
    rnd, vocab = random.Random(11), vocabulary()
    passages = [prose(rnd, n, vocab) for n in (50, 55, 70, 95, 140)]
    rows = [(None, "nothing to see"), (1, None), (2, ""), (3, prose(rnd, 49, vocab)), (4, prose(rnd, 400, vocab))]
    for k in range(40):
        parts = [prose(rnd, rnd.randint(0, 90), vocab), passages[k % 5], prose(rnd, rnd.randint(0, 90), vocab)]
        rows.append((10 + k, " ".join(parts)))
    rows += [(90, rows[4][1]), (90, rows[4][1]), (91, passages[4] + " " + passages[4]), (92, "Da " * 200)]
    seen, where = Counter(), {}
    for doc_id, text in {r for r in rows}:
        w = words(text)
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])] += sum(r == (doc_id, text) for r in rows)
    for doc_id, text in rows:
        w = words(text)
        spans = where.setdefault(doc_id, set())
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] > 1:
                spans.update(range(k, k + 50))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert covered(suffixes.repeated_passages(df)) == {k: v for k, v in where.items() if v}
    assert suffixes.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("segment", [8, 16])
def test_top_k_is_that_of_all_pairs(spark, segment):
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-(2**63), 2**63, 6)
    codes = [int(rnd.choice(centres)) ^ sum(1 << int(b) for b in rnd.integers(0, 63, rnd.integers(0, 9))) for _ in range(300)]
    codes = [c - 2**64 if c >= 2**63 else c for c in codes] + [codes[0] if codes[0] < 2**63 else 0] * 60
    rows = [(i, c) for i, c in enumerate(codes)] + [(900, None), (None, 5)]
    df = spark.createDataFrame(rows, "id long, code long")
    asked = df.filter("id % 20 = 0 or id is null")
    got = {(r.query_id, r["rank"]): (r.distance, r.neighbour_id) for r in hamming.top_k(df, asked, 7, segment=segment).collect()}
    want = {}
    for q, code in rows:
        if q is not None and code is not None and q % 20 == 0:
            near = sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10000 + i for i, c in enumerate(codes))
            want |= {(q, k + 1): divmod(near[k], 10000) for k in range(7)}
    assert got == want
    few = hamming.top_k(df.limit(0), asked, 7, segment=segment)
    assert few.count() == 0


def test_sign_codes(spark):
    vectors = [([1.0] * 64,), ([-1.0] * 64,), ([0.0, 2.0, None, 1.0],), (None,), ([],)]
    df = spark.createDataFrame(vectors, "v array<double>")
    assert [r[0] for r in df.select(hamming.sign_code(df.v)).collect()] == [-1, 0, 10, None, 0]
    with pytest.raises(Exception, match="more than 64 components"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(hamming.sign_code(F.col("v"))).collect()
