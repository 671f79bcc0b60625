"""Reading order of trees, texts of subtrees and phrases in them, against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from claridoc.operators import tour

NODES = "doc_id long, elem long, parent_elem long, text string"


def forest(seed: int, n: int = 120, docs: int = 4):
    """Trees with several roots, unknown parents, self-parents, circles, blank texts and repeated elements."""
    r = random.Random(seed)
    rows = []
    for d in range(docs):
        ids = r.sample(range(1, 10 * n), n if d else 3 * n)
        for i, e in enumerate(ids):
            parent = r.choice([0, None, 99_999]) if r.random() < 0.05 or not i else e if r.random() < 0.02 else ids[r.randrange(i)]
            rows.append((d, e, parent, r.choice(["Total sum", "of", "all", "x", "an order TOTAL", " ", "", None, "sum of all", "é" * r.randint(1, 30)])))
        ring = [100_000 + 7 * k for k in range(5)]
        rows += [(d, e, ring[(k + 1) % 5], f"ring {k}") for k, e in enumerate(ring)] + [(d, 200_000, ring[3], "hanging")]
    return [*rows, rows[3], (1, rows[-1][1], 0, None)]


def walk(rows):
    """Per document its elements in reading order, and per element the texts of its subtree."""
    text, parent = {}, {}
    for d, e, p, t in rows:
        parent[d, e] = min(parent.get((d, e), 10**9), p or 0)
        if t and t.strip():
            text[d, e] = min(text.get((d, e), t), t)
    for (d, e), p in list(parent.items()):
        if p == e or (d, p) not in parent:
            parent[d, e] = 0
    for d, e in sorted(parent):  # circles are cut at their least element
        seen, at = [], e
        while at and at not in seen:
            seen.append(at)
            at = parent[d, at]
        if at:
            parent[d, min(seen[seen.index(at) :])] = 0
    kids = {}
    for (d, e), p in sorted(parent.items()):
        kids.setdefault((d, p), []).append(e)
    order, below = {}, {}
    for d in {d for d, _ in parent}:
        stack = [(e, False) for e in reversed(kids[d, 0])]
        while stack:
            e, left = stack.pop()
            if left:
                below[d, e] = order[d][order[d].index(e) :]
                continue
            order.setdefault(d, []).append(e)
            stack.append((e, True))
            stack += [(k, False) for k in reversed(kids.get((d, e), []))]
    texts = {k: " ".join(text[k[0], e] for e in v if (k[0], e) in text) for k, v in below.items()}
    return order, below, {k: t for k, t in texts.items() if t}


@pytest.mark.parametrize("seed", [1, 2])
def test_tour_and_texts(spark, monkeypatch, seed):
    monkeypatch.setattr(tour, "SPREAD", 50)
    monkeypatch.setattr(tour, "TEXT_BLOCK", 40)
    rows = forest(seed)
    frame = spark.createDataFrame(rows, NODES)
    order, below, texts = walk(rows)
    got = {(r.doc_id, r.elem): (r.entry, r.last) for r in tour.tree_tour(frame).collect()}
    assert got == {(d, e): (order[d].index(e), order[d].index(e) + len(below[d, e]) - 1) for d in order for e in order[d]}
    sequence = tour.text_sequence(frame)
    assert {(r.doc_id, r.elem): r.text for r in tour.subtree_text(sequence).collect()} == texts
    for phrase in ("sum", " sum of all ", "total sum", "of of", "x", "é" * 25, "ring 2 ring", "nowhere", " ", "Total sum of"):
        want = {k for k, t in texts.items() if phrase.strip() and phrase.strip().lower() in t.lower()}
        found = tour.search_subtrees(sequence, phrase)
        assert sorted((r.doc_id, r.elem) for r in found.collect()) == sorted(want), phrase
        few = {(r.doc_id, r.elem): r.text for r in tour.subtree_text(sequence, found).collect()}
        assert few == {k: texts[k] for k in want}


def test_small_documents_are_ranked_without_rounds(spark, monkeypatch):
    frame, writes = spark.createDataFrame(forest(3), NODES), []
    monkeypatch.setattr(tour, "written", lambda df, write=tour.written: writes.append(1) or write(df))
    whole = {tuple(r) for r in tour.text_sequence(frame).collect()}
    assert len(writes) == 3  # rows, large documents (none), the sequence; rounds of joins write tens
    for size in (20_000, 1):  # the largest of the four documents goes by joins, then all
        monkeypatch.setattr(tour, "SHELF_BYTES", size)
        assert {tuple(r) for r in tour.text_sequence(frame).collect()} == whole
    order, below, _ = walk(forest(3))
    assert {(r[0], r[1]): (r[2], r[3] - r[2] + 1) for r in whole} == {(d, e): (order[d].index(e), len(below[d, e])) for d in order for e in order[d]}


def test_texts_as_keys_and_least_texts_of_repeated_elements(spark):
    rows = [("b", 5, 9, "z"), ("b", 5, 0, "é"), ("b", 5, 3, " "), ("b", 0, 5, "zero"), ("a", 9, None, None), ("a", -1, 9, "low"), ("a", 4, 9, "high"), ("b", 3, 5, "k")]
    frame = spark.createDataFrame(rows, "doc_id string, elem int, parent_elem long, text string")
    got = {tuple(r) for r in tour.text_sequence(frame).collect()}
    assert got == {("b", 5, 0, 2, "z", 0, 9), ("b", 0, 1, 1, "zero", 2, 7), ("b", 3, 2, 2, "k", 7, 9), ("a", 9, 0, 2, None, 0, 9), ("a", -1, 1, 1, "low", 0, 4), ("a", 4, 2, 2, "high", 4, 9)}


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_phrases_over_the_edges_of_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(tour, "STRETCH", stretch)
    monkeypatch.setattr(tour.ordered, "row_number", None)  # texts are dealt by their characters, not numbered first
    r = random.Random(stretch)
    rows = [(d, e, 0 if e == 1 else r.randrange(max(1, e - 4), e), r.choice(["a", "b", "A b", None, " ", "b" * 70, "ab a"])) for d in (1, 2) for e in range(1, 150)]
    sequence = tour.text_sequence(spark.createDataFrame(rows, NODES))
    _, _, texts = walk(rows)
    for phrase in ("a b", "b" * 70 + " a", "b a ab", "ab a " + "b" * 60, "a a a b b"):
        want = sorted(k for k, t in texts.items() if phrase in t.lower())
        assert sorted((x.doc_id, x.elem) for x in tour.search_subtrees(sequence, phrase).collect()) == want


def test_long_phrases_go_over_many_texts(spark):
    rows = [(1, e, e // 2, "a" if e % 5 else "b") for e in range(1, 9000)]
    rows = [(d, e, 0 if e == 1 else 1, t) for d, e, _, t in rows]
    sequence = tour.text_sequence(spark.createDataFrame(rows, NODES))
    phrase = " ".join("a" if e % 5 else "b" for e in range(4000, 4200))
    assert [r.elem for r in tour.search_subtrees(sequence, phrase).collect()] == [1]
    places = tour.phrase_places(sequence, phrase).orderBy("entry").collect()
    assert len(places) == sum(phrase.startswith("b" if e % 5 == 0 else "a") and e % 5 == 0 and e + 199 < 9000 for e in range(1, 9000))
    assert all(p.upto - p.entry == 199 for p in places)


def test_a_chain_of_100_000_elements(spark):
    n = 100_000
    frame = spark.range(1, n + 1).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("elem"), (F.col("id") - 1).alias("parent_elem"), F.when(F.col("id") % 1000 == 0, "word").alias("text"))
    sequence = tour.text_sequence(frame)
    wrong = sequence.filter((F.col("entry") != F.col("elem") - 1) | (F.col("last") != n - 1) | (F.col("text_end") != 500))
    assert sequence.count() == n and wrong.isEmpty()
    assert tour.search_subtrees(sequence, "word word").count() == n - 1000
    texts = tour.subtree_text(sequence, spark.createDataFrame([(7, 1), (7, 99_001)], "doc_id long, elem long"))
    assert {r.elem: r.text for r in texts.collect()} == {1: " ".join(["word"] * 100), 99_001: "word"}


def test_nothing_to_walk(spark):
    none = spark.createDataFrame([], NODES)
    assert tour.tree_tour(none).count() == 0 and tour.subtree_text(tour.text_sequence(none)).count() == 0
    odd = spark.createDataFrame([(None, 1, 0, "a"), (1, None, 0, "b"), (1, 2, None, " ")], NODES)
    assert [tuple(r) for r in tour.tree_tour(odd).collect()] == [(1, 2, 0, 0)]
    assert tour.search_subtrees(tour.text_sequence(odd), "a").count() == 0
