import random

import numpy as np
import pytest

from claridoc.llm.jaccard_join import CountTree, near_duplicate_classes, near_duplicate_pairs
from claridoc.llm.tables import components


def plain(docs, size, percent):
    sets = {i: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()) for i, w in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in docs}


@pytest.mark.parametrize("slice_rows,block_bytes", [(1000, 8 << 20), (3, 2000)])
def test_classes_equal_brute_force(spark, slice_rows, block_bytes):
    """Chains of copies of copies, where the ends are not alike, near misses, and slices far smaller than a group."""
    r = random.Random(4)
    docs, n = {}, 0
    for _ in range(6):
        words = [str(r.randint(0, 400)) for _ in range(r.choice([4, 12, 60, 150]))]
        for _ in range(14):
            docs[n] = list(words)
            n += 1
            if r.random() < 0.7:
                words[r.randrange(len(words))] = str(r.randint(0, 400))
    docs |= {n: [], n + 1: ["a"], n + 2: ["a"], n + 3: ["a", "b"]}
    ids = list(docs)
    r.shuffle(ids)
    frame = spark.createDataFrame([(i, " ".join(docs[i])) for i in ids], "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicate_classes(frame, 3, 80, block_bytes, slice_rows).collect()}
    assert got == plain(docs, 3, 80)


def test_null_identifiers_come_last(spark):
    frame = spark.createDataFrame([(None, "a b c d e f g"), (7, "a b c d e f g"), (None, "x y z p q r"), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near_duplicate_classes(frame).collect())
    assert got == [("3", 0, 3), ("7", 3, 7), ("None", 2, None), ("None", 3, 7)]


def test_tree_never_loses_a_point():
    r = np.random.default_rng(1)
    points = r.integers(0, 6, (500, 8)).astype(np.int32)
    points[250:] = points[:250] + r.integers(0, 2, (250, 8))
    sizes = points.sum(axis=1)
    tree = CountTree(points, sizes)
    for q in range(0, 500, 7):
        bound = np.minimum(points, points[q]).sum(axis=1)
        want = np.flatnonzero((bound * 180 >= 80 * (sizes + sizes[q])) & (sizes * 100 >= 80 * sizes[q]) & (sizes * 80 <= 100 * sizes[q]))
        assert set(want) <= set(tree.candidates(points[q], int(sizes[q]), 80))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


@pytest.mark.parametrize("slice_rows", [1000, 4])
def test_links_equal_brute_force(spark, slice_rows):
    """A chain whose ends are not alike and a triangle have different links; equal sets count by their number."""
    r = random.Random(9)
    docs = {}
    for c in range(4):
        words = [str(r.randint(0, 400)) for _ in range(60)]
        for k in range(9):
            docs[len(docs)] = list(words)
            if k % 3:
                words[r.randrange(len(words))] = str(r.randint(0, 400))
    sets = {i: frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) for i, w in docs.items()}
    alike = {(i, j) for i in docs for j in docs if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    assert {x.doc_id: x.n_links for x in near_duplicate_classes(frame, 3, 80, 3000, slice_rows).collect()} == {i: sum(a == i for a, _ in alike) for i in docs}
    links, rows = near_duplicate_pairs(frame, 3, 80, 3000, slice_rows)
    of = {x.set_id: sets[x.doc_id] for x in rows.collect()}
    got = [(frozenset((of[x.a], of[x.b])), x.shared) for x in links.collect()]
    assert len(got) == len({p for p, _ in got}) and all(n == len(frozenset.intersection(*p)) for p, n in got)
    assert {p for p, _ in got} == {frozenset((sets[i], sets[j])) for i, j in alike if sets[i] != sets[j]}


def test_rows_without_identifiers_join_no_strangers(spark):
    """Two unrelated texts without an identifier, each near one document, must not put these in one class."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (2, two), (None, one + " x"), (None, two + " y"), (None, three), (None, three + " z"), (9, "p q r"), (9, three)]
    frame = spark.createDataFrame(rows[:6], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in near_duplicate_classes(frame).collect()), key=str)
    want = sorted([(1, 1, 1), (2, 2, 1), (None, 1, 1), (None, 2, 1), (None, None, 1), (None, None, 1)], key=str)
    assert got == want
    whole = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 9 or component_id = 9")
    assert sorted((str(r.doc_id), r.component_id) for r in whole.collect()) == [("9", 9), ("9", 9), ("None", 9), ("None", 9)]
