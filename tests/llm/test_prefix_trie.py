"""The prefix trie against a plain one in Python, over cuts into segments and parts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claridoc.llm.prefix_trie import _extents, branched, prefix_trie, turn_digests
from claridoc.operators.ledger import chat_turns
from claridoc.sources.fixtures import view

from .conftest import GIVEN

TURNS = "conv_id long, turn long, role string, text string"


def plain(chats):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = {}
    for chat, turns in chats.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(chat)
    rows = []
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    kids = {k: [c for c in members if len(c) == len(k) + 1 and c[: len(k)] == k] for k in members}
    for k, ids in members.items():
        under = [u for u in members if u[: len(k)] == k]
        ends = ",".join(str(i) for i in sorted(i for i in ids if i is not None and len(chats[i]) == len(k)))
        rows.append((
            least(ids), len(k), least(members[k[:-1]]) if k else None, len(ids), len(kids[k]), sum(not kids[u] for u in under),
            sum((len(members[u]) - 1) * len(u[-1][1].split()) for u in under if u), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def rows_of(chats):
    return [(c, i, role, text) for c, turns in chats.items() for i, (role, text) in enumerate(turns)]


def made(seed, n=40, depth=12, letters="ab"):
    r = random.Random(seed)
    chats = {}
    for c in r.sample(range(1000), n):
        start = list(r.choice(list(chats.values()))[: r.randint(0, depth)]) if chats and r.random() < 0.7 else []
        chats[c] = start + [("user" if i % 2 else "assistant", " ".join(r.choices(letters, k=r.randint(1, 3)))) for i in range(r.randint(1, depth))]
    return chats


@pytest.mark.parametrize("segment,part_turns", [(2, 5), (3, 50), (128, 7), (128, 1 << 17)])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_a_plain_one(spark, seed, segment, part_turns):
    chats = made(seed)
    chats[5000] = chats[5001] = chats[5002] = [("user", "same words here"), ("assistant", "again and again")] * 9
    got = prefix_trie(turn_digests(spark.createDataFrame(rows_of(chats), TURNS)), segment, part_turns).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(chats)


def test_chats_may_begin_as_another_one(spark):
    own = {20: [("u", "a"), ("v", "b b")], 21: [("u", "x"), ("v", "y"), ("u", "z")], 22: [("u", "q")], 23: [("w", "r")], 45: [("u", "lone"), ("u", "second")]}
    heads = {20: 1, 21: 2, 22: 3, 23: 1, 45: 1}
    frame = spark.createDataFrame(rows_of(own), TURNS)
    number = F.element_at(F.create_map(*[F.lit(v) for kv in heads.items() for v in kv]), F.col("conv_id").cast("int"))
    turns = branched(turn_digests(frame), F.col("conv_id") - F.col("conv_id") % 20, number, 3)
    want = {c: own.get(c - c % 20, [])[: heads[c]] + t[heads[c] :] for c, t in own.items()}
    assert want[45] == [("u", "second")] and want[22] == own[20]
    want[23] = own[20][:1]
    assert sorted((tuple(r) for r in prefix_trie(turns).collect()), key=str) == plain(want)


def test_nulls_ties_and_chats_without_turns(spark):
    rows = [(1, None, None, None), (1, 0, "user", "hi you"), (2, None, "", ""), (2, 5, "user", "hi you"), (None, 1, "user", "b"), (3, 1, "u", "same"), (3, 1, "u", "same")]
    turns = turn_digests(spark.createDataFrame(rows, TURNS)).select("conv_id", "position", "digest", "words")
    none = spark.createDataFrame([(9, None, None, 0)], "conv_id long, position long, digest string, words long")
    got = prefix_trie(turns.union(none)).collect()
    hi = [("", ""), ("user", "hi you")]
    assert sorted((tuple(r) for r in got), key=str) == plain({1: hi, 2: hi, None: [("user", "b")], 3: [("u", "same")] * 2, 9: []})
    assert prefix_trie(turns.limit(0)).count() == 0
    alone = prefix_trie(none).collect()
    assert [tuple(r) for r in alone] == plain({9: []})


def test_extents_by_the_sparse_table():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        lcp = r.integers(-1, 4, n)
        row, depth = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(4)))
        left, right = _extents(lcp, row, depth)
        for i, d, lo, hi in zip(row, depth, left, right):
            a = b = i
            while a > 0 and lcp[a] >= d:
                a -= 1
            while b + 1 < n and lcp[b + 1] >= d:
                b += 1
            assert (lo, hi) == (a, b)


def test_turns_about_documents(spark):
    turns = chat_turns(view(spark, GIVEN, "conversations"))
    root = prefix_trie(turn_digests(turns)).where("depth = 0").first()
    assert root.n_convs == turns.select("conv_id").distinct().count() and root.n_leaves > 1
