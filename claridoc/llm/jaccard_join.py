"""Near-duplicate text layers by shingle Jaccard: count-vector R-trees inside lossless blocks.

Shingles are hashed into ``GROUPS`` groups; the counts per group are a point. The overlap of two sets is at most the sum of
the coordinate minima of their points, and with the upper corner of a box instead of a point it bounds a whole node.
Points that the bound lets through are verified on the shingle sets themselves.

Unrelated documents of one length have much the same counts, so the inner boxes of one tree over all documents
prune nothing. The trees therefore stand inside blocks of documents that can be similar at all: a pair at or above the
threshold shares one of the ``n - ceil(t*n) + 1`` rarest shingles of both sets, whatever order "rarest" means, as
long as all documents use the same. The order comes from a merged count-min sketch (``claridoc.llm.blocks``); shingles
that it counts once link nothing and are never sent, and shingles of passages in a third of all documents come last.

1. sets and their digests; equal sets have one representative from here on: a row of a block, whatever its doc_id.
2. sketch of the representatives' shingles, merged and answered block by block.
3. rare shingles that others may share: (shingle, representative); the least representative leads the shingle's group.
4. each leader's group, cut in slices, meets itself slice against slice. A task builds the R-tree of its rows and verifies
   every candidate pair once: a pair that stands in several groups belongs to the group with the least leader.
5. links per representative, and connected components of the links; names of documents only come in at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claridoc.llm import blocks, words
from claridoc.llm.tables import components
from claridoc.session import written

SHINGLE_WORDS = 5
PERCENT = 80
BLOCK_BYTES = 4 << 20
SLICE_ROWS = 1000
GROUPS = 64
FANOUT = 16
ROW_BITS = 32


def shingle_sets(w: words.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, sorted; shorter texts are one shingle, texts without words none."""
    at, h = w.grams(size)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    text = np.concatenate([w.text[at], short])
    h = np.concatenate([h, words.mix(w.whole()[short] ^ np.uint64(0xABCDEF12345))])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def _block_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts of a block: hashes, and where each text's begin."""
    hashes, sizes = [], []
    for lo, hi in words.chunks(text):
        t, h = shingle_sets(words.split(text.slice(lo, hi - lo), lower=True), size)
        hashes.append(h)
        sizes.append(np.bincount(t, minlength=hi - lo))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return h, np.concatenate([[0], np.cumsum(n)]).astype(np.int64), n.astype(np.int64)


def _digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, as signed numbers."""
    out = []
    for salt in (0x1234567, 0x7654321):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(words.mix(h ^ np.uint64(salt)), out=sums[1:])
        out.append(words.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


class CountTree:
    """R-tree over count vectors: per node the upper corner of its points and the least and most shingles."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slabs = max(1, int(np.sqrt(len(points) / FANOUT)))
        rank = np.empty(len(points), np.int64)
        rank[np.argsort(sizes, kind="stable")] = np.arange(len(points))
        slope = points @ np.where(np.arange(points.shape[1]) % 2, 1, -1)
        self.order = np.lexsort((slope, rank * slabs // max(1, len(points))))  # tiles of similar size, then of similar slope
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > FANOUT or not self.levels:
            cut = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def candidates(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose set may reach the threshold with this one."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -2, -1):
            top, low, high = self.levels[depth] if depth >= 0 else (self.points, self.sizes, self.sizes)
            near = (high[at] * 100 >= size * percent) & (low[at] * percent <= size * 100)
            at = at[near]
            bound = np.minimum(top[at], point).sum(axis=1)
            at = at[bound * (100 + percent) >= percent * (size + low[at])]
            if depth >= 0:
                below = len(self.levels[depth - 1][0]) if depth else len(self.points)
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < below]
        return self.order[at]


def _ragged(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of some rows, one row after the other, and where each row's begin."""
    n = first[rows + 1] - first[rows]
    begin = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(first[rows] - begin, n), begin


def _shared(flag: np.ndarray, values: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many values of each row are flagged."""
    out = np.zeros(len(rows), np.int64)
    filled = np.flatnonzero(first[rows + 1] > first[rows])
    if len(filled):
        at, begin = _ragged(first, rows[filled])
        out[filled] = np.add.reduceat(flag[values[at]].astype(np.int64), begin)
    return out


def verified_pairs(text: pa.Array, part: np.ndarray, across: bool, lower: list[np.ndarray], size: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs of rows and their common shingles; every candidate pair is verified once.

    ``across``: only pairs of rows of different parts. ``lower``: per row the leaders of its groups that are less than the leader of
    this one; pairs that have one in common belong to that group.
    """
    h, first, n = _block_sets(text, size)
    row = np.repeat(np.arange(len(n)), n)
    points = np.bincount(row * GROUPS + (h % np.uint64(GROUPS)).astype(np.int64), minlength=len(n) * GROUPS).reshape(-1, GROUPS).astype(np.int32)
    tree = CountTree(points, n)
    dense = np.unique(h, return_inverse=True)[1].astype(np.int32)
    leaders = np.concatenate([[0], np.cumsum([len(x) for x in lower])]).astype(np.int64)
    led = np.unique(np.concatenate(lower), return_inverse=True)[1].astype(np.int32)
    have, elsewhere = np.zeros(len(h), bool), np.zeros(len(led), bool)
    left, right, common = [], [], []
    for i in range(len(n)):
        if across and part[i]:
            continue
        near = tree.candidates(points[i], int(n[i]), percent)
        near = near[part[near] != part[i]] if across else near[near > i]
        if len(near) and leaders[i + 1] > leaders[i]:
            elsewhere[led[leaders[i] : leaders[i + 1]]] = True
            near = near[_shared(elsewhere, led, leaders, near) == 0]
            elsewhere[led[leaders[i] : leaders[i + 1]]] = False
        if not len(near):
            continue
        have[dense[first[i] : first[i + 1]]] = True
        both = _shared(have, dense, first, near)
        have[dense[first[i] : first[i + 1]]] = False
        hit = (both > 0) & (both * (100 + percent) >= percent * (n[i] + n[near]))
        left.append(np.full(int(hit.sum()), i))
        right.append(near[hit])
        common.append(both[hit])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none), np.concatenate(common or none)


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row that each of n rows reaches by the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


_ROWS = "id long, root long, weight long"
_PAIRS = "a long, b long, shared long"


def _joined(text_layers: DataFrame, shingle_words: int, percent: int, block_bytes: int, slice_rows: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, one, two) of all rows; (one, two, id, least doc_id, copies) of all sets; and their links, as ``_PAIRS`` or added up by row and task as ``_ROWS``."""
    docs, _, total = blocks.dealt(text_layers, block_bytes)
    shards = blocks.shards_for(max(1, total // 6), 1)
    wide = lambda block: block << ROW_BITS  # noqa: E731  rows are numbered by block and place in its order

    def digest(table: pa.Table) -> pa.Table:
        doc, null, text = blocks.in_order(table)
        h, first, n = _block_sets(text, shingle_words)
        one, two = _digests(h, first)
        rid = wide(table.column("block")[0].as_py()) + np.arange(len(n))
        return pa.table({"doc_id": pa.array(doc, pa.int64(), mask=null), "rid": pa.array(rid), "n_shingles": pa.array(n), "one": pa.array(one), "two": pa.array(two)})

    facts = written(docs.groupBy("block").applyInArrow(digest, "doc_id long, rid long, n_shingles long, one long, two long"))
    sets = written(facts.where("n_shingles > 0").groupBy("one", "two").agg(F.min("rid").alias("id"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    block = F.shiftright("id", ROW_BITS)
    chosen = sets.select(block.alias("block"), F.lit(-1).cast("long").alias("shard"), F.lit(None).cast("binary").alias("payload"), "id")

    def representatives(table: pa.Table, answer: pa.Table):
        """Rows of the block that stand for their set: identifiers, hashes, limits of each."""
        _, _, text = blocks.in_order(table)
        own = answer.filter(pa.array(np.asarray(answer.column("shard")) < 0))
        ids = np.sort(np.asarray(own.column("id")).astype(np.int64))
        rows = ids - wide(table.column("block")[0].as_py())
        h, _, n = _block_sets(text.take(pa.array(rows)), shingle_words)
        return ids, h, n

    def sketch(table: pa.Table, answer: pa.Table) -> pa.Table:
        _, h, _ = representatives(table, answer)
        return blocks.rows_table(blocks.sketch_rows(table.column("block")[0].as_py(), h, shards, 1))

    def rare(table: pa.Table, answer: pa.Table) -> pa.Table:
        ids, h, n = representatives(table, answer)
        counts = blocks.answered(h, {s: p for s, p in blocks.answer_of(answer).items() if s >= 0}, shards, 1)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, counts, row))
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        prefix = n + (-n * percent // 100) + 1
        sent = order[(place < prefix[row]) & (counts[order] > 1)]
        return pa.table({"key": pa.array(h[sent].view(np.int64)), "id": pa.array(ids[row[sent]])})

    sketched = blocks.merged(blocks.passed(docs, chosen, sketch, blocks.ANSWER)).select("*", F.lit(None).cast("long").alias("id"))
    keys = written(blocks.passed(docs, chosen.unionByName(sketched), rare, "key long, id long"))
    leads = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = written(keys.join(leads, "key").select("leader", "id").distinct())
    # a group of at most slice_rows is one slice; others are cut so that two slices together have that many rows
    half = max(1, slice_rows // 2)
    sizes = groups.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select("leader", F.when(F.col("n") <= slice_rows, 1).otherwise(F.ceil(F.col("n") / half)).cast("long").alias("slices"))
    members = groups.join(sizes, "leader").select(block.alias("block"), "leader", "id", "slices", F.pmod(F.xxhash64("id"), "slices").alias("slice")).unionByName(sets.select(block.alias("block"), "id", "copies"), allowMissingColumns=True)

    def texts(table: pa.Table, wanted: pa.Table) -> pa.Table:
        """The wanted rows with their text, once for every slice that theirs meets, and the packed lesser leaders of the row."""
        standing = wanted.filter(pc.is_valid(wanted.column("copies")))
        copies = dict(zip(standing.column("id").to_pylist(), standing.column("copies").to_pylist()))
        wanted = wanted.filter(pc.is_valid(wanted.column("leader")))
        text = blocks.in_order(table)[2] if wanted.num_rows else table.column("text").combine_chunks()
        ids, leader, slices, own = (np.asarray(wanted.column(c)).astype(np.int64) for c in ("id", "leader", "slices", "slice"))
        order = np.lexsort((leader, ids))
        ids, leader, slices, own = ids[order], leader[order], slices[order], own[order]
        begin = np.searchsorted(ids, ids, side="left")
        lesser = pa.array([leader[a:b].tobytes() for a, b in zip(begin.tolist(), range(len(ids)))], pa.binary())
        pick = np.repeat(np.arange(len(ids)), slices)
        other = np.arange(len(pick)) - np.repeat(np.cumsum(slices) - slices, slices)
        low, high = np.minimum(own[pick], other), np.maximum(own[pick], other)
        at = pa.array((ids & ((1 << ROW_BITS) - 1))[pick], pa.int64())
        made = {"leader": leader[pick], "low": low, "high": high, "slice": own[pick], "id": ids[pick], "copies": np.array([copies[i] for i in ids.tolist()], np.int64)[pick]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in made.items()} | {"lesser": lesser.take(pa.array(pick, pa.int64())), "text": text.take(at)})

    def link(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id")).astype(np.int64)
        order = np.argsort(ids)
        table, ids = table.take(pa.array(order)), ids[order]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        part = (np.asarray(table.column("slice")) == high).astype(np.int64)
        lower = [np.frombuffer(x.as_py(), np.int64) for x in table.column("lesser")]
        a, b, shared = verified_pairs(table.column("text").combine_chunks(), part, low != high, lower, shingle_words, percent)
        if pairs:
            return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b]), "shared": pa.array(shared)})
        return _by_row(ids, a, b, np.asarray(table.column("copies")).astype(np.int64))

    def _by_row(ids: np.ndarray, a: np.ndarray, b: np.ndarray, copies: np.ndarray) -> pa.Table:
        weight = np.zeros(len(ids), np.int64)
        np.add.at(weight, a, copies[b])
        np.add.at(weight, b, copies[a])
        on = np.flatnonzero(weight)
        return pa.table({"id": pa.array(ids[on]), "root": pa.array(ids[least_reached(len(ids), a, b)[on]]), "weight": pa.array(weight[on])})

    fields = "leader long, low long, high long, slice long, id long, copies long, lesser binary, text string"
    sent = blocks.passed(docs, members, texts, fields)
    return facts, sets, sent.groupBy("leader", "low", "high").applyInArrow(link, _PAIRS if pairs else _ROWS)


def near_duplicate_classes(
    text_layers: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Links and class of every document under "100 * intersection >= percent * union" of shingle sets, over all documents.

    ``text_layers``: (doc_id, text); other columns are ignored. Words are lower-cased (A-Z) and split at white space.
    Returns (doc_id, n_shingles, component_id, n_links), one row per input row: the least doc_id reachable by links, itself
    included, and the number of other rows that it links to directly. A null or empty text has no shingles and links nothing;
    fewer words than a shingle are one shingle. Rows that share a doc_id are one document to the classes; rows with a null doc_id are
    documents of their own, and a class has the null identifier only if all its rows do. An empty table gives an empty result.
    """
    facts, sets, links = _joined(text_layers, shingle_words, percent, block_bytes, slice_rows, False)
    links = written(links)
    named = facts.where("doc_id is not null and n_shingles > 0").join(sets.select("one", "two", "id"), ["one", "two"]).select("doc_id", "id").distinct()
    twice = named.groupBy("doc_id").agg(F.min("id").alias("root"), F.max("id").alias("last")).where("root < last").drop("last")
    same = named.join(twice, "doc_id").select("id", "root")
    classes = components(links.select("id", "root").unionByName(same).where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = written(sets.select("id", "least").join(classes, "id"))
    labels = linked.groupBy("component").agg(F.min("least").alias("label"))
    weights = links.groupBy("id").agg(F.sum("weight").alias("weight"))
    about = sets.join(linked.drop("least"), "id", "left").join(labels, "component", "left").join(weights, "id", "left")
    return facts.join(about, ["one", "two"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("label", "least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def near_duplicate_pairs(
    text_layers: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, slice_rows: int = SLICE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The join itself: (a, b, shared), every linked pair of distinct shingle sets once with the number of common shingles, and
    (doc_id, n_shingles, set_id), the rows that have each set; a row without shingles has none."""
    facts, sets, links = _joined(text_layers, shingle_words, percent, block_bytes, slice_rows, True)
    return links, facts.join(sets.select("one", "two", F.col("id").alias("set_id")), ["one", "two"], "left").select("doc_id", "n_shingles", "set_id")
