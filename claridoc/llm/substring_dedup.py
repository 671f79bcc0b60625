"""Repeated passages in the text layers of audited documents: a count-min prefilter, then exact groups.

``remove_repeated_passages`` removes every word that a window of ``window`` words covers, when the same word sequence
also starts anywhere else. Three passes over the same blocks of documents:

1. Every window has an anchor, the run of ``anchor`` words in it with the least hash (the last one on a tie). Equal
   windows have equal anchors at different places, so a window repeats only if its anchor does. Blocks sketch their
   anchors; the merged count-min sketch overestimates every anchor's, and so every window's, count.
2. Only windows whose anchor is estimated repeated go on: each block sends the 128-bit hash of each such window once,
   with a mark when it has it twice or more. Shards group the hashes exactly and answer one bit per hash.
3. Each block covers the words of repeated windows and writes what is left.

A passage in a third of all documents costs one hash a block. Memory: one block, one shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claridoc.llm import blocks, words

WINDOW = 35
ANCHOR = 12
BLOCK_BYTES = 4 << 20
HASHES_PER_SHARD = 1 << 22
RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _anchors(w: words.Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word of every window, the start word of its anchor, and the anchor's hash for every start word."""
    at, hashes = w.grams(anchor)
    by_word = np.zeros(len(w.hash), np.uint64)
    by_word[at] = hashes
    starts, _ = w.grams(window)
    steps = window - anchor + 1
    best, where = by_word[starts], starts.copy()
    for j in range(1, steps):
        other = by_word[starts + j]
        take = other <= best
        best = np.where(take, other, best)
        where[take] = starts[take] + j
    return starts, where, by_word


def _anchor_keys(text: pa.Array, window: int, anchor: int) -> np.ndarray:
    keys = []
    for lo, hi in words.chunks(text):
        w = words.split(text.slice(lo, hi - lo))
        _, where, by_word = _anchors(w, window, anchor)
        keys.append(by_word[np.unique(where)])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _candidates(text: pa.Array, counts: np.ndarray, window: int, anchor: int):
    """Per chunk: rows, words, start word and the two hashes of every window whose anchor is estimated repeated."""
    done = 0
    for lo, hi in words.chunks(text):
        w = words.split(text.slice(lo, hi - lo))
        starts, where, _ = _anchors(w, window, anchor)
        places = np.unique(where)
        often = np.zeros(len(w.hash), bool)
        often[places] = counts[done : done + len(places)] > 1
        done += len(places)
        starts = starts[often[where]]
        one = words.mix(words.span_hash(w.hash, starts, starts + window, words.GRAM_BASE))
        two = words.mix(words.span_hash(w.hash, starts, starts + window, words.GRAM_BASE_2))
        yield w, starts, one, two


_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def _pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    out = np.empty(len(one), _PAIR)
    out["a"], out["b"] = one, two
    return out


def _grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the hash pairs, group number of each sorted pair, size of each group."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group) if len(group) else np.zeros(0, np.int64)


def _block_hashes(chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hash pairs of a block in sorted order, and which of them it has more than once."""
    found = [(one, two) for _, _, one, two in chunks]
    one = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
    two = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
    order, group, size = _grouped(one, two)
    first = order[np.flatnonzero(np.diff(group, prepend=-1))]
    return one[first], two[first], size > 1


def _shard_limits(one: np.ndarray, shards: int) -> np.ndarray:
    step = 2**64 // shards + 1
    return np.searchsorted(one, np.array([min(i * step, 2**64 - 1) for i in range(1, shards)], np.uint64))


def _group_shard(table: pa.Table) -> pa.Table:
    """Exact groups of the hash pairs of all blocks; answers one bit for each."""
    parts = [np.frombuffer(p.as_py(), np.uint8) for p in table.column("payload")]
    sizes = [int.from_bytes(p[:8].tobytes(), "little") for p in parts]
    pairs = np.concatenate([p[8 : 8 + 16 * n].view(np.uint8).copy().view(_PAIR) for p, n in zip(parts, sizes)])
    more = np.concatenate([np.unpackbits(p[8 + 16 * n :], count=n) for p, n in zip(parts, sizes)])
    order, group, size = _grouped(pairs["a"], pairs["b"])
    size = size + np.bincount(group, more[order]).astype(np.int64)
    repeated = np.empty(len(order), bool)
    repeated[order] = size[group] > 1
    back, at = [], 0
    for n in sizes:
        back.append(np.packbits(repeated[at : at + n]).tobytes())
        at += n
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "payload": pa.array(back, pa.binary())}, schema=blocks._ANSWER)


def _kept(w: words.Words, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words that stay, one space between them, and the limits of the texts in these bytes."""
    stay = np.flatnonzero(~covered)
    text = w.text[stay]
    edge = np.zeros(len(w.data) + 2, np.int8)
    edge[w.start[stay]] += 1
    ends = w.end[stay].copy()
    follows = np.append(text[1:] == text[:-1], False) if len(stay) else np.zeros(0, bool)
    np.add.at(edge, ends + follows, -1)  # the byte after a word that has a successor becomes its space
    mask = np.cumsum(edge[:-2]) > 0
    data = w.data.copy()
    data[ends[follows]] = 0x20
    size = np.bincount(text, (ends - w.start[stay]) + follows, minlength=len(w.first) - 1).astype(np.int64)
    return data[mask], np.concatenate([[0], np.cumsum(size)])


def remove_repeated_passages(text_layers: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, digest: bool = False) -> DataFrame:
    """Text layers without their repeated passages.

    ``text_layers``: (doc_id, text), one row per document; other columns are ignored, whatever their names. Returns
    (doc_id, n_words, n_removed, kept): the words that stay, joined by one space; with ``digest`` the SHA-256 of that
    instead of the text itself. A null text is empty, an empty text keeps nothing (""); a text of fewer than ``window``
    words is never touched; rows with a null or repeated doc_id are documents of their own; an empty table gives an
    empty result. ``anchor`` may be 1 to ``window``; it changes the work, not the result.
    """
    if not 1 <= anchor <= window:
        raise ValueError("anchor lies between 1 and window")
    docs, _, total = blocks.dealt(text_layers, block_bytes)
    anchors = max(1, total * 2 // (5 * (window - anchor + 2)))  # words of about five bytes; only sizes the sketch
    shards = blocks.shards_for(anchors, 2)
    groups = max(1, -(-total // 5 // HASHES_PER_SHARD))

    def sketch(table: pa.Table) -> pa.Table:
        _, _, text = blocks.in_order(table)
        return blocks.rows_table(blocks.sketch_rows(table.column("block")[0].as_py(), _anchor_keys(text, window, anchor), shards, 2))

    def counts_of(text: pa.Array, answer: dict[int, bytes]) -> np.ndarray:
        return blocks.answered(_anchor_keys(text, window, anchor), answer, shards, 2)

    def ask(table: pa.Table, answer: pa.Table) -> pa.Table:
        _, _, text = blocks.in_order(table)
        one, two, more = _block_hashes(_candidates(text, counts_of(text, blocks.answer_of(answer)), window, anchor))
        limits = [0, *_shard_limits(one, groups), len(one)]
        return blocks.rows_table(
            (table.column("block")[0].as_py(), s, (b - a).to_bytes(8, "little") + _pairs(one[a:b], two[a:b]).tobytes() + np.packbits(more[a:b]).tobytes())
            for s, (a, b) in enumerate(zip(map(int, limits[:-1]), map(int, limits[1:])))
            if b > a
        )

    def write(table: pa.Table, answer: pa.Table) -> pa.Table:
        doc, null, text = blocks.in_order(table)
        answers = blocks.answer_of(answer)  # masks come as shard -1 - s
        counts = counts_of(text, {s: p for s, p in answers.items() if s >= 0})
        one, two, more = _block_hashes(_candidates(text, counts, window, anchor))
        limits = [0, *map(int, _shard_limits(one, groups)), len(one)]
        repeated = more.copy()
        for s in range(groups):
            a, b = limits[s], limits[s + 1]
            if b > a:
                repeated[a:b] |= np.unpackbits(np.frombuffer(answers[-1 - s], np.uint8), count=b - a).astype(bool)
        hit = np.sort(_pairs(one[repeated], two[repeated]), order=["a", "b"])
        n_words, n_removed, kept = [], [], []
        for w, starts, a, b in _candidates(text, counts, window, anchor):
            at = np.searchsorted(hit["a"], a)
            found = np.zeros(len(a), bool)
            for step in range(4):  # equal first halves are next to each other
                near = np.minimum(at + step, max(0, len(hit) - 1))
                if len(hit):
                    found |= (hit["a"][near] == a) & (hit["b"][near] == b)
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, starts[found], 1)
            np.add.at(edge, starts[found] + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
            data, ends = _kept(w, covered)
            n_words.append(w.counts)
            n_removed.append(np.bincount(w.text, covered, minlength=len(w.first) - 1).astype(np.int64))
            out = data.tobytes()
            parts = [out[x:y] for x, y in zip(ends[:-1], ends[1:])]
            kept += [hashlib.sha256(p).hexdigest() for p in parts] if digest else [p.decode() for p in parts]
        ids = pa.array(doc, pa.int64(), mask=null)
        return pa.table({"doc_id": ids, "n_words": pa.array(np.concatenate(n_words)), "n_removed": pa.array(np.concatenate(n_removed)), "kept": pa.array(kept, pa.string())})

    sketched = blocks.merged(docs.groupBy("block").applyInArrow(sketch, blocks.ANSWER))
    masks = blocks.passed(docs, sketched, ask, blocks.ANSWER).groupBy("shard").applyInArrow(_group_shard, blocks.ANSWER)
    answers = sketched.unionByName(masks.withColumn("shard", -1 - F.col("shard")))
    return blocks.passed(docs, answers, write, RESULT)
