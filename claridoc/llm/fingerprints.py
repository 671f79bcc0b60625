"""Version fingerprints of text layers: invertible Bloom lookup sketches over paragraph digests.

A paragraph is a run of words up to a sentence end; in unbroken text also up to a word whose hash has its low bits zero, so that
cuts follow the content. Each digest (with its repeat number, so that lists become sets) adds itself to one cell in each
third of a sketch: number, sum of digests, sum of check values. Two versions' sketches are subtracted cell by cell; cells
that hold one digest alone are peeled until nothing is left, which recovers exactly the paragraphs that differ. A
sketch that does not peel is built again four times larger. The fingerprint is the smallest sketch and the number of paragraphs.

All pairs of a batch are sketched, subtracted and peeled together in numpy.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claridoc.llm import words

CELLS = 12
GROWTH = 4
CUT = 24
BATCH_BYTES = 1 << 19
BUCKET_BYTES = 8 << 20
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def paragraphs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of every paragraph of every text; equal texts have equal lists."""
    w = words.split(texts)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = _STOP[w.data[w.end - 1]] | (w.hash % np.uint64(CUT) == 0)
    last = np.zeros(len(w.hash), bool)
    last[w.first[1:][w.counts > 0] - 1] = True
    stop = np.flatnonzero(ends | last) + 1
    start = np.concatenate([[0], stop[:-1]])
    text = w.text[start]
    digest = words.mix(words.span_hash(w.hash, start, stop, words.GRAM_BASE) + (stop - start).astype(np.uint64))
    order = np.lexsort((digest, text))
    t, d = text[order], digest[order]
    new = np.ones(len(d), bool)
    new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(d)) - np.repeat(begin, np.diff(np.append(begin, len(d))))
    return t, words.mix(d + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _check(keys: np.ndarray) -> np.ndarray:
    return words.mix(keys ^ np.uint64(0x5BF03635F0A31E01)) >> np.uint64(32)


def _spots(owner: np.ndarray, keys: np.ndarray, cells: np.ndarray, offset: np.ndarray, salt: int) -> np.ndarray:
    """Cells (3, n) of each key in its owner's sketch, one in each third."""
    third = (cells[owner] // 3).astype(np.uint64)
    out = [offset[owner] + (i * third + words.mix(keys + np.uint64(7919 * (3 * salt + i + 1))) % third).astype(np.int64) for i in range(3)]
    return np.stack(out) if len(keys) else np.zeros((3, 0), np.int64)


def sketches(owner: np.ndarray, keys: np.ndarray, sign: np.ndarray, cells: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, digest sums and check sums of all owners' sketches, one after the other."""
    offset = np.cumsum(cells) - cells
    spots = _spots(owner, keys, cells, offset, salt).ravel()
    size = int(cells.sum())
    number, sums, checks = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    signed = np.tile(sign, 3)
    np.add.at(number, spots, signed)
    minus = (signed < 0).astype(np.uint64)
    flip = lambda v: np.where(minus, ~v + np.uint64(1), v)
    np.add.at(sums, spots, flip(np.tile(keys, 3)))
    np.add.at(checks, spots, flip(np.tile(_check(keys), 3)))
    return number, sums, checks


def peel(number: np.ndarray, sums: np.ndarray, checks: np.ndarray, cells: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests recovered from subtracted sketches: (owner, digest, sign), and whether each owner's sketch emptied."""
    offset, owner_of = np.cumsum(cells) - cells, np.repeat(np.arange(len(cells)), cells)
    number, sums, checks = number.copy(), sums.copy(), checks.copy()
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(int(cells.max(initial=0)) + 1):
        lone = np.flatnonzero(np.abs(number) == 1)
        sign = number[lone]
        key = np.where(sign < 0, ~sums[lone] + np.uint64(1), sums[lone])
        check = np.where(sign < 0, ~checks[lone] + np.uint64(1), checks[lone])
        pure = _check(key) == check
        owner, key, sign = owner_of[lone][pure], key[pure], sign[pure]
        if not len(key):
            break
        order = np.lexsort((key, owner))
        owner, key, sign = owner[order], key[order], sign[order]
        new = np.ones(len(key), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
        owner, key, sign = owner[new], key[new], sign[new]
        got.append((owner, key, sign))
        spots = _spots(owner, key, cells, offset, salt).ravel()
        np.add.at(number, spots, -np.tile(sign, 3))
        back = np.tile(sign, 3) > 0
        flip = lambda v: np.where(back, ~v + np.uint64(1), v)  # noqa: E731,B023
        np.add.at(sums, spots, flip(np.tile(key, 3)))
        np.add.at(checks, spots, flip(np.tile(_check(key), 3)))
    left = np.bincount(owner_of, (number != 0) | (sums != 0) | (checks != 0), minlength=len(cells))
    join = lambda i, t: np.concatenate([g[i] for g in got]) if got else np.zeros(0, t)
    return join(0, np.int64), join(1, np.uint64), join(2, np.int64), left == 0


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """How many paragraphs differ in each of n pairs of versions, by subtracting and peeling; larger sketches where that fails."""
    out = np.zeros(n, np.int64)
    open_ = np.arange(n)
    cells, step = CELLS, 0
    while len(open_):
        place = np.full(n, -1)
        place[open_] = np.arange(len(open_))
        (oa, ka), (ob, kb) = ((place[t][place[t] >= 0], k[place[t] >= 0]) for t, k in (a, b))
        size = np.full(len(open_), cells)
        number, sums, checks = sketches(np.concatenate([oa, ob]), np.concatenate([ka, kb]), np.concatenate([np.ones(len(ka), np.int64), -np.ones(len(kb), np.int64)]), size, step)
        owner, _, _, empty = peel(number, sums, checks, size, step)
        found = np.bincount(owner, minlength=len(open_))
        out[open_[empty]] = found[empty]
        open_ = open_[~empty]
        cells, step = cells * GROWTH, step + 1
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Shared over all paragraphs of each pair, 1 for two versions without any."""
    both = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    apart = differing(a, b, n)
    return np.where(both > 0, (both - apart) / np.maximum(both + apart, 1), 1.0)


def fingerprint_strings(a: tuple[np.ndarray, np.ndarray], n: int) -> list[str]:
    """The smallest sketch of each text: number of paragraphs and cells, base64."""
    cells = np.full(n, CELLS)
    number, sums, checks = sketches(*a, np.ones(len(a[1]), np.int64), cells)
    row = np.zeros((n, CELLS), np.dtype([("n", "<u4"), ("s", "<u8"), ("c", "<u4")]))
    row["n"], row["s"], row["c"] = number.reshape(n, CELLS), sums.reshape(n, CELLS), (checks & np.uint64(2**32 - 1)).reshape(n, CELLS)
    many = np.bincount(a[0], minlength=n).astype("<u4")
    return [base64.b64encode(many[i].tobytes() + row[i].tobytes()).decode() for i in range(n)]


def compare_versions(versions: DataFrame, before: str = "text", after: str = "after_text", other: str = "other_text") -> DataFrame:
    """Fingerprints of a document's two versions and how alike they are.

    ``versions``: (doc_id, text, after_text, other_text): the text layer of the first version, that of the second, and
    that of some other document to compare with. Returns the other input columns (names that the result uses are
    replaced) and fingerprint, after_fingerprint, near_after, near_other: shared over all paragraphs, 0 to 1. A null
    text is empty; two texts without words are alike (1.0); a text that differs only in white space has the same
    fingerprint. Repeated rows keep rows of their own; an empty table gives an empty result. Nothing is shuffled.
    """
    results = {"fingerprint": "string", "after_fingerprint": "string", "near_after": "double", "near_other": "double"}
    passing = [f for f in versions.schema.fields if f.name not in {before, after, other, *results}]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in passing] + [f"{k} {v}" for k, v in results.items()])

    def run(batches):
        for batch in batches:
            for lo, hi in words.chunks(batch.column(before), BATCH_BYTES):
                rows = batch.slice(lo, hi - lo)
                n = hi - lo
                one, two, three = (paragraphs(rows.column(c)) for c in (before, after, other))
                columns = [rows.column(f.name) for f in passing] + [
                    pa.array(fingerprint_strings(one, n)),
                    pa.array(fingerprint_strings(two, n)),
                    pa.array(likeness(one, two, n)),
                    pa.array(likeness(one, three, n)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in passing] + list(results))

    return versions.select(*[f"`{f.name}`" for f in passing], *[F.coalesce(c, F.lit("")).alias(c) for c in (before, after, other)]).mapInArrow(run, schema)


def with_next_text(text_layers: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, next_text): each document with the one that follows it by descending doc_id, the last with the first.

    Documents go once to buckets of neighbouring identifiers, where a window looks one row ahead; limits are quantiles of
    doc_id. The first document of a bucket also goes to the bucket that ends just before it. Only the limits and the
    first identifier of each bucket pass the driver. A null doc_id comes last; rows with one doc_id are ordered by a hash of the text.
    """
    docs = text_layers.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    least = -(2**63)
    n = max(1, min(-(-(total or 0) // bucket_bytes), rows or 1))
    shares = [i / n for i in range(1, n)]
    limits = np.unique(np.array(docs.agg(F.percentile_approx("doc_id", shares, 10 * n)).first()[0] if shares else [], dtype=np.int64)) if rows else np.zeros(0, np.int64)

    def bucket_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(limits, ids, side="left")

    def firsts(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(least)).astype(np.int64)
            b = bucket_of(ids)
            top = np.full(len(limits) + 1, least)
            np.maximum.at(top, b, ids)
            has = np.unique(b)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(top[has])], ["bucket", "first"])

    heads = {r[0]: r[1] for r in docs.select("doc_id").mapInArrow(firsts, "bucket long, first long").groupBy("bucket").agg(F.max("first")).collect()}
    filled = sorted(heads)
    guests = {heads[b]: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}  # the bucket above ends before b; the lowest ends before the highest

    def deal(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").fill_null(least)).astype(np.int64)
            own = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(bucket_of(ids)), pa.array(np.zeros(len(ids), bool))], ["doc_id", "text", "bucket", "guest"])
            yield own
            more = np.array([i for i, k in enumerate(ids.tolist()) if k in guests], np.int64)
            if len(more):
                to = pa.array([guests[k] for k in ids[more].tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(more)), batch.column("text").take(pa.array(more)), to, pa.array(np.ones(len(more), bool))], ["doc_id", "text", "bucket", "guest"])

    dealt = docs.mapInArrow(deal, "doc_id long, text string, bucket long, guest boolean")
    order = W.partitionBy("bucket").orderBy("guest", F.coalesce("doc_id", F.lit(least)).desc(), F.xxhash64("text"), F.md5("text"))
    return dealt.select("doc_id", "text", F.lead("text").over(order).alias("next_text"), "guest").where("not guest").drop("guest")
