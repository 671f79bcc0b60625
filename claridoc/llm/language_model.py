"""Language-model scores of text layers from a log-frequency Bloom filter.

Words are counted exactly over all training documents. Word pairs (the end of a text is a word, its start a context) are counted
exactly too and go into a log-frequency Bloom filter: a pair with count c enters levels 1 to 1 + floor(log2 c). A lookup
probes level after level until one is missing; the last level found gives the count, never an underestimate but for the
rounding to powers of two. The probability of a word is ``(count(pair) + PRIOR * p(word)) / (count(context) + PRIOR)``,
p(word) being the additive unigram estimate of the base score.

The filter is cut into regions, one for each shard of the pair counts, and grows with the corpus: a region has ``BITS_PER_ENTRY``
bits for every entry of its pairs, and its share of ``FILTER_BITS`` at least, so that it holds all levels of all pairs. Neither
the filter nor the word counts have a bound, so nothing is broadcast: blocks of documents ask the shards for their own pairs
and words (``claridoc.llm.blocks``), with counts of training pairs and words sent along and added up. A region is built, asked
and dropped where its pairs were counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.llm import blocks, words
from claridoc.session import written

BLOCK_BYTES = 4 << 20
FILTER_BITS = 1 << 28
BITS_PER_ENTRY = 10
PROBES = 4
PRIOR = 8.0
ADDED = 0.1
PAIRS_PER_SHARD = 1 << 21
WORDS_PER_SHARD = 1 << 21
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_END, _BEGIN = np.uint64(0x656E64), np.uint64(0x626567696E)
_SENT = "block long, shard long, payload binary"


def held_out(doc_id: Column, folds: int = 10) -> Column:
    """Remainder 0 of the CRC-32 of the identifier as text; a null identifier is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with the end of each text, the token before each (or the start), and where texts begin."""
    w = words.split(text, lower=True)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    token = np.full(first[-1], words.mix(_END[None])[0], np.uint64)
    token[np.arange(len(w.hash)) + w.text] = w.hash
    before = np.roll(token, 1)
    if n:
        before[first[:-1]] = words.mix(_BEGIN[None])[0]
    return token, before, first


def _pair(token: np.ndarray, before: np.ndarray) -> np.ndarray:
    return words.mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def _region(keys: np.ndarray, regions: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(regions) >> np.uint64(32)).astype(np.int64)


def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """PROBES bit numbers of a pair at a level, inside its region."""
    salted = words.mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 % 2**64))
    step = words.mix(salted) | np.uint64(1)
    return ((salted[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(size)).astype(np.int64)


def build_region(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[int, bytes]:
    """Lowest level that fits, and the bits of a region with all levels from there on."""
    top = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
    at_least = np.bincount(top, minlength=65)[::-1].cumsum()[::-1]
    low = 1
    while low < 64 and at_least[low:].sum() * BITS_PER_ENTRY > size:
        low += 1
    on = np.zeros(size, bool)
    for level in range(low, int(top.max(initial=0)) + 1):
        on[_bits(keys[top >= level], level, size).ravel()] = True
    return low, np.packbits(on).tobytes()


def region_bits(counts: np.ndarray, least: int) -> int:
    """Bits of a region that holds all levels of its pairs: a multiple of 8."""
    entries = int((np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1).sum())
    return -(-max(least, BITS_PER_ENTRY * entries) // 8) * 8


class PairFilter:
    """All regions; counts by repeated membership probes."""

    def __init__(self, regions: dict[int, tuple[int, bytes]], n: int, size: int):
        self.n, self.size = n, size
        self.low = np.full(n, 65)
        self.data = np.zeros(n * (size // 8), np.uint8)
        for r, (low, data) in regions.items():
            self.low[r] = low
            self.data[r * (size // 8) : (r + 1) * (size // 8)] = np.frombuffer(data, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level found of each key, 0 when none is."""
        region = _region(keys, self.n)
        out = np.zeros(len(keys), np.int64)
        level = self.low[region].copy()
        alive = np.flatnonzero(level < 65)
        for step in range(1, 65):
            if not len(alive):
                break
            for now in np.unique(level[alive]):
                own = alive[level[alive] == now]
                bit = _bits(keys[own], int(now), self.size) + region[own] * self.size
                hit = (self.data[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).all(axis=0)
                out[own[hit]] = now
                level[own[hit]] += 1
                level[own[~hit]] = 65
            alive = alive[level[alive] < 65]
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts of the last levels found."""
        return quantised(self.levels(keys))


def quantised(level: np.ndarray) -> np.ndarray:
    """The middle of the power of two that a level stands for; 0 without one."""
    return np.where(level > 1, 1.5 * 2.0 ** (level - 1) - 0.5, level)


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts."""
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[at], np.add.reduceat(times[order], at)


def _message(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps, and counts."""
    a, b = _packed(np.diff(keys, prepend=np.uint64(0))), blocks.pack(counts)
    return len(a).to_bytes(8, "little") + a + b


def _packed(gaps: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(gaps).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _opened(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(message[:8], "little")
    a, n = message[16 : 8 + size], int.from_bytes(message[8:16], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(a, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64), blocks.unpack(message[8 + size :])


def _by_shard(block: int, keys: np.ndarray, counts: np.ndarray, shards: int):
    cut = np.searchsorted(_region(keys, shards), np.arange(shards + 1))
    for s in range(shards):
        if cut[s + 1] > cut[s]:
            yield block, s, _message(keys[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]])


def score_text_layers(text_layers: DataFrame, trains: Column | None = None, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Unigram and word-pair log10 probabilities of every text layer.

    ``text_layers``: (doc_id, text); other columns are ignored. ``trains``: which rows the counts come from, a condition on
    doc_id; by default those that are not held out (``held_out``). Returns (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score), one row per input row. Tokens are the lower-cased words and one end. A null or empty text is
    its end alone. Without training rows every token has probability 1 / (V + 1) with V = 0, which is 1. Repeated rows
    count as often as they stand there; an empty table gives an empty result. ``filter_bits``: the least size of the filter.
    """
    docs, _, total = blocks.dealt(text_layers, block_bytes)
    out = ~trains if trains is not None else held_out(F.col("doc_id"))
    docs = docs.withColumn("out", F.coalesce(out, F.lit(False)))
    about = max(1, total // 6)
    pair_shards, word_shards = max(1, -(-about // PAIRS_PER_SHARD)), max(1, -(-about // WORDS_PER_SHARD))
    least = max(1024, filter_bits // pair_shards // 8 * 8)

    def _learning(table: pa.Table) -> np.ndarray:
        doc, null, _ = blocks.in_order(table)
        by_row = dict(zip(table.column("doc_id").to_pylist(), table.column("out").to_pylist()))
        return np.array([not by_row[None if z else d] for d, z in zip(doc.tolist(), null.tolist())], bool)

    def send(table: pa.Table) -> pa.Table:
        """Training counts of a block: pairs to the first shards, words to those after them. What it only asks about has count 0."""
        _, _, text = blocks.in_order(table)
        learn, block = _learning(table), table.column("block")[0].as_py()
        pairs, tokens, pair_times, token_times = [], [], [], []
        for lo, hi in words.chunks(text):
            token, before, first = _tokens(text.slice(lo, hi - lo))
            on = np.repeat(learn[lo:hi], np.diff(first))
            for keys, times, (k, t) in (
                (pairs, pair_times, _counted(_pair(token, before), on.astype(np.int64))),
                (tokens, token_times, _counted(token, on.astype(np.int64))),
            ):
                keys.append(k)
                times.append(t)
        rows = list(_by_shard(block, *_counted(np.concatenate(pairs), np.concatenate(pair_times)), pair_shards))
        rows += [(b, s + pair_shards, m) for b, s, m in _by_shard(block, *_counted(np.concatenate(tokens), np.concatenate(token_times)), word_shards)]
        return blocks.rows_table(rows)

    def settle(table: pa.Table) -> pa.Table:
        """A shard answers every block: pairs with the last level that their region of the filter has, words with their counts; these it also sums up (block -1)."""
        opened = [_opened(p.as_py()) for p in table.column("payload")]
        keys, counts = _counted(np.concatenate([k for k, _ in opened]), np.concatenate([c for _, c in opened]))
        shard = table.column("shard")[0].as_py()
        if shard < pair_shards:
            seen = counts > 0
            size = region_bits(counts[seen], least)
            levels = PairFilter({0: build_region(keys[seen], counts[seen], size)}, 1, size).levels(keys)
            return blocks.rows_table([(b, shard, blocks.pack(levels[np.searchsorted(keys, k)])) for b, (k, _) in zip(table.column("block").to_pylist(), opened)])
        back = [(b, shard, blocks.pack(counts[np.searchsorted(keys, k)])) for b, (k, _) in zip(table.column("block").to_pylist(), opened)]
        back.append((-1, shard, f"{int(counts.sum())} {int((counts > 0).sum())}".encode()))
        return blocks.rows_table(back)

    answers = written(docs.groupBy("block").applyInArrow(send, _SENT).groupBy("shard").applyInArrow(settle, blocks.ANSWER))
    heads = F.split(F.col("payload").cast("string"), " ")
    n_train, n_words = (int(x or 0) for x in answers.where("block = -1").agg(*[F.sum(heads[i].cast("long")) for i in (0, 1)]).first())
    n_docs_row = text_layers.select(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sum(F.when(F.coalesce(out, F.lit(False)), 0).otherwise(1))).first()
    n_docs = int(n_docs_row[0] or 0)

    def score(table: pa.Table, answer: pa.Table) -> pa.Table:
        doc, null, text = blocks.in_order(table)
        learn = _learning(table)
        chunked = [_tokens(text.slice(lo, hi - lo)) for lo, hi in words.chunks(text)]
        keys, pairs = np.unique(np.concatenate([c[0] for c in chunked])), np.unique(np.concatenate([_pair(c[0], c[1]) for c in chunked]))
        got = blocks.answer_of(answer)
        levels, counts = (np.concatenate([blocks.unpack(got[s]) for s in sorted(got) if (s < pair_shards) == first]) for first in (True, False))
        pair_counts, counts = quantised(levels), counts.astype(float)
        base_of = lambda c: (c + ADDED) / (n_train + ADDED * (n_words + 1))
        n_tokens, n_known, base, full = [], [], [], []
        for token, before, first in chunked:
            c = counts[np.searchsorted(keys, token)]
            context = np.roll(c, 1)
            context[first[:-1]] = n_docs
            p = base_of(c)
            pair = np.minimum(pair_counts[np.searchsorted(pairs, _pair(token, before))], np.minimum(c, context))
            q = (pair + PRIOR * p) / (context + PRIOR)
            n_tokens.append(np.diff(first))
            n_known.append(np.add.reduceat(c > 0, first[:-1], dtype=np.int64))
            base.append(np.add.reduceat(np.log10(p), first[:-1]))
            full.append(np.add.reduceat(np.log10(q), first[:-1]))
        n = len(doc)
        return pa.table(
            {
                "doc_id": pa.array(doc, pa.int64(), mask=null),
                "held_out": pa.array(~learn),
                "n_tokens": pa.array(np.concatenate(n_tokens).astype(np.int64)),
                "n_known": pa.array(np.concatenate(n_known)),
                "train_tokens": pa.array(np.full(n, n_train, np.int64)),
                "base_score": pa.array(np.concatenate(base)),
                "score": pa.array(np.concatenate(full)),
            }
        )

    return blocks.passed(docs, answers.where("block >= 0"), score, RESULT)

