import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from claridoc.llm.language_model import PRIOR, PairFilter, build_region, score_text_layers

from .conftest import GIVEN


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\n"]


def plain(rows):
    """(n_tokens, n_known, train_tokens, base_score, score) with exact counts of words and pairs, rounded to powers of two."""
    train = [tokens(t) for i, t in rows if crc32(str(i).encode()) % 10]
    words, pairs = Counter(w for d in train for w in d), Counter(p for d in train for p in zip([" ", *d], d))
    total, known = sum(words.values()), len(words)
    out = []
    for _, text in rows:
        d = tokens(text)
        base = score = 0.0
        for v, w in zip([" ", *d], d):
            c, context, n = words[w], len(train) if v == " " else words[v], pairs[v, w]
            p = (c + 0.1) / (total + 0.1 * (known + 1))
            q = 0 if not n else 1 if n == 1 else 1.5 * 2 ** int(math.log2(n)) - 0.5
            base += math.log10(p)
            score += math.log10((min(q, c, context) + PRIOR * p) / (context + PRIOR))
        out.append((len(d), sum(words[w] > 0 for w in d), total, base, score))
    return out


def test_scores_equal_exact_counts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text").collect()] + [(10**6, None), (10**6 + 1, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in score_text_layers(frame, block_bytes=50_000).collect()}
    for (i, _), want in zip(rows, plain(rows)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.held_out == (crc32(str(i).encode()) % 10 == 0)
        assert (r.base_score, r.score) == pytest.approx(want[3:], rel=1e-9)


def test_pairs_help_on_held_out_documents(spark):
    scored = score_text_layers(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    base, score = scored.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_nothing_trains(spark):
    frame = spark.createDataFrame([(10, "a b")], "doc_id long, text string")
    r = score_text_layers(frame, F.lit(False)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


@pytest.mark.parametrize("n", [194, 223, 0xC3A0, 0xE080])
def test_sums_whose_bytes_look_like_text(spark, n):
    """Numbers of tokens, or of distinct ones, that hold bytes of 0xC0 and more."""
    rows = [(1, " ".join(["a"] * (n - 1))), (2, " ".join(f"w{i}" for i in range(n % 256)) + " A"), (10, "a b")]
    rows = [r for r in rows if crc32(str(r[0]).encode()) % 10 or r[0] == 10]
    for kept in (rows[:1], rows[1:], rows):
        frame = spark.createDataFrame(kept, "doc_id long, text string")
        got = {r.doc_id: r for r in score_text_layers(frame).collect()}
        for (i, _), want in zip(kept, plain(kept)):
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == want[:3]
            assert got[i].base_score == pytest.approx(want[3], rel=1e-9)


def test_filter_never_underestimates_and_rarely_errs():
    r = np.random.default_rng(2)
    keys, counts = np.unique(r.integers(1, 2**63, 4000, dtype=np.uint64)), r.geometric(0.3, 4000)
    low, data = build_region(keys, counts, 1 << 18)
    assert low == 1
    pairs = PairFilter({0: (low, data)}, 1, 1 << 18)
    got = pairs.counts(keys)
    level = np.where(counts == 1, 1.0, 1.5 * 2.0 ** np.floor(np.log2(counts)) - 0.5)
    assert (got >= level).all() and (got > level).mean() < 0.02
    assert (pairs.counts(r.integers(1, 2**63, 4000, dtype=np.uint64)) > 0).mean() < 0.02


def test_full_region_keeps_the_high_levels():
    keys = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.where(np.arange(1000) < 100, 64, 1)
    low, data = build_region(keys, counts, 1 << 12)
    assert 1 < low <= 7
    got = PairFilter({0: (low, data)}, 1, 1 << 12).counts(keys)
    assert (got[:100] >= 64).all()


def test_a_small_filter_grows_with_its_pairs(spark):
    """Pairs seen once are in the filter whatever its least size: no count is lost, and few are too high."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_text_layers(frame, block_bytes=50_000, filter_bits=1024).collect()}
    want = {i: w[4] for (i, _), w in zip(rows, plain(rows))}
    assert all(got[i] >= want[i] - 1e-6 for i in want)
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.02)
