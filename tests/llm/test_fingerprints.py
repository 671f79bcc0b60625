import hashlib

import numpy as np
import pyarrow as pa
import pytest

from claridoc.llm.fingerprints import compare_versions, differing, fingerprint_strings, paragraphs, peel, sketches, with_next_text
from claridoc.llm.queries import op6_fingerprints

from .conftest import GIVEN, prose


def digests(text):
    return set(paragraphs(pa.array([text or ""]))[1].tolist())


def alike(a, b):
    x, y = digests(a), digests(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def followers(rows):
    order = sorted(rows, key=lambda r: -r[0])
    return {r[0]: order[(i + 1) % len(order)][1] or "" for i, r in enumerate(order)}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text").collect()]
    nxt, got = followers(rows), {r.doc_id: r for r in op6_fingerprints(spark, GIVEN).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        k = len(text) // 3
        edited, r = text[: len(text) - k] + nxt[i][:k], got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == pytest.approx((alike(text, edited), alike(text, nxt[i])))
        assert (r.fingerprint == r.edited_fingerprint) == (digests(text) == digests(edited))


@pytest.mark.parametrize("bucket_bytes", [50, 1000, 10**6])
def test_next_text_over_bucket_limits(spark, bucket_bytes):
    rows = [(i * i - 50, prose(i, 1 + i % 9)) for i in range(8, 60)] + [(10**15, "far"), (-(10**15), None)]
    got = {r.doc_id: r.next_text for r in with_next_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bucket_bytes).collect()}
    assert got == followers(rows)


def test_next_text_of_one_row_and_of_none(spark):
    frame = spark.createDataFrame([(5, "alone")], "doc_id long, text string")
    assert with_next_text(frame).first().next_text == "alone"
    assert with_next_text(frame.where("false")).count() == 0
    ties = spark.createDataFrame([(None, "n"), (3, "a"), (3, "b")], "doc_id long, text string")
    got = sorted((r.text, r.next_text) for r in with_next_text(ties).collect())
    assert got in ([("a", "b"), ("b", "n"), ("n", "a")], [("a", "n"), ("b", "a"), ("n", "b")])


def test_peeling_recovers_the_differing_digests():
    r = np.random.default_rng(6)
    shared, a, b = (r.integers(1, 2**63, n, dtype=np.uint64) for n in (5000, 9, 7))
    keys = np.concatenate([shared, a, shared, b])
    sign = np.concatenate([np.ones(5009, np.int64), -np.ones(5007, np.int64)])
    cells = np.array([96])
    owner, got, signs, empty = peel(*sketches(np.zeros(len(keys), np.int64), keys, sign, cells), cells)
    assert empty[0] and set(got[signs > 0].tolist()) == set(a.tolist()) and set(got[signs < 0].tolist()) == set(b.tolist())


def test_failures_retry_larger():
    r = np.random.default_rng(7)
    sizes = [(0, 0), (3, 0), (400, 500), (20000, 10)]
    a = np.concatenate([np.full(x, i) for i, (x, _) in enumerate(sizes)]), r.integers(1, 2**63, sum(x for x, _ in sizes), dtype=np.uint64)
    b = np.concatenate([np.full(y, i) for i, (_, y) in enumerate(sizes)]), r.integers(1, 2**63, sum(y for _, y in sizes), dtype=np.uint64)
    assert differing(a, b, 4).tolist() == [x + y for x, y in sizes]


def test_versions_keep_other_columns(spark):
    long = prose(3, 20000)
    rows = [(1, "A b. C d.", "A b. C e.", "A b. C d.", 1.0), (2, None, "", "x", 2.0), (2, long, long, long + " more.", 3.0), (None, "same. same. same.", "same.", "same. same.", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, after_text string, other_text string, fingerprint double")
    got = compare_versions(frame).collect()
    assert [r.doc_id for r in got] == [1, 2, 2, None]
    assert [round(r.near_after, 4) for r in got] == [round(x, 4) for x in (1 / 3, 1.0, 1.0, 1 / 3)]
    assert got[0].near_other == 1.0 and got[1].near_other == 0.0 and got[2].near_other > 0.99
    assert fingerprint_strings(paragraphs(pa.array(["x  y."])), 1) == fingerprint_strings(paragraphs(pa.array(["x\ny. "])), 1)
