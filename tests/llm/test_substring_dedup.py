import re

import pytest

from claridoc.llm.substring_dedup import remove_repeated_passages

from .conftest import prose


def plain(texts, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for d, w in enumerate(docs):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = {(d, p) for places in seen.values() if len(places) > 1 for d, i in places for p in range(i, i + window)}
    return [(len(w), " ".join(x for p, x in enumerate(w) if (d, p) not in gone)) for d, w in enumerate(docs)]


@pytest.mark.parametrize("window,anchor,block_bytes", [(5, 2, 200), (5, 5, 10**6), (8, 1, 1000), (2, 1, 500)])
def test_equals_brute_force_for_any_block_and_anchor(spark, window, anchor, block_bytes):
    shared = prose(50, 20)
    texts = [prose(i, 30) + (" " + shared if i % 3 == 0 else "") for i in range(40)] + ["a b " * 30, None, "", "a b a b a", shared, "Z " * 7]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.kept) for r in remove_repeated_passages(frame, window, anchor, block_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, window)


def test_rows_without_identifier_are_documents(spark):
    text = prose(9, 50)
    frame = spark.createDataFrame([(None, text), (None, text), (None, prose(8, 50))], "doc_id long, text string")
    assert sorted(r.n_removed for r in remove_repeated_passages(frame).collect()) == [0, 50, 50]
