import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from claridoc.llm.piece_codec import decode, encode, encode_chunk, load_piece_model, piece_model
from claridoc.llm.queries import op10_sentencepiece, tokenizer_path

from .conftest import GIVEN, edge_rows


def toy():
    pieces = [b"", *(bytes([i]) for i in range(256)), b"a", b"b", b" ", b"ab", b"ba", b" a", b"aba", "é".encode(), b"aa"]
    r = random.Random(8)
    return piece_model(pieces, [0.0] * 257 + [-r.random() * 5 for _ in range(len(pieces) - 257)], list(range(1, 257)))


def plain(model, text, n):
    """All segmentations by recursion, best first: (score, identifiers)."""
    byte = set(model.bytes_at.tolist())
    known = {model.data[model.limits[i] : model.limits[i + 1]].tobytes(): i for i in range(len(model.scores)) if i not in byte and model.limits[i + 1] > model.limits[i]}
    data, out = text.encode(), []

    def go(p, score, path):
        if p == len(data):
            out.append((score, path))
            return
        q = p + 1
        while q < len(data) and data[q] & 0xC0 == 0x80:
            q += 1
        if data[p:q] not in known:
            go(q, score + model.unknown * (q - p), path + [int(model.bytes_at[x]) for x in data[p:q]])
        for e in range(p + 1, len(data) + 1):
            if data[p:e] in known:
                go(e, score + model.scores[known[data[p:e]]], path + [known[data[p:e]]])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])[:n]


def applied(ids, best):
    for b in best:
        path = list(ids)
        for c in sorted(b["changes"], key=lambda c: -c["at"]):
            path[c["at"] : c["at"] + c["count"]] = c["ids"]
        yield b["score"], path


@pytest.mark.parametrize("n", [1, 2, 5])
def test_n_best_equal_enumeration(n):
    model, r = toy(), random.Random(n)
    texts = ["".join(r.choices("ab é\nx", weights=[5, 5, 2, 1, 1, 1], k=r.randint(0, 11))) for _ in range(60)]
    ids, many, best = encode_chunk(model, pa.array(texts, pa.string()), n)
    for text, raw, k, b in zip(texts, ids, many, best):
        base, want = np.frombuffer(raw, "<u2").tolist(), plain(model, text, n)
        got = list(applied(base, b))
        assert len(base) == k and base == got[0][1]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])
        ways = {tuple(p): s for s, p in plain(model, text, 10**9)}
        assert len({tuple(p) for _, p in got}) == len(got) and all(ways[tuple(p)] == pytest.approx(s) for s, p in got)


def test_every_text_comes_back(spark):
    rows = [(r["doc_id"], r["text"], "i") for r in edge_rows()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    model = load_piece_model(tokenizer_path())
    got = decode(encode(frame, model), model).collect()
    assert [(r.doc_id, r.text) for r in got] == [(i, t or "") for i, t, _ in rows]


def test_query_round_trip(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{GIVEN}/documents.parquet").collect()}
    for r in op10_sentencepiece(spark, GIVEN).collect():
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.best_score >= r.nth_score and (r.n_pieces > 0) == (texts[r.doc_id] != "")


def test_a_long_run_of_one_character():
    """Paths of a segment of 200,000 bytes are not copied for every entry of the search."""
    text = "a" * 200_000
    model = toy()
    ids, many, best = encode_chunk(model, pa.array([text], pa.string()), 4)
    base = np.frombuffer(ids[0], "<u2").tolist()
    got = list(applied(base, best[0]))
    assert len(got) == 4 and got[0][1] == base and len({tuple(p) for _, p in got}) == 4
    assert all(b"".join(model.data[model.limits[i] : model.limits[i + 1]].tobytes() for i in p) == text.encode() for _, p in got)
