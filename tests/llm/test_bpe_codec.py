"""The codec against one pass of the library over whole texts, with tiny chunks, shared passages and joins inside words."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from claridoc.llm import bpe_codec
from claridoc.llm.queries import bpe_path, op11_bpe_codec
from claridoc.sources.fixtures import view

from .conftest import GIVEN, prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_path())


@pytest.fixture(scope="module")
def model():
    return bpe_codec.load_bpe_model(bpe_path())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("where", ["given", "edges"])
def test_query_equals_the_library(spark, request, library, where):
    folder = GIVEN if where == "given" else request.getfixturevalue(where)
    want = []
    for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids_of(library, r["text"])).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in op11_bpe_codec(spark, folder).collect()) == sorted(want)


def hard_texts():
    r = random.Random(4)
    passage = prose(9, 400)
    marks = ["<|endoftext|>", "x<|startoftext|>y", "don't", "we'll'd", "ΣΑΣ", "İ", "é", " ́a", " ", "日本語", "🏋🏽", "a" * 70, "\x0b", "\x1c", "١٢", "!?'s", " "]
    texts = ["".join(r.choice([*marks, " ", "\n", "\t", "word", "Wörter "]) for _ in range(r.randint(1, 300))) for _ in range(30)]
    texts += [prose(i, 20) + " " + passage + prose(i + 50, 20) for i in range(6)] + [passage] * 3
    return texts + ["z" * 30_000, "日本" * 9_000, " " * 5_000, "á" * 5_000 + " b", "", None, "one", " one", "one "]


@pytest.mark.parametrize("mean,least,most", [(8, 40, 64), (1024, 256, 8192)])
def test_joins_inside_words_are_repaired(spark, monkeypatch, library, model, mean, least, most):
    for name, value in (("CHUNK_MEAN", mean), ("CHUNK_LEAST", least), ("CHUNK_MOST", most)):
        monkeypatch.setattr(bpe_codec, name, value)
    rows = [(None if i % 9 == 0 else i, t, i) for i, t in enumerate(hard_texts())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, block int")
    got = sorted(((r.doc_id, bytes(r.ids), r.n_tokens) for r in bpe_codec.encode(frame, model, 20_000).collect()), key=str)
    want = [(d, ids_of(library, t)) for d, t, _ in rows]
    assert got == sorted(((d, ids, len(ids) // 4) for d, ids in want), key=str)


def test_shared_chunks_are_encoded_by_one_block(spark, monkeypatch, model):
    passage = prose(9, 4000)
    frame = spark.createDataFrame([(i, prose(i, 30) + " " + passage) for i in range(12)], "doc_id long, text string")
    docs, n, _ = bpe_codec.blocks.dealt(frame, len(passage) * 2)
    asked = [(r.one, r.two, r.block) for r in docs.groupBy("block").applyInArrow(bpe_codec._ask, "one long, two long, block long").collect()]
    assert n > 3 and len(asked) > 1.8 * len({a[:2] for a in asked}), "blocks share the passage's chunks"


def test_chunk_limits_follow_the_bytes():
    body = np.frombuffer(prose(1, 3000).encode(), np.uint8)
    other = np.concatenate([np.frombuffer(b"some other beginning, longer than a window of bytes ", np.uint8), body])
    cut = lambda data, limits: bpe_codec.cuts(data, limits, bpe_codec.rolling(data)[1])
    one, _ = cut(body, np.array([0, len(body)]))
    two, _ = cut(other, np.array([0, len(other)]))
    shared = set(one.tolist()) & {t - (len(other) - len(body)) for t in two.tolist()}
    assert len(shared) > 0.8 * len(one) > 5
    japanese = np.frombuffer(("日" * 9000).encode(), np.uint8)
    limits, first = cut(japanese, np.array([0, 9000, 27000]))
    assert (limits % 3 == 0).all() and first[-1] == len(limits) - 1 and np.diff(limits).max() <= bpe_codec.CHUNK_MOST


def test_joins_grow_until_both_ends_agree(model):
    class Odd(bpe_codec.Encoder):
        """Joins the words 'new york' to one token, whatever stands between."""

        def encode(self, texts):
            return super().encode([b" ".join(t.split()).replace(b"new york", b"newyork") for t in texts])

    odd = Odd(bpe_codec.zlib.decompress(model.packed).decode())
    assert bpe_codec.repaired(odd, [b"in", b"the"], b" ci ty ", [b"of", b"x"]) == odd.encode([b"ci ty"])[0]
    assert bpe_codec.repaired(odd, [b"in", b"new"], b" ", [b"york", b"x"]) is None
    text = b"in the new york of x"
    part = bpe_codec.Chunks((0, 1), text, np.array([0, len(text)]), np.array([0, 2]), [2, 10], [8, 18], [(1, 1), (2, 2)])
    assert bpe_codec._assemble(odd, part, {}) == odd.encode([text])


def test_words_in_common_form_have_the_same_identifiers(library, model):
    texts = [*filter(None, hard_texts()), "A, B. c", "J\u030c, H\u0331. W\u030a!", "<|ENDOFTEXT|>, x", 'say "Yes," (no). 3.5, v2.', "don't, WE'LL; e.g.,"]
    for text in texts:
        data = text.encode()
        assert model.encoder.encode_words([model.encoder.split(data)])[0] == ids_of(library, text), text[:50]


def test_models_that_keep_white_space_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe_codec.load_bpe_model("/opt/tokenizers/byte_bpe_50k.json")


def test_decoding_leaves_unknown_numbers_out(spark, library, model):
    frame = spark.createDataFrame([(1, bytearray(np.array([320, 49407, 60000], "<u4").tobytes()), "old"), (2, None, "old")], "doc_id long, ids binary, text string")
    got = {r.doc_id: r.text for r in bpe_codec.decode(frame, model).collect()}
    assert got == {1: library.decode([320, 49407], skip_special_tokens=False), 2: None}


def test_cleaned_pages_of_audits(spark, library, model):
    pages = view(spark, GIVEN, "pages").selectExpr("page_id as doc_id", "html as text").limit(20)
    got = {r.doc_id: bytes(r.ids) for r in bpe_codec.encode(pages, model).collect()}
    assert got == {r.doc_id: ids_of(library, r.text) for r in pages.collect()}
