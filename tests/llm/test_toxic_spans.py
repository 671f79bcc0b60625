import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claridoc.llm import toxic_spans
from claridoc.llm.queries import label_held_out, op4_toxicity
from claridoc.llm.toxic_spans import STRETCH, Model, clean_text_layers, fit, marginals, sample, score_text_layers, tokens, train


@pytest.mark.parametrize("stretch", [1, 2, 3, 64])
def test_marginals_equal_enumeration(monkeypatch, stretch):
    monkeypatch.setattr(toxic_spans, "STRETCH", stretch)
    r = np.random.default_rng(0)
    first = np.array([0, 5, 5, 6, 9])
    toxic, chain = r.normal(0, 2, 9), r.normal(0, 1, (2, 2))
    p, pairs = marginals(toxic, first, chain)
    want, moves = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        weight = {s: np.exp(sum(toxic[a + i] * x for i, x in enumerate(s)) + sum(chain[x, y] for x, y in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=b - a)}
        for s, w in weight.items():
            for i, x in enumerate(s):
                want[a + i] += x * w / sum(weight.values())
            for x, y in zip(s, s[1:]):
                moves[x, y] += w / sum(weight.values())
    assert np.allclose(p, want) and np.allclose(pairs, moves)


def test_long_texts_are_read_to_the_end():
    r = np.random.default_rng(3)
    n = 3 * STRETCH + 7
    toxic = r.normal(0, 1, n)
    p, _ = marginals(toxic, np.array([0, n]), np.zeros((2, 2)))
    assert np.allclose(p, 1 / (1 + np.exp(-toxic)))


def test_cuts_into_stretches_do_not_show(monkeypatch):
    r = np.random.default_rng(5)
    first = np.array([0, 700, 700, 705, 1000])
    toxic, chain = r.normal(0, 2, 1000), np.array([[1.5, -1.0], [-0.5, 2.0]])
    p, pairs = marginals(toxic, first, chain)
    monkeypatch.setattr(toxic_spans, "STRETCH", 5000)
    whole, all_pairs = marginals(toxic, first, chain)
    assert np.allclose(p, whole) and np.allclose(pairs, all_pairs)


def test_sample_takes_documents_once_and_no_long_ones(spark):
    rows = [(1, "hot text")] * 500 + [(1, "another"), (2, "x" * 50), (3, None)] + [(i, f"clean {i}") for i in range(10, 30)] + [(i, f"vile {i}") for i in range(40, 45)]
    labels = [(1, 0), (2, 1), (3, 1), *[(i, 0) for i in range(10, 30)], *[(i, 1) for i in range(40, 45)]]
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = sample(*frames, docs=8, chars=20).collect()
    assert len({r.doc_id for r in got}) == len(got) == 8 + 5 and sum(r.label for r in got) == 5
    assert {r.text for r in sample(*frames, docs=100, chars=20).collect() if r.doc_id == 1} == {"another"}


def test_held_out_labels_are_predicted(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = op4_toxicity(spark, folder).where("held_out").join(labels, "doc_id")
    right, n, caught, toxic = judged.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*"), F.sum(F.col("predicted") * F.col("toxic")), F.sum("toxic")).first()
    assert n > 500 and right > 0.97 and caught > 0.85 * toxic


def toy_model():
    texts = [f"word{i} you plain text here number{i % 17}" for i in range(200)] + [f"Word{i} you vilething{i % 9}, number{i % 17}" for i in range(60)]
    return train(texts, np.array([0] * 200 + [1] * 60), 60 / 260)


def test_spans_are_code_points_of_offending_words(spark):
    frame = spark.createDataFrame([(1, "é you vilething3, ok\nvilething7"), (2, "plain text"), (3, None), (4, ""), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in score_text_layers(frame, toy_model()).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(6, 16), (21, 31)]
    assert got[1].predicted == 1 and got[1].score > 0.9
    assert all(got[i].predicted == 0 and got[i].spans == [] and 0 <= got[i].score < 0.5 for i in (2, 3, 4))


def test_clean_rows_keep_their_columns(spark):
    frame = spark.createDataFrame([(1, "you vilething3", 5.0), (2, "plain text", 0.5), (None, None, None)], "doc_id long, text string, score double")
    assert sorted(clean_text_layers(frame, toy_model()).collect(), key=str) == sorted(frame.where("doc_id is null or doc_id = 2").collect(), key=str)


def test_without_labels_of_both_classes(spark):
    frame = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 0)], [(2, None)]):
        model = fit(frame, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.predicted for r in score_text_layers(frame, model).collect()] == [0, 0]


def test_held_out_rows_by_checksum(spark):
    frame = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    from zlib import crc32

    assert all(r.h == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in frame.withColumn("h", label_held_out()).collect())


def test_no_words():
    t = tokens(pa.array(["", " \n"], pa.string()))
    score, p = Model(np.zeros(1 << 16), 0.0, np.zeros((2, 2)), np.array([-1.0, 1.0, 1.0])).score(t)
    assert len(score) == 2 and len(p) == 0
