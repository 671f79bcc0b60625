import random

import pytest
from pyspark.sql import functions as F

from claridoc.llm.mixing import mix_sources, mixed_documents, sainte_lague, targets


def plain_seats(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        i = max(range(len(weights)), key=lambda k: (weights[k] / (2 * won[k] + 1), -k))
        won[i] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_seats_equal_highest_quotients(spark, seed):
    r = random.Random(seed)
    weights = [r.choice([0.0, 1.0, 1.0, r.random(), 50 * r.random(), 1000.0]) for _ in range(r.choice([1, 5, 30]))]
    seats = r.choice([1, 7, 100, 2000]) if sum(weights) else 0
    rows = spark.createDataFrame([(0, i, w, seats) for i, w in enumerate(weights)] + [(1, 0, 0.0, 5)], "house int, i int, w double, seats long")
    got = {(x.house, x.i): x.won for x in sainte_lague(rows, ["house"], "w", "seats", ["i"]).collect()}
    assert [got[0, i] for i in range(len(weights))] == (plain_seats(weights, seats) if sum(weights) else [0] * len(weights))
    assert got[1, 0] == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free} | {s: most * sizes[s] for s in full}
        over = [s for s in free if t[s] > most * sizes[s]]
        if not over:
            return t
        full |= set(over)


@pytest.mark.parametrize("seed", range(4))
def test_targets_reshare_until_none_is_above(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 10, 100, 5000]) for i in range(r.choice([2, 7, 12]))} | {None: 40}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {x.source: x.target for x in targets(frame).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_reaches_targets_and_reruns_agree(spark):
    r = random.Random(3)
    rows = [(i, f"s{r.choice([0, 0, 0, 1, 2, 3])}", "w " * r.randint(0, 200)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    once, again = (mix_sources(frame.repartition(n), shard_words=3000) for n in (3, 5))
    assert once.exceptAll(again).count() == 0
    assert once.where("taken > 3 * size").count() == 0
    for x in once.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect():
        assert abs(x.taken - x.target) <= 0.01 * x.target + 16 * 4


def test_documents_come_as_often_as_taken(spark):
    rows = [(i, "ab"[i % 2], "w " * (i % 7 + 1), i) for i in range(30)] + [(30, None, None, 1), (31, None, "", 2), (2, "a", "w w w", 5), (2, "a", "w w w", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, taken long")
    words = lambda df: df.select("doc_id", F.regexp_count("text", F.lit("w")).alias("n")).groupBy("doc_id").agg(F.sum("n").cast("long").alias("n"))
    want = mix_sources(frame).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0")
    got = words(mixed_documents(frame))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert mixed_documents(frame).columns == frame.columns
