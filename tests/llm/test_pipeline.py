"""Every stage of the pipeline against a plain version on a small corpus, and the whole run."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from claridoc.llm import queries

from .conftest import GIVEN
from .test_jaccard_join import plain as plain_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = queries.table(spark, GIVEN, "documents"), []
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, GIVEN).cache()
        out.append((name, docs, made))
        docs = made
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_come_in_the_order_asked(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert all(sorted(made.columns) == sorted(COLUMNS) for _, _, made in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    _, given, made = stages[0]
    labels = {r.doc_id: r.toxic for r in queries.table(spark, GIVEN, "labels").collect()}
    before, kept = texts(given), texts(made)
    assert all(before[i] == t for i, t in kept.items())
    insult = re.compile(r"\b(loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid)\b", re.I)
    assert not [i for i, t in kept.items() if insult.search(t or "")]
    clean = [i for i, x in labels.items() if x == 0 and i in before]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_later_runs_of_lines_go(stages):
    _, given, made = stages[1]
    before = texts(given)
    seen, want = set(), {}
    for i in sorted(before):
        lines = (before[i] or "").split("\n")
        full = [k for k, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for size in (1, 2, 3):
            for a in range(len(full) - size + 1):
                key = tuple(lines[k] for k in full[a : a + size])
                if size == 3 or len(" ".join(key).split()) >= 20:
                    gone |= set(full[a : a + size]) if key in seen else set()
                    seen.add(key)
        if not gone or len(gone) < len(full):
            want[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    assert texts(made) == want
    assert all(r.n_chars == len(r.text) for r in made.collect())


def test_one_document_of_each_class_stays(stages):
    _, given, made = stages[2]
    before = texts(given)
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in before.items()}
    want = {i for i, (_, c) in plain_classes(split, 5, 80).items() if c == i}
    assert set(texts(made)) == want


def test_the_mix_takes_what_the_operator_says(stages):
    _, given, made = stages[3]
    from claridoc.llm.mixing import mix_sources

    taken = {r.doc_id: r.taken for r in mix_sources(given).collect() if r.taken}
    got = Counter()
    for r in made.collect():
        got[r.doc_id] += len(r.text.split())
    assert dict(got) == taken


def test_pieces_decode_to_the_texts(stages):
    _, given, made = stages[4]
    want = sorted(r.d for r in given.select(F.sha2("text", 256).alias("d")).collect())
    assert sorted(r.text_sha256 for r in made.collect()) == want


def test_whole_run_equals_its_stages(spark, stages):
    columns = ["doc_id", "source", "n_pieces", "best_score", "ids", "text_sha256"]
    whole = pipeline.run(spark, GIVEN)
    assert whole.columns == columns
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, stages[-1][2].select(columns).collect()))


def test_empty_documents_and_edges(spark, edges, nothing):
    assert pipeline.run(spark, nothing).count() == 0
    assert pipeline.run(spark, edges).count() > 5
