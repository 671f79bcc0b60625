"""The manifest against a plain tree in Python: roots, proofs and what a changed record folds to."""

import hashlib
import zlib

import pyarrow.parquet as pq
import pytest

from claridoc.llm import manifest
from claridoc.llm.queries import op12_merkle_manifest
from claridoc.operators.probe import record_summary
from claridoc.sources.fixtures import view

from .conftest import GIVEN


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, fields):
    return H(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in fields])


def tree(leaves, fanout):
    """The root, and per leaf its siblings level by level as (before, after)."""
    proofs = [[] for _ in leaves]
    below = [[i] for i in range(len(leaves))]
    level = list(leaves)
    while len(level) > 1:
        up, above = [], []
        for a in range(0, len(level), fanout):
            run = level[a : a + fanout]
            for k in range(len(run)):
                for i in below[a + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H(*run))
            above.append(sum(below[a : a + fanout], []))
        level, below = up, above
    return level[0], proofs


def plain(rows, fields, fanout=2):
    """Per row, in the order of the tree: (row, leaf, subroot, root, proof)."""
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    subs = {}
    for lang in order:
        mine = sorted(((r, leaf_of(r, fields)) for r in langs[lang]), key=lambda p: (p[0]["doc_id"] is not None, p[0]["doc_id"] or 0, p[1]))
        subs[lang] = mine, *tree([leaf for _, leaf in mine], fanout)
    root, over = tree([subs[lang][1] for lang in order], fanout)
    return [(r, leaf, subs[lang][1], root, proof + over[i]) for i, lang in enumerate(order) for (r, leaf), proof in zip(subs[lang][0], subs[lang][2])]


def fold(leaf, proof):
    for before, after in proof:
        leaf = H(before, leaf, after)
    return leaf


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("where", ["given", "edges"])
def test_query_equals_a_plain_tree(spark, request, where):
    folder = GIVEN if where == "given" else request.getfixturevalue(where)
    rows = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    want = []
    for r, leaf, subroot, root, proof in plain(rows, FIELDS):
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
        folded = fold(leaf_of(r | {"n_chars": r["n_chars"] + 1}, FIELDS) if tampered else leaf, proof)
        want.append((r["doc_id"], leaf, subroot, root, H(*[b + a for b, a in proof]), folded, folded == root))
    got = [tuple(r) for r in op12_merkle_manifest(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert where != "given" or 0 < sum(not r[-1] for r in got) < len(got) / 4


@pytest.mark.parametrize("fanout", [2, 3, 5])
@pytest.mark.parametrize("tile_levels", [1, 2, 8])
def test_fanouts_and_tiles_give_the_same_tree(spark, monkeypatch, fanout, tile_levels):
    monkeypatch.setattr(manifest, "TILE_LEVELS", tile_levels)
    rows = [{"doc_id": None if i % 40 == 7 else i // 2, "lang": [None, "", "en", "fr", "en", "é"][i % 6] if i else "lone", "title": f"t{i % 5}", "proof": i} for i in range(90)] + [{"doc_id": 3, "lang": "en", "title": "t", "proof": 0}] * 9
    frame = spark.createDataFrame([(r["doc_id"], r["lang"], r["title"], r["proof"]) for r in rows], "doc_id long, lang string, title string, proof long")
    fields = ["doc_id", "lang", "title"]
    want = [(r["doc_id"], r["lang"], leaf, subroot, root, proof) for r, leaf, subroot, root, proof in plain(rows, fields, fanout)]
    got = [(r.doc_id, r.lang, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in manifest.manifest(frame, fields, fanout).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_records_of_audits_fold_to_their_root(spark):
    records = record_summary(view(spark, GIVEN, "probe_facts"))
    whole = manifest.manifest(records).withColumn("folded", manifest.folded_root())
    assert whole.count() == records.count() and whole.where("folded <> root").isEmpty()
    assert whole.select("root").distinct().count() == 1
    with pytest.raises(ValueError):
        manifest.manifest(records, fanout=1)


def test_no_records_no_root(spark):
    assert manifest.manifest(spark.createDataFrame([], "doc_id long, lang string"), ["doc_id"]).count() == 0
