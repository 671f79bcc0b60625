"""Blocks by prefix sums against the sequential scan, over every kind of cut."""

import random

import pytest

from claridoc.functions.blocks import all_blocks
from claridoc.operators import live, splitting

BITS = ["<p>", "</p>", "<div class='a b'>", "</div>", "<br>", "<br/>", "<img src=x>", "</br/>", "text ", " \n", "a < b", " > ", "<", "</", "<a_b>", "<a-b_c>", "<br-x_y>", "<!-- c -->", "é", "<é>", "<aé>", "```", "<p <b>", "<hr"]


def page(seed: int) -> str:
    r = random.Random(seed)
    body = "".join(r.choice(BITS) for _ in range(r.randint(0, 60)))
    if r.random() < 0.6:
        body = "<table>" + "".join(f"<tr><td>{body if i == 3 else i}</td></tr>" for i in range(r.randint(0, 40))) + "</table>" + body
    while body.rstrip().endswith("```"):  # one closing fence is taken off, not two
        body = body.rstrip()[:-3]
    return r.choice(["", " ```HTML\n", "```\n", "﻿```html"]) + body + r.choice(["", "\n```", " ``` ", "<p>open"])


def cut(text: str, r: random.Random) -> list[str]:
    out = []
    while text:
        n = r.choice([1, 2, 3, 10, 200])
        out.append(text[:n])
        text = text[n:]
    return out or [""]


@pytest.mark.parametrize("unit", [1, 3, 64])
def test_blocks_do_not_depend_on_the_cut(spark, monkeypatch, unit):
    monkeypatch.setattr(splitting, "UNIT", unit)
    r = random.Random(unit)
    texts = {i: page(1000 * unit + i) for i in range(60)}
    rows = [(None if d == 7 else d, 3 * i - 4, c) for d, t in texts.items() for i, c in enumerate(cut(t, r))]
    r.shuffle(rows)
    got = live.chunk_blocks(spark.createDataFrame(rows, "doc_id long, chunk_no long, chunk string")).collect()
    want = {(None if d == 7 else d, i, b) for d, t in texts.items() for i, b in enumerate(all_blocks(t), 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    whole = [(d, t) for d, t in texts.items()] + [(3, texts[3]), (None, None)]
    got = live.extract_blocks(spark.createDataFrame(whole, "doc_id long, html string")).collect()
    want = [(d, i, b) for d, t in whole for i, b in enumerate(all_blocks(t or ""), 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_small_documents_are_read_in_one_pass_as_large_ones_by_sums(spark, monkeypatch):
    r = random.Random(9)
    ends = ["", "```", "``` ```", "\n```\n``` ", "<", " a", "<p>open ```"]
    texts = [page(7000 + i) + r.choice(ends) for i in range(80)] + ["", " ", "```", "``` ```", "a", "a < b", "<p>", "</p>x</p>", "```html", "x```"]
    whole = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (3, None), (None, texts[4])], "doc_id long, html string")
    rows = [(None if d == 7 else d, None if i == 0 else 3 * i, c) for d, t in enumerate(texts) for i, c in enumerate(cut(t, r))] + [(5, 3, "<b>"), (5, 3, None), (5, 3, "</b>")]
    chunks, writes, got = spark.createDataFrame(rows, "doc_id long, chunk_no long, chunk string"), [], {}
    monkeypatch.setattr(splitting, "written", lambda df, write=splitting.written: writes.append(1) or write(df))
    for size in (1 << 20, 300, -1):  # all in one pass, some, none
        monkeypatch.setattr(splitting, "WHOLE_BYTES", size)
        got[size] = [sorted((tuple(x) for x in f.collect()), key=str) for f in (live.extract_blocks(whole), live.chunk_blocks(chunks))]
        assert size < 1 << 20 or len(writes) == 3  # the texts, the chunks, large documents (none); prefix sums write twice more each
    assert got[1 << 20] == got[300] == got[-1] and all(got[-1])


def test_one_long_document_is_many_units(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("1L as doc_id", "id as chunk_no", "concat('<p>', id, '</p><ul><li>', repeat('word ', 20), '</li') as chunk")
    rows = rows.unionByName(rows.selectExpr("doc_id", "chunk_no", "'></ul' as chunk").where("false")).selectExpr("doc_id", "chunk_no", "concat(if(chunk_no = 0, '', '></ul>'), chunk) as chunk")
    blocks = live.chunk_blocks(rows)
    assert blocks.count() == 2 * n and blocks.where("block_no = 59999").first().html == "<p>29999</p>"
    assert blocks.where("html like '<ul>%' and html not like '%</li></ul>'").count() == 1
    units = splitting._units(splitting.written(rows.selectExpr("struct(doc_id) as doc", "chunk_no", "chunk as text")), splitting.F.floor(splitting.F.col("chunk_no") / 256))
    assert units.count() >= n
