"""Properties of the sequential helpers on generated input."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from claridoc.functions.blocks import scan_blocks
from claridoc.functions.hashing import base36, code32, powers
from claridoc.operators.markup import sanitize_pages

PIECES = ["<p>", "</p>", "<hr/>", "<br>", "<ul><li>", "</li></ul>", "text", " ", "< 5", "<", "<td", ">", "é", "\n", "<!-- x -->", "<P CLASS='a'>"]
markup = st.lists(st.sampled_from(PIECES), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(markup, st.integers(1, 9))
def test_blocks_do_not_depend_on_the_cut(text, size):
    whole, end = scan_blocks(text)
    got, rest = [], ""
    for i in range(0, len(text), size):
        found, rest = scan_blocks(rest + text[i : i + size])
        got += found
    assert (got, rest.strip()) == (whole, end.strip())


@settings(max_examples=200, deadline=None)
@given(markup)
def test_no_text_is_lost_between_blocks(text):
    blocks, rest = scan_blocks(text)
    squeeze = lambda s: "".join(s.split()).replace("<p>", "").replace("</p>", "")
    assert squeeze("".join(blocks) + rest) == squeeze(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_hash_is_the_rolling_code(text):
    h = 5381
    units = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (h * 33 + int.from_bytes(units[i : i + 2], "little")) % 2**32
    if all(not 0xD800 <= ord(c) <= 0xDFFF for c in text):
        assert code32(text, powers(2 * len(text))) == h
    assert int(base36(h) or "0", 36) == h


def test_cleaning_is_stable_and_removes_code(spark):
    rng = random.Random(12)
    parts = PIECES + ["<script>x()</script>", '<a href="javascript:x">', '<a href="/ok" onclick="y">', "<style>p{}</style>", "<form>", "</form>", "<img src=data:x>", "<svg>", "</svg>", "<!-- c -->"]
    given_ = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(400)]

    def cleaned(texts):
        pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
        return [r.html for r in sanitize_pages(pages).orderBy("page_id").collect()]

    once = cleaned(given_)
    for low in map(str.lower, once):
        assert "<script" not in low and "javascript:" not in low and "onclick" not in low and "<!--" not in low and "<form" not in low
    assert cleaned(once) == once
