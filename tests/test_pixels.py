"""Pixels under spans: boxes sent to the pixels, and pixels folded and sent to the boxes, against a loop over pixels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from claridoc.functions.color import contrast_ratio, hex_to_rgb, luminance, round2
from claridoc.operators import contrast

SPANS = "page_id long, span_idx long, text string, color string, x double, y double, width double, height double, font_size_px double, bold boolean"


def picture(seed: int):
    r = random.Random(seed)
    pages = [(p, r.randint(20, 150), r.randint(20, 150), 600.0) for p in range(4)]
    pixels = []
    for p, w, h, _ in pages:
        plain = [(r.randrange(256),) * 3 + (255,) for _ in range(3)]
        for y in range(h):
            for x in range(w):
                pixels.append((p, x, y, *(plain[(x // 40 + y // 30) % 3] if p % 2 else (r.randrange(256), r.randrange(256), 7, r.choice([255, 255, 255, 9])))))
    spans = [(p, i, f"s{i}", "#%06x" % r.randrange(1 << 24), r.uniform(-5, w), r.uniform(-5, h), r.uniform(0, 90), r.uniform(0, 40), 12.0, False) for p, w, h, _ in pages for i in range(9)]
    return spans, pixels, pages


@pytest.mark.parametrize("most,tile,bits", [(1 << 20, 64, 1 << 24), (0, 64, 1 << 24), (0, 13, 1 << 6), (3, 8, 1 << 12)])
def test_both_ways_equal_a_loop(spark, monkeypatch, most, tile, bits):
    monkeypatch.setattr(contrast, "BROADCAST_BOXES", most)
    monkeypatch.setattr(contrast, "FILTER_BITS", bits)
    spans, pixels, pages = picture(tile)
    frames = spark.createDataFrame(spans, SPANS), spark.createDataFrame(pixels, "page_id long, x long, y long, r int, g int, b int, a int"), spark.createDataFrame(pages, "page_id long, width long, height long, page_point_width double")
    under = {}
    for p, i, _, _, x, y, w, h, _, _ in spans:
        _, width, height, _ = pages[p]
        x0, y0, x1, y1 = max(0, int(x // 1)), max(0, int(y // 1)), min(width, -int(-(x + w) // 1)), min(height, -int(-(y + h) // 1))
        under[p, i] = (x0, y0, x1, y1)
    want = {}
    for p, x, y, r, g, b, a in pixels:
        for i in range(9):
            x0, y0, x1, y1 = under[p, i]
            if x0 <= x < x1 and y0 <= y < y1:
                want[p, i, r, g, b, a >= 255] = want.get((p, i, r, g, b, a >= 255), 0) + 1
    got = {(r.page_id, r.span_idx, r.r, r.g, r.b, r.opaque): r.n for r in contrast.span_pixels(*frames, tile=tile).collect()}
    assert got == want
    ratios = spark.createDataFrame([(*k, v, spans[9 * k[0] + k[1]][3]) for k, v in want.items() if k[5]], "page_id long, span_idx long, r int, g int, b int, o boolean, n long, color string")
    rgb = hex_to_rgb(ratios["color"])
    listed = {}
    for row in ratios.select("page_id", "span_idx", "n", round2(contrast_ratio(luminance(rgb["r"], rgb["g"], rgb["b"]), luminance(ratios["r"], ratios["g"], ratios["b"]))).alias("q")).collect():
        listed.setdefault((row.page_id, row.span_idx), []).extend([row.q] * row.n)
    ranks = {k: (sorted(v)[len(v) // 50], sorted(v)[len(v) // 2]) for k, v in listed.items()}
    assert {(r.page_id, r.span_idx): (r.worst_ratio, r.median_ratio) for r in contrast.span_contrast(*frames, tile=tile).collect()} == ranks


def test_pixels_that_lie_by_page_stay(spark, monkeypatch):
    """With many spans the boxes go to the pages' partitions: same results, and nothing is dealt anew once pixels are made."""
    spans, pixels, pages = picture(5)
    frames = spark.createDataFrame(spans, SPANS), spark.createDataFrame(pixels, "page_id long, x long, y long, r int, g int, b int, a int"), spark.createDataFrame(pages, "page_id long, width long, height long, page_point_width double")
    by_page = frames[0], frames[1].repartition(5, "page_id"), frames[2].withColumn("layer_status", F.expr("if(page_id = 3, 'undecodable', 'ok')"))
    kept = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")

    def rows(f, tables, **more):
        return sorted((tuple(r) for r in f(*tables, tile=16, **more).collect()), key=repr)

    try:
        for f in (contrast.span_pixels, contrast.measure_spans, contrast.measure_pages, contrast.lane_fallback):
            want = rows(f, by_page)
            with monkeypatch.context() as m:
                m.setattr(contrast, "BROADCAST_BOXES", 0)
                assert rows(f, by_page, parts=5) == want != []
                plan = f(*by_page, tile=16, parts=5)._jdf.queryExecution().executedPlan().toString()
            dealt = re.findall(r"(?<!Broadcast)Exchange (\w+\(.*)", plan)
            assert dealt and not any(re.search("tile|span_idx|paint|groupingexpression", d.split("[")[0]) for d in dealt), dealt
            assert "ShuffledHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", kept)
