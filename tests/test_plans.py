"""Shape of the physical plans: no nested loops, narrow scans, no Python where columns do."""

import re

import pytest

from claridoc.plans import catalog
from claridoc.plans.registry import Data
from claridoc.operators import contrast, ledger

FOLDER = "/root/testdata/sf0.001"
EAGER = [n for n in catalog.queries() if "stream" in n or n.startswith("i10") or n == "l2_latest_rows_upsert"]
PYTHON = {"f2_short_hash", "f3_block_id", "f7_safe_filename", "s19_inline_budget"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in EAGER])
def test_no_nested_loops_and_little_python(spark, name):
    plan = plan_of(catalog.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert bool(re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas", plan)) == (name in PYTHON)


def test_scans_read_only_what_is_used(spark):
    from claridoc.sources.tables import read_source

    plan = plan_of(read_source(spark, FOLDER, "documents").select("doc_id", "lang", "source", "n_chars").filter("n_chars > 1000"))
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,1000)]" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"doc_id", "lang", "source", "n_chars"}
    facts = plan_of(catalog.queries()["r5_rollup_summary"](spark, FOLDER))
    assert "text:string" not in facts


def test_rollup_shuffles_only_the_lanes(spark):
    """Facts to 55 criteria to counters: joins and group-by on the same key, the explode stays narrow."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(catalog.queries()["r5_rollup_summary"](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(doc_id") + plan.count("Exchange hashpartitioning(lane_doc") <= 8
    assert "BroadcastHashJoin" in plan  # the 55 fixed rows, by hint


def test_pixels_are_never_broadcast(spark, monkeypatch):
    """A counted number of boxes goes to the pixels; beyond it both sides are dealt."""
    d = Data(spark, FOLDER)
    measured = lambda: plan_of(contrast.measure_pages(d("text_spans"), d("bg_pixels"), d("page_meta")))
    kind = re.compile(r"(\w+Join) \[page_id#\w+, tile#\w+\], \[page_id#\w+, tile#\w+\], Inner(?:, (\w+))?")
    assert kind.search(measured()).groups() == ("BroadcastHashJoin", "BuildRight")
    monkeypatch.setattr(contrast, "BROADCAST_BOXES", 0)
    assert kind.search(measured()).group(1) == "SortMergeJoin"


def test_top_lists_are_limited_before_the_shuffle(spark):
    plan = plan_of(ledger.newest_events(Data(spark, FOLDER)("review_events"), 5))
    assert plan.count("WindowGroupLimit") == 2


def test_hash_key_is_split_by_time(spark):
    plan = plan_of(catalog.queries()["l1_ledger"](spark, FOLDER))
    assert re.search(r"hashpartitioning\(__key#\w+, __bucket#\w+", plan)


def test_a_hot_page_is_split(spark, monkeypatch):
    """A page that holds most spans: adaptive execution splits its partition in the pixel join."""
    monkeypatch.setattr(contrast, "BROADCAST_BOXES", 0)
    spans = spark.range(60000).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 0 ELSE id END AS page_id", "id AS span_idx", "'t' AS text", "concat('#', lpad(cast(id % 1000000 AS string), 6, '0')) AS color",
        "cast(id % 5 AS double) AS x", "1.0D AS y", "1.0D AS width", "1.0D AS height", "10.0D AS font_size_px", "false AS bold",
    )
    pages = spark.range(60000).selectExpr("id AS page_id", "8L AS width", "8L AS height", "cast(null AS double) AS page_point_width")
    pixels = spark.range(60000 * 4).selectExpr("id div 4 AS page_id", "id % 4 AS x", "1L AS y", "1 AS r", "2 AS g", "3 AS b", "255 AS a")
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        counted = contrast.span_pixels(spans, pixels, pages)
        rows = counted.collect()
        plan = plan_of(counted)
    finally:
        for k in small:
            spark.conf.unset(k)
    assert "SortMergeJoin(skew=true)" in plan.split("Initial Plan")[0]
    assert sum(r.n for r in rows) == sum(1 for i in range(60000) if i % 5 < 4)
