"""Hostile input neither ends a job nor slips past a guard; NULL keys stay one key."""

from pyspark.sql import functions as F

from claridoc.functions import urls
from claridoc.operators import ledger, live


def test_numeric_hosts_of_any_length(spark):
    cases = {
        "http://0xffffffffffffffffffff/": None, "http://0777777777777777777777777777/": None, "http://99999999999999999999999999/": None, "http://1.2.3.0xfffffffffffffffffff/": None,
        "http://0x000000000000000000000008080808/": "8.8.8.8", "http://0000000000000000000000010.8.8.8/": "8.8.8.8", "http://0x/": "0.0.0.0", "http://00/": "0.0.0.0", "http://0377.1/": "255.0.0.1",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", urls.host(F.col("url")).alias("host"))
    assert {r.url: r.host for r in df.collect()} == cases
    gated = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("rule", urls.gate_rule(urls.scheme(F.col("url")), urls.host(F.col("url")))).withColumn("shown", urls.redact_url(F.col("url")))
    assert {r.rule for r in gated.collect() if cases[r.url] is None} == {"invalid"}


def test_numbers_stay_finite(spark):
    cases = {"1e400": None, "-1e999": None, "0x" + "f" * 400: None, "0xff": 255.0, "0x" + "0" * 400 + "2A": 42.0, " 12 ": 12.0, "": 0.0, "Infinity": None, "0x": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", live.js_number(F.col("t")).alias("n"), live.resume_point(F.col("t"), F.lit(None).cast("string")).alias("at"))
    got = {r.t: (r.n, r.at) for r in df.collect()}
    assert {t: n for t, (n, _) in got.items()} == cases
    assert got["1e400"][1] == 0 and got["0x" + "f" * 400][1] == 0
    far = spark.createDataFrame([("0x" + "f" * 40,)], "t string").select(live.resume_point(F.col("t"), F.lit("3"))).first()[0]
    assert far == 9 * 10**18


def test_null_key_is_one_document(spark):
    rows = [(None, 0, "<p>a"), (None, 1, "b</p><p>c</p>"), (7, 0, "<p>x</p>"), (7, 1, "<p>y</p>")]
    got = live.chunk_blocks(spark.createDataFrame(rows, "doc_id long, chunk_no long, chunk string")).collect()
    assert sorted(((r.doc_id, r.block_no, r.html) for r in got), key=str) == sorted([(None, 1, "<p>ab</p>"), (None, 2, "<p>c</p>"), (7, 1, "<p>x</p>"), (7, 2, "<p>y</p>")], key=str)
    figures = spark.createDataFrame([(None, "f1", 1, 60), (None, "f2", 2, 60), (1, "f1", 1, 60)], "session_id long, fig_id string, ord long, crop_bytes long")
    assert sorted(((r.session_id, r.fig_id, r.inlined) for r in live.inline_budget(figures, 100).collect()), key=str) == sorted([(None, "f1", True), (None, "f2", False), (1, "f1", True)], key=str)


def test_held_decision_leaves_the_deadline_armed(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", ledger.REQUESTED, False), (1, 2, "2024-01-02 00:00:00", ledger.APPROVED, True)]
    df = spark.createDataFrame(rows, "doc_id long, event_id long, ts string, event string, held boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    assert ledger.review_sla(df).first().outcome == "elapsed"


def test_feed_shows_every_event(spark):
    df = spark.range(80).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 1000).alias("ts"), F.lit("human.approved").alias("event"))
    got = ledger.event_feed(df).collect()
    assert len(got) == 80 and {(r.doc_id, r.rank) for r in got} == {(d, n) for d in (0, 1) for n in range(1, 41)}
    assert max(got, key=lambda r: r.event_id).rank == 1


def test_chunking_does_not_change_the_blocks_of_real_pages(spark):
    from claridoc.plans.queries_live import page_blocks
    from claridoc.plans.registry import Data

    whole, chunked = page_blocks(Data(spark, "/root/testdata/sf0.001"))
    assert chunked.count() == whole.count() and chunked.exceptAll(whole).count() == 0
