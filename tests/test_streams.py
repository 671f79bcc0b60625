"""Stream forms over several micro-batches and restarts equal the batch forms."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claridoc.functions.blocks import all_blocks
from claridoc.operators import ledger, live
from claridoc.streaming import native, stateful
from claridoc.streaming.runner import drain, stream_of, streaming_session
from tests.test_brute_force import EVENTS, live_events

START = datetime(2024, 1, 1)


def arrive(spark, folder, name, rows, schema, files):
    """Store rows in order, as files of increasing time."""
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def collected(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


def test_snapshot_over_batches(spark):
    folder, events = tempfile.mkdtemp(prefix="claridoc-test-"), live_events(21)
    session = streaming_session(spark)
    arrive(spark, folder, "events", events, EVENTS, 4)
    changes = spark.read.parquet(drain(stateful.snapshot_stream(stream_of(session, folder, "events", 1))))
    batch = live.snapshot(spark.createDataFrame(events, EVENTS))
    assert collected(stateful.fold_changes(changes).select(batch.columns)) == collected(batch)


def test_chunks_out_of_order(spark):
    folder = tempfile.mkdtemp(prefix="claridoc-test-")
    text = "<h1>A</h1> loose <ul><li>a</li></ul><hr/><p>end</p> tail"
    pieces = [(d, i, text[i * 5 : i * 5 + 5], i * 5 + 5 >= len(text)) for d in range(3) for i in range(-(-len(text) // 5))]
    pieces.sort(key=lambda p: (p[1] * 7) % 11)
    arrive(spark, folder, "chunks", pieces, "doc_id long, chunk_no long, chunk string, last boolean", 3)
    out = spark.read.parquet(drain(stateful.chunk_stream(stream_of(streaming_session(spark), folder, "chunks", 1))))
    assert collected(out.select("doc_id", "block_no", "html")) == sorted([(d, i, b) for d in range(3) for i, b in enumerate(all_blocks(text), 1)], key=repr)


def test_deadline_fires_once_over_restarts(spark):
    folder, place = tempfile.mkdtemp(prefix="claridoc-test-"), tempfile.mkdtemp(prefix="claridoc-test-")
    session = streaming_session(spark)
    schema = "doc_id long, event_id long, ts timestamp, event string, held boolean"
    day = lambda n: START + timedelta(days=n)
    runs = [
        [(1, 1, day(0), ledger.REQUESTED, False), (2, 2, day(0), ledger.REQUESTED, False), (3, 3, day(1), ledger.REQUESTED, False)],
        [(2, 4, day(3), ledger.APPROVED, False), (3, 5, day(4), ledger.REQUESTED, False)],
        [(9, 6, day(9), ledger.REQUESTED, False), (3, 8, day(10), ledger.APPROVED, True)],
        [(9, 7, day(13), ledger.REJECTED, False)],
    ]
    seen = []
    for rows in runs:
        arrive(spark, folder, "events", rows, schema, 1)
        out = drain(stateful.sla_stream(stream_of(session, folder, "events", 1)), place)
        seen.append({(r.event_id, r.outcome) for r in spark.read.schema("event_id long, outcome string").parquet(out).collect()})
    assert seen[0] == set() and seen[1] == {(2, "decided"), (3, "superseded")}
    assert seen[2] == seen[1] | {(1, "elapsed")}
    assert seen[3] == seen[2] | {(5, "elapsed"), (6, "decided")}
    assert spark.read.parquet(out).count() == 5


def test_late_events_do_not_reopen(spark):
    """A decision behind the watermark is dropped: the deadline already spoke."""
    folder, place = tempfile.mkdtemp(prefix="claridoc-test-"), tempfile.mkdtemp(prefix="claridoc-test-")
    schema = "doc_id long, event_id long, ts timestamp, event string, held boolean"
    rows = [[(1, 1, START, ledger.REQUESTED, False)], [(8, 2, START + timedelta(days=20), ledger.REQUESTED, False)], [(1, 3, START + timedelta(days=2), ledger.APPROVED, False)]]
    for batch in rows:
        arrive(spark, folder, "events", batch, schema, 1)
        out = drain(stateful.sla_stream(stream_of(streaming_session(spark), folder, "events", 1)), place)
    assert {(r.event_id, r.outcome) for r in spark.read.parquet(out).collect()} == {(1, "elapsed")}


def test_rate_limit_and_numbers_over_batches(spark):
    folder = tempfile.mkdtemp(prefix="claridoc-test-")
    rows = [(i, "k" if i % 3 else None, START + timedelta(seconds=7 * i)) for i in range(90)]
    arrive(spark, folder, "requests", rows, "request_id long, key string, ts timestamp", 3)
    session = streaming_session(spark)
    out = spark.read.parquet(drain(stateful.rate_limit_stream(stream_of(session, folder, "requests", 1), 3, 60)))
    from claridoc.operators.ingest import rate_limit

    batch = rate_limit(spark.createDataFrame(rows, "request_id long, key string, ts timestamp"), 3, 60)
    columns = ["request_id", "key", "slot", "n", "ok"]
    assert collected(out.select(columns)) == collected(batch.select(columns))
    numbered = spark.read.parquet(drain(stateful.sequence_stream(stream_of(session, folder, "requests", 1).select(F.lit(1).cast("long").alias("session_id"), F.col("request_id").alias("event_id"), "ts"))))
    assert [r.seq for r in numbered.orderBy("event_id").collect()] == list(range(1, 91))


def test_latest_rows_in_update_mode(spark):
    folder = tempfile.mkdtemp(prefix="claridoc-test-")
    rows = [(i % 4, "wcag", START + timedelta(minutes=(i * 37) % 50), i, f"v{i}") for i in range(40)]
    schema = "doc_id long, agent string, ts timestamp, event_id long, verdict string"
    arrive(spark, folder, "updates", rows, schema, 3)
    stream = native.latest_rows_stream(stream_of(spark, folder, "updates", 1), ["verdict"])
    run = stream.writeStream.format("memory").queryName("latest_updates").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    ends = spark.table("latest_updates").groupBy("doc_id").agg(F.max_by("verdict", F.struct("ts", "event_id")).alias("v"))
    batch = ledger.latest_rows(spark.createDataFrame(rows, schema), ["verdict"])
    assert {r.doc_id: r.v for r in ends.collect()} == {r.doc_id: r.verdict for r in batch.collect()}


@pytest.mark.parametrize("files", [1, 3])
def test_deliver_once(spark, files):
    folder = tempfile.mkdtemp(prefix="claridoc-test-")
    rows = [(s, q, START + timedelta(seconds=q)) for s in range(3) for q in range(30) for _ in range(1 + (q % 2))]
    arrive(spark, folder, "deliveries", rows, "session_id long, seq long, ts timestamp", files)
    out = spark.read.parquet(drain(native.deliver_once_stream(stream_of(streaming_session(spark), folder, "deliveries", 1))))
    assert collected(out.select("session_id", "seq")) == sorted({(r[0], r[1]) for r in rows}, key=repr)


def test_documents_share_a_shelf(spark, monkeypatch):
    """All keys in one group, one of them null: batches that touch some of them leave the waiting chunks of the others as they are."""
    monkeypatch.setattr(stateful, "SHELVES", 1)
    session = streaming_session(spark)
    folder = tempfile.mkdtemp(prefix="claridoc-test-")
    big = 2**60 + 1
    batches = [
        [(1, 1, "b</p>", True), (2, 0, "<p>x</p><p>", False), (big, 0, "<p>z", False), (None, 0, "<p>n", False)],
        [(2, 1, "y</p>", True), (None, 1, "</p>", True)],
        [(1, 0, "<p>a", False), (big, 1, "</p>", True)],
    ]
    for rows in batches:
        arrive(spark, folder, "chunks", rows, "doc_id long, chunk_no long, chunk string, last boolean", 1)
    out = spark.read.parquet(drain(stateful.chunk_stream(stream_of(session, folder, "chunks", 1))))
    want = [(1, 1, "<p>ab</p>"), (2, 1, "<p>x</p>"), (2, 2, "<p>y</p>"), (big, 1, "<p>z</p>"), (None, 1, "<p>n</p>")]
    assert collected(out) == sorted(want, key=repr)


def test_a_group_holds_many_keys(spark):
    """Calls for state follow the shelves, not the keys: these streams group by the shelf."""
    frame = spark.createDataFrame([], "session_id long, fig_id string, at long, pending long")
    gate = spark.createDataFrame([], "doc_id long, event_id long, ts timestamp, event string, held boolean")
    chunks = spark.createDataFrame([], "doc_id long, chunk_no long, chunk string, last boolean, ts timestamp")
    requests = spark.createDataFrame([], "key string, ts timestamp, request_id long")
    for made in (stateful.countdown_stream(frame), stateful.gate_stream(gate), stateful.sla_stream(gate), stateful.chunk_stream(chunks), stateful.ending_chunk_stream(chunks), stateful.rate_limit_stream(requests)):
        assert "shelf" in made._jdf.queryExecution().analyzed().toString()


def test_a_null_beside_numbers_on_a_shelf(spark, monkeypatch):
    """Rows without a time come last, and leave the order of the others on their shelf alone."""
    monkeypatch.setattr(stateful, "SHELVES", 1)
    folder = tempfile.mkdtemp(prefix="claridoc-test-")
    rows = [(1, 5, None, ledger.APPROVED, False), (1, 7, START, ledger.REQUESTED, False), (2, 8, START, ledger.APPROVED, None), (2, 9, START + timedelta(hours=1), ledger.REQUESTED, None), (3, 4, None, ledger.REQUESTED, True)]
    arrive(spark, folder, "events", rows, "doc_id long, event_id long, ts timestamp, event string, held boolean", 1)
    out = spark.read.parquet(drain(stateful.gate_stream(stream_of(streaming_session(spark), folder, "events"))))
    want = [(1, 5, "finalized"), (1, 7, "pending_review"), (2, 8, "no open gate"), (2, 9, "pending_review"), (3, 4, "pending_review")]
    assert collected(out.select("doc_id", "event_id", "outcome")) == want
