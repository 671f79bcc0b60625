"""Streams whose state ends, what they give up, and a stored report that survives a repeated batch."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claridoc.operators import ledger, live
from claridoc.streaming import native, stateful, upsert
from claridoc.streaming.runner import drain, stream_of, streaming_session
from tests.test_streams import arrive, collected

START = datetime(2024, 1, 1)
CHUNKS = "doc_id long, chunk_no long, chunk string, last boolean, ts timestamp"


def minutes(n: float) -> datetime:
    return START + timedelta(minutes=n)


def run(stream, folder):
    """Drain a stream and return its rows and the state rows that are left."""
    out, left = [], []
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        left.append(sum(o.numRowsTotal for o in p.stateOperators))
    out = stream.sparkSession.read.parquet(f"{folder}/out")
    return out, left[-1]


def test_documents_leave_no_state_and_lose_nothing(spark):
    folder, place = tempfile.mkdtemp(prefix="claridoc-test-"), tempfile.mkdtemp(prefix="claridoc-test-")
    session = streaming_session(spark)
    runs = [
        [(1, 0, "<p>a</p><p>", False, minutes(0)), (2, 0, "<p>x", False, minutes(1)), (3, 1, "</p>", True, minutes(1)), (4, 0, "<hr>", False, minutes(2))],
        [(1, 1, "b</p>", True, minutes(5)), (3, 2, "<p>late</p>", False, minutes(6))],
        [(9, 0, "<p>z</p>", True, minutes(200))],
        [(8, 0, "<p>w</p>", True, minutes(400))],
    ]
    for rows in runs:  # every run is a restart from the checkpoint
        arrive(spark, folder, "chunks", rows, CHUNKS, 1)
        out, left = run(stateful.ending_chunk_stream(stream_of(session, folder, "chunks", 1), "1 hour", "10 minutes"), place)
    assert left == 0
    want = [(1, 1, "<p>a</p>", None), (1, 2, "<p>b</p>", None), (2, None, "<p>x", -1), (3, None, "</p>", 1), (3, None, "<p>late</p>", 2), (4, 1, "<hr>", None), (9, 1, "<p>z</p>", None), (8, 1, "<p>w</p>", None)]
    assert collected(out) == sorted(want, key=repr)


def test_numbers_and_countdowns_are_forgotten(spark):
    session = streaming_session(spark)
    folder = tempfile.mkdtemp(prefix="claridoc-test-")
    rows = [(1, 1, minutes(0)), (1, 2, minutes(10)), (2, 3, minutes(20)), (3, 4, minutes(5000)), (3, 5, minutes(5001))]
    arrive(spark, folder, "events", rows, "session_id long, event_id long, ts timestamp", 5)
    out, left = run(stateful.sequence_stream(stream_of(session, folder, "events", 1), "1 hour", "10 minutes"), tempfile.mkdtemp(prefix="claridoc-test-"))
    assert collected(out.select("session_id", "event_id", "seq")) == [(1, 1, 1), (1, 2, 2), (2, 3, 1), (3, 4, 1), (3, 5, 2)] and left == 2  # the number and the timer's place of session 3
    folder = tempfile.mkdtemp(prefix="claridoc-test-")
    at = lambda n: int(minutes(n).timestamp() * 1_000_000)
    arrive(spark, folder, "ready", [(1, "f1", at(0), 2), (1, "f1", at(1), 2), (1, "f2", at(2), 2), (2, "f1", at(5000), 1)], "session_id long, fig_id string, at long, pending long", 4)
    out, left = run(stateful.countdown_stream(stream_of(session, folder, "ready", 1), "1 hour", "10 minutes"), tempfile.mkdtemp(prefix="claridoc-test-"))
    assert collected(out) == [(1, "f1", 1, False), (1, "f2", 0, True), (2, "f1", 0, True)] and left == 3


def test_a_closed_gate_keeps_nothing(spark):
    folder = tempfile.mkdtemp(prefix="claridoc-test-")
    rows = [(1, 1, minutes(0), ledger.REQUESTED, False), (1, 2, minutes(1), ledger.APPROVED, False), (2, 3, minutes(2), ledger.REQUESTED, False), (3, 4, minutes(3), ledger.APPROVED, False)]
    arrive(spark, folder, "events", rows, "doc_id long, event_id long, ts timestamp, event string, held boolean", 2)
    out, left = run(stateful.gate_stream(stream_of(streaming_session(spark), folder, "events", 1)), tempfile.mkdtemp(prefix="claridoc-test-"))
    assert [r.outcome for r in out.orderBy("event_id").collect()] == ["pending_review", "finalized", "pending_review", "no open gate"] and left == 1


@pytest.mark.parametrize("files", [1, 4, 9])
def test_ring_replays_like_the_trimmed_log(spark, files):
    r = random.Random(files)
    rows, tops = [], {}
    for at in range(300):
        s = r.choice([1, 1, 1, 2, None])
        tops[s] = tops.get(s, 0) + 1
        rows.append((s, at, False, tops[s], "append", f"<p>{at}</p>"))
    readers = [(s, 1000 + i, True, a, None, None) for i, (s, a) in enumerate([(1, 0), (1, tops[1] - 3), (1, tops[1] + 5), (2, 0), (None, 2), (7, 0)])]
    folder = tempfile.mkdtemp(prefix="claridoc-test-")
    schema = "session_id long, at long, is_reader boolean, no long, type string, html string"
    arrive(spark, folder, "log", rows + readers, schema, files)
    got = spark.read.parquet(drain(stateful.replay_stream(stream_of(streaming_session(spark), folder, "log", 1), 10)))
    events = spark.createDataFrame([(s, n, k, h) for s, _, _, n, k, h in rows if s is not None], "session_id long, seq long, type string, html string")
    resume = spark.createDataFrame([(s, a) for s, _, _, a, _, _ in readers if s is not None], "session_id long, after long")
    kept = live.trim_log(events, 10)
    want = kept.join(resume, "session_id").filter("seq > after").select("session_id", "after", "seq", "type", "html")
    mine = [r for r in collected(got) if r[0] is not None]
    assert mine == collected(want)
    assert {r[2] for r in collected(got) if r[0] is None} == {n for n in range(3, tops[None] + 1) if n >= tops[None] - 10}


def test_silent_domains_come_out_when_their_time_is_over(spark):
    session, place = streaming_session(spark), tempfile.mkdtemp(prefix="claridoc-test-")
    asked, told = tempfile.mkdtemp(prefix="claridoc-test-"), tempfile.mkdtemp(prefix="claridoc-test-")
    schema = "doc_id long, domain string, ts timestamp"
    arrive(spark, asked, "asked", [(1, "a", minutes(0)), (1, "b", minutes(0)), (2, "a", minutes(1))], schema, 1)
    arrive(spark, told, "told", [(1, "a", minutes(3)), (2, "a", minutes(400))], schema, 1)
    build = lambda: native.reported_domains_stream(stream_of(session, asked, "asked", 1), stream_of(session, told, "told", 1), "60 minutes", "5 minutes")
    first, _ = run(build(), place)
    assert [(r.doc_id, r.domain) for r in first.collect()] == [(1, "a")]
    arrive(spark, asked, "asked", [(5, "a", minutes(500))], schema, 1)
    arrive(spark, told, "told", [(5, "a", minutes(510))], schema, 1)
    out, _ = run(build(), place)
    assert collected(out.select("doc_id", "domain", F.col("reported_at").isNull())) == [(1, "a", False), (1, "b", True), (2, "a", True), (5, "a", False)]


def test_a_repeated_batch_changes_nothing(spark):
    schema = "doc_id long, agent string, ts timestamp, event_id long, verdict string"
    r = random.Random(3)
    rows = [(r.randrange(40), r.choice("xy"), minutes(r.randrange(1000)), i, f"v{i}") for i in range(200)] + [(None, "x", minutes(1), 900, "null document")]
    folder = tempfile.mkdtemp(prefix="claridoc-test-") + "/report"
    frames = [spark.createDataFrame(rows[i::3], schema) for i in range(3)]
    plain = collected(ledger.latest_rows(spark.createDataFrame(rows, schema), ["verdict"]))
    read = lambda: upsert.read_report(spark, folder, ledger.latest_rows(frames[0], ["verdict"]).schema)
    assert read().count() == 0
    for number, frame in enumerate(frames):
        upsert.merge_batch(frame, number, folder, ["verdict"], 4)
        once = collected(read())
        upsert.merge_batch(frame, number, folder, ["verdict"], 4)
        assert collected(read()) == once
    assert collected(read()) == plain
    upsert.merge_batch(frames[0].limit(0), 3, folder, ["verdict"], 4)
    assert collected(read()) == plain


def test_sittings(spark):
    rows = [(1, minutes(m)) for m in (0, 10, 35, 100, 110)] + [(2, minutes(5))]
    got = native.session_windows(spark.createDataFrame(rows, "doc_id long, ts timestamp"), "30 minutes").collect()
    assert sorted((r.doc_id, r.start, r.end, r.n) for r in got) == [(1, minutes(0), minutes(65), 3), (1, minutes(100), minutes(140), 2), (2, minutes(5), minutes(35), 1)]
