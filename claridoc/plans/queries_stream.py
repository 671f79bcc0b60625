"""Registered queries: the stream forms, run to the end over the stored tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claridoc.operators import live
from claridoc.plans.registry import Data, query
from claridoc.streaming import native, stateful, upsert
from claridoc.streaming.runner import drain, shared_folder, stream_of, streaming_session


def _run(data: Data, name: str, build) -> DataFrame:
    """Stream one stored table through ``build`` and read the result."""
    session = streaming_session(data.spark)
    return data.spark.read.parquet(drain(build(stream_of(session, data.folder, name))))


def _run_view(data: Data, name: str, build, files: int = 3) -> DataFrame:
    """The same for a derived view: it is stored first, as several files that arrive one by one."""
    session = streaming_session(data.spark)
    place = shared_folder(data.spark)
    frame = data(name)
    frame.repartition(files).write.parquet(f"{place}/{name}.parquet")
    return data.spark.read.parquet(drain(build(stream_of(session, place, name, 1))))


def _instant(c: str = "ts"):
    return F.col(c).cast("timestamp")


_MICROS_TO_TS = F.timestamp_micros


def review_stream(events: DataFrame) -> DataFrame:
    """The review events view, as columns of the streamed table."""
    kind = (
        F.when(F.col("event_type") == "signup", "human.review.requested").when(F.col("event_type") == "purchase", "human.approved")
        .when(F.col("event_type") == "error", "human.rejected").when(F.col("event_type") == "view", "routine.started").otherwise("routine.done")
    )
    return events.select(
        (F.col("user_id") * 20 + F.col("event_id") % 20).alias("doc_id"), "event_id", _instant().alias("ts"), kind.alias("event"), (F.col("event_id") % 9 == 0).alias("held")
    )


query(
    "s1_sequence_stream",
    lambda d: _run(d, "events", lambda s: stateful.sequence_stream(s.select(F.col("user_id").alias("session_id"), "event_id", "ts"))).select("session_id", "event_id", "seq"),
    "SELECT session_id, event_id, seq FROM numbered_events",
)
query(
    "s2_snapshot_stream",
    lambda d: stateful.fold_changes(_run_view(d, "doc_events", stateful.snapshot_stream, files=1)),
    "SELECT session_id, ord, block_id, html FROM c_snapshot",
)
query(
    "s5_deliver_once_stream",
    lambda d: _run(d, "events", lambda s: native.deliver_once_stream(
        s.select(F.col("user_id").alias("session_id"), F.floor(F.col("event_id") / 2).alias("seq"), _instant().alias("ts"))
    )).select("session_id", "seq"),
    "SELECT DISTINCT user_id AS session_id, event_id // 2 AS seq FROM events",
)
query(
    "s9_figure_countdown_stream",
    lambda d: _run(d, "lineitem", lambda s: stateful.countdown_stream(s.select(
        F.col("l_orderkey").alias("session_id"), F.concat(F.lit("blk-"), F.col("l_linenumber").cast("string")).alias("fig_id"),
        F.unix_micros(_instant("l_shipdate")).alias("at"), F.lit(4).cast("bigint").alias("pending"),
    ))).groupBy("session_id").agg(F.count("*").alias("n_ready"), F.min("remaining").alias("remaining"), F.bool_or("finished").alias("finished")),
    """SELECT l_orderkey AS session_id, COUNT(DISTINCT l_linenumber) AS n_ready, GREATEST(0, 4 - COUNT(DISTINCT l_linenumber)) AS remaining, COUNT(DISTINCT l_linenumber) >= 4 AS finished
       FROM lineitem GROUP BY l_orderkey""",
)


def _chunks(stream: DataFrame) -> DataFrame:
    return stream.withColumn("last", F.length("chunk") < 40)


query(
    "s10_chunk_stream",
    lambda d: _run_view(d, "html_chunks", lambda s: stateful.chunk_stream(_chunks(s))),
    "SELECT doc_id, block_no, html FROM c_blocks",
)
query(
    "l4_gate_stream",
    lambda d: _run(d, "events", lambda s: stateful.gate_stream(review_stream(s))),
    "SELECT doc_id, event_id, event, outcome FROM c_fsm",
)
query(
    "l6_sla_stream",
    lambda d: _run(d, "events", lambda s: stateful.sla_stream(review_stream(s))).select("doc_id", "event_id", "outcome"),
    """SELECT doc_id, event_id, CASE WHEN nts <= ts + INTERVAL 7 DAY THEN CASE WHEN nev = 'human.review.requested' THEN 'superseded' ELSE 'decided' END ELSE 'elapsed' END AS outcome
       FROM (SELECT *, LEAD(ts) OVER w AS nts, LEAD(event) OVER w AS nev FROM review_events WHERE event LIKE 'human.%' AND (event = 'human.review.requested' OR NOT held) WINDOW w AS (PARTITION BY doc_id ORDER BY ts, event_id)) x
       WHERE event = 'human.review.requested' AND (nts IS NOT NULL OR ts + INTERVAL 7 DAY < (SELECT MAX(ts) - INTERVAL 1 DAY FROM review_events WHERE event LIKE 'human.%'))""",
)
query(
    "i7_rate_limit_stream",
    lambda d: _run(d, "events", lambda s: stateful.rate_limit_stream(s.select(
        F.when(F.col("event_type") == "error", None).otherwise(F.col("user_id").cast("string")).alias("key"), _instant().alias("ts"), F.col("event_id").alias("request_id")
    ), 1, 3600)),
    """SELECT request_id, key, slot, n, n <= 1 AS ok FROM (SELECT request_id, key, slot, ROW_NUMBER() OVER (PARTITION BY key, slot ORDER BY ts, request_id) AS n FROM (
         SELECT event_id AS request_id, ts, CASE WHEN event_type = 'error' THEN 'anon' ELSE CAST(user_id AS VARCHAR) END AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS slot FROM events) a) b""",
)
query(
    "l16_event_rates_stream",
    lambda d: _run(d, "events", lambda s: native.event_rates_stream(review_stream(s), "6 hours")).withColumn("start", F.col("start").cast("timestamp_ntz")),
    """SELECT start, event, n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event, COUNT(*) AS n FROM review_events GROUP BY ALL) w
       WHERE start + INTERVAL 6 HOUR <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM review_events)""",
)
query(
    "i10_write_report",
    lambda d: _written(d),
    "SELECT doc_id, lang, source, n_chars FROM documents",
)


def _written(d: Data) -> DataFrame:
    from claridoc.sources.tables import write_report

    place = f"{shared_folder(d.spark)}/report"
    write_report(d("documents").select("doc_id", "lang", "source", "n_chars"), place, ["lang"])
    return d.spark.read.parquet(place).select("doc_id", "lang", "source", "n_chars")


query(
    "s8_session_status_from_stream",
    lambda d: live.session_status(_run_view(d, "session_log", lambda s: native.deliver_once_stream(s.withColumn("ts", _instant()), "400 days"))),
    """SELECT session_id, MAX(seq) AS seq, arg_max(phase, seq) FILTER (WHERE type = 'progress' AND phase <> '') AS phase,
              CASE WHEN bool_or(type = 'error') THEN 'error' WHEN bool_or(type = 'done') THEN 'done' ELSE 'running' END AS status FROM session_log GROUP BY session_id""",
)


def _ending_chunks(d: Data) -> DataFrame:
    """Streamed chunks at one document an hour; of every fifth document the first number never comes."""
    session, place = streaming_session(d.spark), shared_folder(d.spark)
    late = F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    rows = _chunks(d("html_chunks")).withColumn("ts", F.timestamp_seconds(86_400 + F.col("doc_id") * 3600 + F.col("chunk_no"))).withColumn("chunk_no", F.col("chunk_no") + late)
    rows.coalesce(1).write.parquet(f"{place}/chunks.parquet")
    return d.spark.read.parquet(drain(stateful.ending_chunk_stream(stream_of(session, place, "chunks"), "1 hour", "30 minutes")))


query(
    "s10_ending_chunks_stream",
    _ending_chunks,
    """SELECT doc_id, block_no, html, NULL::BIGINT AS given_up FROM c_blocks WHERE doc_id % 5 <> 0
       UNION ALL SELECT doc_id, NULL, chunk, chunk_no + 1 FROM (SELECT *, MAX(chunk_no) OVER (PARTITION BY doc_id) AS upto FROM html_chunks) h
       WHERE doc_id % 5 = 0 AND doc_id * 3600 + upto + 3600 < (SELECT MAX(doc_id * 3600 + chunk_no) FROM html_chunks) - 1800""",
)


def _replayed(d: Data) -> DataFrame:
    """Events of the live documents, then their readers, in files of their own."""
    from claridoc.plans.queries_live import readers

    session, place = streaming_session(d.spark), shared_folder(d.spark)
    last = F.lit(1 << 60)
    events = d("doc_events").select("session_id", F.unix_micros(_instant()).alias("at"), F.lit(False).alias("is_reader"), F.col("seq").cast("bigint").alias("no"), "type", "html")
    came = readers(d).select("session_id", last.alias("at"), F.lit(True).alias("is_reader"), F.col("after").alias("no"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("html"))
    for part in (events, came):
        part.coalesce(1).write.mode("append").parquet(f"{place}/log.parquet")
    return d.spark.read.parquet(drain(stateful.replay_stream(stream_of(session, place, "log", 1), 20)))


query(
    "s3_replay_stream",
    lambda d: _replayed(d).select("session_id", "after", "seq", "type", "html"),
    """SELECT e.session_id, CAST(after AS BIGINT) AS after, seq, type, html FROM (SELECT *, MAX(seq) OVER (PARTITION BY session_id) AS m FROM doc_events) e
       JOIN c_readers r ON e.session_id = r.session_id WHERE seq > after AND (m <= 20 OR seq >= m - 20)""",
)


def _upserted(d: Data) -> DataFrame:
    """Runs as they arrive, merged into a stored report."""
    session, place = streaming_session(d.spark), shared_folder(d.spark)
    rows = d("runs").select("doc_id", "agent", "ts", "event_id", "verdict", "run")
    rows.repartition(3).write.parquet(f"{place}/runs.parquet")
    report = upsert.upsert_stream(stream_of(session, place, "runs", 1), ["verdict", "run"], f"{place}/kept", 8)
    return upsert.read_report(d.spark, report, rows.schema)


query(
    "l2_latest_rows_upsert",
    _upserted,
    "SELECT doc_id, agent, ts, event_id, verdict, run FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, agent ORDER BY ts DESC, event_id DESC) AS rn FROM runs) r WHERE rn = 1",
)


def _reported(d: Data) -> DataFrame:
    """Sign-ups as reports, every other event as a dispatch."""
    session = streaming_session(d.spark)

    def half(reports: bool) -> DataFrame:
        domain = F.when(F.col("event_id") % 2 == 0, "validator").otherwise("contrast-service")
        return stream_of(session, d.folder, "events").filter((F.col("event_type") == "signup") == F.lit(reports)).select(F.col("user_id").alias("doc_id"), domain.alias("domain"), _instant().alias("ts"))

    out = d.spark.read.parquet(drain(native.reported_domains_stream(half(False), half(True), "2 days", "1 hour")))
    return out.select("doc_id", "domain", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("ts", "reported_at")])


query(
    "l7_reported_domains_stream",
    _reported,
    """WITH e AS (SELECT user_id AS doc_id, CASE event_id % 2 WHEN 0 THEN 'validator' ELSE 'contrast-service' END AS domain, ts, event_type = 'signup' AS told FROM events),
       m AS (SELECT a.doc_id, a.domain, a.ts, r.ts AS reported_at FROM e a LEFT JOIN e r ON r.told AND r.doc_id = a.doc_id AND r.domain = a.domain AND r.ts BETWEEN a.ts AND a.ts + INTERVAL 2 DAY WHERE NOT a.told)
       SELECT doc_id, domain, ts, reported_at FROM m
       WHERE reported_at IS NOT NULL OR ts + INTERVAL 2 DAY < (SELECT LEAST(MAX(ts) FILTER (told), MAX(ts) FILTER (NOT told)) - INTERVAL 1 HOUR FROM e)""",
)

_SITTINGS = """SELECT doc_id, MIN(ts) AS start, MAX(ts) + INTERVAL 21601 SECOND AS "end", COUNT(*) AS n FROM (
         SELECT *, SUM(CASE WHEN ts - prev < INTERVAL 21601 SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS no
         FROM (SELECT doc_id, ts, event_id, LAG(ts) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS prev FROM review_events) a) b GROUP BY doc_id, no"""


def _plain_times(windows: DataFrame) -> DataFrame:
    return windows.select("doc_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


query("l16_sittings", lambda d: _plain_times(native.session_windows(d("review_events").withColumn("ts", _instant()), "21601 seconds")), _SITTINGS)
query(
    "l16_sittings_stream",
    lambda d: _plain_times(_run(d, "events", lambda s: native.session_windows(review_stream(s).withWatermark("ts", "1 day"), "21601 seconds"))),
    f"""SELECT * FROM ({_SITTINGS}) s WHERE "end" <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM review_events)""",
)
