"""Stream operators that Spark's own aggregations and deduplication express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claridoc.operators.ledger import event_rates


def deliver_once_stream(deliveries: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once per session; repeats are remembered for ``delay``."""
    return deliveries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "seq"])


def event_rates_stream(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events per type and window, once each window is past the watermark."""
    return event_rates(events.withWatermark("ts", delay), width)


def latest_rows_stream(updates: DataFrame, values: list[str]) -> DataFrame:
    """Last update per document and agent, for update-mode sinks."""
    pick = F.max_by(F.struct("ts", "event_id", *values), F.struct("ts", "event_id"))
    return updates.groupBy("doc_id", "agent").agg(pick.alias("p")).select("doc_id", "agent", "p.*")


def reported_domains_stream(dispatched: DataFrame, reported: DataFrame, patience: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Every dispatched domain once with the time it reported, or with none when ``patience`` is over: doc_id, domain, ts, reported_at.

    ``dispatched`` and ``reported``: doc_id, domain, ts. A report answers the dispatch at most ``patience`` before it. An outer join
    of two streams: a domain that keeps silent comes out once the watermark has passed its time, and its state ends there.
    """
    asked = dispatched.select("doc_id", "domain", "ts").withWatermark("ts", delay)
    told = reported.select(F.col("doc_id").alias("d"), F.col("domain").alias("m"), F.col("ts").alias("reported_at")).withWatermark("reported_at", delay)
    on = F.expr(f"doc_id = d and domain = m and reported_at >= ts and reported_at <= ts + interval {patience}")
    return asked.join(told, on, "leftOuter").select("doc_id", "domain", "ts", "reported_at")


def session_windows(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sittings of a review: events of one document no further apart than ``gap``: doc_id, start, end, n. For tables, and for streams with a watermark."""
    return events.groupBy("doc_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
