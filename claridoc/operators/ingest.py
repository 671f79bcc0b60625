"""Admission of addresses, files and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions import urls
from claridoc.functions.text import trimmed
from claridoc.operators import ordered


def url_parts(df: DataFrame) -> DataFrame:
    return df.withColumn("scheme", urls.scheme(F.col("url"))).withColumn("host", urls.host(F.col("url")))


def url_gate(df: DataFrame) -> DataFrame:
    """ok, level and reason per address: the first rule that applies decides."""
    ruled = url_parts(df).withColumn("rule", urls.gate_rule(F.col("scheme"), F.col("host")))
    return ruled.withColumn("gate", urls.gate_answer(F.col("rule"), F.col("host"))).select(*df.columns, "gate.*")


def admit_documents(files: DataFrame, max_bytes: int = fv.LIVE_MAX_BYTES, max_pages: int = fv.GUEST_PAGE_LIMIT) -> DataFrame:
    """Admit or reject files (bytes, content_type, head, page_count); the reason is kept."""
    pages = F.col("page_count")
    is_pdf = F.coalesce(F.lower("content_type").contains("pdf"), F.lit(False)) | F.coalesce(F.col("head") == "%PDF-", F.lit(False))
    reason = (
        F.when(F.col("bytes") > max_bytes, F.lit(f"PDF too large (max {max_bytes} bytes)."))
        .when(~is_pdf, F.lit("That URL did not return a PDF."))
        .when(
            pages > max_pages,
            F.concat(
                F.lit("PDF has "), pages.cast("string"),
                F.lit(f" pages; documents are limited to {max_pages} pages here."),
            ),
        )
    )
    return files.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def positive_number(c: Column) -> Column:
    """A positive finite number from text, else NULL."""
    n = trimmed(c).try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n)


def upload_limit(files: DataFrame, max_bytes: int = fv.UPLOAD_MAX_BYTES) -> DataFrame:
    """Size check of audit uploads; page width becomes a usable number or NULL."""
    reason = F.when(F.col("bytes") > max_bytes, F.lit(f"upload_too_large: max {max_bytes} bytes"))
    return files.withColumn("reason", reason).withColumn("page_point_width", positive_number(F.col("page_point_width")))


def rate_limit(requests: DataFrame, limit: int = 15, seconds: int = 60) -> DataFrame:
    """Accept the first ``limit`` requests per key and fixed window; ``requests``: key, ts, request_id.

    A window is already a slice of a key. Inside it, positions are counted second by second, so one
    busy key and window still spreads over tasks.
    """
    second = F.floor(F.col("ts").cast("timestamp").cast("double")).cast("bigint")
    slot = requests.withColumn("key", F.coalesce("key", F.lit("anon"))).withColumn("slot", F.expr(f"{seconds}") * F.floor(second / seconds))
    placed = ordered.row_number(slot, ["key", "slot"], ["ts", "request_id"], second, "n")
    return placed.withColumn("ok", F.col("n") <= limit)
