"""End-to-end plans: facts to criteria to the 55-row rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claridoc.functions.text import wrap_table
from claridoc.operators import contrast, criteria, live, reconcile, remediation, rollup
from claridoc.plans.registry import Data


def contrast_assessments(lane: DataFrame) -> DataFrame:
    """An outside lane table as assessments."""
    proof = F.array(criteria.evidence("measurement", F.col("detail")))
    return lane.select("doc_id", "verdict", "needs_human", proof.alias("evidence"), "rationale", "error")


def audit_results(data: Data) -> DataFrame:
    """doc_id and the six results, one row per document."""
    lanes = reconcile.reconcile(data("validator_lanes"))
    return criteria.audit_array(data("probe_facts"), contrast_assessments(data("contrast_lane")), lanes)


def audit_rows(data: Data) -> DataFrame:
    """The six results as rows."""
    lanes = reconcile.reconcile(data("validator_lanes"))
    return criteria.audit(data("probe_facts"), contrast_assessments(data("contrast_lane")), lanes)


def verdicts(data: Data) -> DataFrame:
    return rollup.sc_verdicts_of(audit_results(data))


def audit_rollup(data: Data) -> DataFrame:
    """The flagship: five counters per document.

    Two shuffles for the lanes; the rollup's group-by then works on rows that already lie together.
    """
    return rollup.rollup_summary(verdicts(data))


def page_assessments(data: Data) -> DataFrame:
    """Pixel measurement to assessment rows, one per page."""
    pages = contrast.lane_fallback(data("text_spans"), data("bg_pixels"), data("page_meta"), parts=data.parts("bg_pixels"))
    return contrast.contrast_verdict(pages).withColumn("borderline", contrast.borderline())


def measured_rollup(data: Data) -> DataFrame:
    """The flagship with the contrast lane measured from pixels instead of supplied."""
    pages = reconcile.assess_contrast(page_assessments(data), data("completion_decisions"))
    lane = pages.select(F.col("page_id").alias("doc_id"), "verdict", "needs_human", "evidence", "rationale")
    lanes = reconcile.assess_validator(data("validator_lanes"))
    results = criteria.audit_array(data("probe_facts"), lane, lanes)
    return rollup.rollup_summary(rollup.sc_verdicts_of(results))


def remediation_report(data: Data) -> DataFrame:
    """Audit, repair status, comparison and gate of the full run, one row per document."""
    rows, second = audit_rows(data), data("second_facts")
    delta = remediation.validation_delta(rows, second, criteria.structure_only(second))
    status = remediation.remediation_status(data("probe_facts"), second)
    gates = criteria.gate_by_mode(criteria.audit_gate(rows), F.lit("full"))
    return gates.join(status.select("doc_id", "status"), "doc_id").join(delta.select("doc_id", "before", "after"), "doc_id")


def live_twin(data: Data) -> DataFrame:
    """Chunks to blocks to events to the rendered page, one row per document."""
    blocks = live.chunk_blocks(data("html_chunks"))
    events = blocks.select(
        F.col("doc_id").alias("session_id"), F.col("block_no").alias("seq"), F.lit("append").alias("type"), F.lit(None).cast("string").alias("target"),
        wrap_table(F.col("html")).alias("html"),
    )
    return live.render_body(live.snapshot(events))
