"""Two validator lanes: their verdicts, the reconciled assessment and the specialist protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions.text import number_text, trimmed, truthy
from claridoc.operators.criteria import evidence

LANES = (("verapdf", "veraPDF"), ("pac", "PAC"))
LANE_COLUMNS = ["available", "pass", "n_failures", "gate", "tagged", "n_error"]


def lane_pass() -> Column:
    """What one lane says; NULL when it did not run or says nothing. The first answer wins, even a no."""
    return (
        F.when(~F.col("available"), F.lit(None).cast("boolean"))
        .when(F.col("pass").isNotNull(), F.col("pass"))
        .when(F.col("n_failures").isNotNull(), F.col("n_failures") == 0)
        .when(truthy(F.col("gate")).isNotNull(), F.col("gate") == "finalized")
        .when(F.col("tagged").isNotNull(), F.col("tagged") & (F.coalesce("n_error", F.lit(0)) == 0))
    )


def lane_state() -> Column:
    """How a question to a person names the lane."""
    return (
        F.when(~F.col("available"), "unavailable")
        .when(F.col("pass").isNotNull(), F.when(F.col("pass"), "pass").otherwise("fail"))
        .otherwise(F.coalesce("gate", F.lit("ran")))
    )


def lanes_by_document(lanes: DataFrame) -> DataFrame:
    """One row per document with each lane's verdict and state; a lane without a row stays NULL.

    A pivot by partial aggregation: one shuffle of at most two short rows per document and task.
    """
    said = lanes.select("doc_id", "lane", lane_pass().alias("ok"), lane_state().alias("state"))
    aggs = []
    for lane, _ in LANES:
        mine = F.col("lane") == lane
        aggs.append(F.bool_and(F.when(mine, F.col("ok"))).alias(f"{lane}_pass"))
        aggs.append(F.min(F.when(mine, F.col("state"))).alias(f"{lane}_state"))
    return said.groupBy("doc_id").agg(*aggs)


def _reconciled(wide: DataFrame) -> DataFrame:
    a, b = F.col("verapdf_pass"), F.col("pac_pass")
    only = F.coalesce(a, b)
    single = a.isNull() | b.isNull()
    agree = a == b
    word = F.when(only, "passed").otherwise("failed")
    text = {k: F.lit(v) for k, v in fv.RECONCILE_TEXT.items()}

    def said(label: str, ok: Column) -> Column:
        state = F.when(ok.isNull(), "unavailable").when(ok, "pass").otherwise("fail")
        return evidence("validator", F.concat(F.lit(f"{label} lane: "), state))

    human = single | ~agree
    return wide.select(
        "*",
        F.lit("validator").alias("agent"),
        F.array(F.lit("PDF/UA-1"), F.lit("WCAG")).alias("standard_refs"),
        F.when(human, "input_required").otherwise("completed").alias("state"),
        F.when(only.isNull(), "cannot_tell").when(single | agree, word).otherwise("cannot_tell").alias("verdict"),
        F.when(only.isNull(), 0.0).when(single, 0.5).when(agree, 0.95).otherwise(0.3).alias("confidence"),
        human.alias("needs_human"),
        F.array(*[said(label, F.col(f"{lane}_pass")) for lane, label in LANES]).alias("evidence"),
        F.when(single, text["single"]).when(agree & a, text["both_pass"]).when(agree, text["both_fail"])
        .otherwise(text["disagree"]).alias("rationale"),
    )


ASSESSMENT = ["agent", "standard_refs", "state", "verdict", "confidence", "needs_human", "evidence", "rationale"]


def reconcile(lanes: DataFrame) -> DataFrame:
    """One assessment per document: agreement settles, a single or split opinion goes to a person."""
    return _reconciled(lanes_by_document(lanes)).select("doc_id", *ASSESSMENT)


def _question(rationale: Column) -> Column:
    state = {lane: F.coalesce(F.col(f"{lane}_state"), F.lit("unavailable")) for lane, _ in LANES}
    return F.concat(
        F.lit("Validator reconciliation needs human sign-off (veraPDF lane: "), state["verapdf"],
        F.lit(", PAC lane: "), state["pac"], F.lit("). "), rationale,
    )


def reconcile_question(lanes: DataFrame) -> DataFrame:
    """The question for every document that needs a person, naming both lanes."""
    rows = _reconciled(lanes_by_document(lanes)).filter(F.col("needs_human"))
    return rows.select("doc_id", _question(F.col("rationale")).alias("rationale"))


def settle_validator() -> Column:
    return ~F.col("needs_human")


def settle_contrast() -> Column:
    return ~F.col("borderline")


def stamp(rows: DataFrame, domain: str, standard_refs: list[str]) -> DataFrame:
    """Overwrite who speaks and which rules it speaks to."""
    return rows.withColumn("agent", F.lit(domain)).withColumn("standard_refs", F.array(*[F.lit(x) for x in standard_refs]))


def authority_guard(rows: DataFrame) -> DataFrame:
    """Nothing but a measured pass may lose its human gate.

    Input carries the measured verdict as ``measured_verdict`` beside the decided columns.
    """
    forced = (F.col("measured_verdict") != "passed") & ~F.col("needs_human")
    note = F.concat(
        F.col("rationale"), F.lit(" (base guard: deterministic verdict '"), F.col("measured_verdict"),
        F.lit("' is not a clean pass — LLM cannot clear the human gate; escalated.)"),
    )
    return (
        rows.withColumn("rationale", F.when(forced, trimmed(note)).otherwise(F.col("rationale")))
        .withColumn("state", F.when(forced, "input_required").otherwise(F.col("state")))
        .withColumn("needs_human", F.col("needs_human") | forced)
    )


def apply_completion(rows: DataFrame, decisions: DataFrame, key: str = "page_id") -> DataFrame:
    """Apply an externally made decision table to borderline contrast rows.

    ``rows`` needs verdict, needs_human, state, rationale, approximated, n_spans, worst_text,
    worst_ratio, worst_threshold. Only an accepted, fully measured pass may go without a person.
    """
    given = decisions.select(key, "action", "human_question", "error", F.lit(True).alias("decided"))
    joined = rows.join(given, key, "left")
    acceptable = (F.col("verdict") == "passed") & ~F.col("approximated") & (F.col("n_spans") > 0)
    accept = F.col("action") == "accept"
    default_question = F.when(
        F.col("worst_text").isNotNull(),
        F.concat(
            F.lit('Confirm the contrast of "'), F.col("worst_text"), F.lit('" ('), number_text(F.col("worst_ratio")),
            F.lit(":1, needs "), number_text(F.col("worst_threshold")), F.lit(":1)."),
        ),
    ).otherwise(F.lit("Confirm the borderline contrast measurement."))
    question = F.coalesce(truthy(F.col("human_question")), default_question)
    flag = F.when(F.col("approximated"), "true").otherwise("false")
    note = (
        F.when(F.col("decided").isNull(), F.lit("No decision given → escalated for human review."))
        .when(F.col("error").isNotNull(), F.concat(F.lit("LLM-decide error ("), F.col("error"), F.lit(") → escalated.")))
        .when(accept & acceptable, F.lit("(LLM-decide: accepted machine pre-assessment.)"))
        .when(
            accept,
            F.concat(
                F.lit("LLM-decide returned accept on a non-pass/approximate measurement (verdict="), F.col("verdict"),
                F.lit(", approximated="), flag, F.lit(") → escalated (deterministic verdict authoritative)."),
            ),
        )
        .otherwise(F.concat(F.lit("(LLM-decide: escalate — "), question, F.lit(")")))
    )
    cleared = F.coalesce(F.col("decided") & F.col("error").isNull() & accept & acceptable, F.lit(False))
    return (
        joined.withColumn("rationale", F.concat_ws(" ", "rationale", note))
        .withColumn("state", F.when(cleared, "completed").otherwise("input_required"))
        .withColumn("needs_human", ~cleared)
        .drop("action", "human_question", "error", "decided")
    )


def assess_validator(lanes: DataFrame) -> DataFrame:
    """Settled rows as they are, the others with a question; then guarded and stamped."""
    rows = _reconciled(lanes_by_document(lanes)).withColumn("measured_verdict", F.col("verdict"))
    asked = rows.withColumn("rationale", F.when(settle_validator(), F.col("rationale")).otherwise(_question(F.col("rationale"))))
    guarded = rows_guarded_unless(asked, settle_validator())
    return stamp(guarded, "validator", ["PDF/UA-1", "WCAG"]).select("doc_id", *ASSESSMENT)


def rows_guarded_unless(rows: DataFrame, settled: Column) -> DataFrame:
    """The guard binds only rows that went through a decision."""
    kept = rows.withColumn("__settled", settled)
    guarded = authority_guard(kept.withColumn("__m", F.col("measured_verdict")).withColumn(
        "measured_verdict", F.when(F.col("__settled"), "passed").otherwise(F.col("measured_verdict"))
    ))
    return guarded.withColumn("measured_verdict", F.col("__m")).drop("__m", "__settled")


def assess_contrast(pages: DataFrame, decisions: DataFrame) -> DataFrame:
    """Contrast rows (with ``borderline``): settled ones stay, borderline ones take a decision."""
    changed = ("state", "needs_human", "rationale")
    measured = pages.withColumns({"measured_verdict": F.col("verdict"), "__settled": settle_contrast(), "__was": F.struct(*changed)})
    turned = authority_guard(apply_completion(measured, decisions))
    # decisions are joined once; settled rows take back what they had
    chosen = turned.withColumns({c: F.when(F.col("__settled"), F.col(f"__was.{c}")).otherwise(F.col(c)) for c in changed})
    return stamp(chosen.drop("__settled", "__was"), "contrast-service", ["WCAG 1.4.3"])


def agent_gate(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gate", F.when(F.col("needs_human"), "pending_review").otherwise("finalized"))
