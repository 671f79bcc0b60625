"""The six audited criteria, the audit gate and the report gate.

A criterion result is STRUCT<criterion, via, verdict, needs_human, evidence, rationale>, with
evidence an array of STRUCT<kind, page, bbox, detail, citation>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions.text import truthy

_TITLE = dict(fv.AUDITED)


def evidence(kind: str, detail: Column, citation: str | None = None, page: int | None = None, bbox: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(page).cast("int").alias("page"),
        (F.lit(None) if bbox is None else bbox).cast("array<double>").alias("bbox"),
        detail.alias("detail"),
        F.lit(citation).cast("string").alias("citation"),
    )


def _result(code: str, via: str, verdict: str, human: bool, proof: Column, rationale: Column | str) -> Column:
    why = F.lit(rationale) if isinstance(rationale, str) else rationale
    return F.struct(
        F.lit(_TITLE[code]).alias("criterion"), F.lit(via).alias("via"), F.lit(verdict).alias("verdict"),
        F.lit(human).alias("needs_human"), F.array(proof).alias("evidence"), why.alias("rationale"),
    )


def _text(template: str, *values: Column) -> Column:
    """A template whose {} holes take columns."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, tail in zip(values, parts[1:]):
        out += [value.cast("string"), F.lit(tail)]
    return F.concat(*out)


def _flag(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


# Facts of a document that did not open are absent: it counts as untagged, untitled, empty.
def _open(c: str) -> Column:
    return F.col("openable") & F.col(c)


def _count(c: str) -> Column:
    return F.when(F.col("openable"), F.col(c)).otherwise(0)


def _is_tagged() -> Column:
    return _open("has_struct_root") & F.col("marked")


def alt_text() -> Column:
    figures, present = _count("figures"), _count("figures_with_alt")
    missing = figures - present
    return (
        F.when(
            figures == 0,
            _result("1.1.1", "byte-probe", "not_present", False,
                    evidence("measurement", F.lit("No tagged Figure elements found in the structure tree.")),
                    "No tagged figures → no /Alt to assess at the byte level."),
        )
        .when(
            missing > 0,
            _result("1.1.1", "byte-probe", "failed", True,
                    evidence("measurement", _text("{} of {} tagged figures have no /Alt.", missing, figures), "probe-figures"),
                    _text("{}/{} figures missing /Alt (WCAG 1.1.1 fail at presence level).", missing, figures)),
        )
        .otherwise(
            _result("1.1.1", "vlm-escalate", "cannot_tell", True,
                    evidence("measurement", _text("{}/{} figures have /Alt present; description QUALITY not machine-verifiable.", present, figures), "probe-figures"),
                    "All figures have /Alt present, but alt-text QUALITY needs a VLM judge (deferred) → human review.")
        )
    )


def structure() -> Column:
    tables = _count("tables")
    bare = tables - _count("tables_with_th")
    return (
        F.when(
            ~_is_tagged(),
            _result("1.3.1", "byte-probe", "failed", True,
                    evidence("validator", _text("tagged=false, StructTreeRoot={}, Marked={}", _flag(_open("has_struct_root")), _flag(_open("marked")))),
                    "PDF is untagged (no usable StructTreeRoot) → structure/relationships lost (WCAG 1.3.1 fail)."),
        )
        .when(
            (tables > 0) & (bare > 0),
            _result("1.3.1", "byte-probe", "failed", True,
                    evidence("validator", _text("{} of {} tables have no header (TH) cells.", bare, tables), "probe-tables"),
                    _text("{}/{} tables missing TH headers → cell relationships lost (WCAG 1.3.1 fail).", bare, tables)),
        )
        .otherwise(
            _result("1.3.1", "byte-probe", "passed", False,
                    evidence("validator", _text("tagged=true; tables={} (all with TH where present).", tables)),
                    "Document is tagged and tables (if any) have header cells — WCAG 1.3.1 structure present.")
        )
    )


def sequence() -> Column:
    def row(proof: str, why: str) -> Column:
        return _result("1.3.2", "vlm-escalate", "cannot_tell", True, evidence("measurement", F.lit(proof)), why)

    return F.when(
        _is_tagged(),
        row("Tagged; reading-order correctness requires a VLM vs render diff.",
            "Reading order is a visual judgment — VLM vs reading-order pre-assessment is deferred → human review."),
    ).otherwise(
        row("Untagged; no defined reading order.", "Untagged document has no defined reading order → human review.")
    )


def page_titled() -> Column:
    title = F.when(F.col("openable"), truthy(F.col("title")))
    shown = title
    return (
        F.when(
            title.isNull(),
            _result("2.4.2", "byte-probe", "failed", True, evidence("measurement", F.lit("No document Title in metadata.")),
                    "No document Title → window/tab shows the filename (WCAG 2.4.2 fail)."),
        )
        .when(
            ~_open("display_doc_title"),
            _result("2.4.2", "byte-probe", "failed", True,
                    evidence("measurement", _text('Title="{}" but DisplayDocTitle is not enabled.', shown)),
                    "Title set but ViewerPreferences /DisplayDocTitle is off → viewers show the filename (WCAG 2.4.2 fail)."),
        )
        .otherwise(
            _result("2.4.2", "byte-probe", "passed", False,
                    evidence("measurement", _text('Title="{}"; DisplayDocTitle=true.', shown)),
                    "Document has a Title and DisplayDocTitle is enabled — WCAG 2.4.2 satisfied.")
        )
    )


_LANES = {"1.4.3": ("contrast", "measurement", "Contrast"), "4.1.2": ("validator", "validator", "Validator")}


def lane_result(code: str, row: str) -> Column:
    """The verdict of an outside lane, or the fail-closed result when the lane gave none.

    ``row`` names a struct column with verdict, needs_human, evidence, rationale and error.
    """
    lane, kind, name = _LANES[code]
    message = F.coalesce(F.col(f"{row}.error"), F.lit("no result"))
    failed = _result(
        code, f"{lane}-error", "cannot_tell", True,
        evidence(kind, F.concat(F.lit(f"{lane} facet error: "), message)),
        f"{name} lane failed (facet error) — escalated for human review (fail-closed).",
    )
    given = F.struct(
        F.lit(_TITLE[code]).alias("criterion"), F.lit(lane).alias("via"), F.col(f"{row}.verdict").alias("verdict"),
        F.col(f"{row}.needs_human").alias("needs_human"), F.col(f"{row}.evidence").alias("evidence"),
        F.col(f"{row}.rationale").alias("rationale"),
    )
    ok = F.col(f"{row}.verdict").isNotNull() & F.col(f"{row}.error").isNull()
    return F.when(ok, given).otherwise(failed)


LANE_FIELDS = ["verdict", "needs_human", "evidence", "rationale", "error"]


def with_lane(docs: DataFrame, assessments: DataFrame, row: str) -> DataFrame:
    """Attach an assessments table (one row per document) as a struct column."""
    if "error" not in assessments.columns:
        assessments = assessments.withColumn("error", F.lit(None).cast("string"))
    lane = assessments.select("doc_id", F.struct(*LANE_FIELDS).alias(row))
    return docs.join(lane, "doc_id", "left")


def audit_array(facts: DataFrame, contrast: DataFrame, validator: DataFrame) -> DataFrame:
    """doc_id and the six results in audit order, kept together in one row."""
    joined = with_lane(with_lane(facts, contrast, "__c"), validator, "__v")
    six = F.array(alt_text(), structure(), sequence(), lane_result("1.4.3", "__c"), page_titled(), lane_result("4.1.2", "__v"))
    return joined.select("doc_id", six.alias("criteria"))


def _explode(results: DataFrame) -> DataFrame:
    return results.select("doc_id", F.posexplode("criteria").alias("pos", "c")).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("ord"), "c.*"
    )


def audit(facts: DataFrame, contrast: DataFrame, validator: DataFrame) -> DataFrame:
    """Six rows per document: doc_id, ord, criterion, via, verdict, needs_human, evidence, rationale."""
    return _explode(audit_array(facts, contrast, validator))


def judged(facts: DataFrame, result: Column) -> DataFrame:
    """One criterion on its own."""
    return facts.select("doc_id", result.alias("c")).select("doc_id", "c.*")


def structure_only(facts: DataFrame) -> DataFrame:
    """The four criteria that facts alone decide, for the before/after comparison."""
    four = F.array(alt_text(), structure(), sequence(), page_titled())
    return _explode(facts.select("doc_id", four.alias("criteria")))


def non_pass() -> Column:
    return (F.col("verdict") != "passed") | F.col("needs_human")


def audit_gate(criteria: DataFrame) -> DataFrame:
    """Number of results that are not a clean pass, and the gate that follows.

    A harmless ``not_present`` counts as well; the reading-order result keeps the count above zero.
    """
    counted = criteria.groupBy("doc_id").agg(F.count_if(non_pass()).alias("fail_count"))
    return counted.withColumn("gate", F.when(F.col("fail_count") == 0, "finalized").otherwise("pending_review"))


def code_of(criterion: Column) -> Column:
    """Leading code of a criterion name; the whole name when it starts with a blank."""
    return F.coalesce(truthy(F.split_part(criterion, F.lit(" "), F.lit(1))), criterion)


def criterion_rows(criteria: DataFrame) -> DataFrame:
    """Results as assessment rows, one agent per criterion."""
    code = code_of(F.col("criterion"))
    return criteria.select(
        "doc_id", "ord",
        F.concat(F.lit("wcag:"), code).alias("agent"),
        F.when(F.col("needs_human"), "input_required").otherwise("completed").alias("state"),
        "verdict", "needs_human",
        F.array(F.concat(F.lit("WCAG "), code)).alias("standard_refs"),
        "evidence", "rationale",
    )


def report_gate(docs: DataFrame, rows: DataFrame, parked: DataFrame | None = None) -> DataFrame:
    """Worst case over all rows of a report; a report without rows is clean, parked work is not."""
    clean = rows.groupBy("doc_id").agg(F.bool_and(~non_pass()).alias("clean"), F.count("*").alias("n_rows"))
    joined = docs.select("doc_id").join(clean, "doc_id", "left")
    held: Column = F.lit(False)
    if parked is not None:
        counts = parked.groupBy("doc_id").agg(F.count("*").alias("n_parked"))
        joined = joined.join(counts, "doc_id", "left")
        held = F.coalesce("n_parked", F.lit(0)) > 0
    ok = F.coalesce("clean", F.lit(True)) & ~held
    return joined.select(
        "doc_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(ok, "finalized").otherwise("pending_review").alias("gate"),
    )


def gate_by_mode(gates: DataFrame, mode: Column) -> DataFrame:
    """An audit alone keeps its gate; the full pipeline always waits for a person."""
    return gates.withColumn("gate", F.when(mode == "audit", F.col("gate")).otherwise("pending_review"))
