"""Structure facts of a document: tag trees, findings, verdicts, score and the audit record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions.text import trimmed, truthy
from claridoc.session import written


def _set(c: Column) -> Column:
    return truthy(c).isNotNull()


def tagged(facts: DataFrame) -> DataFrame:
    return facts.withColumn("tagged", F.col("has_struct_root") & F.col("marked"))


# ---------------------------------------------------------------- structure trees


def role_counts(elements: DataFrame) -> DataFrame:
    """Elements per document and role."""
    return elements.filter(_set(F.col("role"))).groupBy("doc_id", "role").agg(F.count("*").alias("n"))


def role_count_map(elements: DataFrame) -> DataFrame:
    """One map per document; its size is the number of different roles, not of elements."""
    pairs = F.array_sort(F.collect_list(F.struct("role", "n")))
    return role_counts(elements).groupBy("doc_id").agg(F.map_from_entries(pairs).alias("role_counts"))


def figure_alt_coverage(elements: DataFrame) -> DataFrame:
    """Figures and figures with usable alternate text.

    Only an empty text falls through to the actual text; a blank one does not, yet counts as missing.
    """
    alt = F.coalesce(truthy(F.col("alt")), F.col("actual_text"))
    return (
        elements.filter(F.col("role") == "Figure")
        .groupBy("doc_id")
        .agg(F.count("*").alias("figures"), F.count_if(trimmed(alt) != "").alias("figures_with_alt"))
    )


def tree_depths(elements: DataFrame, max_depth: int = 200) -> DataFrame:
    """Depth of every element reachable from a root (parent 0 or NULL; depth 0), up to ``max_depth``.

    Pointer doubling in one frame: ``up`` is the ancestor ``hop`` levels above, 0 once a root is passed. A round
    is one join and one write; depth d takes log2(d) rounds however large a document is. Elements whose
    chain breaks leave; those on a circle are still open at the end and leave too.
    """
    rows = written(
        elements.select("doc_id", "elem", F.coalesce("parent_elem", F.lit(0)).cast("bigint").alias("up"), F.lit(1).cast("bigint").alias("hop")).dropDuplicates(["doc_id", "elem"])
    )
    done = F.col("up") == 0
    span = 1
    while span <= max_depth and not rows.filter(~done).isEmpty():
        above = rows.select("doc_id", F.col("elem").alias("up"), F.col("up").alias("up2"), F.col("hop").alias("hop2")).filter("up <> 0")
        climbed = rows.filter(~done).join(above, ["doc_id", "up"]).select("doc_id", "elem", F.col("up2").alias("up"), (F.col("hop") + F.col("hop2")).alias("hop"))
        rows = written(rows.filter(done).unionByName(climbed))
        span *= 2
    return rows.filter(done).select("doc_id", "elem", (F.col("hop") - 1).alias("depth")).filter(F.col("depth") <= max_depth)


def tree_reach(elements: DataFrame, max_depth: int = 200) -> DataFrame:
    """Elements that count: reachable from a root within the depth bound."""
    return elements.join(tree_depths(elements, max_depth), ["doc_id", "elem"])


def table_header_coverage(elements: DataFrame, max_depth: int = 60) -> DataFrame:
    """Tables, and tables with a header cell somewhere below them within ``max_depth`` levels.

    Doubling again: round k knows, per element, the nearest header cell less than 2^k levels below.
    Only elements above a header cell are carried from round to round.
    """
    up = written(
        elements.filter(F.coalesce("parent_elem", F.lit(0)) != 0)
        .select("doc_id", "elem", F.col("parent_elem").alias("up"))
        .dropDuplicates(["doc_id", "elem"])
    )
    near = elements.filter(F.col("role") == "TH").select("doc_id", "elem", F.lit(0).cast("bigint").alias("dist")).distinct()
    span = 1
    while span <= max_depth and not up.isEmpty():
        lifted = near.join(up, ["doc_id", "elem"]).select("doc_id", F.col("up").alias("elem"), (F.col("dist") + span).alias("dist"))
        near = written(near.unionByName(lifted).groupBy("doc_id", "elem").agg(F.min("dist").alias("dist")))
        above = up.select("doc_id", F.col("elem").alias("up"), F.col("up").alias("up2"))
        up = written(up.join(above, ["doc_id", "up"]).select("doc_id", "elem", F.col("up2").alias("up")))
        span *= 2
    headed = near.filter(F.col("dist") <= max_depth).select("doc_id", "elem", F.lit(True).alias("headed"))
    return (
        elements.filter(F.col("role") == "Table")
        .join(headed, ["doc_id", "elem"], "left")
        .groupBy("doc_id")
        .agg(F.count("*").alias("tables"), F.count_if(F.col("headed")).alias("tables_with_th"))
    )


# ---------------------------------------------------------------- findings and verdicts


def _finding(rule: str, n: Column | None = None, m: Column | None = None) -> Column:
    criterion, severity, standard, text, impact, fix = fv.PROBE_RULES[rule]
    message: Column = F.lit(text)
    if n is not None:
        head, tail = text.replace("{n}", "").split("{m}")
        message = F.concat(n.cast("string"), F.lit(head), m.cast("string"), F.lit(tail))
    return F.struct(
        F.lit(criterion).alias("criterion"),
        F.lit(severity).alias("severity"),
        F.array(*[F.lit(x) for x in standard]).alias("standard"),
        message.alias("finding"),
        F.lit(impact).alias("impact"),
        F.lit(fix).alias("fix"),
    )


def findings_array() -> Column:
    """All findings of one facts row, in rule order. One expression, no union of rules."""
    no_alt = F.col("figures") - F.col("figures_with_alt")
    no_th = F.col("tables") - F.col("tables_with_th")
    is_tagged = F.col("has_struct_root") & F.col("marked")
    has_title = _set(F.col("title"))
    rules = F.array(
        F.when(~is_tagged, F.when(F.col("has_struct_root"), _finding("unmarked")).otherwise(_finding("untagged"))),
        F.when(~_set(F.col("lang")), _finding("no_lang")),
        F.when(~has_title, _finding("no_title")).when(~F.col("display_doc_title"), _finding("title_hidden")),
        F.when(F.col("encrypted"), _finding("encrypted")),
        F.when((F.col("figures") > 0) & (no_alt > 0), _finding("figures_no_alt", no_alt, F.col("figures"))),
        F.when((F.col("tables") > 0) & (no_th > 0), _finding("tables_no_th", no_th, F.col("tables"))),
    )
    return F.when(F.col("openable"), F.filter(rules, lambda f: f.isNotNull())).otherwise(F.array(_finding("unopenable")))


def probe_findings(facts: DataFrame) -> DataFrame:
    """Long table of findings: doc_id, ord, criterion, severity, standard, finding, impact, fix."""
    return facts.select("doc_id", F.posexplode(findings_array()).alias("pos", "f")).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("ord"), "f.*"
    )


def _presence(count: Column, ok: Column) -> Column:
    return F.when(count <= 0, "not_present").when(ok, "passed").otherwise("failed")


def probe_verdicts(facts: DataFrame) -> DataFrame:
    """Four verdicts per document; NULL for documents that do not open."""
    is_tagged = F.col("has_struct_root") & F.col("marked")
    complete = is_tagged & _set(F.col("lang")) & _set(F.col("title"))

    def judged(c: Column) -> Column:
        return F.when(F.col("openable"), c)

    return facts.select(
        "doc_id",
        judged(F.when(complete, "passed").otherwise("failed")).alias("semantic_tagging"),
        judged(_presence(F.col("figures"), F.col("figures_with_alt") == F.col("figures"))).alias("alt_text_quality"),
        judged(_presence(F.col("tables"), F.col("tables_with_th") == F.col("tables"))).alias("table_structure"),
        judged(F.when(is_tagged, "cannot_tell").otherwise("failed")).alias("logical_reading_order"),
    )


def score_of(findings: Column) -> Column:
    error, warning = fv.PROBE_WEIGHTS["error"], fv.PROBE_WEIGHTS["warning"]
    lost = F.aggregate(
        findings, F.lit(0), lambda n, f: n + F.when(f["severity"] == "error", error).otherwise(warning)
    )
    return F.greatest(F.lit(0), F.lit(100) - lost).cast("bigint")


def probe_score(facts: DataFrame) -> DataFrame:
    """100 less the weight of each finding, at least 0; NULL for documents that do not open."""
    return facts.select("doc_id", F.when(F.col("openable"), score_of(findings_array())).alias("score"))


def score_from_findings(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """The same score from a stored findings table; documents without findings keep 100."""
    error, warning = fv.PROBE_WEIGHTS["error"], fv.PROBE_WEIGHTS["warning"]
    lost = findings.groupBy("doc_id").agg(
        F.sum(F.when(F.col("severity") == "error", error).otherwise(warning)).alias("lost")
    )
    score = F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).cast("bigint")
    return facts.join(lost, "doc_id", "left").select("doc_id", F.when(F.col("openable"), score).alias("score"))


def review_reasons() -> Column:
    """Why a person is asked: error findings in order, then the reading order of tagged documents."""
    errors = F.filter(findings_array(), lambda f: f["severity"] == "error")
    reasons = F.transform(errors, lambda f: F.concat(f["criterion"], F.lit(": "), f["finding"]))
    undecided = F.col("openable") & F.col("has_struct_root") & F.col("marked")
    return F.when(undecided, F.array_append(reasons, F.lit(fv.READING_ORDER_REASON))).otherwise(reasons)


def audit_record(facts: DataFrame) -> DataFrame:
    """Review reasons, gate, tier and finalized flag per document, from one pass over the facts."""
    open_ = F.size("review_reasons") > 0
    return facts.withColumn("review_reasons", review_reasons()).select(
        "doc_id",
        F.when(open_, "pending_review").otherwise("finalized").alias("gate"),
        F.when(open_, "Audited").otherwise("Remediated").alias("tier"),
        (~open_).alias("finalized"),
        "review_reasons",
    )


def record_summary(facts: DataFrame) -> DataFrame:
    """Flat projection of a document's record; ``served`` only once finalized. One row in, one row out, no join."""
    flat = tagged(facts.withColumns({"review_reasons": review_reasons(), "findings": findings_array()}))
    shown, open_ = F.col("openable"), F.size("review_reasons") > 0
    return flat.select(
        "doc_id", F.when(open_, "pending_review").otherwise("finalized").alias("gate"), F.when(open_, "Audited").otherwise("Remediated").alias("claim_tier"),
        (~open_).alias("finalized"), (~open_).alias("served"),
        F.when(shown, score_of(F.col("findings"))).alias("score"),
        F.when(shown, F.col("tagged")).alias("tagged"),
        F.when(shown, F.col("lang")).alias("lang"),
        F.when(shown, F.col("title")).alias("title"),
        F.when(shown, F.col("page_count")).alias("pages"),
        "review_reasons", F.size("findings").cast("bigint").alias("n_findings"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
