"""Repair plans, phase rows, the content layer, HTML drafts and before/after comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions import urls
from claridoc.functions.text import escape4
from claridoc.operators.criteria import code_of, non_pass

# Texts of drafts, notes and cards.
DRAFT_ROW = {
    "area": "Semantic HTML draft", "refs": ["WCAG 1.3.1", "WCAG 1.3.2"], "status": "draft", "source": "draft",
    "evidence": "Generated a semantic HTML alternate and tag plan from audit evidence. Human review is required before attestation or LMS write-back.",
    "rationale": "Shadow HTML can provide correct DOM reading order in the browser; original PDF reading order changes only after a tagged PDF is emitted and validated.",
}
NOTE_ADOPTED = (
    "Adopted a caller-supplied remediated V2 (tagged) PDF at ",
    ". The repair plan above lists what the second version has to mend.",
)
NOTE_CANDIDATE = (
    "No second version — repair plan derived from audit failures. Supply the address of a tagged second version to compare before and after."
)
NOTE_HTML_ADOPTED = ("Created semantic HTML draft and adopted caller-supplied V2 at ", ".")
NOTE_HTML_ONLY = "Created semantic HTML draft. There is no fixed PDF yet; the review records that unless a second version is supplied."
NOTE_DELTA = (
    "Re-ran the deterministic byte probe on the remediated V2; after = its non-pass count over the SAME 4 structural/byte criteria (1.1.1-presence, 1.3.1, 1.3.2, 2.4.2) used for before. Δ = ",
    " fewer non-pass structural criteria. (1.4.3 contrast + 4.1.2 validator are NOT re-measured on V2, so they are excluded from BOTH sides of this delta.)",
)
NOTE_FAILED = ("V2 re-audit failed (", ") — after not measured; before = the V1 full-audit non-pass count.")
NOTE_NO_V2 = (
    "No emitted fixed PDF to validate yet. Create HTML produced ", " cited block(s) and ",
    " tag-plan item(s); supply a second version to measure after.",
)
DRAFT_HEAD = [
    '<article class="a11y-accessible-html" data-a11y-phase="create-html">', "  <header><p>Source: ", "</p><h1>Accessible HTML draft</h1></header>",
    '  <section aria-labelledby="a11y-audit-summary">', '    <h2 id="a11y-audit-summary">Audit summary</h2>', "    <p>", " WCAG checks need review or remediation before attestation.</p>",
]
DRAFT_TAIL = "  <footer><p>This HTML draft is an accessible alternate for browser/LMS delivery. It does not modify the original PDF bytes.</p></footer>"
DRAFT_NO_REPAIR = "<li>No repair items were generated from the machine audit.</li>"


def _wcag(criterion: Column) -> Column:
    return F.concat(F.lit("WCAG "), code_of(criterion))


def _lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, NULL for unknown keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def with_repairs(criteria: DataFrame) -> DataFrame:
    """Every result with its repair step; the table has six fixed rows, so it rides along as a constant."""
    code = code_of(F.col("criterion"))
    step = F.coalesce(_lookup({k: v[0] for k, v in fv.REPAIRS.items()}, code), F.concat(F.lit("Remediate "), F.col("criterion"), F.lit(".")))
    return (
        criteria.withColumn("needs_repair", non_pass()).withColumn("step", step)
        .withColumn("automation_confidence", F.coalesce(_lookup({k: v[1] for k, v in fv.REPAIRS.items()}, code), F.lit("low")))
        .withColumn("human_qa_required", F.coalesce(_lookup({k: v[2] for k, v in fv.REPAIRS.items()}, code), F.lit(True)))
    )


def repair_plan(criteria: DataFrame) -> DataFrame:
    """One step per result that is not a clean pass."""
    return with_repairs(criteria).filter("needs_repair").select("doc_id", "ord", "criterion", "step", "automation_confidence", "human_qa_required")


def phase_rows(criteria: DataFrame) -> DataFrame:
    """Rows of the drafting phase, with one draft row per document that has a plan."""
    status = (
        F.when((F.col("verdict") == "passed") & ~F.col("needs_human"), "passed").when(F.col("verdict") == "not_present", "not_applicable").otherwise("review")
    )
    rows = criteria.select(
        "doc_id", "ord", F.col("criterion").alias("area"), F.array(_wcag(F.col("criterion"))).alias("refs"), status.alias("status"),
        F.when(F.col("needs_human"), "human").otherwise("machine").alias("source"),
        F.array_join(F.transform("evidence", lambda e: e["detail"]), " ").alias("evidence"), "rationale",
    )
    planned = criteria.groupBy("doc_id").agg(F.bool_or(non_pass()).alias("any"), (F.max("ord") + 1).alias("ord")).filter("any")
    draft = planned.select(
        "doc_id", "ord", F.lit(DRAFT_ROW["area"]).alias("area"), F.array(*[F.lit(r) for r in DRAFT_ROW["refs"]]).alias("refs"),
        *[F.lit(DRAFT_ROW[c]).alias(c) for c in ("status", "source", "evidence", "rationale")],
    )
    return rows.unionByName(draft)


def content_layer(criteria: DataFrame) -> DataFrame:
    """A title and one cited item per result, numbered from 0 (the title)."""
    code = code_of(F.col("criterion"))
    items = criteria.select(
        "doc_id", "ord",
        F.concat(F.lit("criterion-"), F.replace(code, F.lit("."), F.lit("-")), F.lit("-"), F.col("ord").cast("string")).alias("id"),
        F.coalesce(_lookup(fv.ROLE_OF_CRITERION, code), F.lit("review-note")).alias("role"),
        F.concat(F.col("criterion"), F.lit(": "), F.col("rationale")).alias("text"),
        F.array(_wcag(F.col("criterion"))).alias("refs"), F.lit("audit-evidence").alias("source"), "needs_human",
    )
    titles = criteria.select("doc_id").distinct().select(
        "doc_id", F.lit(0).cast("bigint").alias("ord"), F.lit("title").alias("id"), F.lit("heading").alias("role"),
        F.concat(F.lit("Accessible HTML draft for "), F.col("doc_id").cast("string")).alias("text"),
        F.array(F.lit("WCAG 2.4.2")).alias("refs"), F.lit("audit-evidence").alias("source"), F.lit(False).alias("needs_human"),
    )
    return titles.unionByName(items)


def tag_plan(content: DataFrame) -> DataFrame:
    """HTML and document tag of each content item."""
    return content.select(
        "doc_id", "ord", F.concat(F.lit("tag-"), F.col("id")).alias("id"), F.coalesce(_lookup(fv.HTML_TAG, F.col("role")), F.lit("p")).alias("html"),
        _lookup(fv.DOCUMENT_TAG, F.col("role")).alias("pdf_tag"), F.col("id").alias("source_id"), "needs_human",
    )


def html_draft(results: DataFrame, sources: DataFrame) -> DataFrame:
    """One HTML text per document, written from its array of results (doc_id, criteria).

    ``sources`` has doc_id and pdf_url. Results of a document are one row, so nothing is gathered.
    """
    numbered = F.transform("criteria", lambda c, i: F.struct(c.alias("c"), (i + 1).alias("n")))
    bad = F.filter("criteria", lambda c: (c["verdict"] != "passed") | c["needs_human"])

    def li(c: Column) -> Column:
        return F.concat(F.lit("<li><strong>"), escape4(c["criterion"]), F.lit("</strong><br><span>"), escape4(c["rationale"]), F.lit("</span></li>"))

    def step(c: Column) -> Column:
        known = _lookup({k: v[0] for k, v in fv.REPAIRS.items()}, code_of(c["criterion"]))
        text = F.coalesce(known, F.concat(F.lit("Remediate "), c["criterion"], F.lit(".")))
        return F.concat(F.lit("<li><strong>"), escape4(c["criterion"]), F.lit("</strong><br>"), escape4(text), F.lit("</li>"))

    def section(x: Column) -> Column:
        code = code_of(x["c"]["criterion"])
        anchor = F.concat(F.lit("criterion-"), F.replace(code, F.lit("."), F.lit("-")), F.lit("-"), x["n"].cast("string"), F.lit("-heading"))
        return F.concat(
            F.lit('<section aria-labelledby="'), escape4(anchor), F.lit('"><h2 id="'), escape4(anchor), F.lit('">'), escape4(F.concat(F.lit("WCAG "), code)),
            F.lit("</h2><p>"), escape4(F.concat(x["c"]["criterion"], F.lit(": "), x["c"]["rationale"])), F.lit("</p></section>"),
        )

    shown = F.when(F.length("pdf_url") > 0, urls.redact_url(F.col("pdf_url"))).otherwise("source PDF")
    head, lines = DRAFT_HEAD, []
    lines.append(F.lit(head[0]))
    lines.append(F.concat(F.lit(head[1]), escape4(F.col("shown")), F.lit(head[2])))
    lines += [F.lit(head[3]), F.lit(head[4])]
    lines.append(F.concat(F.lit(head[5]), F.size("bad").cast("string"), F.lit(head[6])))
    lines.append(F.concat(F.lit("    <ul>"), F.array_join(F.transform("criteria", li), ""), F.lit("</ul>")))
    lines += [F.lit("  </section>"), F.lit('  <section aria-labelledby="a11y-repair-plan">'), F.lit('    <h2 id="a11y-repair-plan">Repair plan</h2>')]
    repairs = F.when(F.size("bad") == 0, DRAFT_NO_REPAIR).otherwise(F.array_join(F.transform("bad", step), ""))
    lines.append(F.concat(F.lit("    <ol>"), repairs, F.lit("</ol>")))
    lines += [F.lit("  </section>"), F.lit('  <section aria-labelledby="a11y-content-layer">'), F.lit('    <h2 id="a11y-content-layer">Cited content layer</h2>')]
    lines.append(F.array_join(F.transform(numbered, section), "\n"))
    lines += [F.lit("  </section>"), F.lit(DRAFT_TAIL), F.lit("</article>")]
    joined = results.join(sources.select("doc_id", "pdf_url"), "doc_id", "left").withColumn("bad", bad).withColumn("shown", shown)
    return joined.select("doc_id", F.concat_ws("\n", *lines).alias("html"))


def _counts(criteria: DataFrame) -> DataFrame:
    return criteria.groupBy("doc_id").agg(
        F.count("*").alias("n_criteria"), F.count_if(non_pass()).alias("fail_count"), F.count_if("needs_human").alias("n_human"),
        F.count_if(non_pass() & code_of(F.col("criterion")).isin(fv.STRUCTURE_ONLY)).alias("structure_fails"),
    )


def html_summary(criteria: DataFrame, second: DataFrame) -> DataFrame:
    """Status, note and three cards per document; ``second`` lists documents with a second version (doc_id, url)."""
    counts = _counts(criteria).join(second.select("doc_id", "url"), "doc_id", "left")
    note = F.when(F.col("url").isNotNull(), F.concat(F.lit(NOTE_HTML_ADOPTED[0]), urls.redact_url(F.col("url")), F.lit(NOTE_HTML_ADOPTED[1]))).otherwise(NOTE_HTML_ONLY)

    def card(label: str, value: Column, tone: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.cast("bigint").alias("value"), tone.alias("tone"))

    warn = lambda n: F.when(n > 0, "warn").otherwise("pass")
    cards = F.array(
        card("Draft blocks", F.col("n_criteria") + 1, F.lit("neutral")),
        card("Repair items", F.col("fail_count"), warn(F.col("fail_count"))),
        card("Needs review", F.col("n_human"), warn(F.col("n_human"))),
    )
    noted = counts.withColumn("note", note).withColumn("cards", cards)
    return noted.select(
        "doc_id", F.when(F.col("fail_count") > 0, "needs_review").otherwise("ready_for_review").alias("status"), F.col("url").alias("fixed_pdf"), "note", F.inline("cards")
    )


def remediation_status(docs: DataFrame, second: DataFrame) -> DataFrame:
    """Remediated when a second version exists; signed addresses are not repeated in notes."""
    have = F.col("url").isNotNull()
    return docs.select("doc_id").join(second.select("doc_id", "url"), "doc_id", "left").select(
        "doc_id", F.when(have, "remediated").otherwise("candidate").alias("status"), F.col("url").alias("fixed_pdf"),
        F.when(have, F.concat(F.lit(NOTE_ADOPTED[0]), urls.redact_url(F.col("url")), F.lit(NOTE_ADOPTED[1]))).otherwise(NOTE_CANDIDATE).alias("note"),
    )


def validation_delta(criteria: DataFrame, second: DataFrame, second_criteria: DataFrame) -> DataFrame:
    """Before and after per document over the same four criteria; without a usable second version only before.

    ``second``: doc_id, url, error. ``second_criteria``: the four results of the second version.
    """
    after = second_criteria.groupBy("doc_id").agg(F.count_if(non_pass()).alias("after_count"))
    joined = _counts(criteria).join(second.select("doc_id", "url", "error"), "doc_id", "left").join(after, "doc_id", "left")
    have, broken = F.col("url").isNotNull(), F.col("error").isNotNull()
    measured = have & ~broken
    blocks = (F.col("n_criteria") + 1).cast("string")
    note = (
        F.when(~have, F.concat(F.lit(NOTE_NO_V2[0]), blocks, F.lit(NOTE_NO_V2[1]), blocks, F.lit(NOTE_NO_V2[2])))
        .when(broken, F.concat(F.lit(NOTE_FAILED[0]), F.col("error"), F.lit(NOTE_FAILED[1])))
        .otherwise(F.concat(F.lit(NOTE_DELTA[0]), (F.col("structure_fails") - F.col("after_count")).cast("string"), F.lit(NOTE_DELTA[1])))
    )
    return joined.select(
        "doc_id", F.when(measured, F.col("structure_fails")).otherwise(F.col("fail_count")).alias("before"),
        F.when(measured, F.col("after_count")).alias("after"), note.alias("note"), F.lit("deferred").alias("visual_parity"),
    )


def after_evidence(second_facts: DataFrame, scores: DataFrame, second_criteria: DataFrame) -> DataFrame:
    """One measurement and all open results per second version. A document has four results."""
    ends = second_criteria.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(non_pass()).alias("bad"),
        F.array_sort(F.collect_list(F.when(non_pass(), F.struct("ord", F.concat(F.col("criterion"), F.lit(": "), F.col("rationale")).alias("detail"))))).alias("rows"),
    )
    ok = F.col("openable")
    facts = second_facts.select(
        "doc_id", F.when(ok & F.col("has_struct_root") & F.col("marked"), "true").otherwise("false").alias("tagged"),
        F.when(ok & (F.length("title") > 0), "set").otherwise("none").alias("title"), F.when(ok, F.col("lang")).alias("lang"),
    )
    joined = ends.join(facts, "doc_id").join(scores, "doc_id", "left")
    measured = F.concat(
        F.lit("V2 byte re-audit (structural criteria only): tagged="), F.col("tagged"), F.lit(", title="), F.col("title"), F.lit(", lang="),
        F.coalesce("lang", F.lit("none")), F.lit(", score="), F.coalesce(F.col("score").cast("string"), F.lit("n/a")), F.lit("; "), F.col("bad").cast("string"), F.lit("/"),
        F.col("n").cast("string"), F.lit(" byte criteria non-pass. (1.4.3 contrast + 4.1.2 validator NOT re-measured on V2 → delta is scoped to structure.)"),
    )
    first = F.struct(F.lit("measurement").alias("kind"), measured.alias("detail"))
    rest = F.transform("rows", lambda r: F.struct(F.lit("validator").alias("kind"), r["detail"].alias("detail")))
    return joined.select("doc_id", F.posexplode(F.concat(F.array(first), rest)).alias("pos", "e")).select(
        "doc_id", F.col("pos").cast("bigint").alias("ord"), "e.kind", "e.detail", F.lit("v2-reaudit").alias("citation")
    )


def review_rows(comparison: DataFrame) -> DataFrame:
    """Two view rows per comparison."""
    def row(area: str, ref: str, status: Column, source: str, proof: Column) -> Column:
        return F.struct(F.lit(area).alias("area"), F.lit(ref).alias("refs"), status.alias("status"), F.lit(source).alias("source"), proof.alias("evidence"))

    parity = F.col("visual_parity")
    state = lambda held: F.when(held, "deferred").otherwise("passed")
    rows = F.array(
        row("Validation delta", "WCAG structural criteria", state(F.col("after").isNull()), "machine", F.col("note")),
        row("Visual parity", "export snapshot", state(parity == "deferred"), "deferred", F.concat(F.lit("Pixel parity: "), parity)),
    )
    return comparison.select("doc_id", F.inline(rows))


def legacy_rows(plan: DataFrame) -> DataFrame:
    """A repair plan in the older phase-row form."""
    return plan.select(
        "doc_id", "ord", F.col("criterion").alias("area"), F.array(_wcag(F.col("criterion"))).alias("refs"), F.lit("review").alias("status"),
        F.lit("draft").alias("source"), F.col("step").alias("evidence"),
        F.when(F.col("human_qa_required"), "Human QA required.").otherwise("Machine-derived repair item.").alias("rationale"),
    )


def legacy_card(docs: DataFrame, plan: DataFrame, second: DataFrame) -> DataFrame:
    """The single card of the older form, per document."""
    n = plan.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = docs.select("doc_id").join(n, "doc_id", "left").join(second.select("doc_id", "url"), "doc_id", "left")
    return joined.select(
        "doc_id", F.when(F.col("url").isNotNull(), "ready_for_review").otherwise("needs_review").alias("status"), F.lit("Repair items").alias("label"),
        F.coalesce("n", F.lit(0)).alias("value"), F.when(F.coalesce("n", F.lit(0)) > 0, "warn").otherwise("pass").alias("tone"),
    )


def step_components(spark: SparkSession) -> DataFrame:
    """Fixed: the components of the three steps."""
    return spark.createDataFrame([(s, k, c, fv.STEP_WEIGHT[s], fv.STEP_LABEL[s], fv.STEP_REPORT_KEYS[s]) for s, k, c in fv.STEP_COMPONENTS], "step string, kind string, component string, routine_weight double, label string, report_keys array<string>")
