"""Registered queries: structure probe, criteria, reconciliation and rollup."""

from __future__ import annotations

from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.operators import criteria, probe, reconcile, rollup
from claridoc.plans import audit
from claridoc.plans.check_views import quoted
from claridoc.plans.registry import query

FINDING = ["doc_id", "ord", "criterion", "severity", "standard", "finding", "impact", "fix"]


def details(df):
    """Evidence as its detail texts."""
    return df.withColumn("detail", F.transform("evidence", lambda e: e["detail"])).drop("evidence")


# ---- structure trees

query(
    "p2_role_counts",
    lambda d: probe.role_counts(d("struct_elements")),
    "SELECT doc_id, role, COUNT(*) AS n FROM struct_elements GROUP BY doc_id, role",
)
query(
    "p2_role_count_map",
    lambda d: probe.role_count_map(d("struct_elements")).select(
        "doc_id", F.transform(F.map_entries("role_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias("roles")
    ),
    "SELECT doc_id, string_agg(role || '=' || n, ' | ' ORDER BY role) AS roles FROM (SELECT doc_id, role, COUNT(*) AS n FROM struct_elements GROUP BY doc_id, role) t GROUP BY doc_id",
)
query(
    "p3_figure_alt_coverage",
    lambda d: probe.figure_alt_coverage(d("struct_elements")),
    """SELECT doc_id, COUNT(*) AS figures, CAST(COUNT(*) FILTER (WHERE trim(COALESCE(NULLIF(alt, ''), actual_text)) <> '') AS BIGINT) AS figures_with_alt
       FROM struct_elements WHERE role = 'Figure' GROUP BY doc_id""",
)
query(
    "p4_table_header_coverage",
    lambda d: probe.table_header_coverage(d("struct_elements")),
    """WITH RECURSIVE up AS (
         SELECT doc_id, elem, parent_elem, 0 AS dist FROM struct_elements WHERE role = 'TH'
         UNION ALL SELECT e.doc_id, e.elem, e.parent_elem, up.dist + 1 FROM up JOIN struct_elements e ON e.doc_id = up.doc_id AND e.elem = up.parent_elem WHERE up.dist < 60)
       SELECT t.doc_id, COUNT(*) AS tables, CAST(COUNT(*) FILTER (WHERE h.elem IS NOT NULL) AS BIGINT) AS tables_with_th
       FROM struct_elements t LEFT JOIN (SELECT DISTINCT doc_id, elem FROM up) h ON t.doc_id = h.doc_id AND t.elem = h.elem
       WHERE t.role = 'Table' GROUP BY t.doc_id""",
)
_REACH = """WITH RECURSIVE down AS (
         SELECT doc_id, elem, role, CAST(0 AS BIGINT) AS depth FROM struct_elements WHERE parent_elem = 0
         UNION ALL SELECT e.doc_id, e.elem, e.role, down.depth + 1 FROM down JOIN struct_elements e ON e.doc_id = down.doc_id AND e.parent_elem = down.elem WHERE down.depth < {bound})
       SELECT doc_id, elem, role, depth FROM down"""
query(
    "p5_tree_reach",
    lambda d: probe.tree_reach(d("struct_elements")).select("doc_id", "elem", "role", "depth"),
    _REACH.format(bound=200),
)
query(
    "p5_tree_reach_shallow",
    lambda d: probe.tree_reach(d("struct_elements"), 5).select("doc_id", "elem", "role", "depth"),
    _REACH.format(bound=5),
)

# ---- facts to findings

query(
    "p7_tagged",
    lambda d: probe.tagged(d("probe_facts")).select("doc_id", "has_struct_root", "marked", "tagged"),
    "SELECT doc_id, has_struct_root, marked, has_struct_root AND marked AS tagged FROM probe_facts",
)
query("p8_probe_findings", lambda d: probe.probe_findings(d("probe_facts")), f"SELECT {', '.join(FINDING)} FROM c_findings")
query(
    "p9_probe_verdicts",
    lambda d: probe.probe_verdicts(d("probe_facts")),
    """SELECT doc_id, CASE WHEN NOT openable THEN NULL WHEN has_struct_root AND marked AND lang <> '' AND title <> '' THEN 'passed' ELSE 'failed' END AS semantic_tagging,
              CASE WHEN NOT openable THEN NULL WHEN figures = 0 THEN 'not_present' WHEN figures = figures_with_alt THEN 'passed' ELSE 'failed' END AS alt_text_quality,
              CASE WHEN NOT openable THEN NULL WHEN tables = 0 THEN 'not_present' WHEN tables = tables_with_th THEN 'passed' ELSE 'failed' END AS table_structure,
              CASE WHEN NOT openable THEN NULL WHEN has_struct_root AND marked THEN 'cannot_tell' ELSE 'failed' END AS logical_reading_order
       FROM probe_facts""",
)
query("p10_probe_score", lambda d: probe.probe_score(d("probe_facts")), "SELECT doc_id, score FROM c_scores")
query(
    "p10_score_from_findings",
    lambda d: probe.score_from_findings(d("probe_facts"), probe.probe_findings(d("probe_facts"))),
    "SELECT doc_id, score FROM c_scores",
)
query(
    "p11_audit_record",
    lambda d: probe.audit_record(d("probe_facts")),
    """SELECT doc_id, CASE WHEN is_open THEN 'pending_review' ELSE 'finalized' END AS gate, CASE WHEN is_open THEN 'Audited' ELSE 'Remediated' END AS tier,
              NOT is_open AS finalized, review_reasons FROM c_reasons""",
)
query(
    "p12_record_summary",
    lambda d: probe.record_summary(d("probe_facts")),
    """SELECT p.doc_id, CASE WHEN is_open THEN 'pending_review' ELSE 'finalized' END AS gate, CASE WHEN is_open THEN 'Audited' ELSE 'Remediated' END AS claim_tier,
              NOT is_open AS finalized, NOT is_open AS served, s.score, CASE WHEN openable THEN has_struct_root AND marked END AS tagged,
              CASE WHEN openable THEN lang END AS lang, CASE WHEN openable THEN title END AS title, CASE WHEN openable THEN page_count END AS pages,
              review_reasons, COALESCE(n, 0) AS n_findings
       FROM probe_facts p JOIN c_reasons r ON p.doc_id = r.doc_id JOIN c_scores s ON p.doc_id = s.doc_id
       LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM c_findings GROUP BY doc_id) f ON f.doc_id = p.doc_id""",
)

# ---- criteria

_COLS = "doc_id, criterion, via, verdict, needs_human, detail, rationale"
for _name, _result, _table in (
    ("c1_criterion_alt", criteria.alt_text, "c_alt"),
    ("c2_criterion_structure", criteria.structure, "c_structure"),
    ("c3_criterion_sequence", criteria.sequence, "c_sequence"),
    ("c5_criterion_title", criteria.page_titled, "c_title"),
):
    query(_name, lambda d, r=_result: details(criteria.judged(d("probe_facts"), r())), f"SELECT {_COLS} FROM {_table}")
query(
    "c4_criterion_contrast",
    lambda d: details(criteria.judged(
        criteria.with_lane(d("probe_facts"), audit.contrast_assessments(d("contrast_lane")), "lane"), criteria.lane_result("1.4.3", "lane")
    )),
    f"SELECT {_COLS} FROM c_contrast",
)
query(
    "c6_criterion_validator",
    lambda d: details(criteria.judged(
        criteria.with_lane(d("probe_facts"), reconcile.reconcile(d("validator_lanes")), "lane"), criteria.lane_result("4.1.2", "lane")
    )),
    f"SELECT {_COLS} FROM c_validator",
)
query("c7_audit", lambda d: details(audit.audit_rows(d)), f"SELECT ord, {_COLS} FROM c_criteria")
query("c8_audit_gate", lambda d: criteria.audit_gate(audit.audit_rows(d)), "SELECT doc_id, fail_count, gate FROM c_gate")
query(
    "c9_criterion_rows",
    lambda d: details(criteria.criterion_rows(audit.audit_rows(d))),
    """SELECT doc_id, ord, 'wcag:' || split_part(criterion, ' ', 1) AS agent, CASE WHEN needs_human THEN 'input_required' ELSE 'completed' END AS state,
              verdict, needs_human, 'WCAG ' || split_part(criterion, ' ', 1) AS standard_refs, detail, rationale FROM c_criteria""",
)
query(
    "c10_report_gate",
    lambda d: criteria.report_gate(d("documents"), d("contrast_lane"), d("labels").filter("toxic = 1")),
    """SELECT d.doc_id, COALESCE(n, 0) AS n_rows, CASE WHEN COALESCE(clean, TRUE) AND COALESCE(k, 0) = 0 THEN 'finalized' ELSE 'pending_review' END AS gate
       FROM documents d LEFT JOIN (SELECT doc_id, COUNT(*) AS n, bool_and(verdict = 'passed' AND NOT needs_human) AS clean FROM contrast_lane GROUP BY doc_id) r ON d.doc_id = r.doc_id
       LEFT JOIN (SELECT doc_id, COUNT(*) AS k FROM labels WHERE toxic = 1 GROUP BY doc_id) p ON d.doc_id = p.doc_id""",
)
query(
    "c11_gate_by_mode",
    lambda d: criteria.gate_by_mode(
        criteria.report_gate(d("documents"), d("contrast_lane")).join(d("documents").select("doc_id", "source"), "doc_id"),
        F.when(F.col("source") < "src5", "audit").otherwise("full"),
    ).select("doc_id", "gate"),
    """SELECT d.doc_id, CASE WHEN source < 'src5' AND COALESCE(clean, TRUE) THEN 'finalized' ELSE 'pending_review' END AS gate
       FROM documents d LEFT JOIN (SELECT doc_id, bool_and(verdict = 'passed' AND NOT needs_human) AS clean FROM contrast_lane GROUP BY doc_id) r ON d.doc_id = r.doc_id""",
)

# ---- reconciliation

query(
    "v1_lane_pass",
    lambda d: d("validator_lanes").select("doc_id", "lane", reconcile.lane_pass().alias("ok")),
    "SELECT doc_id, lane, ok FROM c_lanes",
)
_ROW = "state, verdict, confidence, needs_human, detail, rationale"
query(
    "v2_reconcile",
    lambda d: details(reconcile.reconcile(d("validator_lanes"))),
    f"SELECT doc_id, 'validator' AS agent, 'PDF/UA-1 | WCAG' AS standard_refs, {_ROW} FROM c_reconciled",
)
_ASK = "'Validator reconciliation needs human sign-off (veraPDF lane: ' || COALESCE(sa, 'unavailable') || ', PAC lane: ' || COALESCE(sb, 'unavailable') || '). ' || rationale"
query(
    "v3_reconcile_question",
    lambda d: reconcile.reconcile_question(d("validator_lanes")),
    f"SELECT doc_id, {_ASK} AS rationale FROM c_reconciled WHERE needs_human",
)
query(
    "v4_settle",
    lambda d: reconcile.reconcile(d("validator_lanes")).select("doc_id", reconcile.settle_validator().alias("settled")),
    "SELECT doc_id, NOT needs_human AS settled FROM c_reconciled",
)
query(
    "v6_authority_guard",
    lambda d: reconcile.authority_guard(
        reconcile.reconcile(d("validator_lanes")).join(d("contrast_lane").select("doc_id", F.col("verdict").alias("measured_verdict")), "doc_id")
    ).select("doc_id", "measured_verdict", "state", "needs_human", "rationale"),
    """SELECT r.doc_id, c.verdict AS measured_verdict, CASE WHEN c.verdict <> 'passed' THEN 'input_required' ELSE r.state END AS state,
              r.needs_human OR c.verdict <> 'passed' AS needs_human,
              CASE WHEN c.verdict <> 'passed' AND NOT r.needs_human THEN r.rationale || ' (base guard: deterministic verdict ''' || c.verdict
                || ''' is not a clean pass — LLM cannot clear the human gate; escalated.)' ELSE r.rationale END AS rationale
       FROM c_reconciled r JOIN contrast_lane c ON r.doc_id = c.doc_id""",
)
query(
    "v7_stamp",
    lambda d: reconcile.stamp(reconcile.reconcile(d("validator_lanes")), "wcag", ["WCAG 2.2", "PDF/UA-1"]).select("doc_id", "agent", "standard_refs", "verdict"),
    "SELECT doc_id, 'wcag' AS agent, 'WCAG 2.2 | PDF/UA-1' AS standard_refs, verdict FROM c_reconciled",
)
query(
    "v8_assess_validator",
    lambda d: details(reconcile.assess_validator(d("validator_lanes"))),
    f"""SELECT doc_id, 'validator' AS agent, 'PDF/UA-1 | WCAG' AS standard_refs, state, verdict, confidence, needs_human, detail,
               CASE WHEN needs_human THEN {_ASK} ELSE rationale END AS rationale FROM c_reconciled""",
)
query(
    "v9_agent_gate",
    lambda d: reconcile.agent_gate(reconcile.reconcile(d("validator_lanes"))).select("doc_id", "needs_human", "gate"),
    "SELECT doc_id, needs_human, CASE WHEN needs_human THEN 'pending_review' ELSE 'finalized' END AS gate FROM c_reconciled",
)

# ---- rollup

query(
    "r1_dimension_coverage",
    lambda d: audit.verdicts(d).join(
        F.broadcast(rollup.dim_sc(d.spark).select("sc", "guideline", "evidence_source", "decidability")), "sc"
    ).groupBy("sc_ord", "sc", "name", "guideline", "evidence_source", "decidability").agg(
        F.count("*").alias("documents"), F.count_if(F.col("verdict") == "failed").alias("failed"), F.count_if("needs_human").alias("human")
    ),
    """SELECT v.sc_ord, v.sc, v.name, guideline, evidence_source, decidability, COUNT(*) AS documents,
              CAST(COUNT(*) FILTER (WHERE verdict = 'failed') AS BIGINT) AS failed, CAST(COUNT(*) FILTER (WHERE needs_human) AS BIGINT) AS human
       FROM c_verdicts v JOIN c_dim m ON v.sc = m.sc GROUP BY ALL""",
)
query(
    "r1_bridge_coverage",
    lambda d: audit.verdicts(d).join(F.broadcast(rollup.area_sc(d.spark)), "sc").groupBy("area_id", "label", "ord", "sc").agg(
        F.count_if(F.col("verdict") == "failed").alias("failed")
    ),
    """SELECT area_id, label, CAST(b.ord AS BIGINT) AS ord, v.sc, CAST(COUNT(*) FILTER (WHERE verdict = 'failed') AS BIGINT) AS failed
       FROM c_verdicts v JOIN c_bridge b ON v.sc = b.sc GROUP BY ALL""",
)
_V = "doc_id, sc_ord, sc, name, level, principle, applicable, verdict, needs_human, source, via, rationale"
query("r2_sc_verdicts", lambda d: audit.verdicts(d), f"SELECT {_V} FROM c_verdicts")
query(
    "r2_sc_verdicts_from_rows",
    lambda d: rollup.sc_verdicts(d("probe_facts"), audit.audit_rows(d).unionByName(
        audit.audit_rows(d).filter(F.col("criterion").startswith("1.1.1")).withColumn("ord", F.col("ord") + 10)
        .withColumn("verdict", F.lit("passed")).withColumn("needs_human", F.lit(False))
    )),
    """SELECT doc_id, sc_ord, sc, name, level, principle, applicable, CASE WHEN sc = '1.1.1' THEN 'passed' ELSE verdict END AS verdict,
              CASE WHEN sc = '1.1.1' THEN FALSE ELSE needs_human END AS needs_human, source, via, rationale FROM c_verdicts""",
)
query(
    "r2_sc_verdicts_last_wins",
    lambda d: rollup.sc_verdicts_of(audit.audit_results(d).withColumn("criteria", F.concat("criteria", F.transform(F.slice("criteria", 1, 1), lambda c: c.withField("verdict", F.lit("passed")).withField("needs_human", F.lit(False)))))),
    """SELECT doc_id, sc_ord, sc, name, level, principle, applicable, CASE WHEN sc = '1.1.1' THEN 'passed' ELSE verdict END AS verdict,
              CASE WHEN sc = '1.1.1' THEN FALSE ELSE needs_human END AS needs_human, source, via, rationale FROM c_verdicts""",
)
query(
    "r3_sc_areas",
    lambda d: audit.verdicts(d).join(F.broadcast(rollup.sc_areas(d.spark)), "sc", "left").select("doc_id", "sc", F.coalesce("area_ids", F.array().cast("array<string>")).alias("area_ids")),
    """SELECT doc_id, v.sc, COALESCE(ids, '') AS area_ids FROM c_verdicts v LEFT JOIN (SELECT sc, string_agg(area_id, ' | ' ORDER BY area_ord) AS ids FROM c_bridge GROUP BY sc) b ON v.sc = b.sc""",
)
query("r4_area_status", lambda d: rollup.area_status(audit.verdicts(d)), "SELECT doc_id, area_id, area_ord, label, primary_standard, status FROM c_areas")
query("r5_rollup_summary", audit.audit_rollup, "SELECT doc_id, total, passed, failed, needs_human, not_applicable FROM c_summary")
query(
    "r6_rollup_row",
    lambda d: details(rollup.rollup_row(audit.verdicts(d))),
    """SELECT s.doc_id, 'wcag' AS agent, CASE WHEN failed > 0 OR needs_human > 0 THEN 'input_required' ELSE 'completed' END AS state,
              CASE WHEN failed > 0 THEN 'failed' WHEN needs_human > 0 THEN 'cannot_tell' ELSE 'passed' END AS verdict,
              CASE WHEN failed > 0 THEN 0.9 WHEN needs_human > 0 THEN 0.5 ELSE 0.95 END::DOUBLE AS confidence, failed > 0 OR needs_human > 0 AS needs_human,
              COALESCE(t.detail, '') AS detail,
              'WCAG 2.2 AA rollup over ' || total || ' SC: ' || passed || ' pass, ' || failed || ' fail, ' || needs_human || ' need human review, ' || not_applicable || ' N/A for static PDF.' AS rationale
       FROM c_summary s LEFT JOIN (
         SELECT doc_id, string_agg(detail, ' | ' ORDER BY sc_ord) AS detail FROM (
           SELECT doc_id, sc_ord, (sc || ' ' || name || ': ' || verdict || CASE WHEN needs_human THEN ' (needs human review)' ELSE '' END || ' — ' || rationale) AS detail
           FROM c_verdicts WHERE (verdict = 'failed' OR needs_human) AND (source <> 'human-only' OR verdict = 'cannot_tell')) x GROUP BY doc_id) t ON s.doc_id = t.doc_id""",
)
query(
    "r7_areas_for_standard",
    lambda d: rollup.areas_for_standard(rollup.area_status(audit.verdicts(d)), "pdfua").select("doc_id", "area_id", "status"),
    "SELECT doc_id, area_id, status FROM c_areas WHERE primary_standard = 'pdfua'",
)
query(
    "r8_machine_backed",
    lambda d: audit.verdicts(d).filter(rollup.machine_backed(F.col("sc"))).select("doc_id", "sc", "verdict"),
    f"SELECT doc_id, sc, verdict FROM c_verdicts WHERE sc IN ({', '.join(quoted(c) for c, _ in fv.AUDITED)})",
)
query(
    "r9_corpus_rollup",
    lambda d: rollup.corpus_rollup(audit.verdicts(d), d("documents")),
    """SELECT CAST(GROUPING(level, principle, lang, source_name) AS BIGINT) AS "grouping", level, principle, lang, source_name, CAST(COUNT(*) AS BIGINT) AS total,
              CAST(COUNT(*) FILTER (WHERE applicable AND verdict <> 'failed' AND NOT needs_human) AS BIGINT) AS passed,
              CAST(COUNT(*) FILTER (WHERE applicable AND verdict = 'failed') AS BIGINT) AS failed,
              CAST(COUNT(*) FILTER (WHERE applicable AND verdict <> 'failed' AND needs_human) AS BIGINT) AS needs_human,
              CAST(COUNT(*) FILTER (WHERE NOT applicable) AS BIGINT) AS not_applicable
       FROM (SELECT v.*, COALESCE(d.lang, 'none') AS lang, d.source AS source_name FROM c_verdicts v JOIN documents d ON v.doc_id = d.doc_id) x
       GROUP BY CUBE (level, principle, lang, source_name)""",
)
query(
    "r10_corpus_area_rank",
    lambda d: rollup.corpus_area_rank(rollup.area_status(audit.verdicts(d)), d("documents")),
    """SELECT * FROM (SELECT area_id, source, documents, failed, round(failed / documents, 6) AS fail_share,
              CAST(DENSE_RANK() OVER (PARTITION BY area_id ORDER BY failed / documents DESC) AS BIGINT) AS rank
       FROM (SELECT area_id, source, COUNT(*) AS documents, CAST(COUNT(*) FILTER (WHERE status = 'fail') AS BIGINT) AS failed
             FROM c_areas a JOIN documents d ON a.doc_id = d.doc_id GROUP BY area_id, source) s) r""",
)
