"""Registered queries: remediation, comparison and the review ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions.text import status_label
from claridoc.operators import criteria, ledger, probe, remediation
from claridoc.plans import audit
from claridoc.plans.check_views import CHECK_VIEWS, quoted, values
from claridoc.plans.registry import query

_OPEN = "(verdict <> 'passed' OR needs_human)"
_CODE = "split_part(criterion, ' ', 1)"
CHECK_VIEWS["c_steps_dim"] = values([(k, *v) for k, v in fv.REPAIRS.items()], "sc, step, automation_confidence, human_qa_required")
CHECK_VIEWS["c_plan"] = f"""
    SELECT doc_id, ord, criterion, COALESCE(s.step, 'Remediate ' || criterion || '.') AS step, COALESCE(s.automation_confidence, 'low') AS automation_confidence,
           COALESCE(s.human_qa_required, TRUE) AS human_qa_required FROM c_criteria c LEFT JOIN c_steps_dim s ON {_CODE} = s.sc WHERE {_OPEN}"""


def plan(d):
    return remediation.repair_plan(audit.audit_rows(d))


query("d1_repair_plan", plan, "SELECT * FROM c_plan")
_D = {k: (v if isinstance(v, str) else " | ".join(v)) for k, v in remediation.DRAFT_ROW.items()}
query(
    "d2_phase_rows",
    lambda d: remediation.phase_rows(audit.audit_rows(d)),
    f"""SELECT doc_id, ord, criterion AS area, 'WCAG ' || {_CODE} AS refs, CASE WHEN verdict = 'passed' AND NOT needs_human THEN 'passed' WHEN verdict = 'not_present' THEN 'not_applicable' ELSE 'review' END AS status,
               CASE WHEN needs_human THEN 'human' ELSE 'machine' END AS source, replace(detail, ' | ', ' ') AS evidence, rationale FROM c_criteria
        UNION ALL SELECT DISTINCT doc_id, 7, {quoted(_D['area'])}, {quoted(_D['refs'])}, 'draft', 'draft', {quoted(_D['evidence'])}, {quoted(_D['rationale'])} FROM c_criteria WHERE {_OPEN}""",
)
CHECK_VIEWS["c_content"] = f"""
    SELECT doc_id, ord, 'criterion-' || replace({_CODE}, '.', '-') || '-' || ord AS id, CASE {_CODE} WHEN '2.4.2' THEN 'metadata' WHEN '1.1.1' THEN 'figure' WHEN '1.3.1' THEN 'table' ELSE 'review-note' END AS role,
           criterion || ': ' || rationale AS text, 'WCAG ' || {_CODE} AS refs, 'audit-evidence' AS source, needs_human FROM c_criteria
    UNION ALL SELECT DISTINCT doc_id, 0, 'title', 'heading', 'Accessible HTML draft for ' || doc_id, 'WCAG 2.4.2', 'audit-evidence', FALSE FROM c_criteria"""
query("d3_content_layer", lambda d: remediation.content_layer(audit.audit_rows(d)), "SELECT * FROM c_content")
query(
    "d4_tag_plan",
    lambda d: remediation.tag_plan(remediation.content_layer(audit.audit_rows(d))),
    """SELECT doc_id, ord, 'tag-' || id AS id, CASE role WHEN 'heading' THEN 'h1' WHEN 'list' THEN 'ul/li' WHEN 'table' THEN 'table/th/td' ELSE 'p' END AS html,
              CASE role WHEN 'heading' THEN 'H1' WHEN 'table' THEN 'Table' WHEN 'figure' THEN 'Figure' WHEN 'metadata' THEN 'DocumentInfo' ELSE 'P' END AS pdf_tag, id AS source_id, needs_human FROM c_content""",
)


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_NL = "chr(10)"
_H = [quoted(x) for x in remediation.DRAFT_HEAD]
_ANCHOR = f"'criterion-' || replace({_CODE}, '.', '-') || '-' || ord || '-heading'"
query(
    "d5_html_draft",
    lambda d: remediation.html_draft(audit.audit_results(d), d("second_facts").select("doc_id", F.col("url").alias("pdf_url"))),
    f"""SELECT c.doc_id, {_H[0]} || {_NL} || {_H[1]} || CASE WHEN ANY_VALUE(s.url) IS NULL THEN 'source PDF' ELSE split_part(ANY_VALUE(s.url), '?', 1) || CASE WHEN contains(ANY_VALUE(s.url), '?') THEN ' (query redacted)' ELSE '' END END
          || {_H[2]} || {_NL} || {_H[3]} || {_NL} || {_H[4]} || {_NL} || {_H[5]} || COUNT(*) FILTER (WHERE {_OPEN}) || {_H[6]} || {_NL}
          || '    <ul>' || string_agg('<li><strong>' || {_esc('criterion')} || '</strong><br><span>' || {_esc('rationale')} || '</span></li>', '' ORDER BY ord) || '</ul>' || {_NL}
          || '  </section>' || {_NL} || '  <section aria-labelledby="a11y-repair-plan">' || {_NL} || '    <h2 id="a11y-repair-plan">Repair plan</h2>' || {_NL}
          || '    <ol>' || COALESCE(string_agg('<li><strong>' || {_esc('criterion')} || '</strong><br>' || {_esc('step')} || '</li>', '' ORDER BY ord) FILTER (WHERE {_OPEN}), {quoted(remediation.DRAFT_NO_REPAIR)}) || '</ol>' || {_NL}
          || '  </section>' || {_NL} || '  <section aria-labelledby="a11y-content-layer">' || {_NL} || '    <h2 id="a11y-content-layer">Cited content layer</h2>' || {_NL}
          || string_agg('<section aria-labelledby="' || {_ANCHOR} || '"><h2 id="' || {_ANCHOR} || '">WCAG ' || {_CODE} || '</h2><p>' || {_esc("criterion || ': ' || rationale")} || '</p></section>', {_NL} ORDER BY ord) || {_NL}
          || '  </section>' || {_NL} || {quoted(remediation.DRAFT_TAIL)} || {_NL} || '</article>' AS html
        FROM c_criteria c LEFT JOIN c_steps_dim p ON {_CODE} = p.sc LEFT JOIN second_facts s ON s.doc_id = c.doc_id GROUP BY c.doc_id""",
)
CHECK_VIEWS["c_counts"] = f"""
    SELECT c.doc_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE {_OPEN}) AS bad, COUNT(*) FILTER (WHERE needs_human) AS hum,
           COUNT(*) FILTER (WHERE {_OPEN} AND {_CODE} IN ('1.1.1', '1.3.1', '1.3.2', '2.4.2')) AS structural, ANY_VALUE(s.url) AS url, ANY_VALUE(s.error) AS error,
           split_part(ANY_VALUE(s.url), '?', 1) || CASE WHEN contains(ANY_VALUE(s.url), '?') THEN ' (query redacted)' ELSE '' END AS shown
    FROM c_criteria c LEFT JOIN (SELECT doc_id, url, error FROM second_facts) s ON s.doc_id = c.doc_id GROUP BY c.doc_id"""
_SUM = f"""SELECT doc_id, CASE WHEN bad > 0 THEN 'needs_review' ELSE 'ready_for_review' END AS status, url AS fixed_pdf,
    CASE WHEN url IS NULL THEN {quoted(remediation.NOTE_HTML_ONLY)} ELSE {quoted(remediation.NOTE_HTML_ADOPTED[0])} || shown || '.' END AS note"""
query(
    "d6_html_summary",
    lambda d: remediation.html_summary(audit.audit_rows(d), d("second_facts")),
    f"""{_SUM}, 'Draft blocks' AS label, n + 1 AS value, 'neutral' AS tone FROM c_counts UNION ALL {_SUM}, 'Repair items', bad, CASE WHEN bad > 0 THEN 'warn' ELSE 'pass' END FROM c_counts
        UNION ALL {_SUM}, 'Needs review', hum, CASE WHEN hum > 0 THEN 'warn' ELSE 'pass' END FROM c_counts""",
)
query(
    "d7_remediation_status",
    lambda d: remediation.remediation_status(d("documents"), d("second_facts")),
    f"""SELECT doc_id, CASE WHEN url IS NULL THEN 'candidate' ELSE 'remediated' END AS status, url AS fixed_pdf,
              CASE WHEN url IS NULL THEN {quoted(remediation.NOTE_CANDIDATE)} ELSE {quoted(remediation.NOTE_ADOPTED[0])} || shown || {quoted(remediation.NOTE_ADOPTED[1])} END AS note FROM c_counts""",
)


def delta(d):
    second = d("second_facts")
    return remediation.validation_delta(audit.audit_rows(d), second, criteria.structure_only(second))


_W = remediation
CHECK_VIEWS["c_delta"] = f"""
    SELECT k.doc_id, CASE WHEN url IS NOT NULL AND error IS NULL THEN structural ELSE bad END AS before, CASE WHEN url IS NOT NULL AND error IS NULL THEN after_n END AS after,
           CASE WHEN url IS NULL THEN {quoted(_W.NOTE_NO_V2[0])} || (n + 1) || {quoted(_W.NOTE_NO_V2[1])} || (n + 1) || {quoted(_W.NOTE_NO_V2[2])}
                WHEN error IS NOT NULL THEN {quoted(_W.NOTE_FAILED[0])} || error || {quoted(_W.NOTE_FAILED[1])}
                ELSE {quoted(_W.NOTE_DELTA[0])} || (structural - after_n) || {quoted(_W.NOTE_DELTA[1])} END AS note, 'deferred' AS visual_parity
    FROM c_counts k LEFT JOIN (SELECT doc_id, COUNT(*) FILTER (WHERE {_OPEN}) AS after_n FROM c_second GROUP BY doc_id) a ON a.doc_id = k.doc_id"""
query("d8_validation_delta", delta, "SELECT * FROM c_delta")


def second_scores(d):
    return probe.probe_score(d("second_facts"))


query(
    "d9_after_evidence",
    lambda d: remediation.after_evidence(d("second_facts"), second_scores(d), criteria.structure_only(d("second_facts"))),
    f"""SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS ord, 'validator' AS kind, criterion || ': ' || rationale AS detail, 'v2-reaudit' AS citation FROM c_second WHERE {_OPEN}
        UNION ALL SELECT s.doc_id, 0, 'measurement', 'V2 byte re-audit (structural criteria only): tagged=' || CASE WHEN openable AND has_struct_root AND marked THEN 'true' ELSE 'false' END || ', title=' ||
            CASE WHEN openable AND title <> '' THEN 'set' ELSE 'none' END || ', lang=' || COALESCE(CASE WHEN openable THEN lang END, 'none') || ', score=' ||
            COALESCE(CAST(CASE WHEN openable THEN GREATEST(0, 100 - CASE WHEN has_struct_root AND marked THEN 0 ELSE 18 END - CASE WHEN lang IS NULL THEN 18 ELSE 0 END - CASE WHEN encrypted THEN 6 ELSE 0 END) END AS VARCHAR), 'n/a')
            || '; ' || bad || '/4 byte criteria non-pass. (1.4.3 contrast + 4.1.2 validator NOT re-measured on V2 → delta is scoped to structure.)', 'v2-reaudit'
        FROM second_facts s JOIN (SELECT doc_id, COUNT(*) FILTER (WHERE {_OPEN}) AS bad FROM c_second GROUP BY doc_id) c ON s.doc_id = c.doc_id""",
)
query(
    "d10_review_rows",
    lambda d: remediation.review_rows(delta(d)),
    """SELECT doc_id, 'Validation delta' AS area, 'WCAG structural criteria' AS refs, CASE WHEN after IS NULL THEN 'deferred' ELSE 'passed' END AS status, 'machine' AS source, note AS evidence FROM c_delta
       UNION ALL SELECT doc_id, 'Visual parity', 'export snapshot', 'deferred', 'deferred', 'Pixel parity: deferred' FROM c_delta""",
)
query(
    "d11_legacy_rows",
    lambda d: remediation.legacy_rows(plan(d)),
    f"""SELECT doc_id, ord, criterion AS area, 'WCAG ' || {_CODE} AS refs, 'review' AS status, 'draft' AS source, step AS evidence,
              CASE WHEN human_qa_required THEN 'Human QA required.' ELSE 'Machine-derived repair item.' END AS rationale FROM c_plan""",
)
query(
    "d11_legacy_card",
    lambda d: remediation.legacy_card(d("documents"), plan(d), d("second_facts")),
    "SELECT doc_id, CASE WHEN url IS NULL THEN 'needs_review' ELSE 'ready_for_review' END AS status, 'Repair items' AS label, bad AS value, CASE WHEN bad > 0 THEN 'warn' ELSE 'pass' END AS tone FROM c_counts",
)

# ---- ledger


def steps(d):
    return ledger.step_state(d("runs"), d("runs").select("doc_id").distinct())


CHECK_VIEWS["c_step_marks"] = """
    SELECT doc_id, step, arg_max(status, (ts, event_id)) AS status, MAX(ts) FILTER (WHERE status = 'started') AS started_at, MAX(ts) FILTER (WHERE status = 'done') AS done_at FROM runs GROUP BY doc_id, step"""
CHECK_VIEWS["c_steps"] = f"""
    SELECT COALESCE(s.doc_id, m.doc_id) AS doc_id, COALESCE(s.step, m.step) AS step, COALESCE(m.status, 'pending') AS status, started_at, done_at
    FROM (SELECT DISTINCT doc_id, unnest([{', '.join(quoted(s) for s in fv.STEPS)}]) AS step FROM runs) s FULL OUTER JOIN c_step_marks m ON s.doc_id = m.doc_id AND s.step = m.step"""
query(
    "d12_step_components",
    lambda d: steps(d).join(F.broadcast(remediation.step_components(d.spark)), "step").groupBy("step", "kind", "routine_weight", "status").agg(
        F.countDistinct("component").alias("components"), F.countDistinct("doc_id").alias("documents")
    ),
    f"""SELECT s.step, kind, routine_weight, status, COUNT(DISTINCT component) AS components, COUNT(DISTINCT doc_id) AS documents FROM c_steps s JOIN (
        {values([(s, k, c, fv.STEP_WEIGHT[s]) for s, k, c in fv.STEP_COMPONENTS], 'step, kind, component, w')}) p ON s.step = p.step, LATERAL (SELECT w::DOUBLE AS routine_weight) GROUP BY ALL""",
)
query(
    "l1_ledger",
    lambda d: ledger.ledger(d("review_events")).select("doc_id", "event_id", "event", "agent", "seq"),
    "SELECT doc_id, event_id, event, agent, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS seq FROM review_events",
)
query(
    "l2_latest_rows",
    lambda d: ledger.latest_rows(d("runs"), ["verdict", "run"]),
    "SELECT doc_id, agent, ts, event_id, verdict, run FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, agent ORDER BY ts DESC, event_id DESC) AS rn FROM runs) r WHERE rn = 1",
)
query("l3_step_state", steps, "SELECT doc_id, step, status, started_at, done_at FROM c_steps")
CHECK_VIEWS["c_fsm"] = """
    SELECT doc_id, event_id, ts, event, CASE WHEN event = 'human.review.requested' THEN 'pending_review' WHEN COALESCE(prev, '') <> 'request' THEN 'no open gate' WHEN held THEN 'deferred' WHEN event = 'human.approved' THEN 'finalized' ELSE 'rejected' END AS outcome
    FROM (SELECT *, LAST_VALUE(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
          FROM (SELECT *, CASE WHEN event = 'human.review.requested' THEN 'request' WHEN NOT held THEN 'decision' END AS mark FROM review_events WHERE event LIKE 'human.%') a) b"""
query("l4_gate_fsm", lambda d: ledger.gate_fsm(d("review_events")).select("doc_id", "event_id", "event", "outcome"), "SELECT doc_id, event_id, event, outcome FROM c_fsm")
query(
    "l4_gate_now",
    lambda d: ledger.gate_now(ledger.gate_fsm(d("review_events"))),
    "SELECT doc_id, COALESCE(arg_max(outcome, (ts, event_id)) FILTER (WHERE outcome IN ('pending_review', 'finalized', 'rejected')), 'open') AS gate FROM c_fsm GROUP BY doc_id",
)


def decisions(d):
    return d("review_events").filter(F.col("event").isin(ledger.APPROVED, ledger.REJECTED)).select(
        "doc_id", "ts", "event_id", F.when(F.col("event") == ledger.APPROVED, "approve").otherwise("reject").alias("decision"), F.concat(F.lit("by "), F.col("agent")).alias("note")
    )


query(
    "l5_record_decide",
    lambda d: ledger.record_decide(probe.audit_record(d("probe_facts")), decisions(d)),
    """SELECT l.doc_id, CASE WHEN known THEN CASE WHEN ok THEN 'finalized' ELSE 'rejected' END END AS gate, CASE WHEN known THEN CASE WHEN ok THEN 'Attested' ELSE 'Audited' END END AS tier,
              CASE WHEN known THEN ok END AS finalized, CASE WHEN known THEN ts END AS decided_at, CASE WHEN known THEN 'by ' || agent END AS note, CASE WHEN NOT known THEN 'no_audit_record' END AS error
       FROM (SELECT r.*, event = 'human.approved' AS ok, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = r.doc_id) AS known,
                    ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS rn FROM review_events r WHERE event IN ('human.approved', 'human.rejected')) l WHERE rn = 1""",
)
_SLA = """SELECT doc_id, event_id, ts AS requested_at, ts + INTERVAL 7 DAY AS deadline,
       CASE WHEN nts <= ts + INTERVAL 7 DAY THEN CASE WHEN nev = 'human.review.requested' THEN 'superseded' ELSE 'decided' END WHEN {later} THEN 'open' ELSE 'elapsed' END AS outcome
       FROM (SELECT *, LEAD(ts) OVER w AS nts, LEAD(event) OVER w AS nev FROM review_events WHERE event LIKE 'human.%' AND (event = 'human.review.requested' OR NOT held) WINDOW w AS (PARTITION BY doc_id ORDER BY ts, event_id)) x WHERE event = 'human.review.requested'"""
query("l6_review_sla", lambda d: ledger.review_sla(d("review_events"), as_of=datetime(2024, 1, 31)), _SLA.format(later="ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-31'"))
query(
    "l7_pending_domains",
    lambda d: ledger.pending_domains(
        d("runs").select("doc_id", F.col("agent").alias("domain")), d("workflow_events").filter("kind = 'completed'"),
        ledger.latest_rows(d("runs"), ["verdict"]).withColumn("needs_human", F.lit(False)), ledger.parked(d("workflow_events")),
    ),
    """SELECT g.doc_id, COALESCE(n, 0) AS n_pending, CASE WHEN COALESCE(n, 0) > 0 THEN 'open' WHEN clean AND p.doc_id IS NULL THEN 'finalized' ELSE 'pending_review' END AS gate
       FROM (SELECT doc_id, bool_and(verdict = 'passed') AS clean FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, agent ORDER BY ts DESC, event_id DESC) AS rn FROM runs) r WHERE rn = 1 GROUP BY doc_id) g
       LEFT JOIN (SELECT r.doc_id, COUNT(*) AS n FROM (SELECT DISTINCT doc_id, agent FROM runs) r LEFT JOIN (SELECT DISTINCT doc_id, domain FROM workflow_events WHERE kind = 'completed') w
                  ON r.doc_id = w.doc_id AND r.agent = w.domain WHERE w.doc_id IS NULL GROUP BY r.doc_id) m ON g.doc_id = m.doc_id
       LEFT JOIN (SELECT DISTINCT doc_id FROM c_parked) p ON g.doc_id = p.doc_id""",
)
CHECK_VIEWS["c_parked"] = """
    SELECT doc_id, workflow_id, domain FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, workflow_id ORDER BY ts DESC, event_id DESC) AS rn FROM workflow_events
        WHERE NOT (kind = 'release' AND message IS NOT NULL AND NOT regexp_matches(lower(message), 'not found|does not exist|terminated|completed'))) w WHERE rn = 1 AND kind = 'parked'"""
query("l8_parked", lambda d: ledger.parked(d("workflow_events")), "SELECT doc_id, workflow_id, domain FROM c_parked")
query(
    "l9_supersede",
    lambda d: ledger.supersede(d("runs"), d("runs").filter("verdict = 'failed' AND step = 'compare'")).select("doc_id", "run", "event_id"),
    """SELECT r.doc_id, r.run, r.event_id FROM runs r JOIN (SELECT n.doc_id, LEAST(newest, COALESCE(stuck, newest)) AS run FROM (SELECT doc_id, MAX(run) AS newest FROM runs GROUP BY doc_id) n
       LEFT JOIN (SELECT doc_id, MIN(run) AS stuck FROM runs WHERE verdict = 'failed' AND step = 'compare' GROUP BY doc_id) s ON n.doc_id = s.doc_id) k ON r.doc_id = k.doc_id AND r.run = k.run""",
)
query(
    "l10_lifecycle_map",
    lambda d: ledger.lifecycle_map(d("progress")).select("doc_id", "event_id", "agent", "ord", "event", "detail"),
    """SELECT doc_id, event_id, domain AS agent, CAST(0 AS BIGINT) AS ord, CASE WHEN phase = 'row.ready' THEN 'machine.pre_assessment' ELSE phase END AS event, CASE WHEN phase = 'row.ready' THEN 'verdict=' || verdict || ' (' || rationale || ')' END AS detail
       FROM progress WHERE workflow = 'SPECIALIST_WORKFLOW' AND phase IN ('routine.started', 'routine.done', 'turn.started', 'turn.done', 'row.ready')
       UNION ALL SELECT doc_id, event_id, domain, 1, 'human.review.requested', rationale FROM progress WHERE workflow = 'SPECIALIST_WORKFLOW' AND phase = 'row.ready' AND needs_human""",
)
query(
    "l11_event_feed",
    lambda d: ledger.event_feed(d("review_events")).select("doc_id", "rank", "event_id", "event", "class"),
    """SELECT doc_id, rank, event_id, event, CASE WHEN event LIKE 'human%' THEN 'human' WHEN event LIKE '%_.done%' THEN 'done' ELSE '' END AS class
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS rank FROM review_events) r""",
)
query(
    "l12_context_summary",
    lambda d: ledger.context_summary(ledger.gate_now(ledger.gate_fsm(d("review_events"))), steps(d), audit.audit_rollup(d), audit.audit_rows(d), d("review_events")),
    """SELECT g.doc_id, g.gate, COALESCE(s.steps, 'none yet') AS steps,
              CASE WHEN r.doc_id IS NULL THEN 'WCAG rollup: not run yet' ELSE 'WCAG 2.2 AA rollup — total ' || total || ', pass ' || passed || ', fail ' || failed || ', needs-human ' || needs_human || ', n/a ' || not_applicable END AS rollup,
              COALESCE(n, 0) AS n_rows, COALESCE(recent, 'none') AS recent
       FROM (SELECT doc_id, COALESCE(arg_max(outcome, (ts, event_id)) FILTER (WHERE outcome IN ('pending_review', 'finalized', 'rejected')), 'open') AS gate FROM c_fsm GROUP BY doc_id) g
       LEFT JOIN (SELECT doc_id, string_agg(step || ':' || status, ', ' ORDER BY CASE step WHEN 'audit' THEN 1 WHEN 'create-html' THEN 2 WHEN 'review-pdf' THEN 3 ELSE 99 END, step) AS steps FROM c_steps GROUP BY doc_id) s ON g.doc_id = s.doc_id
       LEFT JOIN c_summary r ON g.doc_id = r.doc_id LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM c_criteria GROUP BY doc_id) c ON g.doc_id = c.doc_id
       LEFT JOIN (SELECT doc_id, string_agg(event, ', ' ORDER BY ts, event_id) AS recent FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS rn FROM review_events) x WHERE rn <= 6 GROUP BY doc_id) e ON g.doc_id = e.doc_id""",
)
query(
    "l13_chat_turns",
    lambda d: ledger.chat_turns(d("conversations")),
    "SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN trim(text) ELSE text END AS text FROM conversations WHERE role <> 'user' OR trim(text) <> ''",
)
query(
    "l13_chat_state",
    lambda d: ledger.chat_state(d("conversations")),
    "SELECT conv_id, COUNT(*) AS n_turns, arg_max(role, turn) = 'user' AS thinking FROM conversations WHERE role <> 'user' OR trim(text) <> '' GROUP BY conv_id",
)
query(
    "l14_phase_done",
    lambda d: ledger.phase_done(steps(d), d("workflow_events").filter("kind = 'completed'").select("doc_id", F.lit("review-pdf").alias("step"))),
    """SELECT doc_id, phase, bool_or(done) AS done FROM (
         SELECT doc_id, CASE step WHEN 'remediate' THEN 'create-html' WHEN 'compare' THEN 'review-pdf' ELSE step END AS phase, status = 'done' AS done FROM c_steps
         UNION ALL SELECT doc_id, 'review-pdf', TRUE FROM workflow_events WHERE kind = 'completed') x GROUP BY doc_id, phase""",
)
query(
    "l15_status_label",
    lambda d: audit.verdicts(d).select("doc_id", "sc", status_label(F.col("verdict")).alias("label")),
    "SELECT doc_id, sc, CASE verdict WHEN 'not_present' THEN 'n/a' WHEN 'cannot_tell' THEN 'needs human' ELSE replace(verdict, '_', ' ') END AS label FROM c_verdicts",
)
query(
    "l16_event_rates",
    lambda d: ledger.event_rates(d("review_events"), "6 hours"),
    "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event, COUNT(*) AS n FROM review_events GROUP BY ALL",
)
query(
    "l16_event_rates_sliding",
    lambda d: ledger.event_rates(d("review_events"), "1 day", "6 hours"),
    """SELECT start, event, COUNT(*) AS n FROM (SELECT event, unnest([b, b - INTERVAL 6 HOUR, b - INTERVAL 12 HOUR, b - INTERVAL 18 HOUR]) AS start
       FROM (SELECT event, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM review_events) a) w GROUP BY ALL""",
)
query(
    "e2e_remediation_report",
    audit.remediation_report,
    """SELECT k.doc_id, bad AS fail_count, 'pending_review' AS gate, CASE WHEN url IS NULL THEN 'candidate' ELSE 'remediated' END AS status, before, after FROM c_counts k JOIN c_delta d ON k.doc_id = d.doc_id""",
)
