"""Shared parts of the checking SQL. Only the checking database runs these texts."""

from __future__ import annotations

from claridoc.functions import fixed_values as fv


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def trim_ws(c: str) -> str:
    """The whitespace trim of the library, as SQL text."""
    codes = " || ".join(f"chr({ord(ch)})" for ch in fv.WHITESPACE)
    return f"trim({c}, {codes})"


_RULE = {k: v for k, v in fv.PROBE_RULES.items()}


def _rule_row(ord_: int, rule: str, where: str, n: str = "", m: str = "") -> str:
    criterion, severity, standard, text, impact, fix = _RULE[rule]
    message = quoted(text)
    if n:
        head, tail = text.replace("{n}", "").split("{m}")
        message = f"CAST({n} AS VARCHAR) || {quoted(head)} || CAST({m} AS VARCHAR) || {quoted(tail)}"
    return (
        f"SELECT doc_id, {ord_} AS rule_no, {quoted(criterion)} AS criterion, {quoted(severity)} AS severity, "
        f"{quoted(' | '.join(standard))} AS standard, {message} AS finding, {quoted(impact)} AS impact, {quoted(fix)} AS fix "
        f"FROM probe_facts WHERE {where}"
    )


def crit(code: str, via: str, verdict: str, human: str, detail: str, why: str) -> str:
    title = dict(fv.AUDITED)[code]
    return f"{quoted(title)} AS criterion, {via} AS via, {verdict} AS verdict, {human} AS needs_human, {detail} AS detail, {why} AS rationale"


_T = "(openable AND has_struct_root AND marked)"
_FIG = "CASE WHEN openable THEN figures ELSE 0 END"
_ALT = "CASE WHEN openable THEN figures_with_alt ELSE 0 END"
_TAB = "CASE WHEN openable THEN tables ELSE 0 END"
_TH = "CASE WHEN openable THEN tables_with_th ELSE 0 END"


def structure_criteria(table: str) -> dict[str, str]:
    """SQL of the four structure criteria over a facts table."""
    pre = (
        f"SELECT doc_id, {_T} AS t, openable AND has_struct_root AS sr, openable AND marked AS mk, {_FIG} AS f, {_ALT} AS fa, {_TAB} AS tb, {_TH} AS th, "
        f"CASE WHEN openable AND title <> '' THEN title END AS ttl, openable AND display_doc_title AS dd FROM {table}"
    )
    alt = crit(
        "1.1.1", "CASE WHEN f > 0 AND f - fa <= 0 THEN 'vlm-escalate' ELSE 'byte-probe' END",
        "CASE WHEN f = 0 THEN 'not_present' WHEN f - fa > 0 THEN 'failed' ELSE 'cannot_tell' END", "f <> 0",
        "CASE WHEN f = 0 THEN 'No tagged Figure elements found in the structure tree.' WHEN f - fa > 0 THEN (f - fa) || ' of ' || f || ' tagged figures have no /Alt.' "
        "ELSE fa || '/' || f || ' figures have /Alt present; description QUALITY not machine-verifiable.' END",
        "CASE WHEN f = 0 THEN 'No tagged figures → no /Alt to assess at the byte level.' WHEN f - fa > 0 THEN (f - fa) || '/' || f || ' figures missing /Alt (WCAG 1.1.1 fail at presence level).' "
        "ELSE 'All figures have /Alt present, but alt-text QUALITY needs a VLM judge (deferred) → human review.' END",
    )
    bad = "(tb > 0 AND tb - th > 0)"
    struct = crit(
        "1.3.1", "'byte-probe'", f"CASE WHEN NOT t OR {bad} THEN 'failed' ELSE 'passed' END", f"NOT t OR {bad}",
        "CASE WHEN NOT t THEN 'tagged=false, StructTreeRoot=' || CASE WHEN sr THEN 'true' ELSE 'false' END || ', Marked=' || CASE WHEN mk THEN 'true' ELSE 'false' END "
        f"WHEN {bad} THEN (tb - th) || ' of ' || tb || ' tables have no header (TH) cells.' ELSE 'tagged=true; tables=' || tb || ' (all with TH where present).' END",
        "CASE WHEN NOT t THEN 'PDF is untagged (no usable StructTreeRoot) → structure/relationships lost (WCAG 1.3.1 fail).' "
        f"WHEN {bad} THEN (tb - th) || '/' || tb || ' tables missing TH headers → cell relationships lost (WCAG 1.3.1 fail).' "
        "ELSE 'Document is tagged and tables (if any) have header cells — WCAG 1.3.1 structure present.' END",
    )
    seq = crit(
        "1.3.2", "'vlm-escalate'", "'cannot_tell'", "TRUE",
        "CASE WHEN t THEN 'Tagged; reading-order correctness requires a VLM vs render diff.' ELSE 'Untagged; no defined reading order.' END",
        "CASE WHEN t THEN 'Reading order is a visual judgment — VLM vs reading-order pre-assessment is deferred → human review.' "
        "ELSE 'Untagged document has no defined reading order → human review.' END",
    )
    title = crit(
        "2.4.2", "'byte-probe'", "CASE WHEN ttl IS NULL OR NOT dd THEN 'failed' ELSE 'passed' END", "ttl IS NULL OR NOT dd",
        "CASE WHEN ttl IS NULL THEN 'No document Title in metadata.' WHEN NOT dd THEN 'Title=\"' || ttl || '\" but DisplayDocTitle is not enabled.' "
        "ELSE 'Title=\"' || ttl || '\"; DisplayDocTitle=true.' END",
        "CASE WHEN ttl IS NULL THEN 'No document Title → window/tab shows the filename (WCAG 2.4.2 fail).' "
        "WHEN NOT dd THEN 'Title set but ViewerPreferences /DisplayDocTitle is off → viewers show the filename (WCAG 2.4.2 fail).' "
        "ELSE 'Document has a Title and DisplayDocTitle is enabled — WCAG 2.4.2 satisfied.' END",
    )
    return {k: f"SELECT doc_id, {v} FROM ({pre}) p" for k, v in (("1.1.1", alt), ("1.3.1", struct), ("1.3.2", seq), ("2.4.2", title))}


_S = structure_criteria("probe_facts")
_S2 = structure_criteria("second_facts")
_LOST = "(c.verdict IS NULL OR c.error IS NOT NULL)"


def _lane(code: str, lane: str, name: str, table: str) -> str:
    title = dict(fv.AUDITED)[code]
    return (
        f"SELECT p.doc_id, {quoted(title)} AS criterion, CASE WHEN {_LOST} THEN '{lane}-error' ELSE '{lane}' END AS via, "
        f"CASE WHEN {_LOST} THEN 'cannot_tell' ELSE c.verdict END AS verdict, CASE WHEN {_LOST} THEN TRUE ELSE c.needs_human END AS needs_human, "
        f"CASE WHEN {_LOST} THEN '{lane} facet error: ' || COALESCE(c.error, 'no result') ELSE c.detail END AS detail, "
        f"CASE WHEN {_LOST} THEN '{name} lane failed (facet error) — escalated for human review (fail-closed).' ELSE c.rationale END AS rationale "
        f"FROM probe_facts p LEFT JOIN {table} c ON p.doc_id = c.doc_id"
    )


_OPEN = "(verdict <> 'passed' OR needs_human)"

CHECK_VIEWS: dict[str, str] = {
    "c_findings": f"""
        SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY rule_no) AS ord, criterion, severity, standard, finding, impact, fix FROM (
        {_rule_row(0, 'unopenable', 'NOT openable')} UNION ALL
        {_rule_row(1, 'unmarked', 'openable AND has_struct_root AND NOT marked')} UNION ALL
        {_rule_row(1, 'untagged', 'openable AND NOT has_struct_root')} UNION ALL
        {_rule_row(2, 'no_lang', "openable AND COALESCE(lang, '') = ''")} UNION ALL
        {_rule_row(3, 'no_title', "openable AND COALESCE(title, '') = ''")} UNION ALL
        {_rule_row(3, 'title_hidden', "openable AND title <> '' AND NOT display_doc_title")} UNION ALL
        {_rule_row(4, 'encrypted', 'openable AND encrypted')} UNION ALL
        {_rule_row(5, 'figures_no_alt', 'openable AND figures > 0 AND figures > figures_with_alt', 'figures - figures_with_alt', 'figures')} UNION ALL
        {_rule_row(6, 'tables_no_th', 'openable AND tables > 0 AND tables > tables_with_th', 'tables - tables_with_th', 'tables')}) r""",
    "c_scores": """
        SELECT p.doc_id, CASE WHEN openable THEN CAST(GREATEST(0, 100 - COALESCE(lost, 0)) AS BIGINT) END AS score
        FROM probe_facts p LEFT JOIN (SELECT doc_id, SUM(CASE severity WHEN 'error' THEN 18 ELSE 6 END) AS lost FROM c_findings GROUP BY doc_id) f
        ON p.doc_id = f.doc_id""",
    "c_reasons": f"""
        SELECT p.doc_id, COALESCE(f.reasons, '') || CASE WHEN {_T} THEN CASE WHEN f.reasons IS NULL THEN '' ELSE ' | ' END || {quoted(fv.READING_ORDER_REASON)} ELSE '' END AS review_reasons,
               f.reasons IS NOT NULL OR {_T} AS is_open
        FROM probe_facts p LEFT JOIN (SELECT doc_id, string_agg(criterion || ': ' || finding, ' | ' ORDER BY ord) AS reasons
                                      FROM c_findings WHERE severity = 'error' GROUP BY doc_id) f ON p.doc_id = f.doc_id""",
    "c_lanes": """
        SELECT doc_id, lane,
               CASE WHEN NOT available THEN NULL WHEN pass IS NOT NULL THEN pass WHEN n_failures IS NOT NULL THEN n_failures = 0
                    WHEN gate <> '' THEN gate = 'finalized' WHEN tagged IS NOT NULL THEN tagged AND n_error = 0 END AS ok,
               CASE WHEN NOT available THEN 'unavailable' WHEN pass THEN 'pass' WHEN NOT pass THEN 'fail' ELSE COALESCE(gate, 'ran') END AS lane_state
        FROM validator_lanes""",
    "c_wide": """
        SELECT COALESCE(v.doc_id, p.doc_id) AS doc_id, v.ok AS a, p.ok AS b, v.lane_state AS sa, p.lane_state AS sb
        FROM (SELECT * FROM c_lanes WHERE lane = 'verapdf') v FULL OUTER JOIN (SELECT * FROM c_lanes WHERE lane = 'pac') p ON v.doc_id = p.doc_id""",
    "c_reconciled": f"""
        SELECT doc_id, a, b, sa, sb, CASE WHEN a = b THEN 'completed' ELSE 'input_required' END AS state,
               CASE WHEN a IS NULL AND b IS NULL THEN 'cannot_tell' WHEN a IS NULL OR b IS NULL OR a = b THEN CASE WHEN COALESCE(a, b) THEN 'passed' ELSE 'failed' END ELSE 'cannot_tell' END AS verdict,
               CASE WHEN a IS NULL AND b IS NULL THEN 0.0 WHEN a IS NULL OR b IS NULL THEN 0.5 WHEN a = b THEN 0.95 ELSE 0.3 END::DOUBLE AS confidence,
               a IS NULL OR b IS NULL OR a <> b AS needs_human,
               'veraPDF lane: ' || CASE WHEN a IS NULL THEN 'unavailable' WHEN a THEN 'pass' ELSE 'fail' END || ' | PAC lane: ' || CASE WHEN b IS NULL THEN 'unavailable' WHEN b THEN 'pass' ELSE 'fail' END AS detail,
               CASE WHEN a IS NULL OR b IS NULL THEN {quoted(fv.RECONCILE_TEXT['single'])} WHEN a AND b THEN {quoted(fv.RECONCILE_TEXT['both_pass'])}
                    WHEN a = b THEN {quoted(fv.RECONCILE_TEXT['both_fail'])} ELSE {quoted(fv.RECONCILE_TEXT['disagree'])} END AS rationale,
               CAST(NULL AS VARCHAR) AS error
        FROM c_wide""",
    "c_alt": _S["1.1.1"], "c_structure": _S["1.3.1"], "c_sequence": _S["1.3.2"], "c_title": _S["2.4.2"],
    "c_contrast": _lane("1.4.3", "contrast", "Contrast", "contrast_lane"),
    "c_validator": _lane("4.1.2", "validator", "Validator", "c_reconciled"),
    "c_criteria": """
        SELECT CAST(1 AS BIGINT) AS ord, * FROM c_alt UNION ALL SELECT 2, * FROM c_structure UNION ALL SELECT 3, * FROM c_sequence
        UNION ALL SELECT 4, * FROM c_contrast UNION ALL SELECT 5, * FROM c_title UNION ALL SELECT 6, * FROM c_validator""",
    "c_second": f"""
        SELECT CAST(1 AS BIGINT) AS ord, * FROM ({_S2['1.1.1']}) a UNION ALL SELECT 2, * FROM ({_S2['1.3.1']}) b
        UNION ALL SELECT 3, * FROM ({_S2['1.3.2']}) c UNION ALL SELECT 4, * FROM ({_S2['2.4.2']}) d""",
    "c_gate": f"""
        SELECT doc_id, CAST(COUNT(*) FILTER (WHERE {_OPEN}) AS BIGINT) AS fail_count,
               CASE WHEN COUNT(*) FILTER (WHERE {_OPEN}) = 0 THEN 'finalized' ELSE 'pending_review' END AS gate
        FROM c_criteria GROUP BY doc_id""",
    "c_dim": values(
        [(i + 1, *r) for i, r in enumerate(fv.CRITERIA)],
        "sc_ord, sc, name, level, principle, guideline, applicable, reason, evidence_source, decidability, check_note",
    ),
    "c_bridge": values(
        [(a[0], i + 1, a[1], a[3], j + 1, sc) for i, a in enumerate(fv.AREAS) for j, sc in enumerate(a[2])],
        "area_id, area_ord, label, primary_standard, ord, sc",
    ),
    "c_verdicts": """
        SELECT d.doc_id, CAST(m.sc_ord AS BIGINT) AS sc_ord, m.sc, m.name, m.level, m.principle, m.applicable,
               CASE WHEN NOT m.applicable THEN 'not_present' WHEN c.verdict IS NOT NULL THEN c.verdict ELSE 'cannot_tell' END AS verdict,
               CASE WHEN NOT m.applicable THEN FALSE WHEN c.verdict IS NOT NULL THEN c.needs_human ELSE TRUE END AS needs_human,
               CASE WHEN m.applicable AND c.verdict IS NOT NULL THEN 'machine' ELSE 'human-only' END AS source,
               CASE WHEN m.applicable THEN c.via END AS via,
               CASE WHEN NOT m.applicable THEN m.reason WHEN c.verdict IS NOT NULL THEN c.rationale ELSE m.check_note END AS rationale
        FROM probe_facts d CROSS JOIN c_dim m LEFT JOIN c_criteria c ON c.doc_id = d.doc_id AND split_part(c.criterion, ' ', 1) = m.sc""",
    "c_areas": """
        SELECT doc_id, area_id, CAST(area_ord AS BIGINT) AS area_ord, label, primary_standard,
               CASE WHEN NOT bool_or(applicable) THEN 'n/a' WHEN bool_or(applicable AND verdict = 'failed') THEN 'fail'
                    WHEN bool_or(applicable AND needs_human) THEN 'pending-human-review' ELSE 'pass' END AS status
        FROM c_verdicts v JOIN c_bridge b ON v.sc = b.sc GROUP BY doc_id, area_id, area_ord, label, primary_standard""",
    "c_summary": """
        SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS total,
               CAST(COUNT(*) FILTER (WHERE applicable AND verdict <> 'failed' AND NOT needs_human) AS BIGINT) AS passed,
               CAST(COUNT(*) FILTER (WHERE applicable AND verdict = 'failed') AS BIGINT) AS failed,
               CAST(COUNT(*) FILTER (WHERE applicable AND verdict <> 'failed' AND needs_human) AS BIGINT) AS needs_human,
               CAST(COUNT(*) FILTER (WHERE NOT applicable) AS BIGINT) AS not_applicable
        FROM c_verdicts GROUP BY doc_id""",
}
