"""Registered queries: contrast measurement and its decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from claridoc.functions import color
from claridoc.functions import fixed_values as fv
from claridoc.operators import contrast, reconcile
from claridoc.plans import audit
from claridoc.plans.check_views import CHECK_VIEWS, quoted, trim_ws
from claridoc.plans.queries_audit import details
from claridoc.plans.registry import query


def _lin(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE <= 0.03928 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def _lum(r: str, g: str, b: str) -> str:
    return f"(0.2126::DOUBLE * {_lin(r)} + 0.7152::DOUBLE * {_lin(g)} + 0.0722::DOUBLE * {_lin(b)})"


def _hex(c: str, start: int) -> str:
    digits = "'0123456789abcdef'"
    return f"CAST((strpos({digits}, substr(lower({c}), {start}, 1)) - 1) * 16 + strpos({digits}, substr(lower({c}), {start + 1}, 1)) - 1 AS BIGINT)"


def _ratio(a: str, b: str) -> str:
    return f"((GREATEST({a}, {b}) + 0.05::DOUBLE) / (LEAST({a}, {b}) + 0.05::DOUBLE))"


def _round2(c: str) -> str:
    return f"(floor({c} * 100 + 0.5::DOUBLE) / 100.0::DOUBLE)"


def _num(c: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.2f', {c}), '0+$', ''), '\\.$', '')"


_LARGE = "COALESCE(page_point_width > 0 AND (font_size_px * page_point_width / pw >= 18 OR (font_size_px * page_point_width / pw >= 14 AND bold)), FALSE)"

CHECK_VIEWS.update(
    {
        "c_ink": f"SELECT *, {_lum('cr', 'cg', 'cb')} AS ink FROM (SELECT *, {_hex('color', 2)} AS cr, {_hex('color', 4)} AS cg, {_hex('color', 6)} AS cb FROM text_spans) i",
        "c_boxes": """
            SELECT s.page_id, span_idx, text, color, ink, font_size_px, bold, page_point_width, m.width AS pw,
                   CAST(GREATEST(0, floor(s.x)) AS BIGINT) AS x0, CAST(GREATEST(0, floor(s.y)) AS BIGINT) AS y0,
                   CAST(LEAST(m.width, ceil(s.x + s.width)) AS BIGINT) AS x1, CAST(LEAST(m.height, ceil(s.y + s.height)) AS BIGINT) AS y1
            FROM c_ink s JOIN page_meta m ON s.page_id = m.page_id""",
        "c_hits": """
            SELECT b.page_id, span_idx, ink, p.r, p.g, p.b, p.a FROM c_boxes b JOIN bg_pixels p
            ON b.page_id = p.page_id AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1 WHERE x1 > x0 AND y1 > y0""",
        "c_ranked": f"""
            SELECT page_id, span_idx, ratio, ROW_NUMBER() OVER (PARTITION BY page_id, span_idx ORDER BY ratio) - 1 AS i, COUNT(*) OVER (PARTITION BY page_id, span_idx) AS n
            FROM (SELECT page_id, span_idx, {_ratio('ink', _lum('r', 'g', 'b'))} AS ratio FROM c_hits WHERE a = 255) q""",
        "c_spans": f"""
            SELECT b.page_id, b.span_idx, text, color, x0, y0, x1, y1, worst_ratio, median_ratio, {_LARGE} AS large_text,
                   CASE WHEN {_LARGE} THEN 3.0 ELSE 4.5 END::DOUBLE AS threshold, worst_ratio >= CASE WHEN {_LARGE} THEN 3.0 ELSE 4.5 END AS passes
            FROM c_boxes b JOIN (SELECT page_id, span_idx, MAX({_round2('ratio')}) FILTER (WHERE i = n // 50) AS worst_ratio, MAX({_round2('ratio')}) FILTER (WHERE i = n // 2) AS median_ratio
                                 FROM c_ranked GROUP BY page_id, span_idx) s ON b.page_id = s.page_id AND b.span_idx = s.span_idx""",
        "c_approx": f"""
            SELECT page_id, span_idx, text, color, CAST(floor(x) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) AS y0,
                   CAST(ceil(x + width) AS BIGINT) AS x1, CAST(ceil(y + height) AS BIGINT) AS y1, {_round2(_ratio('ink', _lum('255', '255', '255')))} AS worst_ratio,
                   {_round2(_ratio('ink', _lum('255', '255', '255')))} AS median_ratio, FALSE AS large_text, 4.5::DOUBLE AS threshold,
                   {_round2(_ratio('ink', _lum('255', '255', '255')))} >= 4.5 AS passes FROM c_ink""",
        "c_lane_spans": """
            SELECT s.* FROM c_spans s JOIN page_meta m ON s.page_id = m.page_id WHERE layer_status = 'ok'
            UNION ALL SELECT s.* FROM c_approx s JOIN page_meta m ON s.page_id = m.page_id WHERE layer_status = 'undecodable'""",
        "c_exact_pages": f"""SELECT m.page_id, CASE WHEN t.page_id IS NOT NULL THEN {quoted(fv.CONTRAST_METHOD['transparent'])} END AS flaw
            FROM page_meta m LEFT JOIN (SELECT DISTINCT page_id FROM c_hits WHERE a < 255) t ON m.page_id = t.page_id""",
        "c_lane_pages": f"""SELECT m.page_id, CASE WHEN layer_status <> 'ok' THEN {quoted(fv.CONTRAST_METHOD['approx'])} WHEN t.page_id IS NOT NULL THEN {quoted(fv.CONTRAST_METHOD['transparent'])} END AS flaw
            FROM page_meta m LEFT JOIN (SELECT DISTINCT page_id FROM c_hits WHERE a < 255) t ON m.page_id = t.page_id""",
    }
)

_PAGE_COLS = (
    "page_id, n_spans, n_failing, min_worst_ratio, all_pass, any_fail, method, approximated, worst_text, worst_color, worst_x0, worst_y0, worst_x1, worst_y1, "
    "worst_ratio, worst_large, worst_threshold"
)


def _pages(pages: str, spans: str) -> str:
    return f"""
        SELECT p.page_id, COALESCE(n, 0) AS n_spans, COALESCE(k, 0) AS n_failing, lowest AS min_worst_ratio, COALESCE(n, 0) > 0 AND COALESCE(k, 0) = 0 AS all_pass,
               COALESCE(k, 0) > 0 AS any_fail, COALESCE(flaw, {quoted(fv.CONTRAST_METHOD['exact'])}) AS method, flaw IS NOT NULL AS approximated,
               w.text AS worst_text, w.color AS worst_color, w.x0 AS worst_x0, w.y0 AS worst_y0, w.x1 AS worst_x1, w.y1 AS worst_y1,
               w.worst_ratio, w.large_text AS worst_large, w.threshold AS worst_threshold
        FROM {pages} p LEFT JOIN (SELECT page_id, COUNT(*) AS n, CAST(COUNT(*) FILTER (WHERE NOT passes) AS BIGINT) AS k, MIN(worst_ratio) AS lowest FROM {spans} GROUP BY page_id) s ON p.page_id = s.page_id
        LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY worst_ratio - threshold, span_idx) AS rn FROM {spans}) w ON p.page_id = w.page_id AND w.rn = 1"""


CHECK_VIEWS["c_page_exact"] = _pages("c_exact_pages", "c_spans")
CHECK_VIEWS["c_page_lane"] = _pages("c_lane_pages", "c_lane_spans")
CHECK_VIEWS["c_page_rows"] = f"""
    SELECT *, CASE WHEN n_spans = 0 OR approximated OR any_fail THEN 'input_required' ELSE 'completed' END AS state,
           CASE WHEN n_spans = 0 THEN 'not_present' WHEN approximated THEN 'cannot_tell' WHEN any_fail THEN 'failed' ELSE 'passed' END AS verdict,
           CASE WHEN n_spans = 0 OR approximated THEN 0.4 ELSE 0.9 END::DOUBLE AS confidence, n_spans = 0 OR approximated OR any_fail AS needs_human,
           CASE WHEN n_spans > 0 THEN 'worst-case span "' || worst_text || '" ' || worst_color || ' → ' || {_num('worst_ratio')} || ':1 (needs ' || {_num('worst_threshold')} || ':1'
                || CASE WHEN worst_large THEN ', large text' ELSE '' END || ') | ' ELSE '' END
           || n_spans || ' spans; min worst-case ' || COALESCE({_num('min_worst_ratio')}, 'n/a') || ':1; method=' || method AS detail,
           CASE WHEN n_spans = 0 THEN 'No text spans recovered from layerize — contrast not measurable; human confirm whether the page has real text.'
                WHEN approximated THEN 'Background could not be decoded per-pixel; measured against a representative bg color (approximation). ' ||
                     CASE WHEN any_fail THEN 'At least one span fails even approximated → likely fail.' ELSE 'Approximate pass — needs human confirm.' END
                WHEN any_fail THEN n_failing || '/' || n_spans || ' text span(s) below the WCAG 1.4.3 minimum; worst ' || {_num('worst_ratio')} || ':1 needs ' || {_num('worst_threshold')} || ':1.'
                ELSE 'All ' || n_spans || ' text span(s) meet WCAG 1.4.3; min worst-case ' || {_num('min_worst_ratio')} || ':1.' END AS rationale,
           CASE WHEN n_spans = 0 OR approximated THEN TRUE WHEN any_fail THEN FALSE ELSE worst_ratio - worst_threshold >= 0 AND worst_ratio - worst_threshold < 0.5 END AS borderline
    FROM c_page_lane"""
CHECK_VIEWS["c_turned"] = f"""
    SELECT r.*, d.action, d.error, d.page_id AS decided, d.action = 'accept' AND d.error IS NULL AND verdict = 'passed' AND NOT approximated AND n_spans > 0 AS ok,
           CASE WHEN d.page_id IS NULL THEN 'No decision given → escalated for human review.'
                WHEN d.error IS NOT NULL THEN 'LLM-decide error (' || d.error || ') → escalated.'
                WHEN d.action = 'accept' AND verdict = 'passed' AND NOT approximated AND n_spans > 0 THEN '(LLM-decide: accepted machine pre-assessment.)'
                WHEN d.action = 'accept' THEN 'LLM-decide returned accept on a non-pass/approximate measurement (verdict=' || verdict || ', approximated=' ||
                     CASE WHEN approximated THEN 'true' ELSE 'false' END || ') → escalated (deterministic verdict authoritative).'
                ELSE '(LLM-decide: escalate — ' || COALESCE(NULLIF(human_question, ''), CASE WHEN worst_text IS NOT NULL THEN 'Confirm the contrast of "' || worst_text || '" (' ||
                     {_num('worst_ratio')} || ':1, needs ' || {_num('worst_threshold')} || ':1).' ELSE 'Confirm the borderline contrast measurement.' END) || ')' END AS note
    FROM c_page_rows r LEFT JOIN completion_decisions d ON r.page_id = d.page_id"""

_SPAN = "page_id, span_idx, text, color, x0, y0, x1, y1, worst_ratio, median_ratio, large_text, threshold, passes"


def _variants(d):
    """Colours in long, short and broken spelling."""
    c = F.col("color")
    spelled = F.when(F.col("span_idx") % 3 == 0, c).when(F.col("span_idx") % 3 == 1, F.substring(c, 1, 4)).otherwise(F.concat(F.substring(c, 2, 5), F.lit("z")))
    return d("text_spans").select("page_id", "span_idx", spelled.alias("spelled"))


query(
    "k1_hex_to_rgb",
    lambda d: _variants(d).withColumn("rgb", color.hex_to_rgb(F.col("spelled"))).select("page_id", "span_idx", "spelled", "rgb.r", "rgb.g", "rgb.b"),
    f"""SELECT page_id, span_idx, spelled, CASE WHEN ok THEN {_hex('f', 1)} END AS r, CASE WHEN ok THEN {_hex('f', 3)} END AS g, CASE WHEN ok THEN {_hex('f', 5)} END AS b
        FROM (SELECT *, regexp_matches(f, '^[0-9a-fA-F]{{6}}$') AS ok FROM (
          SELECT page_id, span_idx, spelled, CASE WHEN length(s) = 3 THEN substr(s,1,1)||substr(s,1,1)||substr(s,2,1)||substr(s,2,1)||substr(s,3,1)||substr(s,3,1) ELSE s END AS f
          FROM (SELECT page_id, span_idx, spelled, ltrim(spelled, '#') AS s FROM (
            SELECT page_id, span_idx, CASE span_idx % 3 WHEN 0 THEN color WHEN 1 THEN substr(color, 1, 4) ELSE substr(color, 2, 5) || 'z' END AS spelled FROM text_spans) a) b) c) e""",
)
query(
    "k2_luminance",
    lambda d: d("text_spans").withColumn("c", color.hex_to_rgb(F.col("color"))).select("page_id", "span_idx", color.luminance(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("luminance")),
    "SELECT page_id, span_idx, round(ink, 6) AS luminance FROM c_ink",
)
query(
    "k3_contrast_ratio",
    lambda d: d("text_spans").withColumn("c", color.hex_to_rgb(F.col("color"))).select(
        "page_id", "span_idx",
        color.contrast_ratio(color.luminance(F.col("c.r"), F.col("c.g"), F.col("c.b")), color.luminance(*[F.lit(v) for v in (255, 255, 255)])).alias("on_white"),
        color.contrast_ratio(color.luminance(*[F.lit(v) for v in (0, 0, 0)]), color.luminance(F.col("c.r"), F.col("c.g"), F.col("c.b"))).alias("on_black"),
    ),
    f"SELECT page_id, span_idx, round({_ratio('ink', _lum('255', '255', '255'))}, 6) AS on_white, round({_ratio('ink', '0.0::DOUBLE')}, 6) AS on_black FROM c_ink",
)


def nested_containers(d):
    """Text items gathered into one container per page, each with one to three coloured spans."""
    def span(k):
        text = F.when(k == 1, F.concat(F.lit(" w"), F.col("l_partkey").cast("string"))).when(k == 2, "").otherwise("\nab\nc ")
        ink = F.when((k == 2) & (F.col("l_suppkey") % 5 == 0), "").otherwise(F.concat(F.lit("#00000"), k.cast("string")))
        return F.struct(text.alias("text"), ink.alias("color"))

    item = F.struct("item_no", "font_file", "x", "y", "width", "height", "font_size", F.transform(F.sequence(F.lit(1), F.col("n_spans").cast("int")), span).alias("spans"))
    return d("text_items").groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("container_no", F.lit(0).cast("bigint"))


query(
    "k4_flatten_spans",
    lambda d: contrast.flatten_spans(nested_containers(d)),
    f"""SELECT page_id, CAST(0 AS BIGINT) AS container_no, item_no, span_no, text, color, round(CASE WHEN cnt > 1 THEN x + width * (upto - w) / total ELSE x END, 6) AS x, y,
              round(CASE WHEN cnt > 1 THEN width * w / total ELSE width END, 6) AS width, height, font_size AS font_size_px, bold
       FROM (SELECT *, COUNT(*) OVER i AS cnt, SUM(w) OVER i AS total, SUM(w) OVER (PARTITION BY page_id, item_no ORDER BY k) AS upto,
                    ROW_NUMBER() OVER (PARTITION BY page_id, item_no ORDER BY k) - 1 AS span_no
             FROM (SELECT page_id, rank_no AS item_no, k, x, y, width, height, font_size, {trim_ws("replace(raw, chr(10), ' ')")} AS text, GREATEST(1, length({trim_ws('raw')})) AS w,
                          CASE WHEN k = 2 AND l_suppkey % 5 = 0 THEN '' ELSE '#00000' || k END AS color, regexp_matches(font_file, '{fv.BOLD_FACES}') AS bold
                   FROM (SELECT *, CASE k WHEN 1 THEN ' w' || l_partkey WHEN 2 THEN '' ELSE chr(10) || 'ab' || chr(10) || 'c ' END AS raw
                         FROM (SELECT *, unnest(generate_series(1, n_spans)) AS k, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY item_no) - 1 AS rank_no FROM text_items) a) b
                   WHERE x IS NOT NULL AND width IS NOT NULL) c
             WHERE color <> '' WINDOW i AS (PARTITION BY page_id, item_no)) e""",
)
query(
    "k5_large_text",
    lambda d: d("text_spans").join(d("page_meta").select("page_id", F.col("width").alias("pw"), "page_point_width"), "page_id").withColumn(
        "large_text", contrast.large_text(F.col("font_size_px"), F.col("bold"), F.col("page_point_width"), F.col("pw"))
    ).select("page_id", "span_idx", "large_text", F.when(F.col("large_text"), 3.0).otherwise(4.5).alias("threshold")),
    f"SELECT page_id, span_idx, {_LARGE} AS large_text, CASE WHEN {_LARGE} THEN 3.0 ELSE 4.5 END::DOUBLE AS threshold FROM c_boxes",
)
query(
    "k6_span_pixels",
    lambda d: contrast.span_pixels(d("text_spans"), d("bg_pixels"), d("page_meta"), tile=8, parts=d.parts("bg_pixels")),
    "SELECT page_id, span_idx, r, g, b, a >= 255 AS opaque, COUNT(*) AS n FROM c_hits GROUP BY ALL",
)
query("k7_span_contrast", lambda d: contrast.span_contrast(d("text_spans"), d("bg_pixels"), d("page_meta"), parts=d.parts("bg_pixels")), f"SELECT {_SPAN} FROM c_spans")
query("k8_span_contrast_approx", lambda d: contrast.span_contrast_approx(d("text_spans")), f"SELECT {_SPAN} FROM c_approx")
query("k9_page_contrast", lambda d: contrast.measure_pages(d("text_spans"), d("bg_pixels"), d("page_meta"), parts=d.parts("bg_pixels")), f"SELECT {_PAGE_COLS} FROM c_page_exact")
query(
    "k10_contrast_verdict",
    lambda d: details(audit.page_assessments(d)).select("page_id", "state", "verdict", "confidence", "needs_human", "detail", "rationale"),
    "SELECT page_id, state, verdict, confidence, needs_human, detail, rationale FROM c_page_rows",
)
query("k11_contrast_borderline", lambda d: audit.page_assessments(d).select("page_id", "borderline"), "SELECT page_id, borderline FROM c_page_rows")
query("k12_lane_fallback", lambda d: contrast.lane_fallback(d("text_spans"), d("bg_pixels"), d("page_meta"), parts=d.parts("bg_pixels")), f"SELECT {_PAGE_COLS} FROM c_page_lane")
query(
    "v4_settle_contrast",
    lambda d: audit.page_assessments(d).select("page_id", reconcile.settle_contrast().alias("settled")),
    "SELECT page_id, NOT borderline AS settled FROM c_page_rows",
)
_DECIDED = "page_id, verdict, CASE WHEN COALESCE(ok, FALSE) THEN 'completed' ELSE 'input_required' END AS state, NOT COALESCE(ok, FALSE) AS needs_human, rationale || ' ' || note AS rationale"
query(
    "v5_apply_completion",
    lambda d: reconcile.apply_completion(audit.page_assessments(d), d("completion_decisions")).select("page_id", "verdict", "state", "needs_human", "rationale"),
    f"SELECT {_DECIDED} FROM c_turned",
)
query(
    "v8_assess_contrast",
    lambda d: reconcile.assess_contrast(audit.page_assessments(d), d("completion_decisions")).select("page_id", "agent", "standard_refs", "verdict", "state", "needs_human", "rationale"),
    f"""SELECT 'contrast-service' AS agent, 'WCAG 1.4.3' AS standard_refs, * FROM (SELECT {_DECIDED} FROM c_turned WHERE borderline
        UNION ALL SELECT page_id, verdict, state, needs_human, rationale FROM c_page_rows WHERE NOT borderline) x""",
)
CHECK_VIEWS["c_measured"] = """
    SELECT page_id AS doc_id, verdict, needs_human FROM c_page_rows WHERE NOT borderline
    UNION ALL SELECT page_id, verdict, NOT COALESCE(ok, FALSE) FROM c_turned WHERE borderline"""
query(
    "e2e_measured_rollup",
    audit.measured_rollup,
    """SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(*) FILTER (WHERE applicable AND verdict <> 'failed' AND NOT needs_human) AS BIGINT) AS passed,
              CAST(COUNT(*) FILTER (WHERE applicable AND verdict = 'failed') AS BIGINT) AS failed,
              CAST(COUNT(*) FILTER (WHERE applicable AND verdict <> 'failed' AND needs_human) AS BIGINT) AS needs_human,
              CAST(COUNT(*) FILTER (WHERE NOT applicable) AS BIGINT) AS not_applicable
       FROM (SELECT v.doc_id, applicable, CASE WHEN sc = '1.4.3' THEN COALESCE(m.verdict, 'cannot_tell') ELSE v.verdict END AS verdict,
                    CASE WHEN sc = '1.4.3' THEN COALESCE(m.needs_human, TRUE) ELSE v.needs_human END AS needs_human
             FROM c_verdicts v LEFT JOIN c_measured m ON v.doc_id = m.doc_id) x GROUP BY doc_id""",
)
