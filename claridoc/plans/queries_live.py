"""Registered queries: the live document and page geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from claridoc.functions import text
from claridoc.operators import geometry, live, markup, tour
from claridoc.plans import audit
from claridoc.plans.check_views import CHECK_VIEWS
from claridoc.plans.registry import query

query(
    "s1_sequence_events",
    lambda d: live.sequence_events(d("events").select(F.col("user_id").alias("session_id"), "event_id", "ts")),
    "SELECT session_id, event_id, ts, seq FROM numbered_events",
)
CHECK_VIEWS["c_touched"] = """
    SELECT session_id, seq, type, CASE WHEN type = 'append' THEN 'blk-' || seq ELSE substr(target, 2) END AS block_id,
           CASE WHEN type = 'append' THEN '<p id="blk-' || seq || '">' || substr(html, 4) ELSE html END AS html
    FROM doc_events WHERE type IN ('append', 'replace') AND html IS NOT NULL"""
CHECK_VIEWS["c_snapshot"] = """
    SELECT b.session_id, b.seq AS ord, b.block_id, COALESCE(arg_max(r.html, r.seq), ANY_VALUE(b.html)) AS html
    FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, block_id ORDER BY seq) AS nth FROM c_touched) x WHERE type = 'append' OR nth = 1) b
    LEFT JOIN c_touched r ON r.session_id = b.session_id AND r.block_id = b.block_id AND r.type = 'replace' AND r.seq > b.seq
    GROUP BY b.session_id, b.seq, b.block_id"""
query("s2_snapshot", lambda d: live.snapshot(d("doc_events")), "SELECT session_id, ord, block_id, html FROM c_snapshot")


def readers(d):
    return d("sessions").select("session_id", live.resume_point(F.col("last_event_id"), F.col("after_param")).alias("after"))


CHECK_VIEWS["c_readers"] = """
    SELECT session_id, CASE WHEN last_event_id IS NOT NULL THEN CASE last_event_id WHEN '17' THEN 17 WHEN '9.7' THEN 9 WHEN '0x00000000000000000000000000000002A' THEN 42 WHEN '0xffffffffffffffffffffffff' THEN 9000000000000000000 ELSE 0 END
                            WHEN after_param IS NULL THEN 0 WHEN after_param = 'Infinity' THEN 0 ELSE CAST(floor(CAST(trim(after_param) AS DOUBLE)) AS BIGINT) END AS after FROM sessions"""
query(
    "s3_replay_after",
    lambda d: live.replay_after(d("doc_events"), readers(d)).select("session_id", "seq", "type"),
    "SELECT e.session_id, seq, type FROM doc_events e JOIN c_readers r ON e.session_id = r.session_id WHERE seq > after",
)
query("s4_resume_point", readers, "SELECT session_id, CAST(after AS BIGINT) AS after FROM c_readers")
query(
    "s5_deliver_once",
    lambda d: live.deliver_once(d("doc_events").select("session_id", "seq", "type").unionByName(live.replay_after(d("doc_events"), readers(d)).select("session_id", "seq", "type"))),
    "SELECT session_id, seq, type FROM doc_events",
)
query(
    "s6_sse_frame",
    lambda d: d("doc_events").select("session_id", "seq", live.sse_frame(F.col("seq"), F.col("type"), phase=F.col("phase"), target=F.col("target"), html=F.col("html")).alias("frame")),
    """SELECT session_id, seq, 'id: ' || seq || chr(10) || 'event: ' || type || chr(10) || 'data: {"type":"' || type || '"' || COALESCE(',"phase":"' || phase || '"', '')
              || COALESCE(',"target":"' || target || '"', '') || COALESCE(',"html":"' || html || '"', '') || '}' || chr(10) || chr(10) AS frame FROM doc_events""",
)
query(
    "s7_trim_log",
    lambda d: live.trim_log(d("doc_events"), 20).select("session_id", "seq"),
    "SELECT session_id, seq FROM (SELECT session_id, seq, MAX(seq) OVER (PARTITION BY session_id) AS m FROM doc_events) x WHERE m <= 20 OR seq >= m - 20",
)
query(
    "s8_session_status",
    lambda d: live.session_status(d("session_log")),
    """SELECT session_id, MAX(seq) AS seq, arg_max(phase, seq) FILTER (WHERE type = 'progress' AND phase <> '') AS phase,
              CASE WHEN bool_or(type = 'error') THEN 'error' WHEN bool_or(type = 'done') THEN 'done' ELSE 'running' END AS status FROM session_log GROUP BY session_id""",
)
query(
    "s9_figure_countdown",
    lambda d: live.figure_countdown(
        d("lines").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.count("*").alias("pending")),
        d("lineitem").select(F.col("l_orderkey").alias("session_id"), F.concat(F.lit("blk-"), F.col("l_linenumber").cast("string")).alias("fig_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("html")),
    ),
    """SELECT r.session_id, n_ready, GREATEST(0, COALESCE(pending, 1) - n_ready) AS remaining, GREATEST(0, COALESCE(pending, 1) - n_ready) = 0 AS finished
       FROM (SELECT l_orderkey AS session_id, COUNT(DISTINCT l_linenumber) AS n_ready FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey) r
       LEFT JOIN (SELECT l_orderkey AS session_id, COUNT(*) AS pending FROM lines GROUP BY l_orderkey) p ON r.session_id = p.session_id""",
)
CHECK_VIEWS["c_blocks"] = """
    SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY k) AS block_no, html FROM (
      SELECT doc_id, 1 AS k, '<h1>Doc ' || doc_id || '</h1>' AS html FROM documents
      UNION ALL SELECT doc_id, 2, '<ul><li>a</li><li>' || lang || '</li></ul>' FROM documents
      UNION ALL SELECT doc_id, 3, '<p>stray</p>' FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, 4, regexp_extract(html, '(<figure.*</figure>)', 1) FROM whole_fragments
      UNION ALL SELECT doc_id, 5, '<hr/>' FROM documents
      UNION ALL SELECT doc_id, 6, '<table><tr><th>' || source || '</th></tr></table>' FROM documents) b"""
query("s10_chunk_blocks", lambda d: live.chunk_blocks(d("html_chunks")), "SELECT doc_id, block_no, html FROM c_blocks")
query("s11_extract_blocks", lambda d: live.extract_blocks(d("whole_fragments")), "SELECT doc_id, block_no, html FROM c_blocks")


def _squeezed(blocks):
    """Blocks of each page as one text without white space: a page has few blocks, and nothing but white space may get lost."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "html"))), lambda b: b["html"]), "")
    return blocks.groupBy("doc_id").agg(F.md5(F.regexp_replace(whole, r"\s+", "")).alias("squeezed"), F.count("*").alias("n_blocks"))


def page_blocks(d):
    """Blocks of real pages, unchunked and from chunks."""
    whole = live.extract_blocks(d("pages").select(F.col("page_id").alias("doc_id"), "html"))
    return whole, live.chunk_blocks(d("page_chunks"))


def chunked_pages(d):
    whole, chunked = page_blocks(d)
    same = _squeezed(whole).select("doc_id", F.col("n_blocks").alias("unchunked"))
    return _squeezed(chunked).join(same, "doc_id", "left").select("doc_id", "squeezed", (F.col("n_blocks") == F.col("unchunked")).alias("same"))


_SQUEEZED = r"SELECT page_id AS doc_id, md5(regexp_replace(html, '\s+', '', 'g')) AS squeezed"
query("s10_pages_chunks", chunked_pages, f"{_SQUEEZED}, TRUE AS same FROM pages")
query("s11_pages_blocks", lambda d: _squeezed(page_blocks(d)[0]).select("doc_id", "squeezed"), f"{_SQUEEZED} FROM pages")
query(
    "s12_strip_fence",
    lambda d: d("documents").select("doc_id", text.strip_fence(F.concat(F.lit(" ```HTML\n"), F.col("text"), F.lit("\n``` "))).alias("bare"), text.strip_fence(F.col("text")).alias("same")),
    r"""SELECT doc_id, regexp_replace(regexp_replace(' ```HTML' || chr(10) || text || chr(10) || '``` ', '^\s*```(?i:html)?\s*', ''), '\s*```\s*$', '') AS bare, text AS same FROM documents""",
)
query(
    "s13_ensure_block_id",
    lambda d: d("blocks").withColumn("fallback", F.concat(F.lit("blk-"), F.col("block_no").cast("string"))).select(
        "block_no", F.coalesce(text.existing_block_id(F.col("html")), F.col("fallback")).alias("id"), text.with_block_id(F.col("html"), F.col("fallback")).alias("html")
    ),
    r"""SELECT block_no, CASE WHEN html LIKE '<table id="%' THEN 't-' || doc_id ELSE 'blk-' || block_no END AS id,
              CASE WHEN html LIKE '<table id="%' OR html NOT LIKE '<%' THEN html ELSE regexp_replace(html, '^<([a-z0-9]+)', '<\1 id="blk-' || block_no || '"') END AS html FROM blocks""",
)
query(
    "s14_parse_figures",
    lambda d: live.parse_figures(d("blocks")),
    """SELECT block_no, doc_id, GREATEST(1, doc_id % 9) AS page, CAST(doc_id % 400 AS DOUBLE) AS ymin, 100.0::DOUBLE AS xmin, CAST(500 + doc_id % 500 AS DOUBLE) AS ymax, 950.0::DOUBLE AS xmax,
              'see fig "' || source || '"' AS caption FROM (SELECT b.block_no, b.doc_id, d.source FROM blocks b JOIN documents d ON b.doc_id = d.doc_id WHERE b.block_no % 4 = 1) f WHERE doc_id % 10 <> 0""",
)
_ESC = "replace(replace(replace(replace(replace(caption, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_CAP = f"CASE WHEN caption = '' THEN '' ELSE '<figcaption>' || {_ESC} || '</figcaption>' END"
_FIG = f"""'<figure id="' || fig_id || '" data-page="' || page || '" data-bbox="' || CAST(ymin AS BIGINT) || ',' || CAST(xmin AS BIGINT) || ',' || CAST(ymax AS BIGINT) || ',' || CAST(xmax AS BIGINT) ||
    '"><img src="/s/' || session_id || '/fig/' || fig_id || '.png" alt="' || CASE WHEN caption = '' THEN 'Figure' ELSE {_ESC} END || '" loading="lazy">' || {_CAP} || '</figure>'"""


def _src():
    return F.concat(F.lit("/s/"), F.col("session_id").cast("string"), F.lit("/fig/"), F.col("fig_id"), F.lit(".png"))


query(
    "s15_render_figure",
    lambda d: d("figures").select(
        "session_id", "fig_id", live.render_figure(F.col("fig_id"), F.col("page"), [F.col(c) for c in ("ymin", "xmin", "ymax", "xmax")], F.col("caption"), _src()).alias("html"),
        live.caption_only(F.col("fig_id"), F.col("caption")).alias("plain"),
    ),
    f"SELECT session_id, fig_id, {_FIG} AS html, '<figure id=\"' || fig_id || '\">' || {_CAP} || '</figure>' AS plain FROM figures",
)
query(
    "s16_wrap_tables",
    lambda d: d("blocks").select("block_no", text.wrap_table(F.col("html")).alias("html")),
    """SELECT block_no, CASE WHEN html LIKE '<table%' THEN '<div class="a11y-table-scroll">' || html || '</div>' ELSE html END AS html FROM blocks""",
)
query(
    "s17_render_body",
    lambda d: live.render_body(live.snapshot(d("doc_events"))),
    "SELECT session_id, string_agg(html, chr(10) || '      ' ORDER BY ord) AS body FROM c_snapshot GROUP BY session_id",
)
query(
    "s18_visible_sessions",
    lambda d: live.visible_sessions(d("sessions").withColumn("creator_hash", F.sha2("creator_token", 256)), ["8"]),
    """SELECT session_id, is_public OR COALESCE(visibility = 'unlisted', FALSE) OR is_creator AS allowed, is_creator, is_public FROM (
         SELECT session_id, visibility, COALESCE(visibility = 'public', FALSE) OR session_id = 8 AS is_public, COALESCE(sha256(creator_token) = sha256(request_token), FALSE) AS is_creator FROM sessions) s""",
)
query(
    "s19_inline_budget",
    lambda d: live.inline_budget(d("figures"), 1_500_000).select("session_id", "fig_id", "inlined"),
    """WITH RECURSIVE f AS (SELECT session_id, fig_id, crop_bytes, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ord) AS rn FROM figures WHERE crop_bytes IS NOT NULL),
       scan AS (
         SELECT session_id, fig_id, rn, crop_bytes <= 1500000 AS ok, CASE WHEN crop_bytes <= 1500000 THEN crop_bytes ELSE 0 END AS used FROM f WHERE rn = 1
         UNION ALL SELECT f.session_id, f.fig_id, f.rn, used + crop_bytes <= 1500000, CASE WHEN used + crop_bytes <= 1500000 THEN used + crop_bytes ELSE used END
         FROM scan JOIN f ON f.session_id = scan.session_id AND f.rn = scan.rn + 1)
       SELECT g.session_id, g.fig_id, COALESCE(ok, FALSE) AS inlined FROM figures g LEFT JOIN scan s ON g.session_id = s.session_id AND g.fig_id = s.fig_id""",
)
query(
    "s20_figure_lane",
    lambda d: live.figure_lane(d("figures"), d("figures").filter("crop_bytes IS NOT NULL").select("session_id", "fig_id", _src().alias("src"))),
    f"""SELECT session_id, fig_id, crop_bytes IS NOT NULL AS has_image, CASE WHEN crop_bytes IS NOT NULL THEN {_FIG} ELSE '<figure id="' || fig_id || '">' || {_CAP} || '</figure>' END AS html FROM figures""",
)

# ---- names and geometry

query(
    "f7_safe_filename",
    lambda d: markup.doc_metadata(d("pages")).select("page_id", live.safe_filename(F.col("title"), F.concat(F.lit("page-000"), F.col("page_id").cast("string"))).alias("name")),
    r"""SELECT page_id, COALESCE(NULLIF(substr(regexp_replace(regexp_replace(trim(regexp_replace(strip_accents(COALESCE(title, '')), '[^A-Za-z0-9 _.-]+', '', 'g')), '\s+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 60), ''),
              'a11y-document-' || substr('page-000' || page_id, 1, 8)) || '.html' AS name FROM c_meta""",
)
query(
    "f8_crop_rect",
    lambda d: d("figures").withColumn("r", geometry.crop_rect(F.col("ymin"), F.col("xmin"), F.col("ymax"), F.col("xmax"), 800 + F.col("page") * 10, F.lit(1000))).select("session_id", "fig_id", "r.*"),
    """SELECT session_id, fig_id, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1 FROM (
         SELECT *, x1 > x0 AND y1 > y0 AS ok FROM (
           SELECT session_id, fig_id, CAST(trunc(GREATEST(0, (xmin / 1000.0::DOUBLE - 0.02::DOUBLE) * w)) AS BIGINT) AS x0, CAST(trunc(GREATEST(0, (ymin / 1000.0::DOUBLE - 0.02::DOUBLE) * 1000)) AS BIGINT) AS y0,
                  CAST(trunc(LEAST(w, (xmax / 1000.0::DOUBLE + 0.02::DOUBLE) * w)) AS BIGINT) AS x1, CAST(trunc(LEAST(1000, (ymax / 1000.0::DOUBLE + 0.02::DOUBLE) * 1000)) AS BIGINT) AS y1
           FROM (SELECT *, CAST(800 + page * 10 AS DOUBLE) AS w FROM figures) a) b) c""",
)


def _norm(x0: str, y0: str, x1: str, y1: str, px0: str, py0: str, px1: str, py1: str) -> str:
    x = f"GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, ({x0} - {px0}) / ({px1} - {px0})))"
    y = f"GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, ({y0} - {py0}) / ({py1} - {py0})))"
    w = f"GREATEST(0.0::DOUBLE, LEAST(1 - {x}, ({x1} - {x0}) / ({px1} - {px0})))"
    h = f"GREATEST(0.0::DOUBLE, LEAST(1 - {y}, ({y1} - {y0}) / ({py1} - {py0})))"
    return f"{x} AS x, {y} AS y, {w} AS w, {h} AS h"


CHECK_VIEWS["c_placed"] = f"SELECT page_id, node, text, {_norm('x0', 'y0', 'x1', 'y1', '0.0', '0.0', '612.0', '792.0')} FROM text_boxes WHERE x1 > x0 AND y1 > y0"
query(
    "f9_search_text",
    lambda d: geometry.search_text(d("text_boxes"), " TOTAL "),
    """SELECT page_id, rank, node, text, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, round(area, 6) AS area FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY area, node) AS rank FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id, place ORDER BY area, node) AS rn FROM (
             SELECT *, w * h AS area, printf('%.4f:%.4f:%.4f:%.4f', x, y, w, h) AS place FROM c_placed WHERE w > 0 AND h > 0 AND contains(lower(text), 'total')) a) b WHERE rn = 1) c""",
)
CHECK_VIEWS["c_subtree"] = """
    WITH RECURSIVE down AS (
      SELECT doc_id, elem, [elem] AS path, COALESCE(alt, actual_text, role) AS t FROM struct_elements e
      WHERE COALESCE(parent_elem, 0) = 0 OR NOT EXISTS (SELECT 1 FROM struct_elements p WHERE p.doc_id = e.doc_id AND p.elem = e.parent_elem)
      UNION ALL SELECT e.doc_id, e.elem, list_append(down.path, e.elem), COALESCE(e.alt, e.actual_text, e.role) FROM down JOIN struct_elements e ON e.doc_id = down.doc_id AND e.parent_elem = down.elem),
    spoken AS (SELECT doc_id, unnest(path) AS anc, path, t FROM down WHERE trim(t) <> '')
    SELECT doc_id, anc AS elem, string_agg(t, ' ' ORDER BY path) AS text FROM spoken GROUP BY doc_id, anc"""


def spoken_elements(d):
    """Structure elements with the text a reader hears."""
    return tour.text_sequence(d("struct_elements").withColumn("text", F.coalesce("alt", "actual_text", "role")))


def subtree_boxes(d, phrase):
    """Elements whose subtree has a phrase, with the joined text of the subtree, placed on a page by their number."""
    sequence = spoken_elements(d)
    nodes = tour.subtree_text(sequence, tour.search_subtrees(sequence, phrase))
    x, y = ((F.col("elem") % n).cast("double") * step for n, step in ((50, 10), (40, 15)))
    return nodes.select(F.col("doc_id").alias("page_id"), F.col("elem").alias("node"), "text", x.alias("x0"), y.alias("y0"), (x + 5 * (1 + F.col("elem") % 4)).alias("x1"), (y + 12).alias("y1"))


query(
    "f9_search_subtree",
    lambda d: geometry.search_text(subtree_boxes(d, "Actual ALT"), "Actual ALT"),
    f"""SELECT page_id, rank, node, text, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, round(area, 6) AS area FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY area, node) AS rank FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id, place ORDER BY area, node) AS rn FROM (
             SELECT *, w * h AS area, printf('%.4f:%.4f:%.4f:%.4f', x, y, w, h) AS place FROM (
               SELECT page_id, node, trim(text) AS text, {_norm('x0', 'y0', 'x1', 'y1', '0.0', '0.0', '612.0', '792.0')} FROM (
                 SELECT doc_id AS page_id, elem AS node, text, CAST(elem % 50 AS DOUBLE) * 10 AS x0, CAST(elem % 40 AS DOUBLE) * 15 AS y0,
                        CAST(elem % 50 AS DOUBLE) * 10 + 5 * (1 + elem % 4) AS x1, CAST(elem % 40 AS DOUBLE) * 15 + 12 AS y1 FROM c_subtree) p) n
             WHERE w > 0 AND h > 0 AND contains(lower(text), 'actual alt')) a) b WHERE rn = 1) c""",
)
query(
    "f10_normalize_bbox",
    lambda d: d("text_boxes").withColumn("n", geometry.normalize_bbox(geometry.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), geometry.box(*[F.lit(v) for v in (50.0, 20.0, 400.0, 500.0)]))).select("node", "n.*"),
    f"""SELECT t.node, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM text_boxes t LEFT JOIN (SELECT node, {_norm('x0', 'y0', 'x1', 'y1', '50.0', '20.0', '400.0', '500.0')}
        FROM text_boxes WHERE x1 > x0 AND y1 > y0) n ON t.node = n.node AND w > 0 AND h > 0""",
)
query(
    "f11_page_bounds",
    lambda d: d("page_boxes").withColumn("b", geometry.page_bounds(F.col("mediabox"), F.col("cropbox"), F.col("bbox"))).select("page_id", "b.*"),
    """SELECT page_id, CASE WHEN m THEN 0.0 WHEN c THEN 10.0 ELSE 0.0 END::DOUBLE AS x0, CASE WHEN m THEN 0.0 WHEN c THEN 10.0 ELSE 0.0 END::DOUBLE AS y0,
              CASE WHEN m THEN 400 + o_custkey % 300 WHEN c THEN 510 WHEN b THEN 300 ELSE 612 END::DOUBLE AS x1, CASE WHEN m THEN 800 WHEN c THEN 10 + o_custkey % 900 WHEN b THEN 500 ELSE 792 END::DOUBLE AS y1
       FROM (SELECT o_orderkey AS page_id, o_custkey, o_custkey % 4 = 0 AS m, o_custkey % 3 = 0 AND o_custkey % 900 > 0 AS c, o_custkey % 2 = 0 AS b FROM orders) o""",
)
query(
    "f12_parse_bbox",
    lambda d: d("bbox_json").withColumn("b", geometry.parse_bbox(F.col("bbox"))).select("node", "b.*"),
    """SELECT l_orderkey * 100 + l_linenumber AS node,
              CASE k WHEN 0 THEN LEAST(l_partkey, 5) WHEN 1 THEN LEAST(l_partkey, 10) WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN l_partkey % 5 > 0 THEN 3 END WHEN 4 THEN CASE WHEN l_suppkey % 4 > 0 THEN 3 END WHEN 6 THEN 2 END::DOUBLE AS x0,
              CASE k WHEN 0 THEN LEAST(20, l_suppkey) WHEN 1 THEN 2.5 WHEN 2 THEN LEAST(l_suppkey, 3) WHEN 3 THEN CASE WHEN l_partkey % 5 > 0 THEN 4 END WHEN 4 THEN CASE WHEN l_suppkey % 4 > 0 THEN 4 END WHEN 6 THEN 7 END::DOUBLE AS y0,
              CASE k WHEN 0 THEN GREATEST(l_partkey, 5) WHEN 1 THEN GREATEST(l_partkey, 10) WHEN 2 THEN 9 WHEN 3 THEN CASE WHEN l_partkey % 5 > 0 THEN 3 + l_partkey % 5 END WHEN 4 THEN CASE WHEN l_suppkey % 4 > 0 THEN 8 END WHEN 6 THEN 5 END::DOUBLE AS x1,
              CASE k WHEN 0 THEN GREATEST(20, l_suppkey) WHEN 1 THEN 4 WHEN 2 THEN GREATEST(l_suppkey, 3) WHEN 3 THEN CASE WHEN l_partkey % 5 > 0 THEN 10 END WHEN 4 THEN CASE WHEN l_suppkey % 4 > 0 THEN 4 + l_suppkey % 4 END WHEN 6 THEN 11 END::DOUBLE AS y1
       FROM (SELECT *, l_partkey % 7 AS k FROM lines) l""",
)
query("f13_subtree_text", lambda d: tour.subtree_text(spoken_elements(d)), "SELECT doc_id, elem, text FROM c_subtree")
query(
    "f13_tree_tour",
    lambda d: tour.tree_tour(d("struct_elements")),
    """WITH RECURSIVE down AS (
         SELECT doc_id, elem, [elem] AS path FROM struct_elements e
         WHERE COALESCE(parent_elem, 0) = 0 OR NOT EXISTS (SELECT 1 FROM struct_elements p WHERE p.doc_id = e.doc_id AND p.elem = e.parent_elem)
         UNION ALL SELECT e.doc_id, e.elem, list_append(down.path, e.elem) FROM down JOIN struct_elements e ON e.doc_id = down.doc_id AND e.parent_elem = down.elem),
       placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS entry FROM down),
       sizes AS (SELECT doc_id, anc, COUNT(*) AS n FROM (SELECT doc_id, unnest(path) AS anc FROM down) a GROUP BY doc_id, anc)
       SELECT p.doc_id, p.elem, p.entry, p.entry + s.n - 1 AS "last" FROM placed p JOIN sizes s ON s.doc_id = p.doc_id AND s.anc = p.elem""",
)
query(
    "f14_render_params",
    lambda d: d("sessions").withColumn("p", geometry.render_params(F.col("last_event_id"), (F.col("session_id") % 700).cast("string"), 1 + F.col("session_id") % 20)).select("session_id", "p.*"),
    """SELECT session_id, page, dpi, page <= 1 + session_id % 20 AS ok FROM (SELECT session_id, CAST(CASE WHEN last_event_id = '17' THEN 17 ELSE 1 END AS BIGINT) AS page,
              CASE WHEN session_id % 700 BETWEEN 50 AND 600 THEN session_id % 700 ELSE 150 END AS dpi FROM sessions) s""",
)
query(
    "f15_json_props",
    lambda d: d("events").withColumn("raw", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))).select(
        "event_id", geometry.json_number(F.col("raw"), "k").alias("k")
    ),
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k FROM events",
)
query(
    "e2e_live_twin",
    audit.live_twin,
    r"""SELECT doc_id AS session_id, string_agg(CASE WHEN html LIKE '<table%' THEN '<div id="blk-' || block_no || '" class="a11y-table-scroll">' || html || '</div>'
              ELSE regexp_replace(html, '^<([a-z0-9]+)', '<\1 id="blk-' || block_no || '"') END, chr(10) || '      ' ORDER BY block_no) AS body FROM c_blocks GROUP BY doc_id""",
)
