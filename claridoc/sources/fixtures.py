"""Input views for the registered queries, derived from whole driver tables.

Each view is one SQL text that both Spark and the checking database run. ``{series(a,b)}`` stands
for the one thing they spell differently: one output row per number from a to b. Views whose rows
need a dense position per key are built in Spark by the library's own split windows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claridoc.operators import ordered
from claridoc.sources.tables import read_source

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "probe_facts": """
        SELECT doc_id, source,
               doc_id % 37 <> 0 AS openable,
               doc_id % 11 = 0 AS encrypted,
               doc_id % 37 <> 0 AND doc_id % 3 <> 0 AS has_struct_root,
               doc_id % 37 <> 0 AND doc_id % 4 <> 0 AS marked,
               CASE WHEN doc_id % 37 = 0 OR doc_id % 5 = 0 THEN NULL ELSE lang END AS lang,
               CASE WHEN doc_id % 37 = 0 OR doc_id % 6 = 0 THEN NULL ELSE 'Doc ' || CAST(doc_id AS STRING) END AS title,
               doc_id % 37 <> 0 AND doc_id % 2 = 0 AS display_doc_title,
               CAST(1 + FLOOR(n_chars / 200.0) AS BIGINT) AS page_count,
               CAST(CASE WHEN doc_id % 37 = 0 THEN 0 ELSE doc_id % 5 END AS BIGINT) AS figures,
               CAST(CASE WHEN doc_id % 37 = 0 THEN 0 ELSE LEAST(doc_id % 5, doc_id % 4) END AS BIGINT) AS figures_with_alt,
               CAST(CASE WHEN doc_id % 37 = 0 THEN 0 ELSE doc_id % 3 END AS BIGINT) AS tables,
               CAST(CASE WHEN doc_id % 37 = 0 THEN 0 ELSE LEAST(doc_id % 3, doc_id % 2) END AS BIGINT) AS tables_with_th
        FROM documents""",
    # facts of a second version: what a repair would leave; some documents have none, some fail to open
    "second_facts": """
        SELECT doc_id, openable, has_struct_root OR doc_id % 7 <> 0 AS has_struct_root, marked OR doc_id % 5 <> 0 AS marked,
               lang, COALESCE(title, 'Doc') AS title, TRUE AS display_doc_title, page_count, encrypted,
               figures, figures AS figures_with_alt, tables, tables AS tables_with_th,
               'https://files.example.org/v2/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 4 = 1 THEN '.pdf?sig=abc' ELSE '.pdf' END AS url,
               CASE WHEN doc_id % 8 = 1 THEN 'v2_fetch_failed 404' ELSE NULL END AS error
        FROM probe_facts JOIN (SELECT doc_id AS labelled FROM labels) l ON doc_id = labelled""",
    "lines": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, MIN(l_partkey) AS l_partkey, MIN(l_suppkey) AS l_suppkey,
               MIN(l_quantity) AS l_quantity, MIN(l_returnflag) AS l_returnflag
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    # containers are a heap of order rows, leaves hang below their order or below the line before
    "struct_elements": """
        SELECT CAST(FLOOR(o_orderkey / 32.0) AS BIGINT) AS doc_id, 1 + o_orderkey % 32 AS elem,
               CAST(FLOOR((1 + o_orderkey % 32) / 2.0) AS BIGINT) AS parent_elem,
               CASE o_custkey % 5 WHEN 0 THEN 'Table' WHEN 1 THEN 'Sect' WHEN 2 THEN 'Figure' WHEN 3 THEN 'L' ELSE 'Div' END AS role,
               CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'chart ' || CAST(o_custkey AS STRING) ELSE '' END AS alt,
               CASE WHEN o_custkey % 7 = 0 THEN 'order total' ELSE NULL END AS actual_text
        FROM orders
        UNION ALL
        SELECT CAST(FLOOR(l_orderkey / 32.0) AS BIGINT) AS doc_id, 100 + (l_orderkey % 32) * 100 + l_linenumber AS elem,
               CASE WHEN l_linenumber % 2 = 1 THEN 1 + l_orderkey % 32 ELSE 99 + (l_orderkey % 32) * 100 + l_linenumber END AS parent_elem,
               CASE l_partkey % 7 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Table' WHEN 2 THEN 'TH' WHEN 3 THEN 'TD'
                    WHEN 4 THEN 'P' WHEN 5 THEN 'H1' ELSE 'L' END AS role,
               CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE 'alt ' || CAST(l_partkey AS STRING) END AS alt,
               CASE WHEN l_partkey % 2 = 0 THEN 'actual' ELSE NULL END AS actual_text
        FROM lines""",
    # one row per document and lane; the second lane exists for labelled documents only
    "validator_lanes": """
        SELECT d.doc_id, n.lane, (d.doc_id + n.k) % 11 <> 0 AS available,
               CASE (d.doc_id + n.k) % n.m WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS pass,
               CASE (d.doc_id + n.k) % n.m WHEN 2 THEN d.doc_id % 3 ELSE NULL END AS n_failures,
               CASE (d.doc_id + n.k) % n.m WHEN 3 THEN 'finalized' WHEN 4 THEN 'pending_review' ELSE '' END AS gate,
               CASE WHEN (d.doc_id + n.k) % n.m = 5 THEN d.doc_id % 2 = 0 ELSE NULL END AS tagged,
               CAST(COALESCE(l.toxic, 0) AS BIGINT) AS n_error
        FROM documents d
        JOIN (SELECT doc_id AS lane_doc, 'verapdf' AS lane, 0 AS k, 6 AS m FROM documents
              UNION ALL SELECT doc_id, 'pac', 3, 7 FROM labels) n ON d.doc_id = n.lane_doc
        LEFT JOIN (SELECT doc_id, MAX(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    # results of an outside contrast lane; unlabelled documents have none, some report an error
    "contrast_lane": """
        SELECT doc_id, CASE WHEN quality = 1 THEN 'passed' WHEN toxic = 1 THEN 'failed' ELSE 'cannot_tell' END AS verdict,
               quality = 0 AS needs_human, 'measured ' || CAST(doc_id AS STRING) AS detail, 'lane says ' || CAST(quality AS STRING) AS rationale,
               CASE WHEN doc_id % 9 = 4 THEN 'Error: layer service ' || CAST(doc_id AS STRING) ELSE NULL END AS error
        FROM labels""",
    "text_spans": """
        SELECT l_orderkey AS page_id, l_linenumber AS span_idx, 'span ' || CAST(l_partkey AS STRING) AS text,
               '#' || LPAD(CAST((l_partkey * 7919 + l_suppkey * 104729) % 1000000 AS STRING), 6, '0') AS color,
               CAST(l_partkey % 14 AS DOUBLE) + 0.5 AS x, CAST(l_suppkey % 14 AS DOUBLE) + 0.25 AS y,
               CAST(1 + l_partkey % 6 AS DOUBLE) AS width, CAST(1 + l_suppkey % 3 AS DOUBLE) AS height,
               l_quantity AS font_size_px, l_linenumber % 2 = 0 AS bold
        FROM lines""",
    "page_meta": """
        SELECT o_orderkey AS page_id, CAST(16 AS BIGINT) AS width, CAST(16 AS BIGINT) AS height,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(8 + o_orderkey % 8 AS DOUBLE) END AS page_point_width,
               CASE o_custkey % 5 WHEN 0 THEN 'provider_error' WHEN 1 THEN 'undecodable' ELSE 'ok' END AS layer_status
        FROM orders""",
    "bg_pixels": """
        SELECT page_id, x, y,
               CAST((page_id * 37 + x * 11) % 256 AS INT) AS r, CAST((page_id * 53 + y * 7) % 256 AS INT) AS g,
               CAST((page_id * 71 + x + y) % 256 AS INT) AS b, CASE WHEN page_id % 13 = 0 AND x = 3 THEN 128 ELSE 255 END AS a
        FROM (SELECT page_id, x, {series(0,15)} AS y FROM (SELECT o_orderkey AS page_id, {series(0,15)} AS x FROM orders) c) p""",
    "review_events": """
        SELECT user_id * 20 + event_id % 20 AS doc_id, event_id, ts,
               CASE event_type WHEN 'signup' THEN 'human.review.requested' WHEN 'purchase' THEN 'human.approved'
                    WHEN 'error' THEN 'human.rejected' WHEN 'view' THEN 'routine.started' ELSE 'routine.done' END AS event,
               CASE event_id % 3 WHEN 0 THEN 'validator' WHEN 1 THEN 'contrast-service' ELSE 'wcag' END AS agent,
               event_id % 9 = 0 AS held
        FROM events""",
    "doc_events": """
        SELECT session_id, seq, ts,
               CASE event_type WHEN 'view' THEN 'append' WHEN 'click' THEN 'replace' WHEN 'signup' THEN 'progress'
                    WHEN 'error' THEN 'append' ELSE 'replace' END AS type,
               CASE WHEN event_type = 'signup' THEN 'phase ' || CAST(event_id % 4 AS STRING) ELSE NULL END AS phase,
               CASE WHEN event_type IN ('click', 'purchase') THEN '#blk-' || CAST(1 + event_id % seq AS STRING) ELSE NULL END AS target,
               CASE WHEN event_type = 'signup' THEN NULL ELSE '<p>' || CAST(event_id AS STRING) || '</p>' END AS html
        FROM numbered_events""",
    "numbered_events": """
        SELECT user_id AS session_id, event_id, ts, event_type,
               CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq
        FROM events""",
    "sessions": """
        SELECT c_custkey AS session_id,
               CASE c_custkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'unlisted' WHEN 2 THEN 'private' ELSE NULL END AS visibility,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'tok-' || CAST(c_custkey AS STRING) END AS creator_token,
               CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'tok-' || CAST(c_custkey AS STRING) ELSE 'forged' END AS request_token,
               CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '17' WHEN 2 THEN 'nope' WHEN 3 THEN '-4' WHEN 4 THEN '9.7' WHEN 5 THEN '1e400' WHEN 6 THEN '0xffffffffffffffffffffffff' WHEN 7 THEN '0x00000000000000000000000000000002A' ELSE '' END AS last_event_id,
               CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '5' WHEN 2 THEN ' 12 ' WHEN 3 THEN 'Infinity' ELSE '1e1' END AS after_param
        FROM customer""",
    "whole_fragments": """
        SELECT doc_id,
               '<h1>Doc ' || CAST(doc_id AS STRING) || '</h1> <ul><li>a</li><li>' || lang || '</li></ul>' ||
               CASE WHEN doc_id % 3 = 0 THEN ' stray ' ELSE '' END ||
               '<figure data-page="' || CAST(doc_id % 9 AS STRING) || '" data-bbox="' || CAST(doc_id % 400 AS STRING) ||
               ',100,' || CAST(500 + doc_id % 500 AS STRING) || ',950' || CASE WHEN doc_id % 10 = 0 THEN ',' ELSE '' END || '"><figcaption>see <b>fig</b> ' || CAST(doc_id AS STRING) ||
               '</figcaption></figure><hr/><table><tr><th>' || source || '</th></tr></table>' AS html
        FROM documents""",
    "html_chunks": """
        SELECT doc_id, chunk_no, SUBSTR(html, CAST(1 + 40 * chunk_no AS INT), 40) AS chunk
        FROM (SELECT doc_id, html, {series(0,CAST(FLOOR((LENGTH(html) - 1) / 40.0) AS BIGINT))} AS chunk_no FROM whole_fragments) c""",
    "page_chunks": """
        SELECT doc_id, chunk_no, SUBSTR(html, CAST(1 + 97 * chunk_no AS INT), 97) AS chunk
        FROM (SELECT page_id AS doc_id, html, {series(0,CAST(FLOOR((LENGTH(html) - 1) / 97.0) AS BIGINT))} AS chunk_no FROM pages) c""",
    "blocks": """
        SELECT doc_id * 4 AS block_no, doc_id, '<h1>Doc ' || CAST(doc_id AS STRING) || '</h1>' AS html FROM documents
        UNION ALL SELECT doc_id * 4 + 1, doc_id, '<figure data-page="' || CAST(doc_id % 9 AS STRING) || '" data-bbox="' ||
               CAST(doc_id % 400 AS STRING) || CASE doc_id % 6 WHEN 0 THEN ',100,' WHEN 1 THEN ', 100 ,' WHEN 2 THEN ',x,100,' WHEN 3 THEN ',1e400,100,' WHEN 4 THEN ',0x' || REPEAT('f', 300) || ',100,' ELSE ' 100 ' END ||
               CAST(500 + doc_id % 500 AS STRING) || ',950' || CASE WHEN doc_id % 10 = 0 THEN ',' ELSE '' END ||
               '"><figcaption>see <b>fig</b>  "' || source || '"</figcaption></figure>' FROM documents
        UNION ALL SELECT doc_id * 4 + 2, doc_id, '<table id="t-' || CAST(doc_id AS STRING) || '"><tr><th>' || source || '</th></tr></table>' FROM documents
        UNION ALL SELECT doc_id * 4 + 3, doc_id, CASE doc_id % 3 WHEN 0 THEN 'stray text' WHEN 1 THEN '<hr/>' ELSE '<figure class="x">plain</figure>' END FROM documents""",
    "text_boxes": """
        SELECT CAST(FLOOR(l_orderkey / 150.0) AS BIGINT) AS page_id, l_orderkey * 100 + l_linenumber AS node,
               CAST(l_partkey % 50 AS DOUBLE) * 10 AS x0, CAST(l_suppkey % 40 AS DOUBLE) * 15 AS y0,
               CAST(l_partkey % 50 AS DOUBLE) * 10 + 5 * (l_linenumber % 4) AS x1, CAST(l_suppkey % 40 AS DOUBLE) * 15 + 12 AS y1,
               CASE l_returnflag WHEN 'A' THEN 'Total Revenue' WHEN 'R' THEN 'total cost' ELSE 'notes' END AS text
        FROM lines""",
    "url_inputs": """
        SELECT 'page-' || CAST(page_id AS STRING) AS id, url FROM pages
        UNION ALL
        SELECT 'customer-' || CAST(c_custkey AS STRING),
               CASE c_custkey % 16
                    WHEN 0 THEN 'http://' || CAST(c_custkey % 256 AS STRING) || '.' || CAST(c_custkey % 200 AS STRING) || '.0.1/x'
                    WHEN 1 THEN 'http://172.' || CAST(c_custkey % 40 AS STRING) || '.5.5/a?b=c'
                    WHEN 2 THEN 'https://100.' || CAST(c_custkey % 256 AS STRING) || '.1.1'
                    WHEN 3 THEN 'https://192.' || CAST(c_custkey % 256 AS STRING) || '.0.9/p'
                    WHEN 4 THEN 'https://www.sec.gov/f/' || CAST(c_custkey AS STRING) || '.pdf#page=2'
                    WHEN 5 THEN 'https://arxiv.org/pdf/' || CAST(c_custkey AS STRING)
                    WHEN 6 THEN 'https://www1.hkexnews.hk/' || CAST(c_custkey AS STRING)
                    WHEN 7 THEN 'ftp://files.example.org/' || CAST(c_custkey AS STRING)
                    WHEN 8 THEN 'https://svc.internal/' || CAST(c_custkey AS STRING) || '?k='
                    WHEN 9 THEN 'not a url ' || CAST(c_custkey AS STRING) || '?x=1'
                    WHEN 10 THEN 'http://' || CAST(c_custkey * 1000003 AS STRING) || '/int'
                    WHEN 11 THEN 'http://LOCALHOST:8080/' || CAST(c_custkey AS STRING)
                    WHEN 12 THEN 'https://Notsec.gov.example.COM/' || CAST(c_custkey AS STRING)
                    WHEN 13 THEN 'http://169.' || CAST(200 + c_custkey % 100 AS STRING) || '.169.254/latest'
                    WHEN 14 THEN 'https://metadata.goog/' || CAST(c_custkey AS STRING)
                    ELSE 'https://files.gutenberg.org/' || CAST(c_custkey AS STRING) || '?' END
        FROM customer
        UNION ALL
        SELECT 'supplier-' || CAST(s_suppkey AS STRING),
               CASE s_suppkey % 6
                    WHEN 0 THEN 'http://0xffffffffffffffffffff/' WHEN 1 THEN 'http://0777777777777777777777777777/a?b'
                    WHEN 2 THEN 'http://0x000000000000000000000008080808/' || CAST(s_suppkey AS STRING) WHEN 3 THEN 'https://8.8.0x8.010/x#y'
                    WHEN 4 THEN 'http://00000000000000000001002004010/' ELSE 'http://0x7f.1/' || CAST(s_suppkey AS STRING) END
        FROM supplier""",
    "files": """
        SELECT doc_id AS file_id, n_chars * 20000 AS bytes,
               CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/X-PDF; a=b' ELSE '' END AS content_type,
               CASE WHEN doc_id % 3 = 0 THEN '%PDF-' ELSE SUBSTR(text, 1, 5) END AS head,
               CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(1 + FLOOR(n_chars / 20.0) AS BIGINT) END AS page_count,
               CASE doc_id % 6 WHEN 0 THEN '612' WHEN 1 THEN '-3' WHEN 2 THEN 'wide' WHEN 3 THEN NULL WHEN 4 THEN 'Infinity' ELSE '595.5' END AS page_point_width
        FROM documents""",
    # spans of one text line share a row; one to three colours per line
    "text_items": """
        SELECT l_orderkey AS page_id, l_linenumber AS item_no,
               CASE l_returnflag WHEN 'A' THEN 'Inter-SemiBold.ttf' WHEN 'R' THEN 'Inter-bold.ttf' ELSE 'Inter-Black.ttf' END AS font_file,
               CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_partkey % 14 AS DOUBLE) END AS x, CAST(l_suppkey % 14 AS DOUBLE) AS y,
               CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE CAST(1 + l_partkey % 6 AS DOUBLE) END AS width,
               CAST(1 + l_suppkey % 3 AS DOUBLE) AS height, l_quantity AS font_size,
               CAST(1 + l_partkey % 3 AS BIGINT) AS n_spans, l_partkey, l_suppkey
        FROM lines""",
    "workflow_events": """
        SELECT user_id * 10 + event_id % 10 AS doc_id, event_id, ts, 'wf-' || CAST(event_id % 700 AS STRING) AS workflow_id,
               CASE event_id % 2 WHEN 0 THEN 'validator' ELSE 'contrast-service' END AS domain,
               CASE event_type WHEN 'view' THEN 'parked' WHEN 'click' THEN 'release' WHEN 'signup' THEN 'completed'
                    WHEN 'error' THEN 'errored' ELSE 'parked' END AS kind,
               CASE WHEN event_type <> 'click' THEN NULL WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'Error: instance NOT FOUND'
                    WHEN event_id % 4 = 2 THEN 'workflow already Terminated' ELSE 'rpc timeout' END AS message
        FROM events""",
    "progress": """
        SELECT user_id AS doc_id, event_id, ts,
               CASE WHEN event_id % 13 = 0 THEN 'REMEDIATION_WORKFLOW' ELSE 'SPECIALIST_WORKFLOW' END AS workflow,
               CASE event_type WHEN 'view' THEN 'routine.started' WHEN 'click' THEN 'routine.done' WHEN 'signup' THEN 'row.ready'
                    WHEN 'error' THEN 'turn.started' ELSE 'queued' END AS phase,
               CASE event_id % 3 WHEN 0 THEN 'validator' WHEN 1 THEN 'contrast-service' ELSE 'wcag' END AS domain,
               CASE event_id % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'cannot_tell' END AS verdict,
               event_id % 4 <> 0 AS needs_human, 'why ' || CAST(event_id % 5 AS STRING) AS rationale
        FROM events""",
    "runs": """
        SELECT user_id AS doc_id, 1 + event_id % 7 AS run, event_id, ts,
               CASE event_id % 3 WHEN 0 THEN 'validator' WHEN 1 THEN 'contrast-service' ELSE 'wcag' END AS agent,
               CASE event_id % 2 WHEN 0 THEN 'passed' ELSE 'failed' END AS verdict,
               CASE event_type WHEN 'view' THEN 'audit' WHEN 'click' THEN 'create-html' WHEN 'signup' THEN 'review-pdf' WHEN 'error' THEN 'remediate' ELSE 'compare' END AS step,
               CASE WHEN event_id % 5 < 2 THEN 'started' ELSE 'done' END AS status
        FROM events""",
    "completion_decisions": """
        SELECT o_orderkey AS page_id, CASE o_custkey % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'accept' WHEN 2 THEN 'escalate' ELSE NULL END AS action,
               CASE WHEN o_custkey % 3 = 0 THEN 'Is span ' || CAST(o_custkey AS STRING) || ' readable?' WHEN o_custkey % 3 = 1 THEN '' ELSE NULL END AS human_question,
               CASE WHEN o_custkey % 4 = 3 THEN 'timeout' ELSE NULL END AS error
        FROM orders""",
    "figures": """
        SELECT l_orderkey AS session_id, l_linenumber AS ord, 'blk-' || CAST(l_linenumber AS STRING) AS fig_id, 1 + l_partkey % 9 AS page,
               CAST(l_partkey % 500 AS DOUBLE) AS ymin, CAST(l_suppkey % 400 AS DOUBLE) AS xmin,
               CAST(l_partkey % 500 + 20 * (l_linenumber - 2) AS DOUBLE) AS ymax, CAST(l_suppkey % 400 + 300 AS DOUBLE) AS xmax,
               CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'Fig "' || CAST(l_partkey AS STRING) || '" <a> & b''s' END AS caption,
               CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_partkey * 2000 END AS crop_bytes
        FROM lines""",
    # the event log with ends: some sessions report errors, some finish
    "session_log": """
        SELECT session_id, seq, ts, CASE WHEN seq % 40 = 0 AND session_id % 3 = 0 THEN 'error' WHEN seq % 31 = 0 AND session_id % 2 = 0 THEN 'done' ELSE type END AS type, phase, target, html
        FROM doc_events""",
    "page_boxes": """
        SELECT o_orderkey AS page_id,
               CASE o_custkey % 4 WHEN 0 THEN '[0,0,' || CAST(400 + o_custkey % 300 AS STRING) || ',800]' WHEN 1 THEN '[5,5,5,5]' ELSE NULL END AS mediabox,
               CASE o_custkey % 3 WHEN 0 THEN '{"x":10,"y":10,"w":500,"h":' || CAST(o_custkey % 900 AS STRING) || '}' ELSE NULL END AS cropbox,
               CASE o_custkey % 2 WHEN 0 THEN '{"left":0,"top":0,"right":300,"bottom":500}' ELSE 'broken' END AS bbox
        FROM orders""",
    "bbox_json": """
        SELECT l_orderkey * 100 + l_linenumber AS node,
               CASE l_partkey % 7
                    WHEN 0 THEN '[' || CAST(l_partkey AS STRING) || ',20,5,' || CAST(l_suppkey AS STRING) || ']'
                    WHEN 1 THEN '{"x0":' || CAST(l_partkey AS STRING) || ',"y0":2.5,"x1":10,"y1":4}'
                    WHEN 2 THEN '{"left":1,"top":' || CAST(l_suppkey AS STRING) || ',"right":9,"bottom":3}'
                    WHEN 3 THEN '{"x":3,"y":4,"w":' || CAST(l_partkey % 5 AS STRING) || ',"h":6}'
                    WHEN 4 THEN '{"x":3,"y":4,"width":5,"height":' || CAST(l_suppkey % 4 AS STRING) || '}'
                    WHEN 5 THEN '[1,2,3]'
                    ELSE '{"x0":1,"y":7,"x":2,"w":3,"h":4}' END AS bbox
        FROM lines""",
}


_SERIES = r"\{series\((.*?),(.*?)\)\}"


def _spark_sql(text: str) -> str:
    return re.sub(_SERIES, r"explode(sequence(\1, \2))", text)


def _duck_sql(text: str) -> str:
    return re.sub(_SERIES, r"unnest(generate_series(\1, \2))", text)


def _mentioned(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)]


def _numbered_events(spark: SparkSession, folder: str) -> DataFrame:
    events = view(spark, folder, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts", "event_type")
    return ordered.row_number(events, ["session_id"], ["ts", "event_id"], ordered.time_bucket("ts"), "seq")


_BUILT = {"numbered_events": _numbered_events}
# views that multiply rows: their input is dealt by its key first, since the driver's files are one split each
_MULTIPLIED = {"bg_pixels": ("orders", "o_orderkey")}
ROWS_PER_PART = 1 << 15


def parts(spark: SparkSession, folder: str, name: str) -> int:
    """In how many partitions a view that multiplies rows lies by its key."""
    rows = read_source(spark, folder, _MULTIPLIED[name][0]).count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PART))


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table or a derived view of one data folder."""
    if name in TABLES:
        return read_source(spark, folder, name)
    if name in _BUILT:
        return _BUILT[name](spark, folder)
    text = _spark_sql(VIEWS[name])
    tag = hashlib.md5(folder.encode()).hexdigest()[:8]
    for n in _mentioned(text, [*TABLES, *VIEWS]):
        source = view(spark, folder, n)
        alias = f"{n}_{tag}"
        if name in _MULTIPLIED:
            source, alias = source.repartition(parts(spark, folder, name), _MULTIPLIED[name][1]), f"{alias}_spread"
        source.createOrReplaceTempView(alias)
        text = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{alias}", text)
    return spark.sql(text)


def with_views(sql: str, more: dict[str, str] | None = None) -> str:
    """Checking SQL with the views it mentions put in front."""
    order: list[str] = []
    views = {**VIEWS, **(more or {})}

    def visit(text: str) -> None:
        for n in _mentioned(text, views):
            if n not in order:
                visit(views[n])
                order.append(n)

    visit(sql)
    if not order:
        return sql
    defs = ",\n".join(f"{n} AS ({_duck_sql(views[n])})" for n in order)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {defs},\n{re.sub(r'(?i)^with\s+recursive', '', body)}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {defs},\n{re.sub(r'(?i)^with', '', body)}"
    return f"WITH {defs}\n{body}"
