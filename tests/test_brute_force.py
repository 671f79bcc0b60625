"""Operators against slow, plain definitions on small random data with a hot key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claridoc.functions.blocks import all_blocks
from claridoc.functions.text import existing_block_id
from claridoc.operators import contrast, ledger, live, ordered, probe

START = datetime(2024, 1, 1)


def log_rows(seed, n=400, keys=7):
    """Rows of which a third belong to key 0, spread over ten days, with ties in time."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.34 else rng.choice([None, *range(1, keys)]), START + timedelta(minutes=rng.randrange(14400) // 30 * 30), i, rng.choice([None, "a", "b"]), rng.randrange(5)) for i in range(n)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(log_rows(1), "k long, ts timestamp, id long, v string, n long").cache()


def test_split_windows_equal_plain_windows(log):
    w = Window.partitionBy("k").orderBy("ts", "id")
    hour = ordered.time_bucket("ts")
    plain = log.select(
        "id", F.row_number().over(w).cast("bigint").alias("rn"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"), F.lead("id").over(w).alias("next"),
    )
    keys, order = ["k"], ["ts", "id"]
    a = ordered.row_number(log, keys, order, hour, "rn").select("id", "rn")
    b = ordered.running_sum(log, keys, order, hour, F.col("n"), "run").select("id", "run")
    c = ordered.last_before(log, keys, order, hour, F.col("v"), "prev").select("id", "prev")
    d = ordered.next_row(log, keys, order, hour, ["id", "v"], "nx").select("id", F.col("nx.id").alias("next"))
    split = a.join(b, "id").join(c, "id").join(d, "id").select(plain.columns)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))


def test_top_k_and_last(log):
    rows = log_rows(1)
    got = ordered.smallest_k(log, ["k"], [F.col("ts"), F.col("id")], 3, "rank").collect()
    want = {(k, r + 1, row[2]) for k in {x[0] for x in rows} for r, row in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))[:3])}
    assert {(g.k, g["rank"], g.id) for g in got} == want
    last = {r.k: r.id for r in ordered.last_per_key(log, ["k"], [F.col("ts"), F.col("id")], ["id"]).collect()}
    assert last == {k: max((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))[2] for k in last}


def test_chunks_in_any_batch_size(spark):
    rng = random.Random(4)
    parts = ["<h1>A</h1>", " loose ", "<ul><li>a</li></ul>", "<hr/>", "<p>x <b>y</b></p>", "```", "<table><tr><td>", "</td></tr></table>", "\n"]
    texts = {d: rng.choice(["", "```html\n"]) + "".join(rng.choice(parts) for _ in range(30)) + rng.choice(["", "\n```"]) for d in range(12)}
    rows = [(d, i, t[i * 3 : i * 3 + 3]) for d, t in texts.items() for i in range(-(-len(t) // 3))]
    df = spark.createDataFrame(rows, "doc_id long, chunk_no long, chunk string")
    want = {(d, i, b) for d, t in texts.items() for i, b in enumerate(all_blocks(t), 1)}
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert {tuple(r) for r in live.chunk_blocks(df).collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def live_events(seed, n=300):
    rng = random.Random(seed)
    out, seqs = [], {}
    for _ in range(n):
        s = 0 if rng.random() < 0.34 else rng.randrange(1, 5)
        seqs[s] = seq = seqs.get(s, 0) + 1
        kind = rng.choice(["append", "append", "replace", "progress", "replace"])
        html = rng.choice([f"<p>{seq}</p>", f'<p id="fix-{rng.randrange(4)}">{seq}</p>', f'<p id="a11y-load">{seq}</p>', "", None])
        target = rng.choice([f"#blk-{rng.randrange(1, seq + 3)}", f"fix-{rng.randrange(4)}", "#a11y-load", None])
        out.append((s, seq, START, kind, "p" if kind == "progress" else None, target if kind == "replace" else None, html))
    return out


EVENTS = "session_id long, seq long, ts timestamp, type string, phase string, target string, html string"


def fold(events, id_of):
    """The page by the sequential definition: a list of blocks, changed event by event."""
    pages = {}
    for s, seq, _, kind, _, target, html in sorted(events):
        blocks = pages.setdefault(s, [])
        if kind == "append" and html:
            name = id_of.get(html) or f"blk-{seq}"
            shown = html if id_of.get(html) else html.replace("<p", f'<p id="blk-{seq}"', 1)
            pages[s] = [b for b in blocks if b[1] != "a11y-load"] + [[seq, name, shown]]
        elif kind == "replace" and target and html:
            name = target.removeprefix("#")
            hits = [b for b in blocks if b[1] == name]
            for b in hits:
                b[2] = html
            if not hits:
                blocks.append([seq, name, html])
    return {(s, *b) for s, blocks in pages.items() for b in blocks}


@pytest.mark.parametrize("seed", range(4))
def test_snapshot_equals_sequential_fold(spark, seed):
    events = live_events(seed)
    df = spark.createDataFrame(events, EVENTS)
    id_of = {r.html: r.id for r in df.select("html", existing_block_id(F.col("html")).alias("id")).distinct().collect()}
    got = {(r.session_id, r.ord, r.block_id, r.html) for r in live.snapshot(df).collect()}
    assert got == fold(events, id_of)


def test_inline_budget_is_greedy(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 4), f"f{rng.randrange(60)}", i, rng.choice([None, 0, 5, 40, 90, 200])) for i in range(200)]
    sizes = {}
    rows = [(s, f, i, sizes.setdefault((s, f), b)) for s, f, i, b in rows]
    df = spark.createDataFrame(rows, "session_id long, fig_id string, ord long, crop_bytes long")
    used, fits = {}, {}
    for s, f, _, b in rows:
        if (s, f) not in fits:
            ok = b is not None and used.get(s, 0) + b <= 150
            fits[(s, f)] = ok
            used[s] = used.get(s, 0) + (b if ok else 0)
    got = {(r.session_id, r.fig_id): r.inlined for r in live.inline_budget(df, 150).collect()}
    assert got == fits


def ratio(one, other):
    def lum(c):
        f = [v / 255 / 12.92 if v / 255 <= 0.03928 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in c]
        return 0.2126 * f[0] + 0.7152 * f[1] + 0.0722 * f[2]

    a, b = sorted((lum(one), lum(other)))
    return (b + 0.05) / (a + 0.05)


@pytest.mark.parametrize("tile", [3, 64])
def test_contrast_equals_pixel_loops(spark, tile):
    rng = random.Random(5)
    size = 20
    image = {(p, x, y): (rng.choice([0, 90, 255]), rng.randrange(256), 120, 255 if rng.random() < 0.9 or p == 0 else 10) for p in range(4) for x in range(size) for y in range(size)}
    image.update({(3, x, y): (1, 2, 3, 0) for x in range(size) for y in range(size)})
    spans = [(0 if i % 3 else rng.randrange(5), i, f"t{i}", "#%02x%02x%02x" % tuple(rng.randrange(256) for _ in range(3)), rng.uniform(-3, 21), rng.uniform(-3, 21), rng.uniform(0, 9), rng.uniform(0, 9), 30.0 * rng.random(), bool(i % 2)) for i in range(60)]
    pages = [(p, size, size, None if p == 1 else 25.0) for p in range(6)]
    from math import ceil, floor

    want, seen = {}, set()
    for p, i, _, ink, x, y, w, h, px, bold in spans:
        box = [(a, b) for a in range(max(0, floor(x)), min(size, ceil(x + w))) for b in range(max(0, floor(y)), min(size, ceil(y + h))) if (p, a, b) in image]
        ratios = []
        for a, b in box:
            *rgb, alpha = image[p, a, b]
            if alpha < 255:
                seen.add(p)
            else:
                ratios.append(ratio([int(ink[k : k + 2], 16) for k in (1, 3, 5)], rgb))
        if ratios:
            ratios.sort()
            worst, mid = (floor(r * 100 + 0.5) / 100 for r in (ratios[len(ratios) // 50], ratios[len(ratios) // 2]))
            points = None if p == 1 else px * 25.0 / size
            need = 3.0 if points is not None and (points >= 18 or (points >= 14 and bold)) else 4.5
            want[p, i] = (worst, mid, need, worst >= need)
    frames = (
        spark.createDataFrame(spans, "page_id long, span_idx long, text string, color string, x double, y double, width double, height double, font_size_px double, bold boolean"),
        spark.createDataFrame([(*k, *v) for k, v in image.items()], "page_id long, x long, y long, r int, g int, b int, a int"),
        spark.createDataFrame(pages, "page_id long, width long, height long, page_point_width double"),
    )
    got = {(r.page_id, r.span_idx): (r.worst_ratio, r.median_ratio, r.threshold, r.passes) for r in contrast.span_contrast(*frames, tile).collect()}
    assert got == want
    summary = {r.page_id: r for r in contrast.measure_pages(*frames, tile).collect()}
    assert set(summary) == set(range(6))
    for p, r in summary.items():
        mine = {i: v for (q, i), v in want.items() if q == p}
        assert (r.n_spans, r.n_failing, r.approximated) == (len(mine), sum(not v[3] for v in mine.values()), p in seen)
        if mine:
            assert r.worst_text == f"t{min(mine, key=lambda i: (mine[i][0] - mine[i][2], i))}" and r.min_worst_ratio == min(v[0] for v in mine.values())


def tree(seed, n=300):
    rng = random.Random(seed)
    rows = [(d, 1, 0) for d in range(3)]
    for d in range(3):
        # a chain of 250 and a bush, some nodes with a missing parent
        rows += [(d, e, e - 1) for e in range(2, 251)]
        rows += [(d, 1000 + e, rng.choice([1, 1000 + rng.randrange(e + 1), 9999])) for e in range(n)]
    return [(d, e, p, rng.choice(["TH", "Table", "P"]) if rng.random() < 0.05 else "Div", rng.choice(["x", "y ", " ", None])) for d, e, p in rows]


def test_trees(spark):
    rows = tree(11)
    df = spark.createDataFrame(rows, "doc_id long, elem long, parent_elem long, role string, text string")
    parent = {(d, e): p for d, e, p, _, _ in rows}

    def chain(d, e):
        seen = []
        while (d, e) in parent and e not in seen:
            seen.append(e)
            e = parent[d, e]
        return seen, e

    depth = {}
    for d, e, *_ in rows:
        up, end = chain(d, e)
        if end == 0 and len(up) - 1 <= 200:
            depth[d, e] = len(up) - 1
    assert {(r.doc_id, r.elem): r.depth for r in probe.tree_depths(df, 200).collect()} == depth
    headed = {(d, a) for d, e, _, role, _ in rows if role == "TH" for a in chain(d, e)[0][:61]}
    want = {}
    for d, e, _, role, _ in rows:
        if role == "Table":
            n, k = want.get(d, (0, 0))
            want[d] = (n + 1, k + ((d, e) in headed))
    assert {r.doc_id: (r.tables, r.tables_with_th) for r in probe.table_header_coverage(df).collect()} == want


def test_gate_and_deadline_by_hand(spark):
    rng = random.Random(9)
    kinds = [ledger.REQUESTED, ledger.APPROVED, ledger.REJECTED, "routine.done"]
    rows = [(0 if rng.random() < 0.34 else rng.randrange(1, 6), i, START + timedelta(hours=rng.randrange(24 * 40)), rng.choice(kinds), rng.random() < 0.2) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, event_id long, ts timestamp, event string, held boolean")
    outcome, sla = {}, {}
    for d in range(6):
        open_, waiting = False, None
        for _, i, ts, event, held in sorted((r for r in rows if r[0] == d and r[3].startswith("human")), key=lambda r: (r[2], r[1])):
            free = event == ledger.REQUESTED or not held  # a held decision leaves the deadline armed
            if waiting and free:
                sla[waiting[0]] = ("superseded" if event == ledger.REQUESTED else "decided") if ts <= waiting[1] + timedelta(days=7) else "elapsed"
            waiting = (i, ts) if event == ledger.REQUESTED else None if free else waiting
            if event == ledger.REQUESTED:
                open_, outcome[i] = True, "pending_review"
            elif not open_:
                outcome[i] = "no open gate"
            elif held:
                outcome[i] = "deferred"
            else:
                open_, outcome[i] = False, "finalized" if event == ledger.APPROVED else "rejected"
        if waiting:
            sla[waiting[0]] = "open" if waiting[1] + timedelta(days=7) > datetime(2024, 2, 9) else "elapsed"
    assert {r.event_id: r.outcome for r in ledger.gate_fsm(df).collect()} == outcome
    assert {r.event_id: r.outcome for r in ledger.review_sla(df, as_of=datetime(2024, 2, 9)).collect()} == sla
