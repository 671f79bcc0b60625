"""Known inputs and results."""

import pytest
from pyspark.sql import functions as F

from claridoc.functions import color, text, urls
from claridoc.functions.blocks import all_blocks, split_blocks
from claridoc.functions.blocks import strip_fence as strip_fence_py
from claridoc.functions.hashing import base36, code32, powers
from claridoc.operators import ingest, live, markup, rollup
from claridoc.operators.geometry import parse_bbox

BLOCKED = """127.0.0.1 127.5.5.5 0.0.0.0 10.0.0.5 172.16.0.1 172.31.255.255 192.168.1.1 169.254.169.254 100.64.0.1 192.0.0.1
224.0.0.1 255.255.255.255 localhost foo.localhost svc.internal box.local metadata.google.internal ::1 fe80::1 [::1] 2130706433
0x7f000001 999.1.1.1""".split() + [""]
ALLOWED = "arxiv.org www.sec.gov files.catbox.moe 8.8.8.8 1.2.3.4".split()


def column(spark, values, f, name="v"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_blocked_hosts(spark):
    assert column(spark, BLOCKED, urls.blocked_host) == [True] * len(BLOCKED)
    assert column(spark, ALLOWED, urls.blocked_host) == [False] * len(ALLOWED)


def test_gate(spark):
    cases = {
        "https://www.sec.gov/a.pdf": (True, "L0"), "https://arxiv.org/pdf/1": (True, "L1"), "https://example.com/x": (True, "P"),
        "https://www1.hkexnews.hk/x": (False, "L3"), "ftp://example.com/x": (False, "L3"), "nonsense": (False, "L3"),
        "http://169.254.169.254/latest": (False, "L3"), "http://2130706433/": (False, "L3"), "http://0x7f.1/": (False, "L3"), "http://[::1]/": (False, "L3"),
        "http://user:pw@LOCALHOST:80/": (False, "L3"), "https://notsec.gov/": (True, "P"), "http://134744072/": (True, "P"), "http://1.2.3.4.5/": (False, "L3"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: (r.ok, r.level) for r in ingest.url_gate(df).collect()}
    assert got == cases


def test_numeric_hosts(spark):
    values = ["http://2130706433/", "http://0x7f.1/", "http://010.0.0.1/", "http://256.1.1.1/", "http://4294967296/", "http://Example.COM:8080/p"]
    assert column(spark, values, urls.host) == ["127.0.0.1", "127.0.0.1", "8.0.0.1", None, None, "example.com"]


def test_redact(spark):
    values = ["https://a.example/x/y?sig=1", "https://a.example", "http://a.example:80/x", "http://a.example:81/x#top", "broken?x#y", "https://a.example/x?"]
    assert column(spark, values, urls.redact_url) == [
        "https://a.example/x/y (query redacted)", "https://a.example/", "http://a.example/x", "http://a.example:81/x (query redacted)", "broken", "https://a.example/x"]


def test_short_hash(spark):
    values = ["hello", "", "é😀" * 50, "a" * 5000, None]

    def slow(s):
        h = 5381
        units = s.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h * 33 + int.from_bytes(units[i : i + 2], "little")) % 2**32
        return base36(h).rjust(6, "0")[-6:]

    got = column(spark, values, text.short_hash)
    assert got[0] == "4bj995"
    assert got == [None if v is None else slow(v) for v in values]
    assert code32("", powers(0)) == 5381


def test_blocks():
    assert split_blocks("<h1>Title</h1>\n<p>Body</p>\n<table><tr><td>x") == (["<h1>Title</h1>", "<p>Body</p>"], "<table><tr><td>x")
    assert split_blocks("```html\n<h1>Hi</h1>\n")[0] == ["<h1>Hi</h1>"]
    assert split_blocks("loose text<h1>H</h1>")[0] == ["<p>loose text</p>", "<h1>H</h1>"]
    assert split_blocks("<hr/>after") == (["<hr/>"], "after")
    assert split_blocks("<table><tr><td>a</td>")[0] == []
    assert strip_fence_py("```html\n<h1>Hi</h1>\n```") == "<h1>Hi</h1>"
    assert all_blocks("<p>a</p> tail") == ["<p>a</p>", "tail"]
    assert split_blocks("text < 5 <p>x</p>") == (["<p>text</p>", "< 5 <p>x</p>"], "")
    assert split_blocks("words <") == (["<p>words</p>"], "<")


def test_chunked_reassembly():
    rest, got = "", []
    for chunk in ["<h2>Sec", "tion</h2><ul><li>a</li>", "<li>b</li></ul><p>ta", "il</p>"]:
        found, rest = split_blocks(rest + chunk)
        got += found
    assert got == ["<h2>Section</h2>", "<ul><li>a</li><li>b</li></ul>", "<p>tail</p>"] and rest == ""


@pytest.mark.parametrize("size", [1, 3, 7, 40])
def test_any_chunk_size_gives_the_same_blocks(size):
    whole = '<h1>A</h1> <ul><li>a</li></ul> stray <figure data-page="1"><figcaption>x <b>y</b></figcaption></figure><hr/><table><tr><th>z</th></tr></table>'
    rest, got = "", []
    for i in range(0, len(whole), size):
        found, rest = split_blocks(rest + whole[i : i + size])
        got += found
    assert got == all_blocks(whole)


def test_block_ids(spark):
    given = ["<p>hello</p>", '<figure id="fig-x" data-bbox="1,2,3,4"></figure>', '<figure data-page="2"><i></i></figure>', "plain"]
    assert column(spark, given, lambda c: text.with_block_id(c, F.lit("blk-5"))) == [
        '<p id="blk-5">hello</p>', '<figure id="fig-x" data-bbox="1,2,3,4"></figure>', '<figure id="blk-5" data-page="2"><i></i></figure>', "plain"]
    assert column(spark, given, text.existing_block_id) == [None, "fig-x", None, None]


def test_figures(spark):
    rows = [
        (1, '<figure data-page="3" data-bbox="100,200,800,950"><figcaption>A bar chart of revenue.</figcaption></figure>'),
        (2, '<figure data-bbox="0,0,500,500"><figcaption>see <b>fig</b> 2</figcaption></figure>'), (3, "<p>not a figure</p>"),
        (4, "<figure><figcaption>no bbox</figcaption></figure>"), (5, '<figure data-bbox="1,2,3,4,"></figure>'), (6, '<figure data-page="0" data-bbox="0x10, 1e1 x 2 3.5"></figure>'),
    ]
    got = {r.id: (r.page, r.ymin, r.xmin, r.ymax, r.xmax, r.caption) for r in live.parse_figures(spark.createDataFrame(rows, "id int, html string")).collect()}
    assert got == {1: (3, 100, 200, 800, 950, "A bar chart of revenue."), 2: (1, 0, 0, 500, 500, "see fig 2"), 6: (1, 16, 10, 2, 3.5, "")}


def test_resume(spark):
    df = spark.createDataFrame([("9", "5"), (None, "5"), (None, None), ("nope", "5"), ("-4", None), ("", "7"), (" 7.9 ", None), ("1f", None), ("0x1F", None)], "h string, q string")
    assert [r[0] for r in df.select(live.resume_point(F.col("h"), F.col("q"))).collect()] == [9, 5, 0, 0, 0, 0, 7, 0, 31]


def test_filename(spark):
    titles = ["Annual Report 2024", "！！！", "", None, "Résumé — 2024", 'a"; rm -rf /\r\nSet-Cookie: x=1', "--.x.--"]
    got = column(spark, titles, lambda c: live.safe_filename(c, F.lit("abcdef0123")))
    assert got[:5] == ["Annual-Report-2024.html", "a11y-document-abcdef01.html", "a11y-document-abcdef01.html", "a11y-document-abcdef01.html", "Resume-2024.html"]
    assert not set('"\r\n;/') & set(got[5]) and got[6] == "x.html"


def test_page_limit(spark):
    df = spark.createDataFrame([(10, "application/pdf", "", 3), (10, "x", "%PDF-", 50), (10, "x", "%PDF-", 51), (10, "text/html", "<html", 1), (21 * 1024**2, "application/pdf", "", 1), (10, "APPLICATION/PDF", None, None)],
                               "bytes long, content_type string, head string, page_count int")
    assert [r.ok for r in ingest.admit_documents(df).collect()] == [True, True, False, False, False, True]


def test_colors(spark):
    df = spark.createDataFrame([("#fff",), ("000000",), ("#12zz12",), ("#1B2511",), ("",)], "c string").withColumn("rgb", color.hex_to_rgb(F.col("c")))
    assert [None if r.rgb is None else tuple(r.rgb) for r in df.collect()] == [(255, 255, 255), (0, 0, 0), None, (27, 37, 17), None]
    white, black = color.luminance(*[F.lit(255)] * 3), color.luminance(*[F.lit(0)] * 3)
    one = spark.range(1).select(color.contrast_ratio(white, black).alias("a"), color.contrast_ratio(black, white).alias("b"), color.contrast_ratio(white, white).alias("c")).first()
    assert abs(one.a - 21) < 1e-9 and one.a == one.b and one.c == 1


def test_number_text(spark):
    df = spark.createDataFrame([(4.5,), (21.0,), (1.07,), (None,), (10.0,)], "x double")
    assert [r[0] for r in df.select(text.number_text(F.col("x"))).collect()] == ["4.5", "21", "1.07", None, "10"]


def test_boxes(spark):
    given = ["[4,3,2,1]", '{"x0":1,"top":2,"right":3,"y1":4}', '{"x":1,"y":2,"width":3,"h":4}', '{"x":1,"y":2,"w":0,"h":4}', '["1",2,3,4]', '{"x0":"1","y0":2,"x1":3,"y1":4}', "[1,2]", "junk", None]
    got = column(spark, given, parse_bbox)
    assert [None if g is None else tuple(g) for g in got] == [(2, 1, 4, 3), (1, 2, 3, 4), (1, 2, 4, 6), None, None, None, None, None, None]


def cleaned(spark, *pages):
    rows = markup.sanitize_pages(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).orderBy("page_id").collect()
    return [(r.html, r.n_dropped, r.n_unwrapped, r.n_attributes, r.n_comments) for r in rows]


def test_cleaner_reads_quoted_values_and_both_ends_of_comments(spark):
    script = '<p>a</p><script data-x="a>b">evil()</script><style media=\'(x>1)\'>p{}</style><p title="x">ok</p>'
    assert cleaned(spark, script, "<!-- a --!><p>x</p>", "<script src=" + "x" * 50_000 + ">s</script>") == [('<p>a</p><p>ok</p>', 2, 0, 1, 0), ("<p>x</p>", 0, 0, 0, 1), ("", 1, 0, 0, 0)]


def test_cleaner(spark):
    page = (
        '<div onclick="x"><p style="a" data-page="2">Hi &amp; <a href="javascript:1" title="t">x</a><a href="/ok">y</a><br></p><!-- c --><script>var t="</p>"</script>'
        '<form><input><b>gone</b></form><embed src="x"><img src="data:x" alt="&quot;"></div>'
    )
    want = '<p data-page="2">Hi &amp; <a title="t">x</a><a href="/ok">y</a><br></p><img alt="&quot;">'
    assert cleaned(spark, page) == [(want, 3, 1, 3, 1)]


def test_cleaner_on_broken_markup(spark):
    got = cleaned(
        spark, None, "", "a < b <p", "<p>x<svg><svg></svg>in</svg>out", "<form>never closed <b>gone</b>", "</form>stray</foo>", '<p title="a > b" data-page=3>q</p>', "<IMG SRC='/x' onerror=alert(1)/>", "<!DOCTYPE html><p>t<!-- open",
        "<a href=' JavaScript:x'>y</a><a href=#top>z</a>", "<scr<svg></svg>ipt>x",
    )
    assert [g[0] for g in got] == ["", "", "a &lt; b &lt;p", "<p>xout", "", "stray", "<p data-page=3>q</p>", "<img SRC='/x' />", "<p>t", "<a>y</a><a href=#top>z</a>", "&lt;script>x"]
    assert [g[1] for g in got] == [0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1]


def test_quoted_tag_ends(spark):
    pages = spark.createDataFrame([(1, '<p title="a > b"><br></p>')], "page_id long, html string")
    assert [(r.tag, r.attrs, r.depth) for r in markup.html_elements(pages).orderBy("pos").collect()] == [("p", 'title="a > b"', 1), ("br", "", 1), ("p", "", 0)]


def test_tables_with_headers(spark):
    html = [
        "<html><table><tr><th>a</th></tr></table></html>", "<html><table><tr><td>a</td></tr></table><th>late</th></html>",
        "<html><table><tr><td><table><th>inner</th></table></td></tr></table></html>", "<html><table></table><table><th>open", "<html><!-- <table> --><script>'<table>'</script></html>",
    ]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = [(r.tables, r.tables_with_th) for r in markup.probe_pages(pages).orderBy("doc_id").collect()]
    assert got == [(1, 1), (1, 0), (2, 2), (2, 1), (0, 0)]


def test_dimension_counts(spark):
    levels = {r.level: r["count"] for r in rollup.dim_sc(spark).groupBy("level").count().collect()}
    assert levels == {"A": 31, "AA": 24} and rollup.dim_area(spark).count() == 11
    assert rollup.area_sc(spark).join(rollup.dim_sc(spark), "sc", "left_anti").count() == 0


def test_frames(spark):
    df = spark.createDataFrame([(7, "replace", None, "#block-3", '<h2 id="block-3">Hi</h2>'), (1, "progress", "Structuring", None, None)], "seq long, type string, phase string, target string, html string")
    got = [r[0] for r in df.select(live.sse_frame(F.col("seq"), F.col("type"), phase=F.col("phase"), target=F.col("target"), html=F.col("html"))).collect()]
    assert got[0] == 'id: 7\nevent: replace\ndata: {"type":"replace","target":"#block-3","html":"<h2 id=\\"block-3\\">Hi</h2>"}\n\n'
    assert got[1] == 'id: 1\nevent: progress\ndata: {"type":"progress","phase":"Structuring"}\n\n'


def test_files(spark, tmp_path):
    from claridoc.sources.tables import append_log, read_files, write_report

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "deep" / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "in" / "c.txt").write_bytes(b"%PDF-")
    files = read_files(spark, str(tmp_path / "in"))
    named = files.withColumn("content_type", F.lit("application/octet-stream")).withColumn("page_count", F.lit(None).cast("int"))
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.ok) for r in ingest.admit_documents(named).collect()}
    assert got == {"a.pdf": (10, True), "b.pdf": (6, False)}
    write_report(files, str(tmp_path / "out"))
    append_log(files, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
