"""Raw page markup: element streams, page metadata, structure facts and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions.text import safe_url, trimmed, truthy

# what may stand between the name and the end of a tag: a quoted value may hold any character, the end of a tag too;
# possessive, so that long values cost no stack
_INSIDE = r"""(?:\s(?:"[^"]*+"|'[^']*+'|[^'">]++)*+)?"""
_TAG = rf"</?[a-zA-Z][a-zA-Z0-9-]*{_INSIDE}/?>"
_NAME = r"^</?([a-zA-Z][a-zA-Z0-9-]*)"
COMMENT = r"(?s)<!--.*?--!?>"


def without_raw_text(html: Column) -> Column:
    """Markup without comments and without script and style bodies, which may hold tag look-alikes."""
    plain = F.regexp_replace(html, COMMENT, "")
    return F.regexp_replace(plain, rf"(?is)(<(script|style){_INSIDE}>).*?(</\2\s*>)", "$1$3")


def tags(html: Column) -> Column:
    """All tags of a page in order, as written."""
    return F.regexp_extract_all(without_raw_text(html), F.lit(f"({_TAG})"), 1)


def _running_sums(steps: Column, block: int = 64) -> Column:
    """Running sums of an ARRAY<INT>, block by block, so that no long array is copied for every element."""
    none = F.array().cast("array<int>")
    last = lambda sums: F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0))
    append = lambda sums, v: F.array_append(sums, last(sums) + v)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, F.lit(block)))
    local = F.transform(blocks, lambda part: F.aggregate(part, none, append))
    before = F.aggregate(local, F.array(F.lit(0)), lambda sums, part: F.array_append(sums, last(sums) + last(part)))
    return F.when(F.size(steps) > 0, F.flatten(F.transform(local, lambda part, i: F.transform(part, lambda v: v + F.get(before, i))))).otherwise(none)


def html_elements(pages: DataFrame) -> DataFrame:
    """One row per tag: page_id, pos, tag, is_close, is_void, attrs, depth after the tag.

    Depth is a plain running balance of opening and closing tags; void tags do not count. It is taken over the
    tags of the page where they lie, before these become rows, so nothing is shuffled.
    """
    name = lambda t: F.lower(F.regexp_extract(t, _NAME, 1))
    void = lambda t: name(t).isin(fv.VOID_TAGS) | F.endswith(t, F.lit("/>"))
    listed = pages.select("page_id", tags(F.col("html")).alias("raws"))
    told = listed.withColumn("tags", F.transform("raws", lambda t: F.struct(t.alias("raw"), name(t).alias("tag"), F.startswith(t, F.lit("</")).alias("is_close"), void(t).alias("is_void"))))
    steps = F.transform("tags", lambda t: F.when(t["is_close"], -1).when(t["is_void"], 0).otherwise(1))
    summed = told.withColumn("depths", _running_sums(steps))
    rows = summed.select("page_id", F.posexplode(F.zip_with("tags", "depths", lambda t, d: t.withField("depth", d.cast("bigint")))).alias("pos", "t"))
    return rows.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "t.tag", "t.is_close", "t.is_void",
        trimmed(F.regexp_extract("t.raw", r"(?s)^</?[a-zA-Z][a-zA-Z0-9-]*(.*?)/?>$", 1)).alias("attrs"), "t.depth",
    )


def _lang(html: Column) -> Column:
    return truthy(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']([^"']*)["']""", 1))


def _title(html: Column) -> Column:
    return truthy(trimmed(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))


def doc_metadata(pages: DataFrame) -> DataFrame:
    """Language, title and their consequences; an empty title counts as none."""
    return pages.select(
        "page_id", _lang(F.col("html")).alias("lang"), _title(F.col("html")).alias("title"),
        _title(F.col("html")).isNotNull().alias("display_doc_title"),
        F.lit(False).alias("encrypted"), F.lit(1).cast("bigint").alias("page_count"),
    )


def _headed_tables(table_tags: Column) -> Column:
    """Tables that hold a header cell before they close, from the table and header tags in order."""
    start = F.struct(F.array().cast("array<boolean>").alias("open"), F.lit(0).alias("done"))

    def step(acc: Column, tag: Column) -> Column:
        open_, done = acc["open"], acc["done"]
        top = F.element_at(open_, -1)
        return (
            F.when(tag == "table", F.struct(F.array_append(open_, F.lit(False)).alias("open"), done.alias("done")))
            .when(tag == "th", F.struct(F.transform(open_, lambda _: F.lit(True)).alias("open"), done.alias("done")))
            .when(
                F.size(open_) > 0,
                F.struct(F.slice(open_, F.lit(1), F.size(open_) - 1).alias("open"), (done + F.when(top, 1).otherwise(0)).alias("done")),
            )
            .otherwise(acc)
        )

    return F.aggregate(table_tags, start, step, lambda acc: acc["done"] + F.size(F.filter(acc["open"], lambda o: o)))


def probe_pages(pages: DataFrame) -> DataFrame:
    """Raw markup to the facts table of the structure probe (doc_id = page_id), without any shuffle.

    Openable: has an html tag; structure: any heading; marked: any landmark; figures: img and
    figure; tables as the probe counts them.
    """
    raw = pages.select("page_id", "html", tags(F.col("html")).alias("tags"))
    kinds = raw.select(
        "page_id", _lang(F.col("html")).alias("lang"), _title(F.col("html")).alias("title"), "tags",
        F.transform("tags", lambda t: F.lower(F.regexp_extract(t, r"^<(/?[a-zA-Z][a-zA-Z0-9-]*)", 1))).alias("names"),
    )

    def any_of(*names: str) -> Column:
        return F.arrays_overlap("names", F.array(*[F.lit(n) for n in names]))

    figure_tags = F.filter("tags", lambda t: F.lower(F.regexp_extract(t, r"^<([a-zA-Z][a-zA-Z0-9-]*)", 1)).isin("img", "figure"))
    alt = lambda t: F.regexp_extract(t, r"""(?is)\salt\s*=\s*["']([^"']*)["']""", 1)
    table_tags = F.filter("names", lambda n: n.isin("table", "/table", "th"))
    return kinds.select(
        F.col("page_id").alias("doc_id"), F.lit("pages").alias("source"), any_of("html").alias("openable"), F.lit(False).alias("encrypted"),
        any_of("h1", "h2", "h3", "h4", "h5", "h6").alias("has_struct_root"),
        any_of("nav", "main", "article", "section", "header", "footer").alias("marked"),
        "lang", "title", F.col("title").isNotNull().alias("display_doc_title"), F.lit(1).cast("bigint").alias("page_count"),
        F.size(figure_tags).cast("bigint").alias("figures"),
        F.size(F.filter(figure_tags, lambda t: trimmed(alt(t)) != "")).cast("bigint").alias("figures_with_alt"),
        F.size(F.filter("names", lambda n: n == "table")).cast("bigint").alias("tables"),
        _headed_tables(table_tags).cast("bigint").alias("tables_with_th"),
    )


def link_targets(pages: DataFrame) -> DataFrame:
    """Every link of a page and whether its address may stay."""
    links = F.regexp_extract_all(without_raw_text(F.col("html")), F.lit(r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1)
    return pages.select("page_id", F.posexplode(links).alias("pos", "href")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", safe_url(F.col("href")).alias("allowed")
    )


def removal_counts(pages: DataFrame) -> DataFrame:
    """What cleaning will take from each page: dropped tags, unwrapped tags, comments."""
    opened = F.filter(
        F.transform(tags(F.col("html")), lambda t: F.lower(F.regexp_extract(t, r"^<([a-zA-Z][a-zA-Z0-9-]*)", 1))), lambda n: n != ""
    )
    dropped = F.filter("opened", lambda n: n.isin(fv.DROPPED_TAGS))
    unwrapped = F.filter("opened", lambda n: ~n.isin(fv.DROPPED_TAGS) & ~n.isin(fv.ALLOWED_TAGS))
    return pages.withColumn("opened", opened).select(
        "page_id", F.size("opened").cast("bigint").alias("n_tags"), F.size(dropped).cast("bigint").alias("n_dropped"),
        F.size(unwrapped).cast("bigint").alias("n_unwrapped"),
        F.regexp_count("html", F.lit(COMMENT)).cast("bigint").alias("n_comments"),
    )


# tags that never have content
_EMPTY = [*fv.VOID_TAGS, "link", "base", "embed"]
_PIECE = rf"(?s){_TAG}|<[!?][^>]*>|[^<]+|<"
_ATTRIBUTE = r"""(?s)[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
_TO_END = 2**31 - 1


def _dropped_ranges(pieces: Column) -> Column:
    """ARRAY<STRUCT<a, b, opened>> of the pieces that go with a dropped element, from its dropped tags in order.

    Inside a dropped element only its own name opens and closes; a stray closing tag goes alone; an element that never
    closes goes to the end.
    """
    drops = F.filter(F.transform(pieces, lambda p, i: p.withField("i", i)), lambda p: p["name"].isin(fv.DROPPED_TAGS))
    cut = lambda a, b, opened: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(opened).alias("opened"))
    state = lambda name, depth, at, cuts: F.struct(name.alias("name"), depth.cast("int").alias("depth"), at.cast("int").alias("at"), cuts.alias("cuts"))
    none, zero = F.lit(""), F.lit(0)
    start = state(none, zero, zero, F.array().cast("array<struct<a:int,b:int,opened:boolean>>"))

    def step(acc: Column, p: Column) -> Column:
        same = p["name"] == acc["name"]
        inside = (
            F.when(~same | (p["empty"] & ~p["close"]), acc)
            .when(~p["close"], state(acc["name"], acc["depth"] + 1, acc["at"], acc["cuts"]))
            .when(acc["depth"] > 1, state(acc["name"], acc["depth"] - 1, acc["at"], acc["cuts"]))
            .otherwise(state(none, zero, zero, F.array_append(acc["cuts"], cut(acc["at"], p["i"], True))))
        )
        outside = (
            F.when(p["close"], state(none, zero, zero, F.array_append(acc["cuts"], cut(p["i"], p["i"], False))))
            .when(p["empty"], state(none, zero, zero, F.array_append(acc["cuts"], cut(p["i"], p["i"], True))))
            .otherwise(state(p["name"], F.lit(1), p["i"], acc["cuts"]))
        )
        return F.when(acc["depth"] > 0, inside).otherwise(outside)

    return F.aggregate(drops, start, step, lambda acc: F.when(acc["depth"] > 0, F.array_append(acc["cuts"], cut(acc["at"], F.lit(_TO_END), True))).otherwise(acc["cuts"]))


def _attributes(piece: Column) -> Column:
    """ARRAY<STRUCT<raw, keep>> of an allowed opening tag."""
    allowed = F.create_map(*[F.lit(x) for tag, names in fv.ALLOWED_ATTRIBUTES.items() for x in (tag, ",".join(["", *names, ""]))])
    listed = lambda tag, name: F.contains(F.coalesce(F.try_element_at(allowed, tag), F.lit("")), F.concat(F.lit(","), name, F.lit(",")))
    inner = F.regexp_extract(piece["raw"], r"(?s)^<[a-zA-Z][a-zA-Z0-9-]*(.*?)/?>$", 1)

    def judged(a: Column) -> Column:
        name = F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1))
        value = F.regexp_replace(F.regexp_extract(a, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1), r"""(?s)^["'](.*)["']$""", "$1")
        linked = ((piece["name"] == "img") & (name == "src")) | ((piece["name"] == "a") & (name == "href"))
        return F.struct(a.alias("raw"), ((listed(F.lit("*"), name) | listed(piece["name"], name)) & (~linked | safe_url(value))).alias("keep"))

    return F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(0)), judged)


def sanitize_pages(pages: DataFrame) -> DataFrame:
    """Cleaned markup per page and what was removed, in columns alone: nothing is shuffled and nothing leaves the JVM.

    Listed tags and attributes stay as written; dropped tags go with their content, other tags leave theirs; comments and
    declarations go. A link or image keeps its address only in a safe form. A null page is an empty one.
    """
    html = F.coalesce("html", F.lit(""))
    plain = F.regexp_replace(without_raw_text(html), r"(?s)<!--.*$", "")
    named = F.transform(
        F.regexp_extract_all(plain, F.lit(_PIECE), F.lit(0)),
        lambda t: F.struct(
            t.alias("raw"), F.lower(F.regexp_extract(t, _NAME, 1)).alias("name"), F.startswith(t, F.lit("</")).alias("close"),
            (F.endswith(t, F.lit("/>")) | F.lower(F.regexp_extract(t, _NAME, 1)).isin(_EMPTY)).alias("empty"), t.rlike(r"^<[!?]").alias("told"),
        ),
    )
    split = pages.select("page_id", html.alias("html"), named.alias("pieces")).withColumn("cuts", _dropped_ranges(F.col("pieces")))
    n = F.size("pieces")
    gone = F.flatten(F.transform("cuts", lambda c: F.sequence(c["a"], F.least(c["b"], n - 1))))
    left = F.when(n > 0, F.array_except(F.sequence(F.lit(0), n - 1), gone)).otherwise(F.array().cast("array<int>"))
    allowed = lambda p: p["name"].isin(fv.ALLOWED_TAGS)
    kept = split.withColumn("left", F.transform(left, lambda i: F.get("pieces", i)))
    judged = F.transform("left", lambda p: p.withField("attrs", F.when(allowed(p) & ~p["close"], _attributes(p))))

    def written(p: Column) -> Column:
        held = F.transform(F.filter(p["attrs"], lambda a: a["keep"]), lambda a: F.concat(F.lit(" "), a["raw"]))
        tag = F.concat(F.lit("<"), p["name"], F.array_join(held, ""), F.when(F.endswith(p["raw"], F.lit("/>")), " />").otherwise(">"))
        closing = F.when(p["name"].isin(fv.VOID_TAGS), "").otherwise(F.concat(F.lit("</"), p["name"], F.lit(">")))
        whole = F.when(F.forall(p["attrs"], lambda a: a["keep"]), p["raw"]).otherwise(tag)
        # a stray "<" is written as text, so that no tag can come together where something went
        return F.when(p["told"], "").when(p["raw"] == "<", "&lt;").when(p["name"] == "", p["raw"]).when(~allowed(p), "").when(p["close"], closing).otherwise(whole)

    count = lambda c: F.size(c).cast("bigint")
    return kept.withColumn("left", judged).select(
        "page_id", F.array_join(F.transform("left", written), "").alias("html"), count(F.filter("cuts", lambda c: c["opened"])).alias("n_dropped"),
        count(F.filter("left", lambda p: (p["name"] != "") & ~p["close"] & ~allowed(p))).alias("n_unwrapped"),
        count(F.flatten(F.transform("left", lambda p: F.filter(F.coalesce(p["attrs"], F.array().cast("array<struct<raw:string,keep:boolean>>")), lambda a: ~a["keep"])))).alias("n_attributes"),
        F.regexp_count("html", F.lit(COMMENT)).cast("bigint").alias("n_comments"),
    )
