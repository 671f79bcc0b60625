"""Text contrast measured over span and pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions.color import contrast_ratio, hex_to_rgb, luminance, round2
from claridoc.functions.text import number_text, trimmed, truthy
from claridoc.operators.criteria import evidence

TILE = 64
FILTER_BITS = 1 << 24
BROADCAST_BOXES = 1 << 20  # of some 80 bytes


def flatten_spans(containers: DataFrame) -> DataFrame:
    """Nested text containers to one row per coloured span.

    ``containers``: page_id, container_no, items ARRAY<STRUCT<font_file, x, y, width, height,
    font_size, spans ARRAY<STRUCT<text, color>>>>. Spans of one item share its width by text length.
    """
    items = containers.select("page_id", "container_no", F.posexplode("items").alias("item_no", "it")).filter(
        F.col("it.x").isNotNull() & F.col("it.width").isNotNull()
    )
    colored = items.withColumn("sp", F.filter("it.spans", lambda s: truthy(s["color"]).isNotNull()))
    weight = lambda s: F.greatest(F.lit(1), F.length(trimmed(F.coalesce(s["text"], F.lit("")))))
    sized = colored.withColumn("w", F.transform("sp", weight)).withColumn(
        "total", F.aggregate("w", F.lit(0), lambda n, v: n + v)
    )
    one = sized.select("*", F.posexplode("sp").alias("span_no", "s"))
    shared = F.size("sp") > 1
    before = F.aggregate(F.slice("w", F.lit(1), F.col("span_no")), F.lit(0), lambda n, v: n + v)
    width = F.col("it.width")
    mine = F.element_at("w", F.col("span_no") + 1)
    return one.select(
        "page_id", "container_no", F.col("item_no").cast("bigint").alias("item_no"), F.col("span_no").cast("bigint").alias("span_no"),
        trimmed(F.replace(F.coalesce("s.text", F.lit("")), F.lit("\n"), F.lit(" "))).alias("text"),
        F.col("s.color").alias("color"),
        F.when(shared, F.col("it.x") + width * before / F.col("total")).otherwise(F.col("it.x")).alias("x"),
        F.col("it.y").alias("y"),
        F.when(shared, width * mine / F.col("total")).otherwise(width).alias("width"),
        F.col("it.height").alias("height"),
        F.coalesce("it.font_size", F.lit(0.0)).alias("font_size_px"),
        F.coalesce(F.col("it.font_file").rlike(fv.BOLD_FACES), F.lit(False)).alias("bold"),
    )


def large_text(font_px: Column, bold: Column, page_points: Column, image_width: Column) -> Column:
    """Large print by point size; an unknown scale counts as normal print."""
    points = font_px * page_points / image_width
    known = page_points.isNotNull() & (page_points > 0) & (image_width > 0)
    return F.coalesce(known & ((points >= 18) | ((points >= 14) & bold)), F.lit(False))


def _threshold(large: Column) -> Column:
    return F.when(large, 3.0).otherwise(4.5)


def _boxes(spans: DataFrame, pages: DataFrame) -> DataFrame:
    dims = pages.select("page_id", F.col("width").alias("page_width"), F.col("height").alias("page_height"), "page_point_width")
    zero = F.lit(0).cast("bigint")
    return spans.join(dims, "page_id").select(
        "page_id", "span_idx", "text", "color", "font_size_px", "bold", "page_width", "page_point_width",
        F.greatest(zero, F.floor("x")).alias("x0"), F.greatest(zero, F.floor("y")).alias("y0"),
        F.least(F.col("page_width"), F.ceil(F.col("x") + F.col("width"))).alias("x1"),
        F.least(F.col("page_height"), F.ceil(F.col("y") + F.col("height"))).alias("y1"),
    ).filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def _tiled(boxes: DataFrame, tile: int) -> DataFrame:
    """Each box once per square tile it touches, with its text's luminance as ``ink``."""
    def cells(low: str, high: str) -> Column:
        return F.sequence(F.expr(f"{low} div {tile}"), F.expr(f"({high} - 1) div {tile}"))

    rgb = boxes.withColumn("rgb", hex_to_rgb(F.col("color")))
    return (
        rgb.select("page_id", "span_idx", "x0", "y0", "x1", "y1", luminance(F.col("rgb.r"), F.col("rgb.g"), F.col("rgb.b")).alias("ink"))
        .withColumn("tx", F.explode(cells("x0", "x1"))).withColumn("ty", F.explode(cells("y0", "y1")))
        .withColumn("tile", F.shiftleft("ty", 32) + F.col("tx"))
    )


def _under_text(dots: DataFrame, tiled: DataFrame) -> DataFrame:
    """Pixels whose tile some box may touch, by a Bloom filter of tiles: a table of ``FILTER_BITS`` / 64 words at most, however many tiles there are.

    The filter keeps every pixel that counts; when tiles outgrow it, it lets more through and nothing changes but speed.
    """
    place = F.xxhash64("page_id", "tile").bitwiseAND(FILTER_BITS - 1)
    words = tiled.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits"))
    marked = dots.withColumn("h", place).withColumn("word", F.shiftright("h", 6))
    return marked.join(F.broadcast(words), "word").filter("bit_get(bits, cast(h % 64 as int)) = 1").drop("h", "word", "bits")


def _dealt(spans: DataFrame, pages: DataFrame, parts: int | None) -> tuple[DataFrame, DataFrame, int | None]:
    """Spans and pages dealt by page_id into the ``parts`` in which pixels lie; as they are, with None, where pixels lie anyhow or spans are few enough to go to them all."""
    if parts is None or spans.limit(BROADCAST_BOXES + 1).count() <= BROADCAST_BOXES:
        return spans, pages, None
    # joins on page_id and more go on where the pages lie; no result depends on it
    spans.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spans.repartition(parts, "page_id"), pages.repartition(parts, "page_id"), parts


def _covered(boxes: DataFrame, pixels: DataFrame, tile: int, parts: int | None = None) -> DataFrame:
    """Pixels under boxes as (page_id, span_idx, paint, ink, n): ``n`` pixels of one colour under the box, with the box's ``ink``; rows may repeat.

    Up to ``BROADCAST_BOXES`` places of boxes, counted first, go to where the pixels lie, so that no pixel travels. Beyond that the pixels
    travel folded: those of one colour in one row of a tile become one number with a bit per place, by partial
    aggregation, and a box counts the bits inside its range. A plain background then moves one row where it had ``tile``
    pixels. A picture has every pixel once.
    """
    if not 0 < tile <= 64:
        raise ValueError("a row of a tile has 64 places at most")
    tiled = _tiled(boxes, tile)
    paint = F.shiftleft(F.col("a").cast("bigint"), 24) + F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")
    cell = F.shiftleft(F.expr(f"y div {tile}"), 32) + F.expr(f"x div {tile}")
    if parts is not None or tiled.limit(BROADCAST_BOXES + 1).count() <= BROADCAST_BOXES:
        dots = pixels.select("page_id", cell.alias("tile"), "x", "y", paint.alias("paint"))
        met = dots.join(tiled.hint("broadcast" if parts is None else "shuffle_hash"), ["page_id", "tile"]).filter("x >= x0 and x < x1 and y >= y0 and y < y1")
        return met.select("page_id", "span_idx", "paint", "ink", F.lit(1).cast("bigint").alias("n"))
    dots = pixels.select("page_id", cell.alias("tile"), (paint * 64 + F.expr(f"y % {tile}")).alias("dab"), F.expr(f"shiftleft(1L, cast(x % {tile} as int))").alias("bit"))
    runs = _under_text(dots, tiled).groupBy("page_id", "tile", "dab").agg(F.bit_or("bit").alias("bits"))
    # sizes of exploded inputs are not known to the planner, so neither side may be broadcast by estimate
    met = tiled.join(runs.hint("merge"), ["page_id", "tile"])
    y = F.col("ty") * tile + F.col("dab") % 64
    low, high = F.greatest(F.col("x0") - F.col("tx") * tile, F.lit(0)).cast("int"), F.least(F.col("x1") - F.col("tx") * tile, F.lit(tile)).cast("int")
    upto = lambda name: F.expr(f"if({name} = 64, -1L, shiftleft(1L, {name}) - 1)")
    inside = met.filter((y >= F.col("y0")) & (y < F.col("y1"))).withColumns({"low": low, "high": high})
    n = F.bit_count(F.col("bits").bitwiseAND(upto("high")).bitwiseAND(F.bitwise_not(upto("low")))).cast("bigint")
    return inside.select("page_id", "span_idx", F.shiftright("dab", 6).alias("paint"), "ink", n.alias("n")).filter("n > 0")


def _channel(shift: int) -> Column:
    return F.shiftright("paint", shift).bitwiseAND(255).cast("int")


def span_pixels(spans: DataFrame, pixels: DataFrame, pages: DataFrame, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """Colours under each span: page_id, span_idx, r, g, b, opaque, n (pixels of that colour).

    ``parts``, here and below: pixels lie by page_id in so many partitions, as ``repartition(parts, "page_id")`` deals them. They then
    do not travel, however many spans there are. One page's pixels and spans are one task's.
    """
    spans, pages, parts = _dealt(spans, pages, parts)
    colours = _covered(_boxes(spans, pages), pixels, tile, parts).groupBy("page_id", "span_idx", "paint").agg(F.sum("n").alias("n"))
    split = colours.select("page_id", "span_idx", _channel(16).alias("r"), _channel(8).alias("g"), _channel(0).alias("b"), (_channel(24) >= 255).alias("opaque"), "n")
    return split.groupBy("page_id", "span_idx", "r", "g", "b", "opaque").agg(F.sum("n").alias("n"))


SPAN_FIELDS = ["span_idx", "text", "color", "x0", "y0", "x1", "y1", "worst_ratio", "median_ratio", "large_text", "threshold", "passes"]


def measure_spans(spans: DataFrame, pixels: DataFrame, pages: DataFrame, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """Worst (2nd percentile) and median contrast per span by exact rank.

    Also says whether a span lies on see-through pixels, which do not count. A span with no other
    pixels stays, with ``measured`` false. Ratios are shown with two places, and rounding keeps their order, so ranks are
    taken over the rounded ones: a span has some two thousand of them (1.00 to 21.00), however many colours it has,
    and its list of counts is no longer than that.
    """
    spans, pages, parts = _dealt(spans, pages, parts)
    return _measured(spans, pixels, pages, tile, parts)


def _measured(spans: DataFrame, pixels: DataFrame, pages: DataFrame, tile: int, parts: int | None) -> DataFrame:
    boxes = _boxes(spans, pages)
    opaque = _channel(24) >= 255
    ratio = round2(contrast_ratio(F.col("ink"), luminance(_channel(16), _channel(8), _channel(0))))
    hist = _covered(boxes, pixels, tile, parts).groupBy("page_id", "span_idx", opaque.alias("opaque"), F.when(opaque, ratio).alias("ratio")).agg(F.sum(F.when(opaque, F.col("n")).otherwise(0)).alias("n"))
    step = F.when(F.col("opaque"), F.struct("ratio", "n"))
    listed = hist.groupBy("page_id", "span_idx").agg(F.sort_array(F.collect_list(step)).alias("steps"), F.bool_or("opaque").alias("measured"), F.bool_or(~F.col("opaque")).alias("saw_transparency"))
    counted = listed.withColumn("total", F.aggregate("steps", F.lit(0).cast("bigint"), lambda n, s: n + s["n"]))

    def at(rank: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("double").alias("ratio"))

        def add(acc: Column, s: Column) -> Column:
            upto = acc["upto"] + s["n"]
            return F.struct(upto.alias("upto"), F.coalesce(acc["ratio"], F.when(upto > rank, s["ratio"])).alias("ratio"))

        return F.aggregate("steps", start, add, lambda acc: acc["ratio"])

    stats = counted.select("page_id", "span_idx", at(F.expr("total div 50")).alias("worst_ratio"), at(F.expr("total div 2")).alias("median_ratio"), "measured", "saw_transparency")
    large = large_text(F.col("font_size_px"), F.col("bold"), F.col("page_point_width"), F.col("page_width"))
    return (
        boxes.join(stats, ["page_id", "span_idx"])
        .withColumn("large_text", large).withColumn("threshold", _threshold(F.col("large_text")))
        .withColumn("passes", F.coalesce(F.col("worst_ratio") >= F.col("threshold"), F.lit(False)))
        .select("page_id", *SPAN_FIELDS, "measured", "saw_transparency")
    )


def span_contrast(spans: DataFrame, pixels: DataFrame, pages: DataFrame, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """The measured spans alone."""
    return measure_spans(spans, pixels, pages, tile, parts).filter("measured").select("page_id", *SPAN_FIELDS)


def span_contrast_approx(spans: DataFrame, background: tuple[int, int, int] = (255, 255, 255), page_points: Column | None = None, image_width: Column | None = None) -> DataFrame:
    """Contrast against one representative colour; boxes are not clamped and nothing is dropped."""
    rgb = hex_to_rgb(F.col("color"))
    paper = luminance(*[F.lit(v) for v in background])
    ratio = round2(contrast_ratio(luminance(rgb["r"], rgb["g"], rgb["b"]), paper))
    unknown = F.lit(None).cast("double")
    large = large_text(F.col("font_size_px"), F.col("bold"), unknown if page_points is None else page_points, unknown if image_width is None else image_width)
    return (
        spans.withColumn("worst_ratio", ratio).withColumn("median_ratio", F.col("worst_ratio"))
        .withColumn("large_text", large).withColumn("threshold", _threshold(F.col("large_text")))
        .withColumn("passes", F.coalesce(F.col("worst_ratio") >= F.col("threshold"), F.lit(False)))
        .select(
            "page_id", "span_idx", "text", "color",
            F.floor("x").alias("x0"), F.floor("y").alias("y0"),
            F.ceil(F.col("x") + F.col("width")).alias("x1"), F.ceil(F.col("y") + F.col("height")).alias("y1"),
            "worst_ratio", "median_ratio", "large_text", "threshold", "passes",
        )
    )


def page_contrast(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Summary per page: the span with the least margin, the least ratio, and what passed.

    ``spans`` comes from ``measure_spans``. ``pages`` may carry a ``flaw``: the method text of pages
    that were not measured from pixels. Pages without spans stay.
    """
    fields = F.struct("text", "color", "x0", "y0", "x1", "y1", "worst_ratio", "large_text", "threshold")
    margin = F.struct((F.col("worst_ratio") - F.col("threshold")).alias("m"), F.col("span_idx").alias("i"))
    measured = F.col("measured")
    summary = spans.groupBy("page_id").agg(
        F.count_if(measured).alias("n_spans"), F.count_if(measured & ~F.col("passes")).alias("n_failing"),
        F.min("worst_ratio").alias("min_worst_ratio"), F.min_by(fields, F.when(measured, margin)).alias("w"), F.bool_or("saw_transparency").alias("saw"),
    )
    given = F.col("flaw") if "flaw" in pages.columns else F.lit(None).cast("string")
    flaw = F.coalesce(F.col("flaw"), F.when(F.col("saw"), fv.CONTRAST_METHOD["transparent"]))
    n = F.coalesce("n_spans", F.lit(0))
    failing = F.coalesce("n_failing", F.lit(0))
    return (
        pages.select("page_id", given.alias("flaw")).join(summary, "page_id", "left").withColumn("flaw", flaw)
        .select(
            "page_id", n.alias("n_spans"), failing.alias("n_failing"), "min_worst_ratio",
            ((n > 0) & (failing == 0)).alias("all_pass"), (failing > 0).alias("any_fail"),
            F.coalesce("flaw", F.lit(fv.CONTRAST_METHOD["exact"])).alias("method"),
            F.col("flaw").isNotNull().alias("approximated"),
            F.col("w.text").alias("worst_text"), F.col("w.color").alias("worst_color"),
            F.col("w.x0").alias("worst_x0"), F.col("w.y0").alias("worst_y0"), F.col("w.x1").alias("worst_x1"), F.col("w.y1").alias("worst_y1"),
            F.col("w.worst_ratio").alias("worst_ratio"), F.col("w.large_text").alias("worst_large"), F.col("w.threshold").alias("worst_threshold"),
        )
    )


def measure_pages(spans: DataFrame, pixels: DataFrame, pages: DataFrame, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """Exact measurement of every page, untrusted where text lies on see-through pixels. One pass over the pixels."""
    spans, pages, parts = _dealt(spans, pages, parts)
    return page_contrast(pages.drop("flaw"), _measured(spans, pixels, pages, tile, parts))


def lane_fallback(spans: DataFrame, pixels: DataFrame, pages: DataFrame, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """Measurement by layer status: exact, against white, or nothing at all.

    ``pages.layer_status``: ok; undecodable (spans known, image not); provider_error (no spans).
    Statuses are applied before the joins, so only pages with an image reach the pixels.
    """
    spans, pages, parts = _dealt(spans, pages, parts)
    good = pages.filter(F.col("layer_status") == "ok")
    blind = pages.filter(F.col("layer_status") == "undecodable").select("page_id")
    guessed = span_contrast_approx(spans.join(blind, "page_id", "left_semi"))
    rows = _measured(spans, pixels, good, tile, parts).unionByName(
        guessed.withColumn("measured", F.lit(True)).withColumn("saw_transparency", F.lit(False))
    )
    flaw = F.when(F.col("layer_status") != "ok", fv.CONTRAST_METHOD["approx"])
    return page_contrast(pages.withColumn("flaw", flaw), rows)


def contrast_verdict(pages: DataFrame) -> DataFrame:
    """Assessment per page from its summary; keeps the summary columns."""
    n, failing = F.col("n_spans"), F.col("n_failing")
    none = n == 0
    ratio, need = number_text(F.col("worst_ratio")), number_text(F.col("worst_threshold"))
    lowest = F.coalesce(number_text(F.col("min_worst_ratio")), F.lit("n/a"))
    human = none | F.col("approximated") | F.col("any_fail")
    worst = F.when(
        ~none,
        evidence(
            "bbox",
            F.concat(
                F.lit('worst-case span "'), F.col("worst_text"), F.lit('" '), F.col("worst_color"), F.lit(" → "), ratio,
                F.lit(":1 (needs "), need, F.lit(":1"), F.when(F.col("worst_large"), ", large text").otherwise(""), F.lit(")"),
            ),
            "p1-contrast-worst", 1, F.array("worst_x0", "worst_y0", "worst_x1", "worst_y1"),
        ),
    )
    total = evidence(
        "measurement",
        F.concat(n.cast("string"), F.lit(" spans; min worst-case "), lowest, F.lit(":1; method="), F.col("method")),
        "p1-contrast-summary", 1,
    )
    guess = F.when(F.col("any_fail"), "At least one span fails even approximated → likely fail.").otherwise("Approximate pass — needs human confirm.")
    return pages.select(
        "*",
        F.lit("contrast-service").alias("agent"), F.array(F.lit("WCAG 1.4.3")).alias("standard_refs"),
        F.when(human, "input_required").otherwise("completed").alias("state"),
        F.when(none, "not_present").when(F.col("approximated"), "cannot_tell").when(F.col("any_fail"), "failed").otherwise("passed").alias("verdict"),
        F.when(none | F.col("approximated"), 0.4).otherwise(0.9).alias("confidence"),
        human.alias("needs_human"),
        F.filter(F.array(worst, total), lambda e: e.isNotNull()).alias("evidence"),
        F.when(none, F.lit("No text spans recovered from layerize — contrast not measurable; human confirm whether the page has real text."))
        .when(
            F.col("approximated"),
            F.concat(F.lit("Background could not be decoded per-pixel; measured against a representative bg color (approximation). "), guess),
        )
        .when(
            F.col("any_fail"),
            F.concat(
                failing.cast("string"), F.lit("/"), n.cast("string"), F.lit(" text span(s) below the WCAG 1.4.3 minimum; worst "),
                ratio, F.lit(":1 needs "), need, F.lit(":1."),
            ),
        )
        .otherwise(F.concat(F.lit("All "), n.cast("string"), F.lit(" text span(s) meet WCAG 1.4.3; min worst-case "), lowest, F.lit(":1.")))
        .alias("rationale"),
    )


def borderline() -> Column:
    """Whether a person or a model has to look at the page again. A clear fail never is borderline."""
    margin = F.col("worst_ratio") - F.col("worst_threshold")
    return (
        F.when((F.col("n_spans") == 0) | F.col("approximated"), True)
        .when(F.col("any_fail"), False)
        .otherwise(F.coalesce((margin >= 0) & (margin < 0.5), F.lit(True)))
    )
