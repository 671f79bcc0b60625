"""Boxes on pages: parsing, normalising, cropping and text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claridoc.functions.text import let, trimmed
from claridoc.operators import ordered

# Page size when none is given, and the margin added around crops.
DEFAULT_PAGE = (0.0, 0.0, 612.0, 792.0)
CROP_PAD = 0.02
_EDGES = "x0 double, left double, y0 double, top double, x1 double, right double, y1 double, bottom double, x double, y double, w double, width double, h double, height double"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    known = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    return F.when(known, box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)))


def parse_bbox(c: Column) -> Column:
    """STRUCT<x0,y0,x1,y1> from JSON: four corner numbers, named edges, or origin and size."""

    def listed(n: Column) -> Column:
        return F.when(F.size(n) >= 4, _corners(*[F.try_element_at(n, F.lit(i)) for i in (1, 2, 3, 4)]))

    def named(o: Column) -> Column:
        either = lambda a, b: F.coalesce(o[a], o[b])
        edges = _corners(either("x0", "left"), either("y0", "top"), either("x1", "right"), either("y1", "bottom"))
        w, h = either("w", "width"), either("h", "height")
        sized = F.when((w > 0) & (h > 0) & o["x"].isNotNull() & o["y"].isNotNull(), box(o["x"], o["y"], o["x"] + w, o["y"] + h))
        return F.coalesce(edges, sized)

    is_list = F.ltrim(c).startswith("[")
    return F.when(is_list, let(F.from_json(c, "array<double>"), listed)).otherwise(let(F.from_json(c, f"struct<{_EDGES.replace(' double', ':double')}>"), named))


def page_bounds(*candidates: Column) -> Column:
    """The first usable box of several, else letter size."""
    usable = [let(parse_bbox(c), lambda b: F.when((b["x1"] > b["x0"]) & (b["y1"] > b["y0"]), b)) for c in candidates]
    return F.coalesce(*usable, box(*[F.lit(v) for v in DEFAULT_PAGE]))


def normalize_bbox(b: Column, page: Column) -> Column:
    """STRUCT<x,y,w,h> in 0..1 of the page; NULL when nothing of the box lies on it."""

    def placed(p: Column) -> Column:
        width, height = p["page"]["x1"] - p["page"]["x0"], p["page"]["y1"] - p["page"]["y0"]
        clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        x, y = clamp((p["b"]["x0"] - p["page"]["x0"]) / width), clamp((p["b"]["y0"] - p["page"]["y0"]) / height)
        w = F.greatest(F.lit(0.0), F.least(1 - x, (p["b"]["x1"] - p["b"]["x0"]) / width))
        h = F.greatest(F.lit(0.0), F.least(1 - y, (p["b"]["y1"] - p["b"]["y0"]) / height))
        sound = (width > 0) & (height > 0) & (p["b"]["x1"] > p["b"]["x0"]) & (p["b"]["y1"] > p["b"]["y0"])
        return F.when(sound, F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))

    whole = let(F.struct(b.alias("b"), page.alias("page")), placed)
    return let(whole, lambda n: F.when((n["w"] > 0) & (n["h"] > 0), n))


def crop_rect(ymin: Column, xmin: Column, ymax: Column, xmax: Column, width: Column, height: Column) -> Column:
    """STRUCT<x0,y0,x1,y1> in pixels of a padded figure box given in thousandths; NULL when empty."""
    values = [ymin, xmin, ymax, xmax]
    finite = F.lit(True)
    for v in values:
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    low = lambda v, size: F.greatest(F.lit(0.0), (v / 1000.0 - CROP_PAD) * size).cast("bigint")
    high = lambda v, size: F.least(size.cast("double"), (v / 1000.0 + CROP_PAD) * size).cast("bigint")
    rect = box(low(xmin, width), low(ymin, height), high(xmax, width), high(ymax, height))
    return F.when(finite, let(rect, lambda r: F.when((r["x1"] > r["x0"]) & (r["y1"] > r["y0"]), r)))


def search_text(boxes: DataFrame, needle: str, pages: DataFrame | None = None) -> DataFrame:
    """All text boxes that contain a phrase, ranked per page from the smallest; equal places count once.

    ``boxes``: page_id, node, x0, y0, x1, y1, text. Rows are filtered first, and equal places are
    merged by aggregation. A limit is the caller's.
    """
    phrase = needle.strip().lower()
    hits = boxes.filter(F.contains(F.lower("text"), F.lit(phrase)) & F.lit(phrase != ""))
    if pages is not None:
        hits = hits.join(pages.select("page_id", "bounds"), "page_id", "left")
        bounds = F.coalesce("bounds", box(*[F.lit(v) for v in DEFAULT_PAGE]))
    else:
        bounds = box(*[F.lit(v) for v in DEFAULT_PAGE])
    raw = box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    placed = hits.withColumn("n", normalize_bbox(raw, bounds)).filter(F.col("n").isNotNull()).select(
        "page_id", "node", trimmed(F.col("text")).alias("text"), "n.*", (F.col("n.w") * F.col("n.h")).alias("area"),
        F.format_string("%.4f:%.4f:%.4f:%.4f", "n.x", "n.y", "n.w", "n.h").alias("place"),
    )
    order = [F.col("area"), F.col("node")]
    merged = ordered.first_per_key(placed, ["page_id", "place"], order, ["node", "text", "x", "y", "w", "h", "area"])
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(*order)).cast("bigint")
    return merged.withColumn("rank", rank).drop("place")


def render_params(page: Column, dpi: Column, total_pages: Column) -> Column:
    """STRUCT<page, dpi, ok> of a rendering request; unusable numbers fall back to page 1 and 150 dpi."""
    def whole(c: Column) -> Column:
        return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))

    number, dots = whole(page), whole(dpi)
    n = F.when(number > 0, number).otherwise(1)
    d = F.when(dots.between(50, 600), dots).otherwise(150)
    return F.struct(n.cast("bigint").alias("page"), d.cast("bigint").alias("dpi"), (n <= total_pages).alias("ok"))


def json_number(c: Column, field: str) -> Column:
    """A number field of a JSON text; malformed texts give NULL."""
    return F.get_json_object(c, f"$.{field}").try_cast("bigint")
