"""The live document: event log, snapshot, delivery, blocks and figures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.functions import blocks as block_scan
from claridoc.functions import fixed_values as fv
from claridoc.functions.text import WS, escape_html, existing_block_id, trimmed, truthy, with_block_id
from claridoc.operators import ordered
from claridoc.operators.splitting import chunk_blocks, extract_blocks  # noqa: F401  blocks of the live document
from claridoc.session import written

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def js_number(c: Column) -> Column:
    """A text as a finite number: blank is 0, hexadecimal is read, anything else and anything infinite is NULL."""
    t = trimmed(c)
    digits = F.split(F.regexp_replace(t, "^0[xX]", ""), "(?<=.)(?=.)")  # summed as doubles: any length, no overflow
    hexadecimal = F.aggregate(digits, F.lit(0.0), lambda n, d: n * 16 + F.conv(d, 16, 10).cast("double"))
    n = F.when(t == "", 0.0).when(t.rlike(_NUMBER), t.try_cast("double")).when(t.rlike(r"^0[xX][0-9a-fA-F]+$"), hexadecimal)
    return F.when(F.abs(n) < F.lit(float("inf")), n)


def number_plain(c: Column) -> Column:
    """A number as text, whole ones without a point."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


# ---------------------------------------------------------------- log


def sequence_events(events: DataFrame) -> DataFrame:
    """Position of each event within its session, by time then id."""
    return ordered.row_number(events, ["session_id"], ["ts", "event_id"], ordered.time_bucket("ts"), "seq")


def addressed(events: DataFrame) -> DataFrame:
    """Events that change the page, with the block they touch and the markup they leave there."""
    fallback = F.concat(F.lit("blk-"), F.col("seq").cast("string"))
    adds, swaps = F.col("type") == "append", F.col("type") == "replace"
    has_html = truthy(F.col("html")).isNotNull()
    return events.filter(has_html & (adds | (swaps & truthy(F.col("target")).isNotNull()))).select(
        "session_id", "seq", "type",
        F.when(adds, F.coalesce(existing_block_id(F.col("html")), fallback)).otherwise(F.regexp_replace("target", "^#", "")).alias("block_id"),
        F.when(adds, with_block_id(F.col("html"), fallback)).otherwise(F.col("html")).alias("html"),
    )


def snapshot(events: DataFrame) -> DataFrame:
    """Blocks on the page after all events: session_id, ord, block_id, html.

    Every append is a block of its own; a replace of an id nobody used before is one too. A block
    shows the last replace of its id that came later, else its own markup. Its place is the number
    of the event it was born with. All of it is aggregation per block id, without ordered windows. The
    addressed events are written once, since four aggregations read them.
    """
    rows = written(addressed(events))
    # an append takes the loading placeholder away: only what came after the last append remains
    last_append = rows.filter(F.col("type") == "append").groupBy("session_id").agg(F.max("seq").alias("last_append"))
    loading = F.col("block_id") == fv.LOADING_BLOCK
    waiting = rows.filter(loading).join(last_append, "session_id", "left").filter(F.col("seq") >= F.coalesce("last_append", F.lit(0))).drop("last_append")
    rows = rows.filter(~loading).unionByName(waiting)
    swap = F.col("type") == "replace"
    per_block = rows.groupBy("session_id", "block_id").agg(
        F.min("seq").alias("first_seq"), F.min_by("type", "seq").alias("first_type"),
        F.max(F.when(swap, F.col("seq"))).alias("swap_seq"),
        F.max_by("html", F.when(swap, F.col("seq"))).alias("swap_html"),
    )
    by_append = rows.filter(~swap).select("session_id", "block_id", F.col("seq").alias("ord"), "html").join(
        per_block.select("session_id", "block_id", "swap_seq", "swap_html"), ["session_id", "block_id"]
    ).select(
        "session_id", "ord", "block_id", F.when(F.col("swap_seq") > F.col("ord"), F.col("swap_html")).otherwise(F.col("html")).alias("html")
    )
    by_replace = per_block.filter(F.col("first_type") == "replace").select(
        "session_id", F.col("first_seq").alias("ord"), "block_id", F.col("swap_html").alias("html")
    )
    return by_append.unionByName(by_replace)


def resume_point(last_event_id: Column, after: Column) -> Column:
    """Where a reader goes on: the header beats the parameter; nonsense and negatives mean the start."""
    n = js_number(F.coalesce(last_event_id, after))
    return F.coalesce(F.when(n >= 0, F.floor(F.least(n, F.lit(9.0e18)))), F.lit(0)).cast("bigint")


def replay_after(events: DataFrame, resume: DataFrame) -> DataFrame:
    """Events strictly after each reader's resume point (session_id, after)."""
    return events.join(resume.select("session_id", "after"), "session_id").filter(F.col("seq") > F.col("after")).drop("after")


def deliver_once(deliveries: DataFrame) -> DataFrame:
    """Each event once per session, however often it was sent."""
    return deliveries.dropDuplicates(["session_id", "seq"])


def sse_frame(seq: Column, type_: Column, **fields: Column) -> Column:
    """Wire text of an event; the number travels as its id, absent fields are left out."""
    payload = F.to_json(F.struct(type_.alias("type"), *[c.alias(n) for n, c in fields.items()]))
    return F.concat(F.lit("id: "), seq.cast("string"), F.lit("\nevent: "), type_, F.lit("\ndata: "), payload, F.lit("\n\n"))


def trim_log(events: DataFrame, limit: int = fv.EVENT_LOG_LIMIT) -> DataFrame:
    """Drop the old end of long logs; one row more than the limit stays."""
    top = events.groupBy("session_id").agg(F.max("seq").alias("__top"))
    return events.join(top, "session_id").filter((F.col("__top") <= limit) | (F.col("seq") >= F.col("__top") - limit)).drop("__top")


def session_status(events: DataFrame) -> DataFrame:
    """Latest phase and state per session; an error outweighs the final ``done``."""
    phase = (F.col("type") == "progress") & truthy(F.col("phase")).isNotNull()
    return events.groupBy("session_id").agg(
        F.max("seq").alias("seq"), F.max_by("phase", F.when(phase, F.col("seq"))).alias("phase"),
        F.when(F.bool_or(F.col("type") == "error"), "error").when(F.bool_or(F.col("type") == "done"), "done").otherwise("running").alias("status"),
    )


def figure_countdown(pending: DataFrame, ready: DataFrame) -> DataFrame:
    """Figures still to come per session; repeats of a figure count once."""
    valid = truthy(F.col("fig_id")).isNotNull() & truthy(F.col("html")).isNotNull()
    arrived = ready.filter(valid).select("session_id", "fig_id").distinct().groupBy("session_id").agg(F.count("*").alias("n_ready"))
    left = F.greatest(F.lit(0), F.coalesce("pending", F.lit(1)) - F.col("n_ready"))
    return arrived.join(pending.select("session_id", "pending"), "session_id", "left").select(
        "session_id", "n_ready", left.alias("remaining"), (left == 0).alias("finished")
    )


# ---------------------------------------------------------------- blocks


def parse_figures(blocks: DataFrame) -> DataFrame:
    """Figure references of blocks: page, four box numbers and a plain caption."""
    attrs = F.regexp_extract("html", r"(?i)^<figure\b([^>]*)>", 1)
    raw = F.regexp_extract("attrs", r"""(?i)data-bbox\s*=\s*["']([^"']+)["']""", 1)
    page = F.regexp_extract("attrs", r"""(?i)data-page\s*=\s*["']?([0-9]+)""", 1)
    caption = F.regexp_extract("html", r"(?is)<figcaption\b[^>]*>(.*?)</figcaption>", 1)
    plain = trimmed(F.regexp_replace(F.regexp_replace(caption, r"<[^>]+>", ""), f"{WS}+", " "))
    numbers = F.filter(F.transform(F.split(raw, f"(,|{WS})+"), js_number), lambda n: n.isNotNull())
    return (
        blocks.filter(F.col("html").rlike(r"(?i)^<figure\b[^>]*>")).withColumn("attrs", attrs)
        .filter(raw != "").withColumn("box", numbers).filter(F.size("box") == 4)
        .withColumn("page", F.when(page == "", 1).otherwise(F.greatest(F.lit(1), page.try_cast("bigint"))).cast("bigint"))
        .withColumn("caption", plain)
        .select(
            *[c for c in blocks.columns if c != "html"], "page",
            *[F.element_at("box", i + 1).alias(n) for i, n in enumerate(("ymin", "xmin", "ymax", "xmax"))], "caption",
        )
    )


def render_figure(fig_id: Column, page: Column, box: list[Column], caption: Column, src: Column) -> Column:
    """Markup of a figure with its cropped image."""
    cap = escape_html(caption)
    numbers = F.concat_ws(",", *[number_plain(b) for b in box])
    return F.concat(
        F.lit('<figure id="'), fig_id, F.lit('" data-page="'), page.cast("string"), F.lit('" data-bbox="'), numbers, F.lit('"><img src="'),
        escape_html(src), F.lit('" alt="'), F.when(cap == "", "Figure").otherwise(cap), F.lit('" loading="lazy">'), _caption(cap), F.lit("</figure>"),
    )


def _caption(cap: Column) -> Column:
    return F.when(cap == "", "").otherwise(F.concat(F.lit("<figcaption>"), cap, F.lit("</figcaption>")))


def caption_only(fig_id: Column, caption: Column) -> Column:
    """Markup of a figure whose image could not be made."""
    return F.concat(F.lit('<figure id="'), fig_id, F.lit('">'), _caption(escape_html(caption)), F.lit("</figure>"))


def figure_lane(figures: DataFrame, crops: DataFrame) -> DataFrame:
    """One result per figure: with its crop (session_id, fig_id, src), or the caption alone."""
    box = [F.col(c) for c in ("ymin", "xmin", "ymax", "xmax")]
    made = render_figure(F.col("fig_id"), F.col("page"), box, F.col("caption"), F.col("src"))
    return figures.join(crops.select("session_id", "fig_id", "src"), ["session_id", "fig_id"], "left").select(
        "session_id", "fig_id", F.col("src").isNotNull().alias("has_image"),
        F.when(F.col("src").isNotNull(), made).otherwise(caption_only(F.col("fig_id"), F.col("caption"))).alias("html"),
    )


def render_body(blocks: DataFrame) -> DataFrame:
    """The page of each session as one text, which is what this result is."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "html")))
    return blocks.groupBy("session_id").agg(F.array_join(F.transform(rows, lambda b: b["html"]), "\n      ").alias("body"))


def inline_budget(figures: DataFrame, budget: int = fv.INLINE_IMAGE_BUDGET) -> DataFrame:
    """Which crops go inline: in order of first appearance, each that still fits the budget.

    Later smaller crops may fit after a larger one did not, so this is no prefix sum but a scan.
    Tasks read their sessions sorted and keep two numbers between Arrow batches, so a session of
    any length needs no more memory than one batch.
    """
    named = ordered.first_per_key(figures.filter(F.col("crop_bytes").isNotNull() & (F.col("crop_bytes") <= budget)), ["session_id", "fig_id"], [F.col("ord")], ["ord", "crop_bytes"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, used = (), 0  # no session yet; NULL is one like any other
        for batch in batches:
            kept = []
            for s, size in zip(batch["session_id"], batch["crop_bytes"]):
                if s != session:
                    session, used = s, 0
                fits = used + size <= budget
                used += size if fits else 0
                kept.append(fits)
            yield batch[["session_id", "fig_id"]][pd.Series(kept, index=batch.index, dtype=bool)]

    key = F.col("session_id").cast("string").alias("session_id")
    sorted_ = named.select(key, "fig_id", "ord", "crop_bytes").repartition("session_id").sortWithinPartitions("session_id", "ord")
    inlined = sorted_.mapInPandas(scan, "session_id string, fig_id string").withColumn("session_id", F.col("session_id").cast(figures.schema["session_id"].dataType))
    same = F.col("f.session_id").eqNullSafe(F.col("i.session_id")) & (F.col("f.fig_id") == F.col("i.fig_id"))
    return figures.alias("f").join(inlined.alias("i"), same, "left").select("f.*", F.col("i.fig_id").isNotNull().alias("inlined"))


def visible_sessions(sessions: DataFrame, seeded: list[str]) -> DataFrame:
    """Who may read a session: everyone, holders of the link, or its creator by token hash.

    ``seeded``: identifiers of sessions that are public whatever they say.

    ``sessions``: session_id, visibility, creator_hash, request_token.
    """
    public = (F.coalesce("visibility", F.lit("")) == "public") | F.col("session_id").cast("string").isin(seeded)
    unlisted = F.coalesce(F.col("visibility") == "unlisted", F.lit(False))
    token = truthy(F.col("request_token"))
    creator = F.coalesce(truthy(F.col("creator_hash")) == F.sha2(token, 256), F.lit(False))
    return sessions.select("session_id", (public | unlisted | creator).alias("allowed"), creator.alias("is_creator"), public.alias("is_public"))


def safe_filename(title: Column, id_: Column) -> Column:
    """Plain file name of a title: letters, digits, dots and dashes, at most 60."""
    plain = trimmed(F.regexp_replace(block_scan.decomposed(F.coalesce(title, F.lit(""))), r"[^A-Za-z0-9 _.-]+", ""))
    dashed = F.regexp_replace(F.regexp_replace(plain, r"\s+", "-"), r"^[-.]+|[-.]+$", "")
    name = truthy(F.substring(dashed, 1, 60))
    return F.concat(F.coalesce(name, F.concat(F.lit("a11y-document-"), F.substring(id_, 1, 8))), F.lit(".html"))
