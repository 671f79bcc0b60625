"""Streamed markup split into its top-level blocks by prefix sums, whatever the cut into chunks.

A tag never reaches beyond the next ``>``, so a document is a row of fragments, each up to and with one ``>``, and a fragment has one
tag at most. An opening tag counts 1, a closing one -1, a void one 0. A block ends where opened and closed tags balance,
that is, at every tag where the running sum over the whole document is 0. So nothing has to be read in order: fragments over the edge of
a chunk are put together first, each unit of fragments sums up its tags, running sums over the units tell depth and
number of blocks before each of them, and only the pieces of blocks that cross units are gathered. A document of any length
runs in as many tasks as it has units. That takes several shuffles of the text, so it is for documents of more than ``WHOLE_BYTES``;
smaller ones are dealt to shelves, put together there and read in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.functions.blocks import whole_blocks
from claridoc.functions.text import WS, let, strip_fence, trimmed
from claridoc.operators import ordered
from claridoc.session import written

UNIT = 64  # fragments that are looked at together
WHOLE_BYTES = 1 << 20  # the most that a document which is read in one pass may have
CHUNK_BYTES = 64  # what a chunk counts without its text
SHELF_BYTES = 1 << 22  # what the documents of one shelf have together
# the end of a name, counting ASCII letters only
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_NAME = r"([a-zA-Z][a-zA-Z0-9-]*)" + _EDGE
TAG = rf"</?{_NAME}[^>]*>"
_LAST = 1 << 40  # part number of what follows the last fragment


def _running(units: DataFrame, bucket: Column, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier units of the document."""
    summed = ordered.running_sum(units, ["doc"], ["chunk_no", "part"], bucket, value, out)
    return summed.withColumn(out, F.col(out) - value)


def _joined(rows: Column) -> Column:
    """Texts of (order.., text) structs in their order, as one."""
    return F.array_join(F.transform(F.sort_array(rows), lambda r: r["text"]), "")


def _units(chunks: DataFrame, bucket: Column) -> DataFrame:
    """(doc, chunk_no, part, frags): the fragments of each document in order, at most ``UNIT`` a row; the rest after the last one as a part of its own."""
    pieces = chunks.withColumn("pieces", F.split("text", "(?<=>)", -1)).withColumn("n", (F.size("pieces") - 1).cast("bigint"))
    counted = ordered.running_sum(pieces.select("doc", "chunk_no", F.lit(0).alias("part"), "n"), ["doc"], ["chunk_no"], bucket, F.col("n"), "upto")
    cut = pieces.join(counted.select("doc", "chunk_no", (F.col("upto") - F.col("n")).alias("before")), ["doc", "chunk_no"])
    at_edge = lambda no, text: F.struct(no.alias("frag"), text.alias("text"))
    whole = F.array(at_edge(F.col("before"), F.col("text")))
    ends = F.array(at_edge(F.col("before"), F.get("pieces", F.lit(0))), at_edge(F.col("before") + F.col("n"), F.element_at("pieces", -1)))
    edges = cut.select("doc", "chunk_no", F.explode(F.when(F.col("n") == 0, whole).otherwise(ends)).alias("e"))
    # one text between two tags, over as many chunks as it has
    stitched = edges.groupBy("doc", "e.frag").agg(_joined(F.collect_list(F.struct("chunk_no", "e.text"))).alias("first"), F.max("chunk_no").alias("upto_no"))
    homes = cut.filter("n > 0").select("doc", F.col("before").alias("frag"), "chunk_no", "n", "pieces")
    placed = stitched.join(homes, ["doc", "frag"], "left")
    frags = F.when(F.col("n").isNull(), F.array("first")).otherwise(F.concat(F.array("first"), F.slice("pieces", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0)).cast("int"))))
    rows = placed.select("doc", F.coalesce("chunk_no", "upto_no").alias("chunk_no"), F.col("n").isNull().alias("tail"), frags.alias("frags"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("frags") - 1) / UNIT).cast("int")), lambda i: F.struct(i.cast("bigint").alias("part"), F.slice("frags", i * UNIT + 1, F.lit(UNIT)).alias("frags")))
    dealt = rows.select("doc", "chunk_no", "tail", F.explode(parts).alias("p"))
    return dealt.select("doc", "chunk_no", F.when(F.col("tail"), _LAST).otherwise(F.col("p.part")).alias("part"), "p.frags")


def _depths(frags: Column) -> Column:
    """STRUCT<d, at>: net sum of the tags, and for each fragment the sum up to its tag, NULL where it has none."""
    tags = F.transform(frags, lambda f: F.regexp_extract(f, TAG, 0))
    void = lambda t: F.endswith(t, F.lit("/>")) | F.lower(F.regexp_extract(t, "^<" + _NAME, 1)).isin(fv.VOID_TAGS)
    steps = F.transform(tags, lambda t: F.when(t == "", F.lit(None)).when(F.startswith(t, F.lit("</")), -1).when(void(t), 0).otherwise(1))
    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<int>").alias("at"))

    def add(acc: Column, step: Column) -> Column:
        d = acc["d"] + F.coalesce(step, F.lit(0))
        return F.struct(d.alias("d"), F.array_append(acc["at"], F.when(step.isNotNull(), d)).alias("at"))

    return F.aggregate(steps, start, add)


def _cut_at_ends(frags: Column, at: Column, before: Column) -> Column:
    """STRUCT<done, open>: texts up to each end of a block in this unit, and what follows the last one."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, f: Column) -> Column:
        text = F.concat(acc["open"], f["frag"])
        ends = F.coalesce(f["at"] + before == 0, F.lit(False))
        return F.when(ends, F.struct(F.array_append(acc["done"], text).alias("done"), F.lit("").alias("open"))).otherwise(F.struct(acc["done"].alias("done"), text.alias("open")))

    return F.aggregate(F.zip_with(frags, at, lambda f, a: F.struct(f.alias("frag"), a.alias("at"))), start, add)


def _blocks_of(text: Column, ended: Column) -> Column:
    """Array of the blocks in one stretch: stray text before the first tag as a paragraph, then the block; a stretch without end is a block too when something is left."""
    fence_off = lambda c: trimmed(strip_fence(c))

    def found(s: Column) -> Column:
        at = F.when(s["at"] > 0, s["at"] - 1).otherwise(F.char_length(s["text"]))
        gap = F.regexp_replace(F.left(s["text"], at), f"^{WS}+", "")
        rest = F.substr(s["text"], at + 1)

        def lead(g: Column) -> Column:
            mark = F.instr(g["gap"], "<")
            no_tag = (s["at"] == 0) & (mark == 0)  # words that nothing follows are left as they are
            stray = trimmed(F.when(no_tag, "").when(mark > 0, F.left(g["gap"], mark - 1)).otherwise(g["gap"]))
            bare = F.when(no_tag, g["gap"]).when(mark > 0, F.substr(g["gap"], mark)).otherwise("")
            body = F.concat(bare, g["rest"])
            block = F.when(ended, trimmed(body)).otherwise(fence_off(body))
            return F.array(F.when(stray != "", F.concat(F.lit("<p>"), stray, F.lit("</p>"))), F.nullif(block, F.lit("")))

        return let(F.struct(gap.alias("gap"), rest.alias("rest")), lead)

    return F.array_compact(let(F.struct(text.alias("text"), F.regexp_instr(text, F.lit(TAG)).alias("at")), found))


def split_blocks(chunks: DataFrame, bucket: Column) -> DataFrame:
    """(doc, block_no, html) of chunks (doc, chunk_no, text).

    ``doc`` is never NULL and (doc, chunk_no) is unique; ``bucket`` cuts a document along (chunk_no, part) and grows with it.
    A code fence around a document is taken off.
    """
    units = _units(chunks, bucket).withColumn("sum", _depths(F.col("frags")))
    units = written(units.select("doc", "chunk_no", "part", "frags", F.col("sum.d").cast("bigint").alias("net"), "sum.at"))
    thin = _running(units.select("doc", "chunk_no", "part", "net", "at"), bucket, F.col("net"), "before")
    ends = F.size(F.filter("at", lambda a: a + F.col("before") == 0)).cast("bigint")
    known = _running(thin.withColumn("ends", ends), bucket, F.col("ends"), "group").select("doc", "chunk_no", "part", "before", "group")
    cut = units.join(known, ["doc", "chunk_no", "part"]).withColumn("cut", _cut_at_ends(F.col("frags"), F.col("at"), F.col("before")))
    n_done = F.size("cut.done")
    texts = cut.select("doc", "chunk_no", "part", "group", n_done.alias("n_done"), F.posexplode(F.array_append("cut.done", F.col("cut.open"))).alias("i", "text"))
    texts = texts.select("doc", "chunk_no", "part", (F.col("group") + F.col("i")).alias("group"), "text", (F.col("i") < F.col("n_done")).alias("ended"), ((F.col("i") > 0) & (F.col("i") < F.col("n_done"))).alias("inner"))
    inner = texts.filter("inner").select("doc", "group", "text", "ended")
    crossing = texts.filter("not inner and (ended or text <> '')").groupBy("doc", "group").agg(_joined(F.collect_list(F.struct("chunk_no", "part", "text"))).alias("text"), F.bool_or("ended").alias("ended"))
    opened = F.when(F.col("group") == 0, F.regexp_replace("text", rf"(?i)^{WS}*```(?:html)?{WS}*", "")).otherwise(F.col("text"))
    stretches = written(inner.unionByName(crossing).select("doc", "group", _blocks_of(opened, F.col("ended")).alias("blocks")))
    numbers = ordered.running_sum(stretches.select("doc", "group", F.size("blocks").cast("bigint").alias("n")), ["doc"], ["group"], F.floor(F.col("group") / 65536), F.col("n"), "upto")
    numbered = stretches.join(numbers.select("doc", "group", (F.col("upto") - F.col("n")).alias("before")), ["doc", "group"])
    return numbered.select("doc", "before", F.posexplode("blocks").alias("i", "html")).select("doc", (F.col("before") + F.col("i") + 1).alias("block_no"), "html")


def _shelf(table: pa.Table) -> pa.Table:
    """Blocks of the documents of one shelf; rows (doc_id, doc, chunk_no, text) in any order, a NULL doc is a document too."""
    table = table.combine_chunks()
    table = table.append_column("code", pc.dictionary_encode(table.column("doc").combine_chunks(), null_encoding="encode").indices)
    table = table.take(pc.sort_indices(table, sort_keys=[(k, "ascending") for k in ("code", "chunk_no", "text")]))
    code, texts = table.column("code").to_numpy(), table.column("text").to_pylist()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    found = [whole_blocks("".join(texts[a:b])) for a, b in zip(first, [*first[1:], len(texts)])]
    of = np.repeat(first, [len(b) for b in found])
    return pa.table({"doc_id": table.column("doc_id").take(pa.array(of)), "block_no": pa.array([n for b in found for n in range(1, len(b) + 1)], pa.int64()), "html": pa.array([x for b in found for x in b], pa.string())})


def _read_whole(rows: DataFrame, weight: Column) -> DataFrame:
    """(doc_id, block_no, html) of written rows (doc_id, doc, chunk_no, text) whose documents have a bounded length."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    shelf = F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-total // SHELF_BYTES)))).alias("shelf")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "doc", "chunk_no", "text", shelf).groupBy("shelf").applyInArrow(_shelf, f"doc_id {kind}, block_no bigint, html string")


def chunk_blocks(chunks: DataFrame) -> DataFrame:
    """Streamed chunks (doc_id, chunk_no, chunk) to blocks: doc_id, block_no, html.

    Chunks of one number are read in the order of their text; a NULL chunk is empty, a NULL number comes first, and chunks without a
    doc_id are one document.
    """
    of = chunks.select(F.struct("doc_id").alias("doc"), F.coalesce(F.col("chunk_no").cast("bigint"), F.lit(-_LAST)).alias("chunk_no"), F.coalesce("chunk", F.lit("")).alias("text"))
    rows = written(of)
    weight = (CHUNK_BYTES + F.octet_length("text")).cast("bigint")
    large = written(rows.groupBy("doc").agg(F.sum(weight).alias("w")).filter(F.col("w") > WHOLE_BYTES).select("doc"))
    some = not large.isEmpty()
    small = rows.join(large, "doc", "left_anti") if some else rows
    blocks = _read_whole(small.select("doc.doc_id", F.col("doc.doc_id").alias("doc"), "chunk_no", "text"), weight)
    if not some:
        return blocks
    once = rows.join(large, "doc", "left_semi").groupBy("doc", "chunk_no").agg(F.array_join(F.sort_array(F.collect_list("text")), "").alias("text"))
    return blocks.unionByName(split_blocks(written(once), F.floor(F.col("chunk_no") / 256)).select("doc.doc_id", "block_no", "html"))


def extract_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of finished documents (doc_id, html): doc_id, block_no, html. Every row is a document of its own, repeated ones too."""
    rows = written(docs.select("doc_id", F.coalesce("html", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")))
    size = F.octet_length("text").cast("bigint")
    blocks = _read_whole(rows.filter(size <= WHOLE_BYTES).select("doc_id", F.col("row").alias("doc"), F.lit(0).alias("chunk_no"), "text"), CHUNK_BYTES + size)
    large = rows.filter(size > WHOLE_BYTES)
    if large.isEmpty():
        return blocks
    whole = large.select(F.struct("row", "doc_id").alias("doc"), F.lit(0).cast("bigint").alias("chunk_no"), "text")
    return blocks.unionByName(split_blocks(whole, F.floor(F.col("part") / 1024)).select("doc.doc_id", "block_no", "html"))
