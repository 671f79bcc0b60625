"""Element trees laid out in reading order: a subtree is a range of its document's sequence.

The Euler tour of a tree enters and leaves every element once. Ranking it as a linked list, by pointer doubling, numbers the
elements in reading order (an element before its children, these by their number) and tells where each subtree ends. From then on
nothing pairs elements with their ancestors: a text stands once in the sequence, the text of a subtree is a range of characters,
and a phrase lies in a subtree if its next occurrence ends before the subtree does. Documents of up to ``SHELF_BYTES`` are dealt to
shelves and ranked on arrays, many at a time, so a row travels once; a larger document is ranked by joins and no step gives it to one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claridoc.functions.text import trimmed
from claridoc.operators import ordered
from claridoc.session import written

SPREAD = 1 << 16  # elements of one parent, or places of one document, that go to one task together
TEXT_BLOCK = 4096  # characters of a document that are cut together
STRETCH = 1 << 16  # characters of a document that are searched together
SHELF_BYTES = 1 << 22  # what the documents of one shelf have together, and the most that a document on a shelf may have
ROW_BYTES = 64  # what an element counts without its text


def _bucket(c: str) -> Column:
    return F.floor(F.col(c) / SPREAD)


def _cut_circles(rows: DataFrame) -> DataFrame:
    """(doc_id, elem, parent) with the parent of each circle's least element set to 0; two doublings, the second only where there are circles."""
    most = rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    away = rows.filter("parent <> 0").select("doc_id", "elem", F.col("parent").alias("up"))
    span = 1
    while span <= most and not away.isEmpty():  # whoever reaches a root has no row any more
        above = away.select("doc_id", F.col("elem").alias("up"), F.col("up").alias("up2"))
        away = written(away.join(above, ["doc_id", "up"]).select("doc_id", "elem", F.col("up2").alias("up")))
        span *= 2
    if away.isEmpty():
        return rows
    on = away.select("doc_id", F.col("up").alias("elem")).distinct()  # after so many steps every chain goes round
    ring = written(on.join(rows, ["doc_id", "elem"]).select("doc_id", "elem", F.col("parent").alias("next"), F.col("elem").alias("low")))
    span = 1
    while span <= most:
        ahead = ring.select("doc_id", F.col("elem").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        ring = written(ring.join(ahead, ["doc_id", "next"]).select("doc_id", "elem", F.col("next2").alias("next"), F.least("low", "low2").alias("low")))
        span *= 2
    cut = ring.filter("low = elem").select("doc_id", "elem", F.lit(True).alias("cut"))
    return rows.join(cut, ["doc_id", "elem"], "left").select("doc_id", "elem", F.when(F.col("cut"), 0).otherwise(F.col("parent")).alias("parent"))


def _parents(up: np.ndarray) -> np.ndarray:
    """``up``, the row of each row's parent (-1 for a root), with the least row of each circle made a root."""
    n = len(up)
    away, span = np.append(np.where(up < 0, n, up), n), 1
    while span <= n and (away < n).any():
        away, span = away[away], span * 2
    on = np.unique(away[away < n])  # after so many steps every chain goes round
    if len(on):
        low, ahead, span = np.arange(n), up.copy(), 1
        while span <= n:  # only rows on a circle are read
            low[on] = np.minimum(low[on], low[ahead[on]])
            ahead[on] = ahead[ahead[on]]
            span *= 2
        up = up.copy()
        up[on[low[on] == on]] = -1
    return up


def _ranked(doc: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and last of each row; rows are sorted by document and element, ``up`` has no circles."""
    n = len(up)
    family = np.where(up < 0, n + doc, up)  # children of one parent, or roots of one document
    kin = np.argsort(family, kind="stable")
    same = family[kin][1:] == family[kin][:-1]
    after, child = np.full(n, -1), np.full(n, -1)
    after[kin[:-1][same]] = kin[1:][same]
    heads = kin[np.append(True, ~same)]
    heads = heads[up[heads] >= 0]
    child[up[heads]] = heads
    # arc 2i enters row i, arc 2i + 1 leaves it, 2n is the end
    ahead = np.full(2 * n + 1, 2 * n)
    rows = np.arange(n)
    ahead[0 : 2 * n : 2] = np.where(child >= 0, 2 * child, 2 * rows + 1)
    ahead[1 : 2 * n : 2] = np.where(after >= 0, 2 * after, np.where(up >= 0, 2 * up + 1, 2 * n))
    left = np.zeros(2 * n + 1, dtype=np.int64)  # rows entered from here to the end, here included
    left[0 : 2 * n : 2] = 1
    while (ahead < 2 * n).any():
        left, ahead = left + left[ahead], ahead[ahead]
    size = np.bincount(doc)[doc]
    return size - left[0 : 2 * n : 2], size - left[1 : 2 * n : 2] - 1


def _shelf(spoken: bool) -> Callable[[pa.Table], pa.Table]:
    """Lays out the documents of one shelf (doc_id, elem, parent, and text and chars if ``spoken``)."""

    def laid(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        codes = pc.dictionary_encode(table.column("doc_id").combine_chunks())
        table = table.append_column("doc", codes.indices.cast(pa.int64()))
        keys = ["doc", "elem", "parent"]
        table = table.take(pc.sort_indices(table, sort_keys=[(k, "ascending") for k in keys]))
        doc, elem, parent = (table.column(k).to_numpy() for k in keys)
        new = np.append(True, (doc[1:] != doc[:-1]) | (elem[1:] != elem[:-1]))
        if spoken and not new.all():  # of an element that is listed several times: its least text, beside its least parent
            text = table.take(pc.sort_indices(table, sort_keys=[("doc", "ascending"), ("elem", "ascending"), ("text", "ascending")])).filter(pa.array(new))
            table = table.filter(pa.array(new)).set_column(table.schema.get_field_index("text"), "text", text.column("text"))
            table = table.set_column(table.schema.get_field_index("chars"), "chars", text.column("chars"))
        elif not new.all():
            table = table.filter(pa.array(new))
        doc, elem, parent = doc[new], elem[new], parent[new]
        names, number = np.unique(elem, return_inverse=True)
        place = doc * len(names) + number
        at = np.minimum(np.searchsorted(names, parent), len(names) - 1)
        above = np.minimum(np.searchsorted(place, doc * len(names) + at), len(place) - 1)
        known = (parent != 0) & (parent != elem) & (names[at] == parent) & (place[above] == doc * len(names) + at)
        entry, last = _ranked(doc, _parents(np.where(known, above, -1)))
        out = {"doc_id": table.column("doc_id"), "elem": table.column("elem"), "entry": entry, "last": last}
        if spoken:
            chars = table.column("chars").to_numpy()
            first = np.searchsorted(doc, doc)  # of the row's document
            read = np.empty(len(doc), dtype=np.int64)  # rows in reading order
            read[first + entry] = chars
            upto = np.append(0, np.cumsum(read))
            out |= {"text": table.column("text"), "start": upto[first + entry] - upto[first], "text_end": upto[first + last + 1] - upto[first]}
        return pa.table(out)

    return laid


def _tour_by_joins(rows: DataFrame) -> DataFrame:
    """``tree_tour`` of (doc_id, elem, parent) of documents of any size. A round joins arcs that are still open and writes only these."""
    once = written(rows.groupBy("doc_id", "elem").agg(F.min("parent").alias("parent")))
    there = once.select("doc_id", F.col("elem").alias("parent"), F.lit(True).alias("there"))
    known = once.join(there, ["doc_id", "parent"], "left").select("doc_id", "elem", F.when(F.col("there") & (F.col("parent") != F.col("elem")), F.col("parent")).otherwise(0).alias("parent"))
    rows = _cut_circles(written(known))
    first = rows.filter("parent <> 0").groupBy("doc_id", F.col("parent").alias("elem")).agg(F.min("elem").alias("child"))
    kin = written(ordered.next_row(rows, ["doc_id", "parent"], ["elem"], _bucket("elem"), ["elem"], "after").join(first, ["doc_id", "elem"], "left"))
    enter, leave = F.col("elem") * 2, F.col("elem") * 2 + 1
    arcs = kin.select("doc_id", enter.alias("arc"), F.coalesce(F.col("child") * 2, leave).alias("next"), F.lit(1).cast("bigint").alias("n")).unionByName(
        kin.select("doc_id", leave.alias("arc"), F.coalesce(F.col("after.elem") * 2, F.when(F.col("parent") != 0, F.col("parent") * 2 + 1)).alias("next"), F.lit(0).cast("bigint").alias("n"))
    )
    open_ = written(arcs)
    done = [open_.filter("next is null")]
    while not (open_ := open_.filter("next is not null")).isEmpty():
        ahead = reduce(DataFrame.unionByName, [*done, open_]).select("doc_id", F.col("arc").alias("next"), F.col("next").alias("next2"), F.col("n").alias("n2"))
        open_ = written(open_.join(ahead, ["doc_id", "next"]).select("doc_id", "arc", F.col("next2").alias("next"), (F.col("n") + F.col("n2")).alias("n")))
        done.append(open_.filter("next is null"))
    # n counts the elements that are entered from here to the end, here included
    ranked = reduce(DataFrame.unionByName, done).groupBy("doc_id", F.shiftright("arc", 1).alias("elem")).agg(F.max("n").alias("n_in"), F.min("n").alias("n_out"))
    sizes = ranked.groupBy("doc_id").agg(F.max("n_in").alias("size"))
    return ranked.join(sizes, "doc_id").select("doc_id", "elem", (F.col("size") - F.col("n_in")).alias("entry"), (F.col("size") - F.col("n_out") - 1).alias("last"))


def _summed_by_joins(rows: DataFrame) -> DataFrame:
    """``text_sequence`` of (doc_id, elem, parent, text) of documents of any size."""
    spoken = rows.filter("text is not null").groupBy("doc_id", "elem").agg(F.min("text").alias("text"))
    laid = _tour_by_joins(rows).join(spoken, ["doc_id", "elem"], "left").withColumn("chars", F.coalesce(F.char_length("text").cast("bigint") + 1, F.lit(0)))
    summed = written(ordered.running_sum(laid, ["doc_id"], ["entry"], _bucket("entry"), F.col("chars"), "upto"))
    ends = summed.select("doc_id", F.col("entry").alias("last"), F.col("upto").alias("text_end"))
    return summed.join(ends, ["doc_id", "last"]).select("doc_id", "elem", "entry", "last", "text", (F.col("upto") - F.col("chars")).alias("start"), "text_end")


def _laid_out(elements: DataFrame, spoken: bool) -> DataFrame:
    """Documents on shelves by arrays, those too large for one by joins."""
    columns = ["doc_id", F.col("elem").cast("bigint").alias("elem"), F.coalesce("parent_elem", F.lit(0)).cast("bigint").alias("parent")]
    text = F.when(trimmed(F.col("text")) != "", F.col("text")).alias("text")
    rows = written(elements.filter("doc_id is not null and elem is not null").select(*columns, *[text] * spoken))
    weight = ROW_BYTES + F.coalesce(F.octet_length("text"), F.lit(0)) if spoken else F.lit(ROW_BYTES)
    total = rows.agg(F.sum(weight.cast("bigint"))).first()[0] or 0
    large = written(rows.groupBy("doc_id").agg(F.sum(weight.cast("bigint")).alias("w")).filter(F.col("w") > SHELF_BYTES).select("doc_id"))
    some = not large.isEmpty()
    small = rows.join(large, "doc_id", "left_anti") if some else rows
    shelf = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-total // SHELF_BYTES)))).alias("shelf")
    numbers = [F.coalesce(F.char_length("text").cast("bigint") + 1, F.lit(0).cast("bigint")).alias("chars")] * spoken
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = small.select("*", *numbers, shelf).groupBy("shelf")
    laid = dealt.applyInArrow(_shelf(spoken), f"doc_id {kind}, elem bigint, entry bigint, last bigint" + ", text string, start bigint, text_end bigint" * spoken)
    if not some:
        return laid
    rest = rows.join(large, "doc_id", "left_semi")
    return laid.unionByName(_summed_by_joins(rest) if spoken else _tour_by_joins(rest))


def tree_tour(elements: DataFrame) -> DataFrame:
    """(doc_id, elem, entry, last): number of each element in reading order, from 0, and number of the last one below it.

    ``elements``: doc_id, elem, parent_elem (0 or NULL for a root). An element with an unknown parent is a root; the least element of a
    circle is one too, its own parent is ignored. Roots come by their number, as children of one parent do. An element that is listed
    several times counts once, below its least parent; rows without doc_id or elem have no place in a tree. Rounds are
    logarithmic in the largest document; they are rounds over arrays where it fits a shelf.
    """
    return _laid_out(elements, False)


def text_sequence(nodes: DataFrame) -> DataFrame:
    """Every element in reading order with its own text and the range of characters of its subtree's text; written once.

    ``nodes``: doc_id, elem, parent_elem, text. Returns doc_id, elem, entry, last, text (NULL when blank), start, and text_end: the texts
    of a document stand one after another with a blank after each; the subtree's text is [start, text_end), its last blank included.
    """
    return written(_laid_out(nodes, True))


def subtree_text(sequence: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, elem, text): texts below and at each element in reading order, joined by blanks; of the elements in ``only`` (doc_id, elem) if given.

    ``sequence``: result of ``text_sequence``. A document's text is kept in blocks of ``TEXT_BLOCK`` characters (more where one text
    is longer); an element cuts its range out of the blocks it touches, so rows are as many as the result has blocks. Elements without any text have no row.
    """
    place = F.floor(F.col("start") / TEXT_BLOCK)
    gathered = sequence.filter("text is not null").groupBy("doc_id", place.alias("block")).agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"))
    blocks = gathered.select("doc_id", "block", F.concat(F.array_join("p.text", " "), F.lit(" ")).alias("whole"), F.get("p.start", F.lit(0)).alias("from"))
    wanted = sequence.select("doc_id", "elem", "start", "text_end")
    if only is not None:  # both ways below read them
        wanted = written(wanted.join(only.select("doc_id", "elem"), ["doc_id", "elem"], "left_semi"))
    spans = wanted.filter("text_end > start").select("doc_id", "elem", "start", F.col("text_end").alias("end"), place.alias("a"), F.floor((F.col("text_end") - 1) / TEXT_BLOCK).alias("b"))

    def cut(touched: DataFrame) -> DataFrame:
        begin = F.greatest(F.col("start"), F.col("from"))
        size = F.greatest(F.col("end") - begin, F.lit(0))
        return touched.join(blocks, ["doc_id", "block"]).withColumn("text", F.substring(F.col("whole"), (begin - F.col("from") + 1).cast("int"), size.cast("int")))

    one = cut(spans.filter("a = b").withColumn("block", F.col("a"))).select("doc_id", "elem", "text")
    many = cut(spans.filter("a < b").withColumn("block", F.explode_outer(F.sequence("a", "b"))))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])  # one element's own text
    joined = many.groupBy("doc_id", "elem").agg(F.array_join(parts, "").alias("text"))
    return one.unionByName(joined).withColumn("text", F.expr("left(text, char_length(text) - 1)"))


def phrase_places(sequence: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, entry, upto): where a phrase begins in the sequence of texts, by element, and the element it ends in; the first place in each element.

    A phrase may go over several texts. A text is searched in the stretch of characters in which it ends, so that the texts after it begin there;
    a window reads as many of them ahead as the phrase can touch, and those that begin a stretch are also at the end of the one before.
    """
    size, ahead = len(phrase), len(phrase) // 2 + 1
    stretch = max(STRETCH, size)
    after = F.col("start") + F.char_length("text") + 1
    first, home = F.floor(F.col("start") / stretch), F.floor(after / stretch)
    also = F.when((F.col("start") % stretch < size) & (first > 0), F.array(first - 1, first)).otherwise(F.array(first))
    spoken = sequence.filter("text is not null").select("doc_id", "entry", "start", F.lower("text").alias("text"), home.alias("home"), F.explode(F.array_union(F.array(home), also)).alias("stretch"))
    dealt = spoken.withColumn("text", F.when(F.col("stretch") == F.col("home"), F.col("text")).otherwise(F.left("text", F.lit(size))))
    following = Window.partitionBy("doc_id", "stretch").orderBy("entry").rowsBetween(1, ahead)
    read = dealt.withColumn("next", F.collect_list(F.struct("entry", "start", F.left("text", F.lit(size)).alias("text"))).over(following)).filter(F.col("stretch") == F.col("home"))
    # a text that is cut for reading ahead is longer than the phrase, so nothing after it matters
    at = F.instr(F.concat_ws(" ", "text", F.array_join("next.text", " ")), phrase)
    end = F.col("start") + F.col("at") + size - 2
    upto = F.array_max(F.transform(F.filter("next", lambda n: n["start"] <= end), lambda n: n["entry"]))
    return read.withColumn("at", at).filter((F.col("at") > 0) & (F.col("at") <= F.char_length("text"))).select("doc_id", "entry", F.coalesce(upto, F.col("entry")).alias("upto"))


def search_subtrees(sequence: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, elem) of the elements whose subtree's text has the phrase, in any case; blanks around the phrase do not count.

    The places of a phrase end in the order in which they begin, so an element has one exactly if the next place at or after its
    entry ends inside it: one carried value per element instead of its ancestors. An empty phrase is nowhere.
    """
    needle = phrase.strip().lower()
    elements = sequence.select("doc_id", "elem", "entry", "last", F.lit(None).cast("bigint").alias("upto"))
    if not needle:
        return elements.filter(F.lit(False)).select("doc_id", "elem")
    places = written(phrase_places(sequence, needle)).select("doc_id", F.lit(None).cast("bigint").alias("elem"), "entry", F.lit(None).cast("bigint").alias("last"), "upto")
    backwards = elements.unionByName(places).withColumns({"back": -F.col("entry"), "of_element": F.col("elem").isNotNull()})
    carried = ordered.last_before(backwards, ["doc_id"], ["back", "of_element"], _bucket("back"), F.col("upto"), "found")
    return carried.filter("of_element and found <= last").select("doc_id", "elem")
