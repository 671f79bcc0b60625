"""Prefix trie of chats: which beginnings are shared, by whom, and how many tokens sharing them saves.

A chat is a sequence of turns (role, text). Chats are sorted by the digests of their turns, so the chats that share a beginning
are neighbours. The least of the longest common prefixes (LCP) between two neighbours says how deep a range of chats
agrees; a sparse table gives that least for any range in two reads. Every candidate prefix (a chat and a depth) then
searches its left and its right extent on its own, by halving steps over the table: member intervals without a stack.
All counts of a node are differences of running sums over its interval.

Nothing gathers a whole chat or a whole group. A chat is cut into segments of ``SEGMENT`` turns; a later segment is sorted
among those with the same beginning (a digest of all turns before), and starts with the last turn of the one before, so
that each knows its parent and its children. What later segments add to the subtrees of earlier ones are sums per chat.
Segments are dealt by ranges of the sorted order, a bounded number of turns to a part. A prefix that goes over the edge of a
part gives one partial row a part; these are added up by key. Turns travel as digests, never as text.
"""

from __future__ import annotations

import binascii
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claridoc.llm import words
from claridoc.llm.tables import numbered
from claridoc.session import written

SEGMENT = 128
PART_TURNS = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"
_NO_CHAT = 2**63 - 1
_ORDER = ["s", "g1", "g2", "key", "more", "conv_id"]
_ROW = ["s", "g1", "g2", "key"]
_KEY = ["depth", "k1", "k2"]
_PASSED = pa.schema([(c, pa.int64()) for c in ("conv_id", "s", "saved", "leaves")])
_NODES = pa.schema(
    [("is_end", pa.bool_()), ("owned", pa.bool_()), ("open", pa.bool_()), ("parent_open", pa.bool_())]
    + [(c, pa.int64()) for c in ("depth", "k1", "k2", "part", "at", "local", "parent_at", "parent_local", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'string' if f.type == pa.string() else 'long'}" for f in schema)


def turn_digests(chat_turns: DataFrame) -> DataFrame:
    """Turns as digests: (conv_id, position from 0, n turns of the chat, digest, words).

    ``chat_turns``: (conv_id, turn, role, text); other columns are ignored. Turns go by ``turn``, null first, ties by digest; a null role
    or text is empty; turns without conv_id form one chat; repeated rows are turns of their own. Texts are read once and not moved.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = chat_turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
    )
    return written(numbered(written(turns), "conv_id", ["turn", "digest", "spread"]).select("conv_id", "position", "n", "digest", "words"))


def branched(turns: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Chats that begin as another one: the first ``heads`` turns of chat ``base``, then their own turns after the first ``heads``.

    ``turns``: result of ``turn_digests``; ``base`` and ``heads`` are columns over conv_id, ``most`` the largest number of heads. Where the
    base has fewer turns all are taken, where there is none, none; a null base or number of heads takes nothing away and adds nothing.
    Every chat of ``turns`` also has one row of null position, so that chats left without turns are not lost.
    """
    chats = turns.where("position = 0").select("conv_id", "n", base.cast("long").alias("base"), F.coalesce(F.when(base.isNotNull(), heads), F.lit(0)).cast("long").alias("heads"))
    known = chats.join(chats.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select("conv_id", "base", "heads", F.least("heads", F.coalesce("base_n", F.lit(0))).alias("taken"))
    first = turns.where(F.col("position") < most).select(F.col("conv_id").alias("base"), "position", "digest", "words")
    head = known.where("taken > 0").join(first, "base").where("position < taken").select("conv_id", "position", "digest", "words")
    shift = known.select(F.col("conv_id").alias("chat"), "heads", "taken")
    own = turns.join(shift, F.col("conv_id").eqNullSafe(F.col("chat"))).where("position >= heads").select("conv_id", (F.col("position") - F.col("heads") + F.col("taken")).alias("position"), "digest", "words")
    none = chats.select("conv_id", F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("words"))
    return head.unionByName(own).unionByName(none)


def _segments(turns: DataFrame, size: int) -> DataFrame:
    """(conv_id, s, g1, g2, key, words, more): segment s has turns s*size to (s+1)*size of its chat, s = 0 from the first."""
    e = F.col("position") + 1
    item = lambda s, turn: F.struct(s.cast("long").alias("s"), turn.alias("turn"))
    turn = F.struct(e.alias("e"), "digest", "words")
    nothing = F.lit(None).cast("struct<e:bigint,digest:string,words:bigint>")
    none = F.array().cast("array<struct<s:bigint,turn:struct<e:bigint,digest:string,words:bigint>>>")
    places = F.when(F.col("digest").isNull(), F.array(item(F.lit(0), nothing))).otherwise(
        F.concat(
            F.array(item(F.floor(e / size), turn)),
            F.when(e % size == 0, F.array(item(e / size - 1, turn))).otherwise(none),
            F.when((e + 1) % size == 0, F.array(item((e + 1) / size, nothing))).otherwise(none),
        )
    )
    placed = turns.select("conv_id", F.explode(places).alias("p")).groupBy("conv_id", "p.s").agg(F.sort_array(F.collect_list("p.turn")).alias("turns"))  # size + 1 turns at most
    keyed = placed.select("conv_id", "s", F.array_join("turns.digest", "").alias("key"), F.col("turns.words").alias("words"), F.coalesce(F.array_max("turns.e"), F.lit(0)).alias("last"))
    before_last = F.expr(f"substr(key, 1, 32 * ({size} - if(s = 0, 1, 0)))")  # the last turn comes again in the next segment
    digest = F.md5(F.concat_ws(":", F.col("s").cast("string"), before_last))
    chat = Window.partitionBy("conv_id")
    earlier = chat.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    half = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("long")
    return keyed.withColumns({"x1": half(1), "x2": half(17), "length": F.max("last").over(chat)}).select(
        "conv_id", "s", F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)).alias("g1"), F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0)).alias("g2"),
        "key", "words", (F.col("length") > (F.col("s") + 1) * size).alias("more"),
    )


def _neighbours(rows: DataFrame) -> DataFrame:
    """Per part the last row of the part before and the first row of the part after it, as ``side`` -1 and 1."""
    row = F.struct(*_ROW)
    ends = rows.groupBy("part").agg(F.min_by(row, "row").alias("first"), F.max_by(row, "row").alias("last"))
    number = rows.select("part").distinct().select("part", F.row_number().over(Window.orderBy("part")).alias("no"))  # one integer a part
    known = ends.join(number, "part")
    before = known.select((F.col("no") + 1).alias("no"), F.lit(-1).alias("side"), "last.*")
    after = known.select((F.col("no") - 1).alias("no"), F.lit(1).alias("side"), "first.*")
    return before.unionByName(after).join(number, "no").select("part", "side", *_ROW)


def _least_tables(values: np.ndarray) -> list[np.ndarray]:
    """Table k holds the least of every 2**k consecutive values."""
    tables = [values]
    while 2 ** len(tables) <= len(values):
        half = 2 ** (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    return tables


def _least(tables: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of values[left..right], both ends included."""
    out = np.empty(len(left), tables[0].dtype)
    k = np.frexp(right - left + 1)[1] - 1
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(tables[level][left[at]], tables[level][right[at] - 2**level + 1])
    return out


def _extents(lcp: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the range around ``row`` whose neighbours agree in ``depth`` turns; lcp[i] is between rows i-1 and i."""
    tables = _least_tables(lcp)
    left, right = row.copy(), row.copy()
    for k in range(len(tables) - 1, -1, -1):
        step, least = 2**k, tables[k]
        ok = np.flatnonzero(left >= step)
        left[ok[least[left[ok] - step + 1] >= depth[ok]]] -= step
        ok = np.flatnonzero(right + step < len(lcp))
        right[ok[least[right[ok] + 1] >= depth[ok]]] += step
    return left, right


class _Part:
    """Sorted segments of one part with the rows next to it: turn digests, lengths and LCPs as arrays."""

    def __init__(self, rows: pa.Table, sides: pa.Table):
        rows = rows.sort_by("row")
        side = lambda k: sides.filter(pc.equal(sides.column("side"), k)).select(_ROW)
        before, after = side(-1), side(1)
        whole = pa.concat_tables([before, rows.select(_ROW), after])
        data, limits = words.text_bytes(whole.column("key"))
        turns = np.frombuffer(binascii.unhexlify(data.tobytes()), ">u8").astype(np.uint64).reshape(-1, 2)
        self.one, self.two = words.mix(turns[:, 0]), words.mix(turns[:, 1])
        begin = limits // 32
        self.local = np.arange(len(turns)) - np.repeat(begin[:-1], np.diff(begin))
        group = [np.asarray(whole.column(c)) for c in ("s", "g1", "g2")]
        lcp = np.full(whole.num_rows + 1, -1, np.int64)
        if whole.num_rows > 1:
            lcp[1:-1] = self._common(begin, np.logical_and.reduce([g[1:] == g[:-1] for g in group]))
        skip, n = before.num_rows, rows.num_rows
        self.n, self.lcp = n, lcp[skip : skip + n + 1]
        self.begin, self.length = begin[skip : skip + n], np.diff(begin)[skip : skip + n]
        self.s, self.g1, self.g2 = (g[skip : skip + n] for g in group)
        counts = rows.column("words").combine_chunks().flatten()
        # words of the part's own turns; the neighbours' turns are counted as 0
        own = np.zeros(len(turns) + 1, np.int64)
        own[1 + begin[skip] : 1 + begin[skip + n]] = np.asarray(counts)
        self.words = np.cumsum(own)
        self.rows = rows

    def _common(self, begin: np.ndarray, same: np.ndarray) -> np.ndarray:
        size = np.diff(begin)
        both = np.where(same, np.minimum(size[:-1], size[1:]), 0)
        starts = np.cumsum(both) - both
        at = np.arange(both.sum()) - np.repeat(starts, both)
        a, b = np.repeat(begin[:-2], both) + at, np.repeat(begin[1:-1], both) + at
        differs = np.where((self.one[a] != self.one[b]) | (self.two[a] != self.two[b]), at, np.iinfo(np.int64).max)
        out, some = both.copy(), both > 0
        if some.any():
            out[some] = np.minimum(both[some], np.minimum.reduceat(differs, starts[some]))
        return np.where(same, out, -1)

    def column(self, name: str) -> np.ndarray:
        return np.asarray(self.rows.column(name))

    def words_to(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the first ``depth`` turns of the rows."""
        return self.words[self.begin[row] + depth] - self.words[self.begin[row]]

    @property
    def is_leaf(self) -> np.ndarray:
        """Rows at whose end a path ends: the next row neither repeats nor continues them."""
        return (self.lcp[1:] < self.length) & ~self.column("more")


def _passed_on(rows: pa.Table, sides: pa.Table) -> pa.Table:
    """What later segments of chats add to the subtrees before them: words shared with the row before, and ends of paths."""
    part = _Part(rows, sides)
    row, deep = np.arange(part.n), np.maximum(part.lcp[:-1], 1)
    saved = np.where(part.lcp[:-1] >= 1, part.words_to(row, np.minimum(deep, part.length)) - part.words_to(row, np.minimum(1, part.length)), 0)
    leaves = (part.is_leaf & (part.length >= 2)).astype(np.int64)
    return pa.table([part.rows.column("conv_id"), part.rows.column("s"), pa.array(saved), pa.array(leaves)], schema=_PASSED)


def _nodes(rows: pa.Table, sides: pa.Table, size: int) -> pa.Table:
    """Prefixes of one part with their counts inside the part, and the node at which each chat ends."""
    part = _Part(rows, sides)
    n, lcp, length, s = part.n, part.lcp, part.length, part.s
    low, high = np.where(s == 0, 0, 1), np.where(s == 0, size - 1, size)  # depths of the segment that are its own
    before = np.where(s == 0, 0, s * size - 1)
    chat = np.asarray(part.rows.column("conv_id").fill_null(_NO_CHAT))
    count = np.minimum(length, high) + 1
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(n), count)
    depth = np.arange(len(row)) - first[row]
    left, right = _extents(lcp[:-1], row, depth)
    top = first[left] + depth  # the candidate that stands for the node
    children = np.bincount(top[(length[row] > depth) & (lcp[row] <= depth)], minlength=len(row))
    is_node = left == row
    at, d, r = row[is_node], depth[is_node], right[is_node]
    open_left, open_right = (at == 0) & (lcp[0] >= d), (r == n - 1) & (lcp[n] >= d)
    leaves = np.concatenate([[0], np.cumsum(part.is_leaf + part.column("later_leaves"))])
    again = part.words_to(np.arange(n), np.maximum(lcp[:-1], 0))
    shared = np.concatenate([[0], np.cumsum(again)])
    later = np.concatenate([[0], np.cumsum(part.column("later_saved"))])
    saved = shared[r + 1] - shared[at + 1] + open_left * again[at] - (r - at + open_left) * part.words_to(at, np.maximum(d - 1, 0)) + later[r + 1] - later[at]
    least = np.full(len(row), _NO_CHAT)
    least[is_node] = _least(_least_tables(chat), at, r)
    is_open = np.zeros(len(row), bool)
    is_open[is_node] = open_left | open_right
    above = top[first[at] + np.maximum(d - 1, 0)]
    sums = []
    for values, factor in ((part.one, words.GRAM_BASE), (part.two, words.GRAM_BASE_2)):
        weight = words.powers(factor, size + 3)[part.local + 1]
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * weight)]))

    def key(rows_: np.ndarray, depths: np.ndarray, k: int, group: np.ndarray) -> np.ndarray:
        return words.mix(sums[k][part.begin[rows_] + depths] - sums[k][part.begin[rows_]] + words.mix(group[rows_].astype(np.uint64))).view(np.int64)

    ends = np.flatnonzero(~part.column("more") & (length >= low) & (length <= high))
    number = int(part.rows.column("part")[0].as_py())
    m, e = len(at), len(ends)
    none = np.zeros(e, np.int64)
    ids = lambda v: pa.array(v, mask=v == _NO_CHAT)
    columns = [
        np.repeat([False, True], [m, e]), np.concatenate([d >= low[at], np.ones(e, bool)]), np.concatenate([is_open[is_node], np.zeros(e, bool)]), np.concatenate([is_open[above], np.zeros(e, bool)]),
        np.concatenate([before[at] + d, before[ends] + length[ends]]), np.concatenate([key(at, d, 0, part.g1), key(ends, length[ends], 0, part.g1)]), np.concatenate([key(at, d, 1, part.g2), key(ends, length[ends], 1, part.g2)]),
        np.full(m + e, number), np.concatenate([at, none]), np.concatenate([d, none]), np.concatenate([row[above], none]), np.concatenate([depth[above], none]),
        ids(np.concatenate([least[is_node], chat[ends]])), ids(np.concatenate([np.where(before[at] + d > 0, least[above], _NO_CHAT), none + _NO_CHAT])),
        np.concatenate([r - at + 1, none]), np.concatenate([children[is_node], none]), np.concatenate([leaves[r + 1] - leaves[at], none]), np.concatenate([saved, none]),
    ]
    return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_NODES)


def _end_digests(ends: DataFrame) -> DataFrame:
    """Per node the digest of the chats that end there, in ascending order, streamed: no list is held."""
    schema = pa.schema([(c, pa.int64()) for c in _KEY] + [("ends_sha256", pa.string())])

    def run(batches):
        now, digest, started = None, None, False
        for batch in batches:
            done = []
            for *key, chat in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "conv_id")]):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest, started = key, hashlib.sha256(), False
                if chat is not None:
                    digest.update(b",%d" % chat if started else b"%d" % chat)
                    started = True
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], schema.field(i).type) for i in range(4)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*now, digest.hexdigest()), schema)], schema=schema)

    return ends.select(*_KEY, "conv_id").repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id").mapInArrow(run, _ddl(schema))


def prefix_trie(turns: DataFrame, segment: int = SEGMENT, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per distinct beginning of chats, from the empty one (depth 0) on.

    ``turns``: (conv_id, position from 0 without gaps, digest, words), as ``turn_digests`` and ``branched`` give them; a row of null position
    names a chat that may have no turns. Returns (conv_id, the least member; depth; parent_conv_id, that of the beginning one turn
    shorter, null for the root; n_convs, members; n_children; n_leaves, beginnings in the subtree that nothing continues;
    saved_tokens, over the subtree the words of each last turn times the members that repeat it; ends_sha256, SHA-256 (lowercase hex)
    of the ids of the members that end here, ascending, with commas).
    The chat of turns without conv_id is a member like others, but has no number: it is not the least one unless alone, and is in no list
    of ends. Equal chats are members of the same nodes. An empty table gives no rows. Digests of 128 bits stand for turns.
    """
    if segment < 2:
        raise ValueError("a segment has two turns at least")
    parts = max(1, -(-turns.count() // part_turns))
    placed = written(_segments(turns, segment)).repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    rows = written(placed.withColumns({"part": F.spark_partition_id().cast("long"), "row": F.monotonically_increasing_id()}))
    sides = written(_neighbours(rows))
    by_part = lambda df: df.groupBy("part").cogroup(sides.groupBy("part"))
    passed = by_part(rows.where("s > 0")).applyInArrow(lambda r, n: _passed_on(r, n) if r.num_rows else _PASSED.empty_table(), _ddl(_PASSED))
    # sums over the later segments of a chat, for the one before them and all in between
    later = Window.partitionBy("conv_id").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    added = passed.select("conv_id", (F.col("s") - 1).alias("s"), F.sum("saved").over(later).alias("later_saved"), F.sum("leaves").over(later).alias("later_leaves"))
    whole = rows.join(added.withColumnsRenamed({"conv_id": "chat", "s": "of"}), F.col("conv_id").eqNullSafe(F.col("chat")) & (F.col("s") == F.col("of")), "left").drop("chat", "of")
    whole = whole.fillna(0, ["later_saved", "later_leaves"])
    found = written(by_part(whole).applyInArrow(lambda r, n: _nodes(r, n, segment) if r.num_rows else _NODES.empty_table(), _ddl(_NODES)))
    nodes = found.where("not is_end")
    # a prefix over the edge of a part: its rows are added up, and every part learns the whole one's least member
    edge = nodes.where("open")
    least = edge.groupBy(*_KEY, "owned").agg(F.min("conv_id").alias("whole_id"))
    told = edge.join(least, [*_KEY, "owned"]).select("part", F.col("at").alias("parent_at"), F.col("local").alias("parent_local"), "whole_id", F.lit(True).alias("told"))
    owned = nodes.where("owned").join(told, ["part", "parent_at", "parent_local"], "left")
    is_child = (F.col("depth") > 0) & F.col("parent_open") & F.col("told").isNotNull()
    owned = owned.withColumn("parent_conv_id", F.when(is_child, F.col("whole_id")).otherwise(F.col("parent_conv_id")))
    measures = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    joined = owned.where("open").groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in measures])
    out = [*_KEY, "conv_id", "parent_conv_id", *measures]
    trie = owned.where("not open").select(*out).unionByName(joined.select(*out)).join(_end_digests(found.where("is_end")), _KEY, "left")
    return trie.select("conv_id", "depth", "parent_conv_id", *measures, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
