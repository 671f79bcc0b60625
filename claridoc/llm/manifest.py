"""Merkle manifest of the records of audited documents: one root for a release, a proof for every record.

Leaves are digests of records, in the order of doc_id inside each language. Every ``fanout`` consecutive nodes become one
parent: conditional aggregates spread the children of a parent into ``fanout`` slot columns; the columns side by side
hash to the parent, and the columns without a node's own slot are its siblings. The roots of the languages, in their order,
grow the same way to one root.

Levels are climbed ``TILE_LEVELS`` at a time: a tile of ``fanout ** TILE_LEVELS`` consecutive nodes lies in one partition, so that all
its levels are windows over one exchange, and only the tops of tiles go on. The number of jobs is the logarithm of the
largest language to the tile's width (three for 10 million records). On the way back a tile's rows get the proof of their
tile by one join on the tile, so no key is larger than a tile, however many records a language has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claridoc.llm.tables import numbered
from claridoc.session import written

RECORD_FIELDS = ("doc_id", "gate", "claim_tier", "score", "lang", "title", "pages")
TILE_LEVELS = 8
PROOF = "array<struct<before:string,after:string>>"


def leaf_digest(fields: dict[str, Column] | Sequence[str] = RECORD_FIELDS) -> Column:
    """SHA-256 (lowercase hex) of the fields in order, each ``-`` if null, else the UTF-8 bytes of its text, ``:`` and the text."""
    columns = fields.values() if isinstance(fields, dict) else [F.col(f) for f in fields]
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def sibling_text(proof: str = "proof") -> Column:
    """The siblings of a proof from the leaf's run to the root's, left to right inside a run, side by side."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def folded_root(leaf: str = "leaf", proof: str = "proof") -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, F.col(leaf), lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def _climb(nodes: DataFrame, levels: int, fanout: int, width: int) -> DataFrame:
    """(.., position, n, top) with ``tile``, and ``proof`` from the node to the top of its tile."""
    rows = nodes.withColumn("tile", F.expr(f"position div {width}")).withColumn("proof", F.array().cast(PROOF)).repartition("__group", "tile")

    for level in range(levels):
        slot = F.expr(f"position div {fanout**level} % {fanout}")
        run = Window.partitionBy("__group", "tile", F.expr(f"position div {fanout ** (level + 1)}"))
        slots = [F.col(f"__slot{k}") for k in range(fanout)]
        rows = rows.withColumns({f"__slot{k}": F.max(F.when(slot == k, F.col("top"))).over(run) for k in range(fanout)})
        before = F.concat_ws("", *[F.when(slot > k, slots[k]) for k in range(fanout)])
        after = F.concat_ws("", *[F.when(slot < k, slots[k]) for k in range(fanout)])
        hashed = F.col("n") > fanout**level  # otherwise one node is left, which needs no parent
        rows = rows.withColumns({
            "proof": F.when(hashed, F.array_append("proof", F.struct(before.alias("before"), after.alias("after")))).otherwise(F.col("proof")),
            "top": F.when(hashed, F.sha2(F.concat_ws("", *slots), 256)).otherwise(F.col("top")),
        }).drop(*[f"__slot{k}" for k in range(fanout)])
    return rows


def _tiers(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Tables of climbed nodes: the given ones, the tops of their tiles, and so on until one top a group is left."""
    width = fanout**TILE_LEVELS
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = []
    while True:
        levels = next(k for k in range(TILE_LEVELS + 1) if k == TILE_LEVELS or fanout**k >= most)
        tiers.append(written(_climb(nodes, levels, fanout, width)))
        if most <= width:
            return tiers
        nodes = tiers[-1].where(F.col("position") % width == 0).select("__group", F.col("tile").alias("position"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), "top")
        most = -(-most // width)


def _descend(tiers: list[DataFrame], over: DataFrame, carried: list[str]) -> DataFrame:
    """The lowest tier with whole proofs. ``over``: per group the ``carried`` columns and __rest, the way from its top to the root."""
    above = tiers[-1].join(over, "__group").withColumn("proof", F.concat("proof", "__rest")).drop("__rest", "top")
    for tier in tiers[-2::-1]:
        up = above.select("__group", F.col("position").alias("tile"), F.col("proof").alias("__rest"), *carried)
        above = tier.join(up, ["__group", "tile"]).withColumn("proof", F.concat("proof", "__rest")).drop("__rest", "top")
    return above


def manifest(records: DataFrame, fields: Sequence[str] = RECORD_FIELDS, fanout: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Every record as a leaf of one tree, with the proof that leads from it to the root.

    ``records``: one row per audited document, such as ``probe.record_summary``; ``doc_id``, ``lang`` and the ``fields`` are read, ``keep``
    names columns to hand through, others are ignored. Returns (doc_id, lang, leaf, subroot, root, proof) and ``keep``; ``proof``
    is an array of (before, after), the siblings at each level as hex text, empty where a node stands alone.
    A null field hashes as ``-``; records without ``lang`` form a language of their own, before the others; records without ``doc_id`` come
    first in their language. Records alike in doc_id are ordered by their digest; equal rows are leaves of their own, side by side. An
    empty table has no rows and no root. Columns of other names, whatever they are called, do no harm.
    """
    if fanout < 2:
        raise ValueError("fanout must be two at least")
    kept = [F.col(k).alias(f"__keep_{k}") for k in keep]
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null before every text
    hashed = records.select(lang.alias("__group"), "doc_id", leaf_digest(fields).alias("leaf"), *kept)
    # equal rows may be a third of all: a number without meaning lets the ranges split them
    leaves = written(hashed.withColumn("__spread", F.xxhash64(F.monotonically_increasing_id())))
    nodes = numbered(leaves, "__group", ["doc_id", "leaf", "__spread"]).drop("__spread").withColumn("top", F.col("leaf"))
    tiers = _tiers(nodes, fanout)
    langs = tiers[-1].where("position = 0").select(F.lit(0).alias("__all"), F.col("__group").alias("__lang"), F.col("top").alias("subroot"))
    lang_tiers = _tiers(numbered(langs, "__all", ["__lang"]).withColumn("top", F.col("subroot")).withColumnRenamed("__all", "__group"), fanout)
    root = lang_tiers[-1].where("position = 0").select("__group", F.col("top").alias("root"), F.array().cast(PROOF).alias("__rest"))
    over = _descend(lang_tiers, root, ["root"]).select(F.col("__lang").alias("__group"), "subroot", "root", F.col("proof").alias("__rest"))
    named = F.when(F.col("__group") != "", F.expr("substr(__group, 2)")).alias("lang")
    return _descend(tiers, over, ["subroot", "root"]).select("doc_id", named, "leaf", "subroot", "root", "proof", *[F.col(f"__keep_{k}").alias(k) for k in keep])
