"""Mixing document sources to target weights: Sainte-Laguë seats for equal blocks of words, native plans only.

Sources share the words of all documents by weight (``targets``). The mix is counted in blocks of ``block_words`` words:
sources get blocks by highest quotients ``target / (2s + 1)``, then the shards of a source share its blocks in the same way
by their sizes. Inside a shard documents stand in a seeded order; whole rounds of the shard are taken first and the
blocks that remain from the front of that order. Documents move once, without their texts; windows see one shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claridoc.llm.quality_rules import WORD
from claridoc.session import written

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 16
SHARD_WORDS = 2_000_000
SEED = 7


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sainte_lague(parties: DataFrame, house: list[str], weight: str, seats: str, tie: list[str]) -> DataFrame:
    """Adds ``won``: seats by highest quotients ``weight / (2s + 1)``, s = 0, 1, ..., among the rows of one ``house``.

    ``seats`` is the same in all rows of a house; ties go by ``tie``. Seats that any order of quotients must give are
    counted at once (a divisor that cannot hand out too many); only the last few, about one a row, are ranked.
    """
    all_of = W.partitionBy(*house)
    share = parties.withColumns({"_total": F.sum(weight).over(all_of), "_rows": F.count("*").over(all_of)})
    per = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(F.lit(0.0))
    share = share.withColumn("_sure", F.floor(per * F.greatest(F.col(seats) - F.col("_rows") / 2, F.lit(0.0)) + 0.5 - 1e-9).cast("long"))
    share = share.withColumn("_sure", F.greatest("_sure", F.lit(0).cast("long"))).withColumn("_rest", F.col(seats) - F.sum("_sure").over(all_of))
    open_ = share.where("_total > 0 and _rest > 0").select(*house, *tie, weight, "_rest", F.explode(F.sequence("_sure", F.col("_sure") + F.ceil(per * (F.col("_rows") + 1)) + 1)).alias("_seat"))
    won = (
        open_.where(f"{weight} > 0")
        .withColumn("_rank", F.row_number().over(all_of.orderBy(F.desc(F.col(weight) / (2 * F.col("_seat") + 1)), *tie)))
        .where("_rank <= _rest")
        .groupBy(*house, *tie)
        .agg(F.count("*").alias("_won"))
    )
    return share.join(won, [*house, *tie], "left").withColumn("won", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_total", "_rows", "_sure", "_rest", "_won")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_no, source_size, target) of every source in ``sizes`` (source, size).

    Sources by code point, NULL last, take the weights in turn and share all words; a target stops at ``most`` times its
    source, and the excess is shared by weight among the others until none is above. One row a source: a window over all.
    """
    every, by_name = W.partitionBy(), W.orderBy(F.asc_nulls_last("source"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(by_name).cast("long") - 1)
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("_cap", (most * F.col("source_size")).cast("double"))
    before = W.orderBy(F.col("_cap") / F.col("_w"), "source_no").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    s = s.withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    level = F.min_by(F.when(~F.col("_full"), F.col("_level")), F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), F.col("source_no")))).over(every)
    return s.select("source", "source_no", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * level).alias("target"))


def mix_sources(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_TIMES,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    ``documents``: audited documents (doc_id, source, text); other columns are ignored. Returns (doc_id, source, text_hash,
    size, source_size, target, taken), one row per input row; ``text_hash`` is ``xxhash64`` of the text and joins the result
    back to rows. A null or empty text has size 0 and nothing is taken; a null source is a source; documents without an id, and
    rows that share one, are separate documents; an empty table gives an empty result. The taken words of a source are its
    target to within a block, or ``most`` times its words; ``taken`` never exceeds ``most`` times ``size``. Reruns agree.
    """
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = written(documents.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), word_count(F.col("text")).alias("size"), key.alias("key")))
    sources = targets(docs, weights, most).withColumn("blocks", F.round(F.sum("source_size").over(W.partitionBy()) / block_words).cast("long")).withColumn("house", F.lit(1))
    sources = written(sainte_lague(sources, ["house"], "target", "blocks", ["source_no"]).select("source", "source_no", "source_size", "target", F.col("won").alias("source_blocks")))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1).cast("long"))
    placed = (
        docs.alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.*", "source_no", "source_size", "target", "source_blocks", (F.conv(F.substring("key", 1, 15), 16, 10).cast("long") % shards).alias("shard"))
    )
    sizes = placed.groupBy("source_no", "source_blocks", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = sainte_lague(sizes, ["source_no"], "shard_size", "source_blocks", ["shard"]).select("source_no", "shard", "shard_size", (F.col("won") * block_words).alias("quota"))
    order = W.partitionBy("source_no", "shard").orderBy("key", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    rounds = F.when(F.col("shard_size") > 0, F.least(F.lit(most), F.floor(F.col("quota") / F.col("shard_size")))).otherwise(F.lit(0)).cast("long")
    rest = F.when(F.col("rounds") < most, F.col("quota") - F.col("rounds") * F.col("shard_size")).otherwise(F.lit(0))
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    return (
        placed.join(quotas, ["source_no", "shard"])
        .withColumn("rounds", rounds)
        .withColumn("taken", (F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))).cast("long"))
        .select("doc_id", "source", "text_hash", "size", "source_size", "target", "taken")
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: documents as often as they are taken, in their own columns.

    Whole rounds repeat a document as it is; where a shard's last block ends inside a document, one copy has its first words,
    joined by one space. Documents of which nothing is taken go. Options are those of ``mix_sources``.
    """
    key = ["doc_id", "source", "text_hash"]
    nth = lambda order: F.row_number().over(W.partitionBy(*key).orderBy(order))
    mix = mix_sources(documents, **options).select(*key, "size", "taken").withColumn("nth", nth(F.desc("taken")))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).withColumn("nth", nth(F.lit(1)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*key, "nth")]
    taken = rows.alias("r").join(mix.alias("m"), same).where("taken > 0").select("row", "size", "taken", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))).alias("copy"))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), 1, left.cast("int")), " ")
    text = F.when(left >= F.col("size"), F.col("row.text")).otherwise(cut)
    return taken.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])
