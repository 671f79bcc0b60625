"""Connected components on tables of links, and positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claridoc.session import written


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable from every id that occurs in ``links`` (a, b).

    Rounds of "hang every neighbour on the least one" (large star, then small star) until nothing changes; a round
    is two shuffles of the links, written once. The number of rounds is logarithmic in the diameter.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = written(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").union(now.select("b", "b").distinct())
        state = tuple(seen)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``position`` (from 0, within the group, in ascending order with null first) and ``n`` (rows of the group).

    No group is one task: rows are dealt by ranges of (group, order), counted inside each range, and every range learns how many
    rows of the group lie before it. What is gathered is one row a (range, group). The dealt table is written once, so that
    both looks see the same ranges. ``order`` should tell rows apart, or rows that it cannot tell apart lie in one range.
    """
    keys = [group, *order]
    row = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__row", F.monotonically_increasing_id()))
    ranged = row.withColumn("__range", F.shiftright("__row", 33)).withColumn("__of", F.struct(group))
    ends = ranged.groupBy("__range", "__of").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("__of").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(
        "__range", "__of", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(Window.partitionBy("__of")).alias("n")
    )
    return ranged.join(offsets, ["__range", "__of"]).withColumn("position", F.col("__row") + F.col("__shift")).drop("__row", "__range", "__of", "__shift")
