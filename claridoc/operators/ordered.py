"""Order-dependent columns that survive hot keys.

A plain window hands every row of one key to one task. These helpers cut each key into buckets
along its own order (an hour, a range of numbers), work inside the buckets, and carry one row per
bucket forward. The result equals the plain window; only the work is split. ``bucket`` must grow
with the order: a later row never falls in an earlier bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# the key as one struct: never NULL itself, so rows with NULL keys stay and form a key of their own
_KEY = "__key"
_BUCKET = "__bucket"
_BOTH = [_KEY, _BUCKET]


def _bucketed(df: DataFrame, keys: list[str], order: list[str], bucket: Column):
    local = Window.partitionBy(*_BOTH).orderBy(*order)
    across = Window.partitionBy(_KEY).orderBy(_BUCKET)
    return df.withColumn(_KEY, F.struct(*keys)).withColumn(_BUCKET, bucket), local, across


def time_bucket(ts: str, seconds: int = 3600) -> Column:
    """Number of the hour (or another span) a time falls in; works for both timestamp types."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def row_number(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str) -> DataFrame:
    """Dense 1-based position of each row within its key."""
    rows, local, across = _bucketed(df, keys, order, bucket)
    sizes = rows.groupBy(*_BOTH).agg(F.count("*").alias("__n"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*_BOTH, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (
        rows.withColumn(out, F.row_number().over(local).cast("bigint"))
        .join(offsets, _BOTH)
        .withColumn(out, F.col(out) + F.col("__before"))
        .drop(*_BOTH, "__before")
    )


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over the rows up to and including the current one."""
    rows, local, across = _bucketed(df.withColumn("__v", value), keys, order, bucket)
    sums = rows.groupBy(*_BOTH).agg(F.sum("__v").alias("__s"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*_BOTH, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn(out, F.sum("__v").over(upto))
        .join(offsets, _BOTH)
        .withColumn(out, F.col(out) + F.col("__before"))
        .drop(*_BOTH, "__before", "__v")
    )


def last_before(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """The latest non-NULL ``value`` among the earlier rows of the key."""
    rows, local, across = _bucketed(df.withColumn("__v", value), keys, order, bucket)
    position = F.struct(*order)
    ends = rows.groupBy(*_BOTH).agg(
        F.max_by(F.when(F.col("__v").isNotNull(), F.col("__v")), F.when(F.col("__v").isNotNull(), position)).alias("__e")
    )
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*_BOTH, F.last("__e", ignorenulls=True).over(before).alias("__carry"))
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn(out, F.last("__v", ignorenulls=True).over(earlier))
        .join(carried, _BOTH)
        .withColumn(out, F.coalesce(F.col(out), F.col("__carry")))
        .drop(*_BOTH, "__carry", "__v")
    )


def next_row(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: list[str], out: str) -> DataFrame:
    """STRUCT of ``values`` of the row that follows within the key, NULL for the last one."""
    rows, local, across = _bucketed(df.withColumn("__v", F.struct(*values)), keys, order, bucket)
    heads = rows.groupBy(*_BOTH).agg(F.min_by("__v", F.struct(*order)).alias("__h"))
    following = heads.select(*_BOTH, F.lead("__h").over(across).alias("__carry"))
    return (
        rows.withColumn(out, F.lead("__v").over(local))
        .join(following, _BOTH)
        .withColumn(out, F.coalesce(F.col(out), F.col("__carry")))
        .drop(*_BOTH, "__carry", "__v")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """One row per key: the ``values`` of the row that sorts first. Partial aggregation, no window."""
    pick = F.min_by(F.struct(*values), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(pick.alias("__p")).select(*keys, *[F.col(f"__p.{v}").alias(v) for v in values])


def last_per_key(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """One row per key: the ``values`` of the row that sorts last."""
    pick = F.max_by(F.struct(*values), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(pick.alias("__p")).select(*keys, *[F.col(f"__p.{v}").alias(v) for v in values])


def smallest_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows per key, ranked from 1.

    Spark limits each group before the shuffle for this filter (WindowGroupLimit), so a hot key
    brings at most ``k`` rows per map task to one reducer.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))
