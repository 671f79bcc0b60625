"""Registry of queries: a Spark plan and, where it can be said in SQL, the checking text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claridoc.plans.check_views import CHECK_VIEWS
from claridoc.sources.fixtures import parts, view, with_views


@dataclass(frozen=True)
class Data:
    """Tables and views of one data folder: ``data("probe_facts")``."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    def parts(self, name: str) -> int:
        """Partitions of a view that lies by its key."""
        return parts(self.spark, self.folder, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Stable output types: 64-bit integers, doubles to six places, arrays of texts joined."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.DecimalType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, " | ")
        out.append(c.alias(field.name))
    return df.select(*out)


@cache
def checks() -> dict[str, str]:
    """Checking SQL of every query that has one, complete with the views it needs."""
    return {name: with_views(text, CHECK_VIEWS) for name, text in CHECKS.items()}


def query(name: str, run: Callable[[Data], DataFrame], check: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, folder: _plain(run(Data(spark, folder)))
    if check is not None:
        CHECKS[name] = check
