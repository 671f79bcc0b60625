"""Repeated runs of lines across text layers, by hashed windows with a fingerprint filter; native plans only.

No positions are selected and no match is extended, as winnowing would: every window is compared, and the fingerprint only
leaves out windows before that. The fingerprint of ``run_lines`` consecutive lines is the least of their hashes (the last one on a tie). A run of that length or
more always contains a fingerprint, the same one wherever it occurs. Fingerprints that occur once are dropped by a
partial aggregation; positions of the others are joined with the windows around them, to the left and to the right. A
window that also stands earlier is a repeat; neighbouring repeats are one longer match. Later repeats are deleted, the
earliest occurrence stays, so every deleted line is still somewhere.

A line in a third of all documents is one row a task after the partial aggregation; its windows are compared by the hashes
of all their lines and meet only the earliest occurrence, never each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claridoc.llm.quality_rules import WORD, let
from claridoc.session import written

RUN_LINES = 3
LONG_WORDS = 20  # words that make a run of fewer lines worth deleting, in the query and the pipeline


def windows(lines: Column, run_lines: int, long_words: int | None = None) -> Column:
    """(pos, finger, one, two, at) of every window of lines with a word: window number, fingerprint, 128-bit hash, line numbers."""
    filled = F.filter(F.transform(lines, lambda l, i: F.struct(F.xxhash64(l).alias("h"), i.alias("i"), l.rlike(WORD).alias("w"), *([F.size(F.regexp_extract_all(l, F.lit(f"({WORD})+"), F.lit(0))).alias("n")] if long_words else []))), lambda x: x["w"])

    def of(x: Column) -> Column:
        def window(i: Column, many: int = run_lines) -> Column:
            part = F.slice(x, i + 1, many)
            hashes = F.transform(part, lambda p: p["h"])
            return F.struct(
                i.alias("pos"), F.array_min(hashes).alias("finger"), F.xxhash64(hashes).alias("one"), F.xxhash64(F.lit("run"), F.reverse(hashes)).alias("two"), F.transform(part, lambda p: p["i"]).alias("at")
            )

        def of_size(many: int) -> Column:
            at = F.sequence(F.lit(0), F.size(x) - many)
            if many < run_lines:
                at = F.filter(at, lambda i: F.aggregate(F.slice(x, i + 1, many), F.lit(0), lambda n, p: n + p["n"]) >= long_words)
            return F.when(F.size(x) >= many, F.transform(at, lambda i: window(i, many))).otherwise(F.array())

        if not long_words:
            return of_size(run_lines)
        return F.concat(*[of_size(n) for n in range(1, run_lines + 1)])

    return let(filled, of)


def remove_repeated_lines(text_layers: DataFrame, run_lines: int = RUN_LINES, long_words: int | None = None) -> DataFrame:
    """Text layers without the runs of ``run_lines`` or more lines that already stand earlier; with ``long_words``
    also without shorter runs of that many words or more in all.

    ``text_layers``: (doc_id, text); other columns stay as they are, but n_lines and n_deleted, which are replaced. Earlier means a smaller doc_id (null first), then an
    earlier line of the same text. Lines are compared as they are; lines without a word neither count nor go. Returns the
    input columns with the new ``text``, and n_lines and n_deleted (lines with a word). A null text stays null, an empty
    one empty, shorter texts than a run as they are. Rows alike in doc_id and text are one document and get the same
    result; rows that only share a doc_id are ordered by a hash of their texts. An empty table gives an empty result.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    passing = [c for c in text_layers.columns if c not in ("n_lines", "n_deleted")]
    keyed = text_layers.select(F.struct(*[F.col(f"`{c}`") for c in passing]).alias("row"), F.col("doc_id").alias("d"), F.col("text"), F.xxhash64("text").alias("h"))
    spots = written(keyed.select("d", "h", F.explode(windows(lines, run_lines, long_words)).alias("s")).select("d", "h", "s.*").distinct())
    fingers = spots.groupBy("finger").agg(F.count("*").alias("n")).where("n > 1").select("finger")
    shared = written(spots.join(fingers, "finger", "left_semi"))
    first = shared.groupBy("one", "two").agg(F.min(F.struct("d", "h", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = shared.join(first, ["one", "two"]).where(~F.struct("d", "h", "pos").eqNullSafe(F.col("first")))
    gone = later.select(F.col("d").alias("gd"), F.col("h").alias("gh"), F.explode("at").alias("i")).groupBy("gd", "gh").agg(F.collect_set("i").alias("gone"))
    joined = keyed.join(gone, F.col("d").eqNullSafe(F.col("gd")) & (F.col("h") == F.col("gh")), "left")
    kept = let(lines, lambda l: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("gone")), lambda i: F.get(l, i)), "\n"))
    return joined.select(
        *[F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in passing],
        F.size(F.filter(lines, lambda l: l.rlike(WORD))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_deleted"),
    )
