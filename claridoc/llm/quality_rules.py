"""Quality rules over text layers as a bitmask ledger; native plans only.

Every rule is evaluated once. The ledger keeps a document's measurements and one bit per failed rule; a policy is a versioned
mask of the rules that count. Verdicts of any policy, and what each rule decides alone (its ablation), are bitwise
operations on the ledger: no text is read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: name and failing condition over the measurements, in bit order. Integers only, so that bounds are exact.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
)
#: policy version and the rules that it applies
POLICIES = (("base", ("few_words", "repeated_words")), ("v1", tuple(name for name, _ in RULES)))


def mask_of(rules: tuple[str, ...]) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[r] for r in rules)


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once a row, also where ``f`` names it many times."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the list, the first occurrence included.

    Windows are compared by a 64-bit hash inside one document. Sorting brings equal windows together, so a text of n words
    costs n log n, however often a window repeats; texts without a repeat stop at counting distinct hashes.
    """

    def heavy(h: Column) -> Column:
        spots = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda i, j: (j >= 0) & (j < F.size(s)) & (F.get(s, i)["h"] == F.get(s, j)["h"])
            hit = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return let(spots, places)

    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    counted = lambda w: let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), heavy(h)).otherwise(F.lit(0)))
    return let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.when(F.size(w) >= 3, counted(w)).otherwise(F.lit(0)).alias("n_repeat_words")))


def rule_ledger(text_layers: DataFrame) -> DataFrame:
    """One row per text layer: measurements and ``failed``, the bits of the rules it fails.

    ``text_layers``: (doc_id, text); other columns are ignored. Returns (doc_id, n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, failed). A null or empty text has no words and fails ``few_words``; rows without an id or
    with the same id keep rows of their own; an empty table gives an empty ledger. Nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda l: l.rlike(WORD))
    long = lambda name, c: c.cast("long").alias(name)
    measured = text_layers.select(
        "doc_id",
        repeated_words(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("_w"),
        let(lines, lambda l: F.struct(F.size(l).alias("n"), (F.size(l) - F.size(F.array_distinct(l))).alias("d"))).alias("_l"),
        long("word_chars", F.char_length(F.translate(text, SPACES, ""))),
        long("n_symbols", F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))),
    ).select(
        "doc_id",
        long("n_words", F.col("_w.n_words")),
        "word_chars",
        "n_symbols",
        long("n_lines", F.col("_l.n")),
        long("n_dup_lines", F.col("_l.d")),
        long("n_repeat_words", F.col("_w.n_repeat_words")),
    )
    bits = [F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, condition) in enumerate(RULES)]
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def verdicts(ledger: DataFrame, policies: tuple = POLICIES) -> DataFrame:
    """The ledger with one boolean ``kept_<version>`` per policy: no failed bit under its mask."""
    return ledger.withColumns({f"kept_{version}": F.col("failed").bitwiseAND(F.lit(mask_of(rules)).cast("long")) == 0 for version, rules in policies})


def ablations(ledger: DataFrame, policies: tuple = POLICIES) -> DataFrame:
    """(version, rule, documents, failed, rejected, only_by_rule): what each rule of each policy decides.

    ``only_by_rule`` documents would be kept by the policy without the rule. One aggregation over distinct bit patterns.
    """
    patterns = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    pairs = [F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(mask_of(rules)).cast("long").alias("mask"), F.lit(mask_of((r,))).cast("long").alias("bit")) for v, rules in policies for r in rules]
    under = F.col("failed").bitwiseAND(F.col("mask"))
    n = lambda name, c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    return (
        patterns.select("failed", "n", F.inline(F.array(*pairs)))
        .groupBy("version", "rule")
        .agg(F.sum("n").alias("documents"), n("failed", F.col("failed").bitwiseAND(F.col("bit")) != 0), n("rejected", under != 0), n("only_by_rule", under == F.col("bit")))
    )
