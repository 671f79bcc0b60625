"""Fold criterion results onto all 55 success criteria, areas, summaries and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv
from claridoc.operators.criteria import code_of

_FOUND = ["verdict", "needs_human", "via", "rationale"]


def dim_sc(spark: SparkSession) -> DataFrame:
    """The fixed criterion dimension, 55 rows."""
    rows = [(i + 1, *r) for i, r in enumerate(fv.CRITERIA)]
    return spark.createDataFrame(
        rows,
        "sc_ord bigint, sc string, name string, level string, principle string, guideline string, applicable boolean, "
        "reason string, evidence_source string, decidability string, check_note string",
    )


def dim_area(spark: SparkSession) -> DataFrame:
    """The fixed area dimension, 11 rows, each with its ordered criteria."""
    rows = [(i + 1, *r) for i, r in enumerate(fv.AREAS)]
    return spark.createDataFrame(
        rows,
        "area_ord bigint, area_id string, label string, sc_refs array<string>, primary_standard string, "
        "evidence_source string, default_status string",
    )


def area_sc(spark: SparkSession) -> DataFrame:
    """Bridge of areas and criteria."""
    return dim_area(spark).select("area_id", "area_ord", "label", "primary_standard", F.posexplode("sc_refs").alias("pos", "sc")).select(
        "area_id", "area_ord", "label", "primary_standard", (F.col("pos") + 1).cast("bigint").alias("ord"), "sc"
    )


def sc_areas(spark: SparkSession) -> DataFrame:
    """Areas of each criterion, in area order."""
    listed = F.array_sort(F.collect_list(F.struct("area_ord", "area_id")))
    return area_sc(spark).groupBy("sc").agg(F.transform(listed, lambda a: a["area_id"]).alias("area_ids"))


def _spread(found: DataFrame) -> DataFrame:
    """doc_id and a map of found results, to one row per document and criterion.

    The dimension has 55 rows for ever, so it is broadcast; no row of the corpus is shuffled here.
    """
    spark = found.sparkSession
    codes = F.array(*[F.lit(c[0]) for c in fv.CRITERIA])
    rows = found.withColumn("sc", F.explode(codes)).withColumn("hit", F.try_element_at("found", F.col("sc")))
    dims = F.broadcast(dim_sc(spark))
    skip, hit = ~F.col("applicable"), F.col("hit").isNotNull()
    return rows.join(dims, "sc").select(
        "doc_id", "sc_ord", "sc", "name", "level", "principle", "applicable",
        F.when(skip, "not_present").when(hit, F.col("hit.verdict")).otherwise("cannot_tell").alias("verdict"),
        F.when(skip, False).when(hit, F.col("hit.needs_human")).otherwise(True).alias("needs_human"),
        F.when(~skip & hit, "machine").otherwise("human-only").alias("source"),
        F.when(~skip & hit, F.col("hit.via")).alias("via"),
        F.when(skip, F.col("reason")).when(hit, F.col("hit.rationale")).otherwise(F.col("check_note")).alias("rationale"),
    )


def sc_verdicts(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Documents times 55 criteria from a long findings table; the last finding of a code wins.

    Findings shrink to one per document and code before they are gathered, so a document brings at
    most 55 entries however many findings it has.
    """
    coded = findings.withColumn("sc", code_of(F.col("criterion"))).filter(F.col("sc").isin([c[0] for c in fv.CRITERIA]))
    last = coded.groupBy("doc_id", "sc").agg(F.max_by(F.struct(*_FOUND), "ord").alias("f"))
    maps = last.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("sc", "f"))).alias("found"))
    return _spread(docs.select("doc_id").join(maps, "doc_id", "left"))


def sc_verdicts_of(results: DataFrame) -> DataFrame:
    """The same from one array of results per document (the audit's own form): no shuffle at all."""
    codes = F.transform("criteria", lambda c: F.split_part(c["criterion"], F.lit(" "), F.lit(1)))

    def is_last(c: Column, i: Column) -> Column:
        later = F.slice("codes", i + 2, F.size("codes"))
        return ~F.array_contains(later, F.split_part(c["criterion"], F.lit(" "), F.lit(1)))

    def entry(c: Column) -> Column:
        return F.struct(F.split_part(c["criterion"], F.lit(" "), F.lit(1)), F.struct(*[c[k].alias(k) for k in _FOUND]))

    coded = results.withColumn("codes", codes).withColumn("last", F.filter("criteria", is_last))
    return _spread(coded.select("doc_id", F.map_from_entries(F.transform("last", entry)).alias("found")))


def area_status(verdicts: DataFrame) -> DataFrame:
    """Status of the 11 areas per document."""
    spark = verdicts.sparkSession
    use = F.col("applicable")
    counted = verdicts.join(F.broadcast(area_sc(spark)), "sc").groupBy("doc_id", "area_id", "area_ord", "label", "primary_standard").agg(
        F.bool_or(use).alias("any_use"),
        F.bool_or(use & (F.col("verdict") == "failed")).alias("any_failed"),
        F.bool_or(use & F.col("needs_human")).alias("any_human"),
    )
    status = (
        F.when(~F.col("any_use"), "n/a").when(F.col("any_failed"), "fail").when(F.col("any_human"), "pending-human-review").otherwise("pass")
    )
    return counted.select("doc_id", "area_id", "area_ord", "label", "primary_standard", status.alias("status"))


def bucket() -> Column:
    """The counter a verdict belongs to; the first that fits."""
    return (
        F.when(~F.col("applicable"), "not_applicable").when(F.col("verdict") == "failed", "failed")
        .when(F.col("needs_human"), "needs_human").otherwise("passed")
    )


def _counters() -> list[Column]:
    one = F.count("*").alias("total")
    return [one, *[F.count_if(bucket() == b).alias(b) for b in ("passed", "failed", "needs_human", "not_applicable")]]


def rollup_summary(verdicts: DataFrame) -> DataFrame:
    """Five counters per document; they add up to 55."""
    return verdicts.groupBy("doc_id").agg(*_counters())


def rollup_row(verdicts: DataFrame) -> DataFrame:
    """One assessment per document with all its open criteria, 55 at most; ``text.displayed`` shortens it for a page."""
    detail = F.concat(
        F.col("sc"), F.lit(" "), F.col("name"), F.lit(": "), F.col("verdict"),
        F.when(F.col("needs_human"), " (needs human review)").otherwise(""), F.lit(" — "), F.col("rationale"),
    )
    open_ = (F.col("verdict") == "failed") | F.col("needs_human")
    kept = open_ & ((F.col("source") != "human-only") | (F.col("verdict") == "cannot_tell"))
    listed = F.array_sort(F.collect_list(F.when(kept, F.struct("sc_ord", F.col("sc").alias("citation"), detail.alias("detail")))))
    rows = verdicts.groupBy("doc_id").agg(*[c.alias(f"n_{n}") for c, n in zip(_counters(), ("total", "passed", "failed", "human", "na"))], listed.alias("open"))
    failed, human = F.col("n_failed") > 0, F.col("n_human") > 0
    return rows.select(
        "doc_id", F.lit("wcag").alias("agent"),
        F.when(failed | human, "input_required").otherwise("completed").alias("state"),
        F.when(failed, "failed").when(human, "cannot_tell").otherwise("passed").alias("verdict"),
        F.when(failed, 0.9).when(human, 0.5).otherwise(0.95).alias("confidence"),
        (failed | human).alias("needs_human"),
        F.transform("open", lambda t: F.struct(t["citation"].alias("citation"), t["detail"].alias("detail"))).alias("evidence"),
        F.concat(
            F.lit("WCAG 2.2 AA rollup over "), F.col("n_total").cast("string"), F.lit(" SC: "), F.col("n_passed").cast("string"), F.lit(" pass, "),
            F.col("n_failed").cast("string"), F.lit(" fail, "), F.col("n_human").cast("string"), F.lit(" need human review, "),
            F.col("n_na").cast("string"), F.lit(" N/A for static PDF."),
        ).alias("rationale"),
    )


def areas_for_standard(areas: DataFrame, standard: str) -> DataFrame:
    """The areas a standard shows: its own for PDF/UA, all otherwise."""
    return areas.filter(F.col("primary_standard") == "pdfua") if standard == "pdfua" else areas


def machine_backed(sc: Column) -> Column:
    return sc.isin([code for code, _ in fv.AUDITED])


def corpus_rollup(verdicts: DataFrame, attrs: DataFrame) -> DataFrame:
    """The counters over the corpus with all subtotals of level, principle, language and source.

    Rows are counted by the full key first; the cube then expands those few rows only.
    """
    keys = ["level", "principle", "lang", "source_name"]
    named = attrs.select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.col("source").alias("source_name"))
    fine = verdicts.join(named, "doc_id").groupBy(*keys).agg(*_counters())
    names = ("total", "passed", "failed", "needs_human", "not_applicable")
    subtotals = fine.cube(*keys).agg(*[F.sum(n).alias(n) for n in names], F.grouping_id().alias("grouping"))
    return subtotals.select("grouping", *keys, *names)


def corpus_area_rank(areas: DataFrame, attrs: DataFrame) -> DataFrame:
    """All sources ranked by the share of failed documents, per area; a limit is the caller's."""
    share = areas.join(attrs.select("doc_id", "source"), "doc_id").groupBy("area_id", "source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "fail").alias("failed")
    ).withColumn("fail_share", F.col("failed") / F.col("documents"))
    w = Window.partitionBy("area_id").orderBy(F.desc("fail_share"))
    return share.withColumn("rank", F.dense_rank().over(w).cast("bigint"))
