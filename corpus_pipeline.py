"""From the documents of a corpus to training pieces, in five stages over whole tables.

Each stage takes all documents that the one before it kept and returns documents in the same columns; the last returns
pieces. Between stages the documents are a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claridoc.llm import jaccard_join, line_dedup, mixing, piece_codec, queries, toxic_spans
from claridoc.session import written


def _measured(documents: DataFrame) -> DataFrame:
    return documents.withColumn("n_chars", F.char_length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span tagger, trained on the labels that are not held out, does not predict toxic.

    Every row is judged by its own text: null and empty ones stay, repeated rows stay or go together, a missing id does not matter.
    """
    labels = queries.table(spark, sf_dir, "labels").where(~queries.label_held_out())
    return toxic_spans.clean_text_layers(docs, toxic_spans.fit(docs.select("doc_id", "text"), labels))


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the runs of lines that stand earlier, of three lines or of twenty words; documents of which no line is left go.

    Rows without an id come first; rows alike in doc_id and text are one document and stay or go together; null and empty texts stay.
    """
    return _measured(line_dedup.remove_repeated_lines(docs, long_words=line_dedup.LONG_WORDS).where("n_deleted = 0 or n_deleted < n_lines").drop("n_lines", "n_deleted"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least doc_id.

    Rows without an id, or without words, are in no class and stay. Rows that repeat one doc_id are one document and stay together.
    """
    classes = jaccard_join.near_duplicate_classes(docs.select("doc_id", "text"))
    return docs.join(classes.where("component_id < doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source, a null text has no words and is not taken."""
    return _measured(mixing.mixed_documents(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, best_score, ids, text_sha256): identifiers in base64, and the digest of the text they decode to; one row a row."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", queries.BATCH_ROWS)
    model = piece_codec.load_piece_model(queries.tokenizer_path())
    encoded = piece_codec.encode(docs, model, keep=("source",)).select("doc_id", "source", "n_pieces", F.get("nbest", F.lit(0))["score"].alias("best_score"), "ids", F.base64("ids").alias("ids64"))
    return piece_codec.decode(encoded, model).select("doc_id", "source", "n_pieces", "best_score", F.col("ids64").alias("ids"), F.sha2("text", 256).alias("text_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_repeats),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", pieces),
]

#: No SQL says what a trained tagger rejects; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
