"""The corpus pipeline: quality rules, quality classifier, near-duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import classifier, near_copies, packing, pii, quality_rules
from turnloom.llm.common import deleted, memory_returned, only_kept, written
from turnloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source.

    Each row goes by its own text, whatever other rows share its id; null and empty texts fail, rows alike stay or go
    together, null languages and sources are groups of their own, and no rows give none.
    """
    return quality_rules.judged(docs, carry=True).filter("kept").select("row.*").select(*COLUMNS)


def keep_by_grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents likely enough to be of the top grade, by a model fitted on the rated ones among them.

    Each row goes by its own text; null and empty texts score as texts without words; without ratings of two grades all
    rows stay.
    """
    ratings = classifier.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = classifier.train(docs, ratings)
    memory_returned()
    return classifier.selected(docs.select(*COLUMNS), model)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles overlap by 0.8 or more: one with the smallest doc_id.

    Of rows alike in id and text one stays; an id on texts of two groups can stay twice; texts without words, null ones
    included, are a group; a null id stands for a group only if it has no other.
    """
    with only_kept(spark) as needed:  # of all that the search for groups writes, only its result
        groups = near_copies.near_copies(docs).filter("first")
        kept = written(groups.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.count("*").alias("__n")), "kept")
        needed.append(kept.turnloom_path)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h"))
    rows = docs.withColumn("__text", near_copies.text_hash("text")).join(kept, same, "left_semi")
    if kept.filter("__n > 1").limit(1).count():  # rows alike in id and text
        rows = rows.dropDuplicates(["doc_id", "__text"])
    return rows.select(*COLUMNS)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced; n_chars is that of the new text. Null texts
    stay null, with null n_chars; rows alike stay, each sanitised."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every row's text lies in sequences of 4096 tokens; a null text is its end alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", keep_by_rules), ("quality_classifier", keep_by_grade), ("simhash_dedup", keep_first_copies), ("pii", sanitise), ("packing", pack)]

#: Neither the fingerprints nor the trained model nor the tokenizer has a form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage's rows written to the shared folder and read again as the next one's. What a
    stage wrote on its way, and its predecessor's rows, are deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        with only_kept(spark) as kept:
            rows = written(stage(spark, docs, sf_dir), name)
            kept.append(rows.turnloom_path)
        if path := getattr(docs, "turnloom_path", None):
            deleted(spark, path)
        docs = rows
    return STAGES[-1][1](spark, docs, sf_dir)
