"""Corpus pipeline: documents in, packed training sequences out. Each stage is one operator, over all rows it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard, packing, secrets, substrings, weak
from graphloom.llm.common import materialize, table
from graphloom.llm.tokens import default_vocabulary

#: One stage's model is trained on the corpus and one counts tokens of a vocabulary: SQL cannot express them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, null, empty and blank texts among them. All columns stay as they are, also
    those named like the classifier's own."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = weak.classify(docs.select("doc_id", "text", row)).where("kept")
    return judged.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least id stays.

    Documents are told apart by id and text, through a 64-bit hash of both: texts that share an id are documents of their
    own, and of rows that repeat an id and a text one stays (the least as JSON). Rows without an id link with nothing and
    all stay."""
    named = docs.where("doc_id IS NOT NULL").withColumn("__key", F.xxhash64("doc_id", "text"))
    keys = materialize(named.groupBy("__key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "document-keys")
    found = jaccard.near_duplicates(named, "__key").select("__key", "component_id").distinct().join(keys, "__key")
    stay = found.groupBy("component_id").agg(F.min(F.struct("least", "__key", "rows")).alias("of")).select("of.__key", "of.rows")
    stay = materialize(stay, "documents-that-stay")
    kept = named.join(stay.where("rows = 1"), "__key", "left_semi").select(*docs.columns)
    again = stay.where("rows > 1")
    if not again.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = named.join(again, "__key", "left_semi").groupBy("__key").agg(F.min_by(row, F.to_json(row)).alias("row"))
        kept = kept.union(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
    return kept.union(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a 50-word passage of a document with a smaller id go, and documents left without words. A text that
    loses words keeps the others joined by one space; all other texts stay as they are, null and empty ones and those of
    rows without an id among them. Rows that repeat an id do not remove each other's words."""
    out = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    rows = out.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    return _with_length(rows.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; rows and other columns stay, null and empty texts as they are."""
    return _with_length(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is the end id alone."""
    return packing.pack(docs, default_vocabulary())


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("secret scan", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
