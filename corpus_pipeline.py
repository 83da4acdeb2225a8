"""A corpus pipeline in four stages: language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read
again as the next one's docs. Stages but the last keep all columns of docs, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velotrace.llm import jaccard, langid, packing, secrets
from velotrace.llm.common import discard, free_name, written

#: The near-duplicate stage's shingles and threshold, wider than the defaults of op4's query.
WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was recognised. Those with a null or empty text, or with noise for one, go; rows that are
    repeated, share an id or have none are each judged by themselves. An empty table stays empty."""
    name = free_name(docs, "language")
    return langid.documents(docs, name).where(F.col(name)["accepted"]).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, a row without one last.

    Rows are compared, not ids: rows that share an id or have none stay unless another row that stays is, by links, a
    near copy. Empty and null texts are copies of nothing and stay. An empty table stays empty.
    """
    row = free_name(docs, "row")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = jaccard.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), WORDS, NUMERATOR, DENOMINATOR)
    found = found.select(F.col("doc_id").alias(row), F.col("component_id").alias("_group"))
    members = written(found.join(keyed.select(row, "doc_id"), row), "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    stays = members.groupBy("_group").agg(F.min(order)[row].alias("_stays")).select("_stays")
    # by row, which no group shares, so that a large group isn't one task's
    drop = written(members.select(row).join(stays, F.col(row) == F.col("_stays"), "left_anti"), "copies")
    few = drop.count() <= jaccard.HELD_IDS
    return keyed.join(F.broadcast(drop) if few else drop, row, "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and n_chars told anew; null texts stay null."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences; a null or empty text is packed as its end id alone."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", ngram_jaccard), ("secret scans", secret_scans), ("best-fit packing", best_fit_packing)]

#: No SQL: the first stage is a fitted model, the last a packing plan. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
