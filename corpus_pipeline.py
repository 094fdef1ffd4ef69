"""A training-data pipeline over `documents`: toxicity, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and gives the next one its documents,
written as Parquet and reread in between; all but the last keep the columns of
`documents`. Stages that look a document up again do so by a number that its row
gets when the stage begins, so null and repeated ids, and columns of any name, are
no matter: every row is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm import bpe_tables, decontamination, minhash, secrets, toxicity
from vitaframe.llm.common import free_name, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written so that it stays the row's own, and that column's name."""
    name = free_name(docs, "row_number")
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go; a null or empty text stays unless the network rejects all that has no words."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "toxicity")
    return toxicity.score(docs, net, name).where(F.col(name) < toxicity.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id (a null id only where all are null); texts without words stay, all of them."""
    rows, name = _numbered(docs)
    group = minhash.near_classes(rows.select(F.col(name).alias("doc_id"), "text")).select(F.col("doc_id").alias(name), F.col("component_id").alias("_group"))
    ids = rows.select(name, F.col("doc_id").cast("long").alias("_id")).join(group, name)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col(name).alias("row")))
    kept = ids.groupBy("_group").agg(first.alias("first")).select(F.col("first.row").alias(name))
    return rows.join(kept, name, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, name = _numbered(docs)
    found = decontamination.decontaminate(rows.select(F.col(name).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), near=0)
    # written, so that Spark knows how few they are before it decides whether texts must be shuffled to meet them
    out = written(found.where("contaminated").select(F.col("doc_id").alias(name)), "contaminated")
    return rows.join(out, name, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding that the forest confirms is masked; all documents stay."""
    return secrets.redact(docs, secrets.default_forest())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with digests of them and of the decoded text."""
    return bpe_tables.round_trip(docs, ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("tokens", tokenize)]

#: No stage but the third could be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
