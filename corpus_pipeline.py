"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns the same columns; the last
returns the encoded mix. run() writes each stage's rows as a table in the shared folder and gives them to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import dropped, written
from loomspark.llm.jaccard import jaccard_components
from loomspark.llm.lines import dedup_lines
from loomspark.llm.mixing import mix_sources
from loomspark.llm.pieces import encode_pieces
from loomspark.llm.quality import quality_rules
from loomspark.llm.queries import MIX_WEIGHTS, digest, mix_domain

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the last of them alone; a document that has no text left goes."""
    kept = dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.trim("text") != "")).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on five-word shingles, directly or through others, the least id stays."""
    groups = jaccard_components(docs, width=5, num=80, den=100)
    return docs.join(groups.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by target weights; a document taken for two epochs is there twice."""
    mixed = mix_sources(docs, mix_domain(), share=0.5, weights=MIX_WEIGHTS, max_epochs=2, seed=1)
    return mixed.where("mix_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "mix_copies"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces; exact tells whether they read back as its text."""
    coded = encode_pieces(docs)
    return coded.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("bigint").alias("n_pieces"), digest(F.col("decoded")).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_copies), ("mixing", mixing), ("sentencepiece", encoding)]
#: The trees of the first stage and the encoding aren't told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)  # a stage's table goes when the next one's is there; documents itself is no such table
    return STAGES[-1][1](spark, docs, sf_dir)
