"""Keyed upserts, deletes and versions as joins that return the new table; the caller writes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """By id: content and updated_at from ``new``, created_at kept."""
    o, n = old.alias("o"), new.alias("n")
    x = o.join(n, "id", "full")
    return x.select("id", F.coalesce("n.content", "o.content").alias("content"), F.coalesce("o.created_at", "n.created_at").alias("created_at"), F.coalesce("n.updated_at", "o.updated_at").alias("updated_at"))


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """By name: the first type stays, types are united, properties are updated, version counts up."""
    x = old.alias("o").join(new.alias("n"), "name", "full")
    none = F.array().cast("array<string>")
    return x.select("name", F.coalesce("o.type", "n.type").alias("type"), F.array_sort(F.array_union(F.coalesce("o.types", none), F.coalesce("n.types", none))).alias("types"), (F.coalesce("o.version", F.lit(0)) + F.col("n.type").isNotNull().cast("int")).cast("bigint").alias("version"))


def upsert_relations(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """By (src, dst, type); new relations whose ends aren't both nodes are left out."""
    ends = lambda c: nodes.select(F.col("node_id").alias(c)).distinct()
    fresh = new.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select("src", "dst", "type")
    return old.select("src", "dst", "type").unionByName(fresh).distinct()


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``gone(node_id)``, and edges without those at either end."""
    keep = nodes.join(gone, "node_id", "left_anti")
    left = edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return keep, left


def replace_documents(chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Incremental update: all chunks of the documents in ``new_chunks`` go, the new ones come."""
    return chunks.join(new_chunks.select("document_id").distinct(), "document_id", "left_anti").unionByName(new_chunks)


def new_documents(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming rows whose id and content hash are both unknown; the least id of equal contents."""
    x = incoming.withColumn("content_hash", F.sha2(F.encode("content", "UTF-8"), 256))
    x = x.join(known.select("id"), "id", "left_anti").join(known.select("content_hash"), "content_hash", "left_anti")
    first = x.groupBy("content_hash").agg(F.min("id").alias("id"))
    return x.join(first, ["content_hash", "id"], "left_semi")


def upsert_versions(old: DataFrame, touched: DataFrame, now: int) -> DataFrame:
    """Version records(document_id, version, created_at, updated_at): those ``touched(document_id)`` count up, new ones begin at 1."""
    x = old.alias("o").join(touched.select("document_id").distinct().withColumn("hit", F.lit(True)), "document_id", "full")
    hit = F.col("hit").isNotNull()
    return x.select("document_id", (F.coalesce("version", F.lit(0)) + hit.cast("int")).cast("bigint").alias("version"), F.coalesce("created_at", F.lit(now)).alias("created_at"), F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def upsert_stamped(old: DataFrame, new: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """Relations(src, dst, type, created_at, updated_at) by (src, dst, type); new ones need both ends among ``nodes``."""
    ends = lambda c: nodes.select(F.col("node_id").alias(c)).distinct()
    fresh = new.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select("src", "dst", "type").distinct().withColumn("hit", F.lit(True))
    x = old.join(fresh, ["src", "dst", "type"], "full")
    return x.select("src", "dst", "type", F.coalesce("created_at", F.lit(now)).alias("created_at"), F.when(F.col("hit"), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def upsert_versioned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities(name, type, types, version, confidence, source): a new row counts the version up, its confidence and source win, types are united, the first type stays."""
    x, none = old.alias("o").join(new.alias("n"), "name", "full"), F.array().cast("array<string>")
    hit = F.col("n.type").isNotNull()
    return x.select("name", F.coalesce("o.type", "n.type").alias("type"), F.array_sort(F.array_union(F.coalesce("o.types", none), F.coalesce("n.types", none))).alias("types"), (F.coalesce("o.version", F.lit(0)) + hit.cast("int")).cast("bigint").alias("version"), F.coalesce("n.confidence", "o.confidence").alias("confidence"), F.coalesce("n.source", "o.source").alias("source"))
