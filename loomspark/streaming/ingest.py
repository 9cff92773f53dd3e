"""Ingest in batches: documents deduplicated, cleaned and chunked into tables that a log of manifests makes up.

A batch writes its rows into folders of its own and becomes visible when its manifest is there, under its number in the log. A
batch whose key is in the log is not run again, and folders that no manifest names are never read: a batch that is repeated, or
was lost between writing and committing, leaves the tables of one run. Only the batch's own rows are written; a document's rows
count if they are of the last batch that took it. compact() writes them anew as one. A log has one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loomspark.operators.text import clean_text, fixed_windows

#: Incremental: documents that changed are replaced. Full rebuild: the batch is all there is from then on.
STRATEGIES = ("incremental", "full_rebuild")
_DOCUMENTS = "document_id string, status string, content_hash string, content string, n_chunks bigint, seq bigint"
_CHUNKS = "chunk_id string, document_id string, chunk_index int, content string, seq bigint"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """The log's manifests in order, from the last that replaced all before; one of a few hundred bytes for each batch."""
    fs, at = _files(spark, f"{root}/manifest")
    if not fs.exists(at):
        return []
    names = sorted(f.getPath().toString() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json"))
    log = [json.loads(r.value) for r in spark.read.text(names, wholetext=True).collect()] if names else []
    return sorted(log, key=lambda m: m["seq"])


def _current(log: list[dict]) -> list[dict]:
    return log[max((k for k, m in enumerate(log) if m["base"]), default=0) :]


def _commit(spark: SparkSession, root: str, manifest: dict) -> None:
    """The manifest is written beside its place and renamed into it, whole or not at all."""
    place = f"{root}/manifest/{manifest['seq']:010d}.json"
    fs, to = _files(spark, place)
    if fs.exists(to):
        raise RuntimeError(f"{place} is there: the log has another writer")
    _, draft = _files(spark, f"{root}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(draft, to):
        raise RuntimeError(f"{place} could not be written")


def _batches(spark: SparkSession, log: list[dict], table: str, schema: str | None) -> DataFrame | None:
    paths = [m["tables"][table] for m in log if table in m["tables"]]
    if not paths:
        return spark.createDataFrame([], schema) if schema else None
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def _owners(spark: SparkSession, log: list[dict]) -> DataFrame:
    """(document_id, seq) of the last batch that took each document."""
    return _batches(spark, log, "documents", _DOCUMENTS).where("status in ('added', 'updated')").groupBy("document_id").agg(F.max("seq").alias("seq"))


def snapshot(spark: SparkSession, root: str, table: str = "chunks") -> DataFrame:
    """The rows that count now of ``documents``, ``chunks`` or a derived table. KeyError for a table that the log doesn't hold."""
    log = _current(manifests(spark, root))
    rows = _batches(spark, log, table, {"documents": _DOCUMENTS, "chunks": _CHUNKS}.get(table))
    if rows is None:
        raise KeyError(table)
    if table == "documents":
        rows = rows.where("status in ('added', 'updated')").drop("status")
    return rows.join(_owners(spark, log), ["document_id", "seq"], "left_semi").drop("seq")


def results(spark: SparkSession, root: str) -> DataFrame:
    """(seq, key, document_id, status, n_chunks) of every document of every batch in the log, compactions left out.

    Status is added, updated, unchanged (same content as before), duplicate (another document has the content: one taken in a
    batch before, or the one of the least id in this batch; a version taken before stays) or failed (null or blank content).
    """
    log = [m for m in manifests(spark, root) if not m["compacted"]]
    keys = spark.createDataFrame([(m["seq"], m["key"]) for m in log], "seq bigint, key string")
    return _batches(spark, log, "documents", _DOCUMENTS).join(F.broadcast(keys), "seq").select("seq", "key", "document_id", "status", "n_chunks")


def ingest_batch(batch: DataFrame, key: str, root: str, strategy: str = "incremental", size: int = 512, overlap: int = 75, derive: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> bool:
    """Takes ``batch(document_id, content)`` into the tables below ``root``; False if ``key`` is in the log, and nothing is done.

    ``derive`` names further tables and how they follow from the batch's chunks (rows with a document_id). Rows without an id
    go; of several contents of one id that of the least hash is taken. An empty batch is committed without documents.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}")
    spark = batch.sparkSession
    log = manifests(spark, root)
    if any(m["key"] == key for m in log):
        return False
    seq, base = 1 + max((m["seq"] for m in log), default=-1), strategy == "full_rebuild"
    live = [] if base else _current(log)
    known = _batches(spark, live, "documents", _DOCUMENTS).join(_owners(spark, live), ["document_id", "seq"], "left_semi").where("status in ('added', 'updated')").select("document_id", "content_hash")

    text = F.nullif(clean_text(F.col("content")), F.lit(""))
    rows = batch.where("document_id is not null").select(F.col("document_id").cast("string").alias("document_id"), text.alias("content"))
    rows = rows.withColumn("content_hash", F.sha2(F.encode("content", "UTF-8"), 256)).groupBy("document_id").agg(F.min("content_hash").alias("content_hash"), F.min_by("content", "content_hash").alias("content"))
    first = rows.where("content_hash is not null").groupBy("content_hash").agg(F.min("document_id").alias("first"))
    before = known.select("document_id", F.col("content_hash").alias("old_hash"))
    owner = known.groupBy("content_hash").agg(F.min("document_id").alias("owner"))
    x = rows.join(before, "document_id", "left").join(first.join(owner, "content_hash", "left"), "content_hash", "left")
    status = F.when(F.col("content").isNull(), "failed").when(F.col("old_hash") == F.col("content_hash"), "unchanged").when(F.col("owner").isNotNull() | (F.col("first") != F.col("document_id")), "duplicate").when(F.col("old_hash").isNotNull(), "updated").otherwise("added")
    x = x.withColumn("status", status).withColumn("taken", F.col("status").isin("added", "updated"))
    n_chunks = F.when(F.col("taken"), F.floor((F.length("content") - 1) / (size - overlap)) + 1).otherwise(0).cast("bigint")
    x = x.select("document_id", "status", "content_hash", F.when(F.col("taken"), F.col("content")).alias("content"), n_chunks.alias("n_chunks"), F.lit(seq).cast("bigint").alias("seq"))

    tables = {}

    def write(name: str, df: DataFrame) -> DataFrame:
        tables[name] = f"{root}/{name}/{seq:010d}-{uuid.uuid4().hex}"
        df.write.parquet(tables[name])
        return spark.read.schema(df.schema).parquet(tables[name])

    taken = write("documents", x).where("status in ('added', 'updated')")
    chunks = write("chunks", fixed_windows(taken, size, overlap, "document_id", "content").withColumn("seq", F.lit(seq).cast("bigint")))
    for name, how in (derive or {}).items():
        write(name, how(chunks.drop("seq")).withColumn("seq", F.lit(seq).cast("bigint")))
    _commit(spark, root, {"seq": seq, "key": key, "base": base, "compacted": False, "tables": tables})
    return True


def compact(spark: SparkSession, root: str) -> None:
    """Writes the rows that count as one batch that stands for all before; their folders stay for readers that began earlier."""
    log = _current(manifests(spark, root))
    if len(log) < 2:
        return
    seq = 1 + log[-1]["seq"]
    tables = {}
    for name in {t for m in log for t in m["tables"]}:
        tables[name] = f"{root}/{name}/{seq:010d}-{uuid.uuid4().hex}"
        rows = snapshot(spark, root, name).withColumn("seq", F.lit(seq).cast("bigint"))
        (rows.withColumn("status", F.lit("added")) if name == "documents" else rows).write.parquet(tables[name])
    _commit(spark, root, {"seq": seq, "key": f"compact-{seq}", "base": True, "compacted": True, "tables": tables})


def ingest_files(spark: SparkSession, source: str, root: str, checkpoint: str, name: str = "files", **options) -> StreamingQuery:
    """A stream of the text files that come to ``source``, by which each micro-batch is taken in; ids are the MD5 of the path.

    ``name`` is part of the batches' keys: one name goes with one ``checkpoint``. Runs until all files there are taken.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(source)
    rows = files.select(F.md5(F.encode("_metadata.file_path", "UTF-8")).alias("document_id"), F.col("value").alias("content"))
    stream = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return stream.foreachBatch(lambda df, n: ingest_batch(df, f"{name}-{n}", root, **options) and None).start()
