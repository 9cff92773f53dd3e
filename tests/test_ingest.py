"""Batches that are repeated or lost before their commit, updates, duplicates, a stream of files and compaction."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators.text import clean_text, fixed_windows
from loomspark.streaming import ingest


def frame(spark, rows):
    return spark.createDataFrame(rows, "document_id string, content string")


def said(spark, root):
    return {(r.document_id, r.chunk_index): r.content for r in ingest.snapshot(spark, root).collect()}


def want(spark, texts):
    df = frame(spark, list(texts.items())).withColumn("content", clean_text(F.col("content")))
    return {(r.document_id, r.chunk_index): r.content for r in fixed_windows(df, 512, 75, "document_id", "content").collect()}


def test_batches(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "kb")
    long, words = "ab c, " * 300, {"upper": lambda c: c.select("document_id", F.upper("content").alias("content"))}
    assert said(spark, root) == {} and ingest.results(spark, root).count() == 0
    one = [("a", long), ("b", "  two\n words"), ("c", "two words"), ("d", None), ("e", " "), (None, "gone"), ("f", "x"), ("f", "x")]
    assert ingest.ingest_batch(frame(spark, one), "s-0", root, derive=words)
    two = [("a", long), ("b", "new text"), ("g", "x"), ("h", "added"), ("d", "now")]
    with monkeypatch.context() as m:
        m.setattr(ingest, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            ingest.ingest_batch(frame(spark, two), "s-1", root, derive=words)
    assert said(spark, root) == want(spark, {"a": long, "b": "two words", "f": "x"})
    assert ingest.ingest_batch(frame(spark, two), "s-1", root, derive=words)
    assert not ingest.ingest_batch(frame(spark, two), "s-1", root, derive=words) and not ingest.ingest_batch(frame(spark, one), "s-0", root)
    now = {"a": long, "b": "new text", "f": "x", "h": "added", "d": "now"}
    assert said(spark, root) == want(spark, now)
    assert {(r.document_id, r.content) for r in ingest.snapshot(spark, root, "upper").collect()} == {(k, v.upper()) for (k, _), v in said(spark, root).items()}
    got = {(r.key, r.document_id): r.status for r in ingest.results(spark, root).collect()}
    assert got == {
        ("s-0", "a"): "added", ("s-0", "b"): "added", ("s-0", "c"): "duplicate", ("s-0", "d"): "failed", ("s-0", "e"): "failed", ("s-0", "f"): "added",
        ("s-1", "a"): "unchanged", ("s-1", "b"): "updated", ("s-1", "g"): "duplicate", ("s-1", "h"): "added", ("s-1", "d"): "added",
    }
    ingest.compact(spark, root)
    assert {(r.key, r.document_id): r.status for r in ingest.results(spark, root).collect()} == got
    assert said(spark, root) == want(spark, now) and len(ingest._current(ingest.manifests(spark, root))) == 1
    assert ingest.ingest_batch(frame(spark, [("b", "third"), ("a", long)]), "s-2", root) and not ingest.ingest_batch(frame(spark, two), "s-1", root)
    assert said(spark, root) == want(spark, {**now, "b": "third"})
    assert ingest.ingest_batch(frame(spark, []), "s-3", root) and said(spark, root) == want(spark, {**now, "b": "third"})
    assert ingest.ingest_batch(frame(spark, [("z", "all")]), "s-4", root, strategy="full_rebuild") and said(spark, root) == want(spark, {"z": "all"})
    with pytest.raises(KeyError):
        ingest.snapshot(spark, root, "nothing")
    counts = {(r.key, r.document_id): r.n_chunks for r in ingest.results(spark, root).where("status = 'added'").collect()}
    assert counts["s-0", "a"] == sum(k[0] == "a" for k in want(spark, {"a": long})) and counts["s-4", "z"] == 1


def test_stream_of_files(spark, tmp_path, monkeypatch):
    """A stream that is lost between writing and committing runs the batch again, under its own key."""
    source, root, at = tmp_path / "in", str(tmp_path / "kb"), str(tmp_path / "cp")
    source.mkdir()
    (source / "a.txt").write_text("first\nfile")
    (source / "b.txt").write_text("second file")
    commit = ingest._commit
    monkeypatch.setattr(ingest, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        ingest.ingest_files(spark, str(source), root, at).awaitTermination(120)
    assert said(spark, root) == {}
    monkeypatch.setattr(ingest, "_commit", commit)
    ingest.ingest_files(spark, str(source), root, at).awaitTermination(120)
    assert sorted(said(spark, root).values()) == ["first file", "second file"]
    (source / "c.txt").write_text("third file")
    for _ in range(2):
        ingest.ingest_files(spark, str(source), root, at).awaitTermination(120)
    assert sorted(said(spark, root).values()) == ["first file", "second file", "third file"]
    assert ingest.results(spark, root).groupBy("key").count().count() == 2
