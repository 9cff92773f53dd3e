"""Literal cases of what the tables can't show: Chinese rules, splitters, extraction, and streams against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.catalog_more import CLAIMS
from loomspark.operators import knowledge, quality, report, text
from loomspark.sources import load
from loomspark.streaming import state


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("v")).first().v


def test_claims(spark):
    said = one(spark, "这个偏方保证治愈，不用去医院", lambda t: knowledge.claims(t, CLAIMS))
    assert said == ["absolute promise", "against seeing a doctor", "folk remedy"]
    assert one(spark, "请咨询医生", lambda t: knowledge.claims(t, CLAIMS)) == []


def test_reference_terms(spark):
    assert one(spark, "血压（BP）为 120 mmHg，编码 I10.5", report.reference_terms) == ["BP", "I10.5", "120 mmHg"]


def test_expand_query(spark):
    variants = one(spark, "red ring", lambda t: knowledge.expand_query(t, {"ring": ["band", "loop"], "red ring": ["ruby"], "blue": ["navy"]}))
    assert variants == ["red ring", "ruby", "red band", "red loop"]


def test_decompose(spark):
    assert one(spark, "a 和 b", lambda t: knowledge.decompose(t, ["以及", "和"])) == ["a", "b"]
    assert one(spark, "a", lambda t: knowledge.decompose(t, ["以及", "和"])) == ["a"]


def test_char_f1_matches_counting(spark):
    rnd = random.Random(4)
    rows = [(k, "".join(rnd.choices("ab c\né.", k=rnd.randrange(9))), "".join(rnd.choices("ab c\né.", k=rnd.randrange(9)))) for k in range(80)] + [(90, None, "x"), (91, "x", None)]
    got = {r.id: r.f1 for r in report.char_f1(spark.createDataFrame(rows, "id int, prediction string, reference string")).collect()}
    for k, p, r in rows:
        p, r = ([c for c in x or "" if not c.isspace()] for x in (p, r))
        common = sum(min(p.count(c), r.count(c)) for c in set(p))
        assert got[k] == pytest.approx(1.0 if not r else 2 * common / (len(p) + len(r)) if p else 0.0, abs=1e-6)


def test_splitters_keep_all_words():
    rnd = random.Random(3)
    for _ in range(60):
        body = "".join(rnd.choice(["word ", "long sentence here. ", "\n\n", "# Heading\n", "。", "x" * 40, "```\n# code\n```\n"]) for _ in range(rnd.randrange(60)))
        bare = re.sub(r"\s", "", body)
        for name in text.SPLITTERS:
            parts = text.SPLITTERS[name](body, 100)
            assert re.sub(r"\s", "", "".join(parts)) == bare, name
            assert all(len(p) <= 100 for p in parts if name in ("recursive", "hybrid"))


def test_hierarchical_children_are_their_parent():
    body = "\n\n".join(f"Paragraph {k} says this. And that! Does it?" for k in range(60))
    parts, squeeze = text.split_hierarchical(body, 100, 300), lambda x: re.sub(r"\s", "", x)
    at = 0
    while at < len(parts):
        parent, child, at = parts[at], "", at + 1
        assert len(parent) >= 300 or parent.endswith("Paragraph 59 says this. And that! Does it?")
        while at < len(parts) and len(squeeze(child)) < len(squeeze(parent)):
            child, at = child + parts[at], at + 1
        assert squeeze(child) == squeeze(parent)


def test_streaming_ends_at_sentences():
    assert text.split_streaming("aaaa. bbbb cccc", 10, 0, 8) == ["aaaa.", "cccc"]
    assert text.split_streaming("x" * 25, 10, 5) == ["x" * 10, "x" * 10, "x" * 10, "x" * 10, "x" * 5]


def test_headed_sections():
    assert text.split_headed("intro 主诉 a 诊断 b", 100, ("主诉", "诊断")) == ["intro", "主诉 a", "诊断 b"]


def test_strategies(spark):
    cases = {"# a\n# b\n# c": "markdown", "# a\n## b": "hierarchical", "x" * 5001: "semantic", "1. Alpha " + "x" * 5001: "recursive", "short": "recursive", "主诉": "section"}
    for body, want in cases.items():
        assert one(spark, body, lambda t: text.select_strategy(t, "主诉|诊断")) == want


def test_extraction_matches_python(spark):
    rows = [(1, "Alphabetical 123 Alphabetical", "x"), (2, "Abcdefghijkl 4567", "x"), (3, None, "x")]
    found = text.pattern_mentions(spark.createDataFrame(rows, "doc_id int, text string, name string").drop("name"), [(r"[A-Z][a-z]{9,}", "Name", 0.7), (r"[A-Za-z]{12,}", "Name", 0.6), (r"[0-9]{3,}", "Number", 0.75), (r"23", "Number", 0.9)], "doc_id", "text")
    got = sorted((r.id, r.name, r.start, r.confidence) for r in text.extracted(found).collect())
    assert got == [(1, "23", 14, 0.9), (1, "alphabetical", 0, 0.73), (2, "4567", 13, 0.75), (2, "abcdefghijkl", 0, 0.73)]


def test_split_by_hash(spark):
    items = spark.range(2000).withColumnRenamed("id", "item")
    train, test = quality.split_by_hash(items, "item", 0.8, 7)
    assert train.count() + test.count() == 2000 and train.join(test, "item").count() == 0 and 1500 < train.count() < 1700


def test_term_files_and_stats(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,name,synonyms\nI10,high,a| b |\nI11,low,\n")
    got = sorted(tuple(r) for r in load.read_terms(spark, str(tmp_path / "t.csv"), "csv").collect())
    assert got == [("I10", "high", ["a", "b"]), ("I11", "low", [])]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("a text that is long enough")
    (tmp_path / "d" / "b.bin").write_text("whatever it is")
    assert tuple(load.load_stats(load.load_documents(spark, str(tmp_path / "d"))).first()) == (2, 1, 1)


def test_breaker_stream(spark, tmp_path):
    calls = [("k", t, ok) for t, ok in [(0, False), (1, False), (2, True), (12, True), (13, True), (14, False)]]
    spark.createDataFrame(calls, "key string, s int, ok boolean").select("key", F.timestamp_seconds("s").alias("ts"), "ok").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, ok boolean").parquet(str(tmp_path / "in"))
    run = state.breaker_states(stream, failures=2, seconds=10.0, probes=2).writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [r.state for r in spark.table("breaker").orderBy("ts").collect()]
    assert got == ["CLOSED", "OPEN", "OPEN", "HALF_OPEN", "CLOSED", "CLOSED"]
