import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loomspark.operators import fusion, graph, merge, quality, retrieval, rollup, text
from loomspark.sources import load
from loomspark.streaming import state


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_trails_and_modularity(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "X"), ("e2", "b", "c", "Y"), ("e3", "c", "a", "X"), ("e4", "d", "e", "X")], "edge_id string, src string, dst string, type string")
    start = spark.createDataFrame([("a",)], "node_id string")
    found = graph.expand(edges, start, 3)
    assert found.count() == 6 and found.where("hops = 3").select("end").distinct().collect()[0][0] == "a"
    assert rows(graph.find_paths(edges, start, "c"), "hops", "path") == [(1, "a,c"), (2, "a,b,c")]
    assert graph.expand(edges, start, 2, ["Y"]).count() == 0
    parts = spark.createDataFrame([(n, "1" if n in "abc" else "2") for n in "abcde"], "node string, community string")
    assert graph.modularity(graph.simple_graph(edges), parts).first()[0] == pytest.approx(0.375)
    labels = {r.node: r.community for r in graph.communities(graph.simple_graph(edges)).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["d"] == labels["e"]


def test_hybrid_merge(spark):
    v = spark.createDataFrame([("c1", 0.9), ("c2", 0.7)], "chunk_id string, similarity double")
    g = spark.createDataFrame([("c3", 0.8), ("c1", 0.8)], "chunk_id string, entity_score double")
    got = {r.chunk_id: r.combined for r in retrieval.hybrid_combine(v, g).collect()}
    assert got == {"c1": 0.9, "c2": pytest.approx(0.388889), "c3": 0.4}


def test_routes(spark):
    df = spark.createDataFrame([("请总结高血压的主要症状",), ("高血压是什么",), ("高血压",), ("糖尿病患者数量统计",)], "q string")
    routed = retrieval.route(F.col("q"), ["总结", "概述"], ["是什么", "症状是"], ["数量", "统计"])
    assert [r[0] for r in df.select(routed).collect()] == ["global", "local", "hybrid", "local"]
    assert [r[0] for r in df.select(retrieval.route_alpha(routed)).collect()] == [0.2, 0.7, 0.5, 0.7]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, ""), (3, "abc"), (4, None)], "doc_id bigint, text string")
    got = rows(text.fixed_windows(docs), "chunk_id", F.length("content").alias("n"))
    assert got == [("1_chunk_0", 512), ("1_chunk_1", 512), ("1_chunk_2", 126), ("3_chunk_0", 3)]
    long = "One. Two! " * 200 + "\n\n" + "A" * 2000 + "\n# H\n```\n# no\n```\n" + "词。" * 400
    for name, split in text.SPLITTERS.items():
        parts = split(long, 300)
        assert all(len(p) <= 300 for p in parts), name
        strip = lambda t: "".join(t.split())
        assert strip("".join(parts)) == strip(long), name
        assert split("", 300) == [] and split("abc", 300) == ["abc"]
    assert rows(text.split_documents(docs, 100), "document_id", "strategy").count((1, "recursive")) == 10


def test_mentions(spark):
    e = spark.createDataFrame([("Flu", "D", 0.95, "exact"), ("flu", "D", 0.7, "suffix"), ("x", "D", 0.99, "a")], "name string, type string, confidence double, strategy string")
    assert rows(text.validated(e), "name", "confidence") == [("flu", 0.98), ("x", 0.99)]
    spans = spark.createDataFrame([(1, "a", 0, 3, 0.95), (1, "b", 0, 2, 0.7), (1, "c", 3, 5, 0.1)], "id int, name string, start int, end int, confidence double")
    assert rows(text.non_overlapping(spans), "name") == [("a",), ("c",)]
    t = spark.createDataFrame([(1, "HTN is a common condition")], "id int, text string")
    assert rows(text.abbreviation_mentions(t, "id", "text"), "abbr", "start") == [("HTN", 0)]


def test_metrics(spark):
    pairs = spark.createDataFrame([(1, "a b", "a b c d"), (2, "Hello, World! x y", "hello world x y"), (3, "", "a"), (4, "高血压", "高血糖")], "id int, prediction string, reference string")
    assert dict(rows(quality.rouge_recall(pairs, 1), "id", "rouge")) == {1: 0.5, 2: 1.0, 3: 0.0, 4: pytest.approx(0.666667)}
    assert dict(rows(quality.bleu(pairs), "id", "bleu")) == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}
    assert dict(rows(quality.token_f1(pairs), "id", "f1"))[1] == pytest.approx(2 / 3, abs=1e-6)
    assert dict(rows(quality.rouge_l(pairs), "id", "rouge_l"))[4] == pytest.approx(2 / 3, abs=1e-6)
    assert spark.range(1).select(quality.keyword_share(F.lit("x"), F.array().cast("array<string>"))).first()[0] == 1.0


def test_rollups(spark):
    df = spark.createDataFrame([("m", v) for v in (3.0, 7.0, 15.0, 60.0, 200.0)], "k string, v double")
    got = {r.le: r.n for r in rollup.histogram(df, "k", "v").collect()}
    assert (got["5"], got["10"], got["25"], got["Inf"]) == (1, 2, 3, 5)
    many = spark.range(100).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v")).unionByName(spark.range(20).select(F.lit("b").alias("k"), F.col("id").cast("double").alias("v")))
    assert rows(rollup.indexed_quantile(many, "k", "v", 0.95), "k", "quantile") == [("a", 95.0), ("b", 19.0)]
    assert math.isclose(rollup.ab_stats(spark.createDataFrame([(4, "A"), (2, None), (6, "B")], "rating int, variant string")).first().improvement, 100.0)
    m = spark.createDataFrame([("http requests-total.rate", "5", 2)], "metric string, le string, n int")
    assert rollup.prometheus(m).first()[0] == 'http_requests_total_rate_bucket{le="5"} 2'


def test_merges(spark):
    old = spark.createDataFrame([("a", "X", ["X"], 1)], "name string, type string, types array<string>, version int")
    new = spark.createDataFrame([("a", "Y", ["Y"], 1), ("b", "Z", ["Z"], 1)], "name string, type string, types array<string>, version int")
    assert rows(merge.upsert_entities(old, new), "name", "type", F.array_join("types", ",").alias("t"), "version") == [("a", "X", "X,Y", 2), ("b", "Z", "Z", 1)]


def test_fusion(spark):
    e = spark.createDataFrame([("HTN", "D"), ("High BP", "D"), ("other", "D")], "name string, type string")
    a = spark.createDataFrame([("HTN", "hypertension")], "abbr string, canonical string")
    y = spark.createDataFrame([("D", "hypertension", "high bp")], "entity_type string, canonical string, synonym string")
    assert dict(rows(fusion.normalise(e, a, y), "name", "canonical")) == {"HTN": "hypertension", "High BP": "hypertension", "other": "other"}
    r = spark.createDataFrame([(1, "is treated with"), (2, "nothing")], "id int, text string")
    p = spark.createDataFrame([("TREATED_BY", "treated", 1), ("USES", "with", 0)], "relation string, phrase string, ord int")
    assert rows(fusion.align_relations(r, p), "id", "relation") == [(1, "TREATED_BY"), (2, "nothing")]
    t = spark.createDataFrame([("I10", "x"), ("I11", "y"), ("J1", "z")], "code string, name string")
    assert rows(fusion.search_terms(t, "I1"), "code", "score") == [("I10", 0.9), ("I11", 0.9)]


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("a;b\n\n1\n3;4;5\n")
    (tmp_path / "sub" / "b.html").write_text("<title>T</title><style>x{}</style><p>Fish &amp; <b>chips</b> &lt;now</p>")
    (tmp_path / "c.txt").write_text("short")
    (tmp_path / "d.bin").write_text("0123456789abc")
    got = {r.path.rsplit("/", 1)[1]: r for r in load.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.csv"].content == "| a | b |\n| --- | --- |\n| 1 |  |\n| 3 | 4 | 5 |"
    assert got["b.html"].content == "T Fish & chips <now" and got["b.html"].title == "T"
    assert got["c.txt"].error == "too short" and got["d.bin"].error == "unknown kind"


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    data = [(f"k{k % 3}", base + dt.timedelta(seconds=7 * k)) for k in range(60)]
    df = spark.createDataFrame(data, "key string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = state.rate_limit(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = rows(state.rate_limit_batch(df, 2, 60.0), "key", "ts", "allowed")
    assert rows(spark.table("limited"), "key", "ts", "allowed") == batch and 0 < sum(r[2] for r in batch) < 60
