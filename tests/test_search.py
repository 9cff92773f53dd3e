"""Rules of intents on literal questions, and searches against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import intents, retrieval, search

WORDS = intents.Words(diseases=("高血压", "肺癌"), drugs=("阿司匹林",), symptoms=("头痛", "咳嗽"), examinations=("血常规",))


@pytest.mark.parametrize(("text", "intent", "confidence"), [
    ("阿司匹林头痛怎么办", "drug_query", 0.9), ("头痛怎么办", "symptom_query", 0.95), ("哮喘发作怎么处理", "symptom_query", 0.95), ("发作时头痛", "symptom_query", 0.9),
    ("我头痛是怎么回事", "diagnosis_assist", 0.9), ("我该注意什么", "health_advice", 0.85), ("我咳嗽", "diagnosis_assist", 0.85), ("中风后康复训练", "treatment_query", 0.9),
    ("高血压有什么症状", "disease_query", 0.9), ("骨折怎么治", "treatment_query", 0.8), ("肺癌怎么治", "disease_query", 0.9), ("什么是肺癌", "disease_query", 0.85),
    ("头痛的原因", "symptom_query", 0.8), ("要做哪些检查", "examination_query", 0.85), ("如何预防", "prevention_query", 0.85), ("肺癌", "disease_query", 0.8), ("你好", None, None), ("", None, None), (None, None, None)])
def test_intents(spark, text, intent, confidence):
    row = spark.createDataFrame([(text,)], "text string").select(intents.classified(F.col("text"), intents.rules(WORDS)).alias("c")).select("c.*", intents.agent(F.col("c.intent")).alias("agent")).first()
    assert (row.intent, row.confidence) == (intent, confidence)
    assert row.agent == intents.AGENTS.get(intent, "general_agent")


def test_routes_hints_and_entities(spark):
    text = F.col("text")
    row = lambda t: spark.createDataFrame([(t,)], "text string").select(
        retrieval.route(text, intents.GLOBAL_WORDS, intents.LOCAL_WORDS, intents.NUMERIC_WORDS).alias("route"), intents.hinted(text).alias("hints"), intents.named(text, WORDS, F.array(F.lit("x"))).alias("named"), intents.classified(text, intents.FINE_RULES)["intent"].alias("fine")).first()
    assert row("总结整体概况").route == "global" and row("治疗头痛").route == "local" and row("排名").route == "local" and row("你好").route == "hybrid"
    assert row("头痛病").hints == ["diagnosis_assist", "symptom_query"] and row("药").hints == ["drug_query", "drug_interaction"] and row("你好").hints == []
    assert row("高血压头痛头痛").named == ["x", "头痛", "高血压"]
    assert row("药物联用").fine == "drug_interaction" and row("手术方案").fine == "treatment_query" and row("你好").fine is None


@pytest.mark.parametrize("seed", [1, 2])
def test_strongest_paths(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{k}" for k in range(14)]
    rows = [(rnd.choice(nodes), rnd.choice(nodes), rnd.randrange(1, 4)) for _ in range(16)] + [("hub", n, 1) for n in nodes[:9]]
    weight = {}
    for a, b, n in rows:
        for x, y in ((a, b), (b, a)):
            if a != b:
                weight[x, y] = weight.get((x, y), 0) + n
    want = set()
    for name in [*nodes, "hub"]:
        one = [(1, -n, b, 0, b) for (a, b), n in weight.items() if a == name]
        two = [(2, p[1], p[2], -n, b) for p in one for (a, b), n in weight.items() if a == p[2] and b != name]
        want |= {(name, k, h, via, end) for k, (h, _, via, _, end) in enumerate(sorted(one + two)[:5], 1)}
    got = search.strongest_paths(spark.createDataFrame([(n,) for n in [*nodes, "hub", "absent"]], "name string"), spark.createDataFrame(rows, "a string, b string, n bigint"), 5)
    assert {tuple(r) for r in got.collect()} == want


def test_variants(spark):
    questions = spark.createDataFrame([("a", "cold and cough"), ("b", "none"), ("c", ""), ("d", None)], "query_id string, text string").withColumn("intents", F.array(F.lit("x"), F.lit("unknown")))
    synonyms = spark.createDataFrame([("cold", 1, "flu"), ("cold", 2, "cold"), ("cough", 1, "hack"), ("cough", 2, "bark")], "term string, place int, synonym string")
    got = {(r.query_id, r.place): r.text for r in search.variants(questions, synonyms, {"x": "about {query}?"}).collect()}
    assert got == {("a", 0): "cold and cough", ("a", 1): "cold and hack", ("a", 2): "cold and bark", ("a", 3): "flu and cough", ("a", 4): "about cold and cough?", ("b", 0): "none", ("b", 1): "about none?", ("c", 0): "", ("c", 1): "about ?", ("d", 0): None}


def test_merged_names_keep_the_first_place(spark):
    hits = spark.createDataFrame([("q", "Cold", 1.0, 1)], "query_id string, name string, score double, rank int")
    more = spark.createDataFrame([("q", 2, "flu", 0.5, 1), ("q", 1, "cold", 1.0, 1), ("q", 1, "FLU", 0.4, 2)], "query_id string, place int, name string, score double, rank int")
    assert [(r.place, r.name, r["rank"]) for r in search.with_variants(hits, more).orderBy("rank").collect()] == [(0, "Cold", 1), (1, "FLU", 2)]


def test_golden_set_deals_what_a_type_lacks(spark):
    rows = [("a", "few", "x"), ("a", "few", "y")] + [(f"s{k}", "many", f"t{j}") for k in range(30) for j in range(7)] + [(f"s{k}", "more", "t") for k in range(30)] + [("z", "untold", "t")]
    edges = spark.createDataFrame(rows, "src string, type string, dst string")
    got = search.golden_set(edges, {"few": "{src}?", "many": "m {src}", "more": "o {src}"}, 21).collect()
    assert sorted(r.type for r in got) == ["few"] + ["many"] * 10 + ["more"] * 10
    assert {r.expected for r in got if r.type == "many"} == {"t0,t1,t2,t3,t4"} and {r.n_answers for r in got if r.type == "many"} == {7}
    again = search.golden_set(edges.repartition(3), {"few": "{src}?", "many": "m {src}", "more": "o {src}"}, 21).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got)) != sorted(map(tuple, search.golden_set(edges, {"few": "{src}?", "many": "m {src}", "more": "o {src}"}, 21, seed=2).collect()))
    assert search.golden_set(edges.limit(0), {"few": "{src}?"}, 5).collect() == []
