import random

from pyspark.sql import functions as F

from loomspark.operators import fusion, relations


def test_alignment_equals_brute_force(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choices("ab c", k=n))
    phrases = list({w: (w, f"R{k % 5}", k % 3) for k, w in enumerate(word(rnd.randrange(1, 7)) for _ in range(30))}.values())
    texts = [word(rnd.randrange(0, 9)) for _ in range(120)] + ["zzz", "", " ", " ab ", None]
    got = dict(map(tuple, relations.align(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(phrases, "phrase string, relation string, ord int")).collect()))
    assert set(got) == set(texts) - {None}
    for text, relation in got.items():
        bare = text.strip(" ")
        fits = [(-len(p), o, r) for p, r, o in phrases if p in bare or bare in p]
        assert relation == (min(fits)[2] if fits else bare), text


def test_fusion_keeps_what_the_ontology_allows(spark):
    entities = spark.createDataFrame([("Flu", "Disease"), ("influenza", "Disease"), ("fever", "Symptom"), ("ACE", "Drug")], "name string, type string")
    rels = spark.createDataFrame([("Influenza", None, "fever", None, " shows often "), ("ACE", "Drug", "Flu", "Disease", "treats"), ("flu2", None, "fever", None, "shows"), ("fever", "Symptom", "Flu", "Disease", "shows"), ("ACE", "Drug", "fever", None, "x")], "source string, source_type string, target string, target_type string, type string")
    out = relations.fuse(
        entities, rels, spark.createDataFrame([("ACE", "enzyme")], "abbr string, canonical string"), spark.createDataFrame([("influenza", "Disease", "Flu")], "synonym string, entity_type string, canonical string"),
        spark.createDataFrame([("shows", "HAS_SYMPTOM", 0), ("treats", "TREATS", 1)], "phrase string, relation string, ord int"), spark.createDataFrame([("Disease", "HAS_SYMPTOM", "Symptom"), ("Drug", "TREATS", None)], "src_type string, relation string, dst_type string"))
    assert sorted(map(tuple, out.collect())) == [("Flu", "fever", "HAS_SYMPTOM"), ("enzyme", "Flu", "TREATS")]


def test_valid_relations_do_not_meet_by_type(spark):
    """All relations of one kind don't meet in one task (F10): a small ontology is broadcast, so they aren't dealt by type."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        relations = spark.range(1000).select("id", F.lit("A").alias("src_type"), F.lit("to").alias("relation"), F.when(F.col("id") % 2 == 0, "B").alias("dst_type"))
        ontology = spark.createDataFrame([("A", "to", "B"), ("A", "to", None)], "src_type string, relation string, dst_type string")
        found = fusion.valid_relations(relations, ontology)
        assert found.count() == 500
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert fusion.valid_relations(relations, ontology, 1).count() == 500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
