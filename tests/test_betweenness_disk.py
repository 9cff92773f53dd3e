"""what betweenness writes grows with the edges alone, however many sources there are."""

import random

from pyspark.sql import functions as F

from loomspark import catalog
from loomspark.operators import community
from loomspark.plans import model

rows = lambda df: {r.node: (r.community, round(r.betweenness, 9), round(r.degree, 9)) for r in df.collect()}


def test_no_edge_is_written_for_each_group_of_sources(spark, monkeypatch):
    rnd, packed = random.Random(5), []
    edges = list({tuple(sorted(rnd.sample([f"x{k}" for k in range(30)], 2))) for _ in range(60)}) + [("y0", "y1"), ("y1", "y2"), ("z0", "z1"), ("z1", "z2"), ("z2", "z3")]
    graph = spark.createDataFrame(edges, "u string, v string")
    part = spark.createDataFrame([(n, n[0]) for n in sorted({n for e in edges for n in e})], "node string, community string")
    want, cut = rows(community.betweenness(graph, part)), community._cut
    monkeypatch.setattr(community, "TASK_STEPS", 15)  # x and z are large, y is one task's
    monkeypatch.setattr(community, "_cut", lambda df, *by: packed.append(df) or cut(df, *by))
    for local_ends in (1000, 150):  # in one broadcast and in two
        packed.clear()
        assert rows(community.betweenness(graph, part, local_ends=local_ends)) == want
        assert not any("block" in df.columns for df in packed)
        assert sum("near" in df.columns for df in packed) == 1


def test_the_query_equals_the_operator_on_the_first_level(spark, sf_dir):
    edges = model.simple_edges(spark, sf_dir)
    first = community.community_levels(edges.withColumn("weight", F.lit(1)), most_levels=1).select("node", "community")
    assert rows(catalog.QUERIES["g05_betweenness"](spark, sf_dir)) == rows(community.betweenness(edges, first))
    how = {"names": model.edge_ends(spark, sf_dir)[0], "several": True}
    assert rows(community.level_betweenness(model.unsummed_edges(spark, sf_dir), list_nodes=0, **how)) == rows(community.betweenness(edges, first))
