"""F1 to F5: a search over lists reads its graph once, edges meet in packed blocks, and it ends with what the contracted graph and the modularity are made of."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark import catalog
from loomspark.operators import community, graph
from loomspark.plans import model

rows = lambda df: sorted(map(tuple, df.collect()))


def test_a_graph_with_repeats_is_read_once(spark, monkeypatch):
    rnd = random.Random(3)
    pairs = {tuple(sorted(rnd.sample([f"{c}{k}" for k in range(6)], 2))) for c in "abc" for _ in range(14)} | {("a0", "b0"), ("b1", "c1")}
    plain = spark.createDataFrame([(*e, 1) for e in pairs], "u string, v string, weight long")
    repeated = spark.createDataFrame([e for e in pairs for _ in range(rnd.randint(1, 3))], "u string, v string").repartition(5)
    names = spark.createDataFrame([(n,) for n in sorted({n for e in pairs for n in e} | {"z"})], "name string")
    tables, cut = [], community._cut
    monkeypatch.setattr(community, "_cut", lambda df, *by: tables.append(df.columns) or cut(df, *by))
    monkeypatch.setattr(community, "LIST_ENDS", 5)  # several blocks of a task, and several tasks
    monkeypatch.setattr(community, "PIECE_ENDS", 3)
    levels, between, value = community.contracted_levels(repeated, least_gain=0.001, names=names, several=True, count=50)
    assert [c for c in tables if c[0] in ("name", "node")][:2] == [["name", "node"], ["node", "place", "near", "w"]] and tables.index(["u", "v", "w"]) > 1  # no table of edges before the lists
    want = community.community_levels(plain, least_gain=0.001)
    assert rows(levels) == rows(want) and "z" not in {r.node for r in levels.collect()}
    top = community.top_level(want)
    assert rows(between) == rows(graph.contracted(plain, top)) and value == pytest.approx(graph.modularity(plain, top).first()[0])
    by_joins = community.contracted_levels(repeated, least_gain=0.001, list_nodes=0, names=names, several=True)
    assert rows(by_joins[0]) == rows(want) and rows(by_joins[1]) == rows(between) and by_joins[2] == pytest.approx(value)


def test_hosts_are_asked_only_where_it_matters(spark, monkeypatch):
    asked, told = [], community._Lists.told
    monkeypatch.setattr(community._Lists, "told", lambda self, arrays, *how: asked.append(arrays.get("guests")) or told(self, arrays, *how))
    graph_ = spark.createDataFrame([(f"a{k}", f"a{j}", 1) for j in range(9) for k in range(j)], "u string, v string, weight long")
    trace = []
    community.community_levels(graph_, trace=trace)
    assert asked.count(True) == len(trace) and asked.count(False) < len(trace)


def test_packed_rows_come_back():
    x = np.array([3, 1, 2, 9], np.int32)
    packed = community._packed(np.array([0, 1, 1, 4]), x)
    assert community._flat(packed, np.int32).tolist() == x.tolist() and community._flat(packed.slice(1), np.int32).tolist() == [1, 2, 9] and community._sizes(packed).tolist() == [1, 0, 3]
    assert community._weights(community._packed(np.array([0, 1, 1, 4]), None), packed).tolist() == [1.0] * 4


def test_queries_equal_the_operators_on_the_found_partition(spark, sf_dir):
    top = graph._cut(catalog.QUERIES["g02_communities"](spark, sf_dir))
    edges = model.simple_edges(spark, sf_dir)
    assert rows(catalog.QUERIES["g03_contracted"](spark, sf_dir)) == rows(graph.contracted(edges, top))
    assert catalog.QUERIES["g04_modularity"](spark, sf_dir).first()[0] == graph.modularity(edges, top).select(F.round("modularity", 6)).first()[0]
    assert rows(model.unsummed_edges(spark, sf_dir).distinct()) == rows(edges.select("u", "v"))
