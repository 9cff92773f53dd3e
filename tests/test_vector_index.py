import math
import random

import pytest

from loomspark import catalog, catalog_more  # noqa: F401  (the second adds its queries to the first)
from loomspark.operators import vector_index


def brute(vectors, queries, k):
    unit = lambda v: None if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) else [x / math.hypot(*v) for x in v]
    units = {i: unit(v) for i, v in vectors}
    out = {}
    for q, v in queries:
        u = unit(v)
        if u:
            scored = sorted((-round(sum(a * b for a, b in zip(u, w)), 6), i) for i, w in units.items() if w)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    made = [[x + rnd.gauss(0, 0.3) for x in rnd.choice(centres)] for _ in range(500)]
    odd = [None, [], [0.0] * 6, [float("nan"), *[1.0] * 5], [float("inf"), *[1.0] * 5], [1e200] * 6, made[0], made[0]]
    return list(enumerate([*made, *odd]))


@pytest.mark.parametrize("cells,fit_rows", [(None, 200_000), (1, 200_000), (12, 50)])
def test_exact_search_equals_brute_force(spark, vectors, cells, fit_rows):
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    index = vector_index.build_vector_index(df, cells=cells, fit_rows=fit_rows)
    assert index.cells.agg({"n": "sum"}).first()[0] == 503
    queries = [(i, v) for i, v in vectors if i % 9 == 0 or i >= 500]
    for k in (1, 7, 600):
        got = {}
        for r in vector_index.search_vectors(index, spark.createDataFrame(queries, "query_id bigint, vector array<double>"), k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.similarity))
        want = brute(vectors, queries, k)
        assert set(got) == set(want)
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)
    index.drop()


def test_recall_of_probes(spark, sf_dir):
    exact = {(r.query_id, r.id) for r in catalog.QUERIES["v03_index_exact"](spark, sf_dir).collect()}
    found = {(r.query_id, r.id) for r in catalog.QUERIES["v03_index_probes"](spark, sf_dir).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    index = vector_index.build_vector_index(none)
    assert index.cells.count() == 0 and vector_index.search_vectors(index, spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>")).count() == 0


def test_blocks_of_members_and_queries_lose_nothing(spark, monkeypatch):
    """Cells and queries of many blocks (F8, F9) give what one block gives, ties by id among them."""
    rows = [(k, [float(k % 5), float(k % 7) - 3.0, 1.0]) for k in range(140)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = vectors.where("vec_id % 9 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    index = vector_index.build_vector_index(vectors, cells=3)
    monkeypatch.setattr(vector_index, "BLOCK_MEMBERS", 11)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 5)
    found = sorted(map(tuple, vector_index.search_vectors(index, asked, 6).select("query_id", "rank", "id").collect()))
    unit = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, v in rows}
    brute = lambda q: sorted(unit, key=lambda i: (-round(sum(x * y for x, y in zip(unit[q], unit[i])), 6), i))[:6]
    assert found == sorted((q, r + 1, i) for q in unit if q % 9 == 0 for r, i in enumerate(brute(q)))
