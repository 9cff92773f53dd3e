import random
from collections import defaultdict

import pytest

from loomspark.operators import graph


def brute_trails(edges, start, depth):
    near = defaultdict(list)
    for e, a, b in edges:
        near[a].append((e, b))
        if a != b:
            near[b].append((e, a))
    found, here = [], [((start,), ())]
    for _ in range(depth):
        here = [((*path, b), (*used, e)) for path, used in here for e, b in near[path[-1]] if e not in used]
        found += here
    return sorted(",".join(path) for path, _ in found)


@pytest.mark.parametrize("most", [200_000, 0])
def test_expand_equals_brute_force_and_picks_edges_by_their_ends(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", most, raising=False)
    rnd = random.Random(3)
    edges = [(f"e{k}", f"x{rnd.randrange(9)}", f"x{rnd.randrange(9)}") for k in range(16)]
    table = spark.createDataFrame([(*e, "T") for e in edges], "edge_id string, src string, dst string, type string").distinct()
    seeds = spark.createDataFrame([("x1",)], "node_id string")
    found = graph.expand(table, seeds, 3)
    want = brute_trails(edges, "x1", 3)
    assert sorted(",".join(r.path) for r in found.collect()) == want
    assert ("LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()) == (most > 0)
    ending = [p for p in want if p.endswith("x5")]
    assert sorted(",".join(r.path) for r in graph.expand(table, seeds, 3, target="x5").collect()) == ending
    assert [r.path for r in graph.find_paths(table, seeds, "x5").collect()] == sorted(ending, key=lambda p: (p.count(","), p))[:5]
