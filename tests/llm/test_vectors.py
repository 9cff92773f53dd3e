import numpy as np

from loomspark.llm.vectors import dealt_tiles, near_vectors


def test_matches_brute_force(spark):
    rnd = np.random.default_rng(7)
    rows = []
    for k in range(700):
        if k > 10 and rnd.random() < 0.5:
            v, label = rows[rnd.integers(len(rows))][1:3]
            v = np.array(v) + (rnd.random() < 0.7) * rnd.standard_normal(64) * rnd.choice([0.02, 0.05])
        else:
            v, label = rnd.standard_normal(64) * np.linspace(2, 0.2, 64), int(rnd.integers(3))
        rows.append((k, [float(np.float32(x)) for x in v], int(label) if rnd.random() < 0.95 else 0))
    odd = [(800, None, 1), (801, [0.0] * 64, 1), (802, [], 1), (803, [float("nan")] + [1.0] * 63, 1), (804, [float("inf")] * 64, 1), (805, rows[0][1], None), (806, [1.0, 0.0], 1), (807, [2.0, 0.0], 1), (808, [None] + [1.0] * 63, 1), (5, rows[9][1], rows[9][2]), (None, rows[9][1], 1)]
    data = rows + odd
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id bigint, embedding array<float>, label int, n_links int")
    got = near_vectors(df, block_rows=64).collect()
    ok = [i is not None and v is not None and label is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for i, v, label in data]
    up = {i: i for i, *_ in data}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(data)
    for a in range(len(data)):
        for b in range(a):
            if ok[a] and ok[b] and data[a][2] == data[b][2] and len(data[a][1]) == len(data[b][1]):
                x, y = np.array(data[a][1]), np.array(data[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    p, q = sorted((root(data[a][0]), root(data[b][0])))
                    up[q] = p
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(key((i, n, None if i is None else root(i), i is not None and root(i) == i)) for (i, *_), n in zip(data, links))
    assert sorted(key((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == want
    assert near_vectors(df.limit(0)).collect() == []


def test_norms_out_of_range(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.1e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1e308, -1e308]), (6, [1e-200] * 8), (7, [3e200] * 8)]
    got = near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5), (6, 1, 6), (7, 1, 6)]


def test_far_blocks_meet_in_no_tile(spark):
    rnd = np.random.default_rng(2)
    turn = np.repeat(np.linspace(0, 3, 8), 40)
    x = np.stack([np.cos(turn), np.sin(turn)], 1) + rnd.standard_normal((320, 2)) * 0.02
    angle = np.arccos(x[:, 0] / np.linalg.norm(x, axis=1))
    rows = [(k, k, k, 1, "2:0", v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, angle))]
    tiles = dealt_tiles(spark.createDataFrame(rows, "h1 bigint, h2 bigint, rep bigint, copies bigint, label string, embedding array<double>, angle double"), 0.93, 16).select("ci", "i", "cj", "j").distinct().count()
    blocks = 8 * 3
    assert 0 < tiles < blocks * (blocks + 1) // 3
    df = spark.createDataFrame([(k, [float(a) for a in v], 0) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.93).sum(1) - 1
    assert [r.n_links for r in sorted(near_vectors(df, block_rows=16).collect())] == want.tolist()
