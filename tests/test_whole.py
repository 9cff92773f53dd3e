"""Queries and operators do the whole job: nothing is cut, filtered or sampled on the way."""

import datetime as dt
import random
import re
from collections import Counter

import pytest

from loomspark import catalog
from loomspark.operators import graph, quality, rollup, text
from loomspark.plans import model
from loomspark.streaming import state


def put(spark, folder, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def brute_lcs(a, b):
    last = [0] * (len(b) + 1)
    for w in a:
        here = [0]
        for k, v in enumerate(b):
            here.append(last[k] + 1 if v == w else max(last[k + 1], here[k]))
        last = here
    return last[-1]


def test_every_document_is_scored_whole(spark, tmp_path):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(n))
    items = [(k, words(12)) for k in (3, 5, 9)]
    docs = [(k, words(200) + " " + items[k % 3][1]) for k in range(10)] + [(10, items[1][1]), (11, "")]
    d = put(spark, tmp_path, documents=(docs, "doc_id bigint, text string"), benchmark=(items, "item_id bigint, text string"))
    got = {n: {r[0]: r[1] for r in catalog.QUERIES[n](spark, d).collect()} for n in ("e01_exact_match", "e02_token_f1", "e04_rouge_2", "e03_bleu", "e05_rouge_l")}
    for i, text in docs:
        p, r = text.split(), items[i % 3][1].split()
        grams = lambda w, n: Counter(zip(*(w[k:] for k in range(n))))
        lcs = brute_lcs(p, r)
        assert got["e01_exact_match"][i] == (text == items[i % 3][1])
        assert got["e02_token_f1"][i] == pytest.approx(2 * (grams(p, 1) & grams(r, 1)).total() / (len(p) + len(r)), abs=1e-6)
        assert got["e04_rouge_2"][i] == pytest.approx((grams(p, 2) & grams(r, 2)).total() / (len(r) - 1), abs=1e-6)
        assert got["e05_rouge_l"][i] == pytest.approx(2 * lcs / (len(p) + len(r)), abs=1e-6)
        assert (got["e03_bleu"][i] > 0) == bool(p)
    assert all(len(x) == len(docs) for x in got.values())


def test_rouge_l_rows_equal_the_table(spark):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choices("abcdefg", k=rng.randrange(150))), " ".join(rng.choices("abcdefg", k=rng.randrange(1, 150)))) for i in range(40)]
    got = dict(tuple(r) for r in quality.rouge_l(spark.createDataFrame(data, "id int, prediction string, reference string")).collect())
    for i, p, r in data:
        p, r = p.split(), r.split()
        assert got[i] == pytest.approx(2 * brute_lcs(p, r) / (len(p) + len(r)), abs=1e-6)


def test_abbreviations_of_accented_texts(spark, tmp_path):
    texts = ["Die EU und ÜBER die Straße, vgl. DIN.", "l'ÉTAT, la SNCF et l'UE", "plain HTN text", "USAñ ñEU EU_X EU2 NATO", "ABCDEF", ""]
    d = put(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id bigint, text string"))
    got = sorted((r.id, r.abbr) for r in catalog.QUERIES["n02_abbreviations"](spark, d).collect())
    assert got == sorted((i, a) for i, t in enumerate(texts) for a in set(re.findall(r"\b[A-Z]{2,5}\b", t)))
    assert {a for _, a in got} == {"EU", "DIN", "SNCF", "UE", "HTN", "NATO"}


def test_context_holds_whole_neighbours(spark):
    chunks = spark.createDataFrame([(f"1_{k}", 1, k, f"{k}" * 500) for k in range(12)] + [("2_0", 2, 0, "alone " * 80)], "chunk_id string, document_id int, chunk_index int, content string")
    got = {r.chunk_id: r.context for r in text.chunk_context(chunks).collect()}
    assert [(c.chunk_index, c.content, c.is_target) for c in got["1_10"]] == [(k, f"{k}" * 500, k == 10) for k in (9, 10, 11)]
    assert [c.content for c in got["2_0"]] == ["alone " * 80]
    wide = {r.chunk_id: r.context for r in text.chunk_context(chunks, 2).collect()}
    assert [c.chunk_index for c in wide["1_0"]] == [0, 1, 2]


def brute_history(turns, keep=4, longest=50):
    old, kept = turns[:-keep], turns[-keep:]
    parts, pairs, i = [], 0, 0
    while i < len(old):
        role, said = old[i]
        i += 1
        if role != "user":
            continue
        answer = ""
        if i < len(old) and old[i][0] == "assistant":
            answer, pairs, i = old[i][1][:longest], pairs + 1, i + 1
        if said:
            parts += [f"问: {said[:longest]}"] + ([f"答: {answer}"] if answer else [])
    return len(old), pairs, "[对话摘要] " + "；".join(parts) if parts else None, kept


def test_history_is_summed_up_and_kept(spark):
    rng = random.Random(3)
    talks = {c: [(rng.choice(["user", "assistant", "system"]), rng.choice(["", "short", "long words " * 9])) for _ in range(rng.randrange(1, 14))] for c in range(60)}
    talks[60] = [("user", "q"), ("assistant", "a"), ("user", "q2"), ("assistant", "kept"), ("user", "x"), ("assistant", "y"), ("user", "z")]
    df = spark.createDataFrame([(c, k, *turn) for c, turns in talks.items() for k, turn in enumerate(turns)], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: (r.n_old, r.n_pairs, r.summary, [(k.role, k.text) for k in r.kept]) for r in text.history_summary(df).collect()}
    assert got == {c: brute_history(turns) for c, turns in talks.items()}
    assert got[60][1] == 1


def test_prometheus_has_a_line_for_each_bucket(spark, sf_dir):
    lines = [r.line for r in catalog.QUERIES["s22_prometheus"](spark, sf_dir).collect()]
    assert len(lines) == len(set(lines)) == 5 * (len(rollup.BUCKETS) + 1)


def test_communities_settle(spark):
    pairs = [(f"p{k:02}", f"p{k + 1:02}") for k in range(40)] + [(f"x{a}", f"y{b}") for a in range(3) for b in range(3)]
    g = spark.createDataFrame([(*sorted(p), 1) for p in pairs], "u string, v string, weight bigint")
    label = {r.node: r.community for r in graph.communities(g).collect()}
    assert set(label) == {n for p in pairs for n in p}
    for n in label:
        votes = Counter(label[b if a == n else a] for a, b in pairs if n in (a, b))
        assert votes[label[n]] == max(votes.values())
    with pytest.raises(RuntimeError):
        graph.communities(g, rounds=1)


def test_communities_of_a_hub_and_of_no_edges(spark):
    g = spark.createDataFrame([("hub", f"leaf{k:03}", 1) for k in range(200)], "u string, v string, weight bigint")
    rows = graph.communities(g, rounds=10).collect()
    assert len(rows) == 201 and len({r.community for r in rows}) == 1
    assert graph.communities(g.limit(0)).collect() == []


def test_two_cliques_contract_to_one_edge(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 3) for c in "ab" for i in range(5) for j in range(i + 1, 5)]
    g = spark.createDataFrame([*cliques, ("a0", "b0", 1), ("a1", "b1", 2)], "u string, v string, weight bigint")
    parts = graph.communities(g)
    found = {r.node: r.community for r in parts.collect()}
    assert {n[0] for n in found} == {"a", "b"} and len({(n[0], c) for n, c in found.items()}) == len(set(found.values())) == 2
    assert [r.weight for r in graph.contracted(g, parts).collect()] == [3]


def test_detected_communities_of_all_edges(spark, sf_dir):
    parts = catalog.QUERIES["g02_communities"](spark, sf_dir).cache()
    g = graph.simple_graph(model.edges(spark, sf_dir)).cache()
    label = {r.node: r.community for r in parts.collect()}
    edges = g.collect()
    assert set(label) == {n for e in edges for n in (e.u, e.v)} and any(n[0] == "P" for n in label)
    cross = Counter()
    for e in edges:
        if label[e.u] != label[e.v]:
            cross[tuple(sorted((label[e.u], label[e.v])))] += e.weight
    assert {(r.u, r.v): r.weight for r in catalog.QUERIES["g03_contracted"](spark, sf_dir).collect()} == cross
    sizes = Counter(label.values())
    assert [(r.community, r["size"]) for r in catalog.QUERIES["a06_community_sizes"](spark, sf_dir).collect()] == sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:3]


def test_rate_limit_carries_over_batches(spark):
    base, old = dt.datetime(2024, 1, 1), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    data = [("hot" if k % 3 else f"k{k % 5}", base + dt.timedelta(seconds=k)) for k in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = state.rate_limit_batch(spark.createDataFrame(data, "key string, ts timestamp"), 2, 60.0)
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    for key in {k for k, _ in data}:
        times = sorted(t for k, t in data if k == key)
        want += zip([key] * len(times), times, state.decide([t.timestamp() for t in times], [], 2, 60.0)[0])
    assert got == sorted(want)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()


def test_quantiles_and_sizes_leave_no_single_task(spark):
    rng = random.Random(4)
    data = [(g, None if rng.random() < 0.1 else float(rng.choice([7, rng.randrange(1000)]))) for g in ("a", "b", None) for _ in range(500)] + [("one", 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r["quantile"] for r in rollup.indexed_quantile(df, "k", "v", q).collect()}
        for g in ("a", "b", None, "one"):
            values = sorted(v for k, v in data if k == g and v is not None)
            assert got[g] == values[min(int(len(values) * q), len(values) - 1)]
    nodes = spark.createDataFrame([("a", 3), ("b", 0)], "node_id string, degree bigint")
    sized = graph.node_sizes(nodes)
    assert {r.node_id: r["size"] for r in sized.collect()} == {"a": 60.0, "b": 20.0}
    assert "Window" not in sized._jdf.queryExecution().toString()


def test_types_and_inner_edges_are_told_from_keys(spark, sf_dir):
    """what the keys tell equals what all edges with their names tell."""
    from loomspark.operators import graph
    from loomspark.plans import model

    nodes, edges = model.nodes(spark, sf_dir), model.edges(spark, sf_dir)
    known = nodes.select("node_id")
    whole = edges.join(known.withColumnRenamed("node_id", "src"), "src", "left_semi").join(known.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    assert sorted(map(tuple, model.edge_types(spark, sf_dir).collect())) == sorted(map(tuple, whole.select("type").distinct().collect()))
    page, inside = graph.top_page(nodes, edges, 120, 3)
    told = graph.top_page(nodes, edges, 120, 3, lambda page: model.inner_edges(spark, sf_dir, page))[1]
    columns = ["edge_id", "src", "dst", "type"]
    rows = sorted(map(tuple, told.select(*columns).collect()))
    assert rows and rows == sorted(map(tuple, inside.select(*columns).collect()))


def test_fusion_by_joined_texts_and_without_any(spark, monkeypatch):
    """many relation texts are joined, few are literals, and none give no rows."""
    from loomspark.operators import relations

    put = spark.createDataFrame
    entities = put([("a", "X"), ("b", "Y"), ("c", "Y")], "name string, type string")
    links = put([("a", "X", "b", "Y", "helps b"), ("a", "X", "c", None, "hurts"), ("a", "X", "z", "Y", "helps b")], "source string, source_type string, target string, target_type string, type string")
    none, synonyms = put([], "abbr string, canonical string"), put([("A", "X", "alpha"), ("C", "Y", "gamma")], "synonym string, entity_type string, canonical string")
    phrases = put([("helps", "HELPS", 0), ("hurts", "HURTS", 1)], "phrase string, relation string, ord int")
    rules = lambda *names: put([("X", n, None) for n in names], "src_type string, relation string, dst_type string")
    fused = lambda *names: sorted(map(tuple, relations.fuse(entities, links, none, synonyms, phrases, rules(*names), target_type="Y").collect()))
    want = [("alpha", "b", "HELPS"), ("alpha", "gamma", "HURTS")]
    assert fused("HELPS", "HURTS") == want and fused("OTHER") == []
    monkeypatch.setattr(relations, "FEW_TEXTS", 0)
    assert fused("HELPS", "HURTS") == want


def test_rouge_frames_are_bounded():
    """a task makes ROWS texts of a batch into strings at a time and hands their results on."""
    import pyarrow as pa

    from loomspark.operators import quality

    batch = pa.RecordBatch.from_pydict({"id": list(range(600)), "p": ["a b"] * 599 + [None], "r": ["b"] * 600})
    frames = list(quality._told(lambda p, r: [len(p), len(r)])([batch]))
    assert [f.num_rows for f in frames] == [256, 256, 88]
    assert pa.Table.from_batches(frames)["m"].to_pylist() == [[2, 1]] * 599 + [[0, 1]]
