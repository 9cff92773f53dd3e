import collections
import random
import re

from loomspark.llm.lines import dedup_lines
from loomspark.llm.passages import remove_repeats


def test_lines_match_brute_force(spark):
    rnd = random.Random(3)
    pool = [f"Line number {k} of the pool é" for k in range(12)] + ["short", "", "\t", "  LINE number 3 of the pool É  ", "LINE NUMBER 3 OF THE POOL é\x0b"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randrange(0, 9)))) for i in range(60)] + [(60, None), (61, ""), (None, pool[0]), (7, pool[1] + "\n" + pool[2]), (3, "x" * 200_000 + "\n" + pool[4])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n_lines int, hash string")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\f\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(low(line)) >= 20:
                held[low(line)].add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(low(x), ())) < 3 or max(held[low(x)]) == i]
        want.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept), "x"))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text, r.hash) for r in dedup_lines(docs).collect()]
    assert sorted(got) == sorted(want)
    assert dedup_lines(docs.limit(0)).collect() == []
    salted = dedup_lines(docs, broadcast_rows=0).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text, r.hash) for r in salted) == sorted(want)


def test_lines_with_clashing_names(spark):
    rows = [(k, "One line that all of them share\nown " + str(k), "a", "b", "c", "d", "e") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _id string, drop string, N_Lines string, mark string, `a.b` string")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "_id", "drop", "mark", "a.b", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == [(k, f"own {k}" if k < 3 else rows[3][1], "a", "b", "d", "e", 2, int(k < 3)) for k in range(4)]
    long = "\n".join(["One line that all of them share"] * 30_000 + ["y"] * 100_000)
    kept = {r.doc_id: r for r in dedup_lines(docs.select("doc_id", "text").union(spark.createDataFrame([(2, long)], "doc_id int, text string"))).collect() if r.n_lines > 2}
    assert kept[2].n_dropped == 30_000 and kept[2].text == "\n".join(["y"] * 100_000)


def brute_repeats(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_repeats_match_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdeé") + str(rnd.randrange(300))
    passages = [[word() for _ in range(rnd.randrange(20, 90))] for _ in range(8)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randrange(0, 5)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 2)
            parts += rnd.choice([[word() for _ in range(rnd.randrange(40))], p, p[a:], p[: len(p) - a], p[:3] * 15])
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(120, None), (121, ""), (None, rows[5][1]), (4, rows[9][1]), (122, "z " * 50), (124, "y " * 100_000 + "end"), (123, " ".join("ab") + " q" * 36)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, shard int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs).collect())
    assert got == brute_repeats(rows, 35)
    assert remove_repeats(docs.limit(0)).collect() == []


def test_repeats_over_many_shards(spark, monkeypatch):
    rnd = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([f"u{rnd.random()}" for _ in range(3000)] + passage[i % 7 : 60 - i % 5] + [f"v{i}"])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in remove_repeats(docs, shard_mb=1).collect())
    assert got == brute_repeats(rows, 35)


def test_crowded_phrases(spark, monkeypatch):
    """A phrase in very many recurring contexts, and a regular pair of words that a polynomial modulo 2 ** 64 can't tell apart."""
    rnd = random.Random(11)
    phrase = [f"p{k}" for k in range(30)]
    contexts = [[f"a{k}_{j}" for j in range(20)] + phrase + [f"b{k}_{j}" for j in range(20)] for k in range(30)]
    morse = ["ab"[bin(k).count("1") % 2] for k in range(2048)]
    rows = [(i, " ".join(rnd.choice(contexts)[rnd.randrange(12) : 70 - rnd.randrange(12)] + [f"u{i}"] + rnd.choice(contexts))) for i in range(80)]
    for k, word in enumerate(["".join(morse), "".join("ba"[c == "b"] for c in morse)]):
        rows.append((100 + k, " ".join([word] + [f"m{j}" for j in range(34)] + [f"end{k}"])))
    got = sorted(tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == brute_repeats(rows, 35)
