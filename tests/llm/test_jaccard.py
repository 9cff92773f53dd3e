import random
import re

import pytest

from loomspark.llm.jaccard import jaccard_components


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, s) in enumerate(sets):
        for j, o in sets[:k]:
            if i is not None and j is not None and s and o and den * len(s & o) >= num * len(s | o):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sorted((-1 if i is None else i, len(s), None if i is None else root(i)) for i, s in sets)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = rnd.choices(vocabulary, k=60)
    rows = []
    for i in range(n):
        kind = rnd.random()
        if rows and kind < 0.55:
            words = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                if words:
                    k = rnd.randrange(len(words))
                    words[k : k + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [words[k].upper()], rnd.choices(vocabulary, k=2)])
        else:
            words = rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 3, 4, 5, 7, 9, 12, 20, 40, 80, 200, 500]))
            if rnd.random() < 0.4:
                words = words[: len(words) // 5] + common
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(n, None), (n + 1, " \n"), (None, rows[0][1]), (5, rows[40][1]), (7, rows[7][1])]


@pytest.mark.parametrize(("width", "num", "den", "hot"), [(4, 85, 100, 4), (5, 80, 100, 1), (1, 60, 100, 1)])
def test_matches_brute_force(spark, width, num, den, hot):
    rows = corpus(width, 400)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, id string, key int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, width=width, num=num, den=den, hot_members=hot, broadcast_rows=hot).collect())
    assert got == brute(rows, width, num, den)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
