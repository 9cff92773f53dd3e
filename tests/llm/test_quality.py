import re

import numpy as np

from loomspark.llm.quality import FEATURES, fit, quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    gone = {i + j for i, t in enumerate(threes) if threes.count(t) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(gone)


def test_statistics_and_verdict(spark):
    clean = "\n".join(f"sentence {k} about word{k} and thing{k * 7} done." for k in range(12))
    rows = [(0, clean), (1, None), (2, ""), (3, " \n "), (4, "a b c " * 30), (5, clean + "\n" + clean), (6, "é€ #x\n#x\n#x " + clean), (None, clean), (0, clean), (7, "w" * 100_000)]
    docs = spark.createDataFrame([(i, t, "n", 5) for i, t in rows], "doc_id bigint, text string, lang string, n_words int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality_rules(docs, labels).collect()
    assert len(got) == len(rows) and got[0].lang == "n"
    want = sorted((-1 if i is None else i, *brute(t)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed) for r in got)
    assert quality_rules(docs.limit(0), labels).collect() == []


def test_trees_learn_and_stay_monotonic():
    rnd = np.random.default_rng(1)
    x = rnd.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.02 * rnd.standard_normal(3000)) < 0.6).astype(float)
    trees = fit(x[:2000], y[:2000], [-1, 0, 0])
    assert ((trees.score(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    grid = np.linspace(0, 1, 101)
    for other in rnd.random((30, 2)):
        s = trees.score(np.column_stack([grid, np.tile(other, (101, 1))]))
        assert (np.diff(s) <= 1e-12).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality_rules(docs, train).join(test.select("doc_id", "quality"), "doc_id").where("not base_failed").toPandas()
    assert ((got.score >= 0) == (got.quality > 0)).mean() > 0.95
    assert len(FEATURES) == 10
