import math
import random
import re
from collections import Counter

import pytest

from loomspark.operators import fulltext

WORD = re.compile(r"[^\W_]+")


def brute(texts, queries, k):
    docs = {i: Counter(WORD.findall((t or "").lower())) for i, t in texts}
    mean = sum(c.total() for c in docs.values()) / len(docs)
    df = Counter(w for c in docs.values() for w in c)
    out = []
    for qid, query in queries:
        scores = Counter()
        for w in set(WORD.findall(query.lower())):
            for i, c in docs.items():
                if c[w]:
                    scores[i] += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean))
        ranked = sorted((-round(s, 9), i) for i, s in scores.items())[:k]
        out += [(qid, i, -s, r + 1) for r, (s, i) in enumerate(ranked)]
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    pool = [f"w{int(rnd.expovariate(0.08))}" for _ in range(400)] + ["the"] * 200 + ["É", "日本"]
    made = [" ".join(rnd.choices(pool, k=rnd.randrange(1, 80))) for _ in range(300)]
    return list(enumerate([None, "", "the", "the the", "unbroken-substring", "same", "same", "same", *made]))


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_ranks_equal_brute_force(spark, texts, k):
    index = fulltext.build_index(spark.createDataFrame(texts, "id bigint, text string"), "id", "text")
    rnd = random.Random(k)
    queries = [(q, " ".join(rnd.choices(["the", "É", "same", *[f"w{n}" for n in range(60)]], k=rnd.randrange(1, 8)))) for q in range(40)] + [(98, "nowhere"), (99, "")]
    got = sorted(map(tuple, fulltext.search(index, spark.createDataFrame(queries, "query_id bigint, text string"), k).collect()))
    want = sorted(brute(texts, queries, k))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-9)
    index.drop()


def test_queries_without_hits_are_scanned_for(spark, texts):
    df = spark.createDataFrame(texts, "id bigint, text string")
    index = fulltext.build_index(df, "id", "text")
    queries = spark.createDataFrame([(1, "Broken-sub"), (2, "same"), (3, "zzzz"), (4, "nb")], "query_id bigint, text string")
    got = sorted(map(tuple, fulltext.search_or_scan(index, queries, df, "id", "text", 2).select("query_id", "id", "rank").collect()))
    assert got == [(1, 4, 1), (2, 5, 1), (2, 6, 2), (4, 4, 1)]


def test_containing_equals_brute_force(spark):
    rnd = random.Random(6)
    texts = [(k, "".join(rnd.choices("abé ", k=rnd.randrange(30)))) for k in range(200)] + [(200, None), (201, "")]
    for shortest in (1, 2, 3):
        keywords = ["".join(rnd.choices("abé ", k=rnd.randrange(shortest, 6))) for _ in range(60)] + ["", "q" * 5]
        got = sorted(map(tuple, fulltext.containing(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x,) for x in keywords] + [(None,)], "keyword string")).collect()))
        assert got == sorted({(x, k) for x in keywords if x for k, t in texts if t and x in t})
    assert fulltext.containing(spark.createDataFrame([], "id int, text string"), spark.createDataFrame([("a",)], "keyword string")).count() == 0
