import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from loomspark.llm import queries
from loomspark.llm.divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, ranks):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = {s: c for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        whole = share(sum(mine.values(), Counter()))
        p = {s: share(c) for s, c in mine.items()}
        for s in mine:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s))
            term = sorted((whole[t] - p[s][t], t.encode(), t) for t in kept if mine[s][t] and p[s][t] > whole[t])[:ranks]
            for part, found in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, i, -v, k + 1) for k, (v, _, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("least,ranks,broadcast", [(3, 4, 10), (1, 50, 0), (500, 5, 10)])
def test_rows_equal_brute_force(spark, least, ranks, broadcast):
    rnd = random.Random(least)
    words = ["the", "The", "ÉTÉ", "été", "ab1cd", "x_y", "日本", "z" * 400, "a", "b-c", "über"]
    rows = [(rnd.choice(["en", "fr", None, "EN"]), rnd.choice(["s1", "s2", "s3", "", None, "é"]), " ".join(rnd.choices(words, k=rnd.randrange(30)))) for _ in range(150)]
    rows += [("de", "only", None), ("de", "two", ""), ("xx", "alone", "the a b"), *[("en", "s1", "hot hot")] * 60]
    got = source_divergence(spark.createDataFrame(rows, "lang string, source string, text string").withColumnRenamed("text", "Text").selectExpr("*", "1 AS value", "2 AS rank"), least, ranks, broadcast_rows=broadcast)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, ranks)


def test_no_rows(spark):
    assert source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_the_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    got = queries.op12_source_divergence(spark, sf_dir)
    want = con.sql(queries.ORACLES["op12_source_divergence"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
