"""The index counts a text's words where the text is read: the counts are right in runs of any size, and nothing is shuffled or sampled for them."""

from loomspark.operators import fulltext


def test_counts_are_right_and_shuffled_once(spark, monkeypatch):
    plans, cut = [], fulltext._cut
    monkeypatch.setattr(fulltext, "_cut", lambda df, *by: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, *by))
    monkeypatch.setattr(fulltext, "COUNTED_WORDS", 5)
    texts = [("t0", "A b a ÉÉ éé a"), ("t1", None), ("t2", ""), ("t3", "b b c1 " * 4), ("t4", "x"), ("t5", "!?")]
    index = fulltext.build_index(spark.createDataFrame(texts, "k string, text string").coalesce(1), "k", "text")
    assert "Aggregate" not in plans[0] and plans[0].count("RepartitionByExpression") == 1
    mean = (6 + 12 + 1) / 6
    want = {("t0", "a", 3, 6), ("t0", "b", 1, 6), ("t0", "éé", 2, 6), ("t3", "b", 8, 12), ("t3", "c1", 4, 12), ("t4", "x", 1, 1)}
    got = {(r.id, r.term, round(r.impact, 9)) for r in index.postings.collect()}
    assert got == {(i, t, round(tf / (tf + 1.2 * (0.25 + 0.75 * n / mean)), 9)) for i, t, tf, n in want}
    index.drop()
