"""The index keys are counted in parts, so that no shuffle holds them all; the parts together are the whole."""

from loomspark.llm import jaccard


def test_keys_meet_in_parts(spark, monkeypatch):
    texts = [" ".join(f"w{k * 97 + j * (1 + (k % 3 == 0))}" for j in range(60)) for k in range(40)]
    texts += [texts[4] + " more", texts[7], texts[7]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen, shared = [], jaccard._shared

    def watched(keyed):
        seen.append([{(r.key, r.id) for r in part.collect()} for part in (keyed if isinstance(keyed, list) else [keyed])])
        return shared(keyed)

    monkeypatch.setattr(jaccard, "_shared", watched)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {k: {40: 4, 41: 7, 42: 7}.get(k, k) for k in range(43)}
    parts = seen[0]
    whole = set().union(*parts)
    assert sum(map(len, parts)) == len(whole) and {i for _, i in whole} == set(range(41))
    assert max(map(len, parts)) < len(whole) / 2
