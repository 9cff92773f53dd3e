import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import queries
from loomspark.llm.alignment import Block, Encoder, Tokens, align_tokens

ODD = [None, "", " ", "▁", "a ▁b", "<|endoftext|> <s></s>", "\n\n\t x\r\n", "日本語 тест 𝒳𝒴", "é́", "word " * 3000, "x" * 20_000, "a\x00b", "  two  spaces ", "ñandú über ÇA"]


@pytest.fixture(scope="module")
def tokens():
    return Tokens()


def brute(tokens, texts):
    """Tokens, spans, overlaps and counts by plain loops."""
    a, b = tokens.load()
    found, counts = [], Counter()
    for text in texts:
        want = b" " + (text or "").encode()
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        if not text or b"".join(tokens.spelt_a[i] for i in x) != want or b"".join(tokens.spelt_b[i] for i in y) != want:
            found.append(([], [], [], []))
            continue
        spans = []
        for ids, spelt in ((x, tokens.spelt_a), (y, tokens.spelt_b)):
            at, here = 0, []
            for i in ids:
                here.append((at, at + len(spelt[i]), i))
                at += len(spelt[i])
            spans.append(here)
        links, lo = [], 0
        for s, e, i in spans[0]:
            while spans[1][lo][1] <= s:
                lo += 1
            k = lo
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, _, i in side if at <= s < end) for side in spans) if len(want) < 3000 else None)
            at = end
        found.append((x, y, links, groups))
        counts.update(links)
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(len(x), len(y), len(g), len(k), None if None in g else ";".join(g), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k)) for x, y, k, g in found]


def texts():
    rnd = random.Random(11)
    return ODD + ["".join(rnd.choices(["th", "e ", "ing", "é", "日", " ", "xq", "ation", "\n", "Ç", "1"], k=rnd.randrange(60))) for _ in range(120)] + ["the same row"] * 7


@pytest.mark.parametrize("frequent", [500_000, 40, 0])
def test_rows_equal_brute_force(spark, tokens, frequent):
    every = texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(every)], "doc_id bigint, text string, n_best string")
    got = {r.doc_id: r for r in align_tokens(docs, frequent=frequent).collect()}
    assert len(got) == len(every)
    for k, want in enumerate(brute(tokens, every)):
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups if want[4] is not None else None, r.n_best, r.count_sum) == want, every[k]


def test_the_query_digests_the_groups(spark, tokens, tmp_path):
    every = texts()
    spark.createDataFrame(list(enumerate(every)), "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.groups_sha256 for r in queries.op11_tokenizer_alignment(spark, str(tmp_path)).collect()}
    for k, want in enumerate(brute(tokens, every)):
        if want[4] is not None:
            assert got[k] == (hashlib.sha256(want[4].encode()).hexdigest() if want[4] else "")


def test_no_rows_null_ids_and_repeats(spark):
    empty = align_tokens(spark.createDataFrame([], "doc_id string, text string"))
    assert empty.count() == 0 and empty.schema["doc_id"].dataType.simpleString() == "string"
    rows = align_tokens(spark.createDataFrame([(None, "a b"), ("1", "a b"), ("1", "a b")], "doc_id string, text string")).collect()
    assert len(rows) == 3 and {r.n_links for r in rows} == {rows[0].n_links} and rows[0].count_sum == 3 * rows[0].n_links


def test_union_find_joins_what_overlaps():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        total = int(rnd.integers(1, 60))
        cut = lambda: np.diff(np.concatenate([[0], np.flatnonzero(rnd.random(total - 1) < rnd.random()) + 1, [total]]))
        a, b = cut(), cut()
        block = Block(np.arange(len(a)), np.arange(len(b)), np.array([len(a)]), np.array([len(b)]), a, b)
        ea, eb = np.cumsum(a), np.cumsum(b)
        both = np.intersect1d(ea, eb)
        of_a, of_b = block.groups()
        assert of_a.tolist() == np.searchsorted(both, ea, "left").tolist() and of_b.tolist() == np.searchsorted(both, eb, "left").tolist()
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if ea[i] - a[i] < eb[j] and eb[j] - b[j] < ea[i]}
        assert set(zip(block.at_a.tolist(), block.at_b.tolist())) == want and len(block.at_a) == len(want)


def test_runs_are_encoded_as_in_the_whole_text(tokens):
    """Cut texts give the ids of whole ones, white space of all kinds and their mixtures included."""
    rnd, encoder = random.Random(7), Encoder(tokens)
    assert tokens.by_run
    odd = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "\ufeff", "'s", "'", "a", "word", "1", "23", "é", "日", "▁", "-", "...", "<s>", "\u0301", "\x00", "𝒳"]
    texts = ["".join(rnd.choices(odd, weights=[30, *[2] * (len(odd) - 1)], k=rnd.randrange(1, 30))) for _ in range(4000)]
    for text, (a, b) in zip(texts, encoder.encode(texts)):
        x, y = encoder.a.encode(" " + text, add_special_tokens=False).ids, encoder.b.encode(text)
        same = all(b"".join(spelt[i] for i in ids) == b" " + text.encode() for spelt, ids in ((tokens.spelt_a, x), (tokens.spelt_b, y)))
        assert (np.frombuffer(a, tokens.dtype).tolist(), np.frombuffer(b, tokens.dtype).tolist()) == ((x, y) if same else ([], [])), repr(text)
