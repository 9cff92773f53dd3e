import random
import re

import numpy as np
import pytest

from loomspark.llm import pieces
from loomspark.llm.pieces import SPACE, Encoder, TrieCounter, count_tokens, encode_pieces, load_vocabulary

ODD = ["", " ", "  ", SPACE, f"a {SPACE}b{SPACE * 3} \x00", "\x00m\x00z" + SPACE, "\n\n\t x\r\n", "日本語 тест 𝒳𝒴", "é", "word " * 3000, "x" * 200_000, "ñandú über ÇA"]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary()


def brute(vocabulary, text):
    """Best score by plain dynamic programming over all substrings."""
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for size in range(1, min(16, end) + 1):
            piece = text[end - size : end]
            if piece in vocabulary.pieces:
                best[end] = max(best[end], best[end - size] + vocabulary.pieces[piece][1])
            elif size == 1:
                best[end] = max(best[end], best[end - 1] + vocabulary.low * len(piece.encode()))
    return best[-1]


def score(vocabulary, ids):
    by_id = {i: s for i, s in vocabulary.pieces.values()}
    return sum(by_id.get(i, vocabulary.low) for i in ids)


def test_segments_are_best(vocabulary):
    rnd, encoder = random.Random(2), Encoder(vocabulary)
    for _ in range(400):
        text = SPACE * rnd.randrange(3) + "".join(rnd.choices("abcdethioun", k=rnd.randrange(1, 14))) + rnd.choice(["", "é", "𝒳", "日q", "\t", "ß" * 3])
        assert score(vocabulary, encoder.segment(text)) == pytest.approx(brute(vocabulary, text))


def test_round_trip(vocabulary):
    encoder, rnd = Encoder(vocabulary), random.Random(4)
    texts = ODD + ["".join(rnd.choices(f"ab \n\x00{SPACE}é𝒳mz", k=rnd.randrange(30))) for _ in range(500)]
    for text in texts:
        assert encoder.decode(encoder.encode(text)) == text


def test_trie_counts_match_the_best_score(vocabulary):
    rnd, trie = random.Random(6), TrieCounter(vocabulary)
    words = sorted({"".join(rnd.choices("aeiouthn", k=rnd.randrange(1, 12))) + rnd.choice(["", "é", "𝒳", "日"]) for _ in range(300)} | {"a" * 3000})
    trie.insert([w.encode() for w in words[::2]])
    trie.insert([w.encode() for w in words[1::2]])
    encoder = Encoder(vocabulary)
    for w in words:
        assert trie.counts[w.encode()] == len(encoder.segment(SPACE + w))
    for w in words[:60]:  # among the segmentations of the best score, the count is that of one
        n, text = trie.counts[w.encode()], SPACE + w
        best = [{0: 0.0}] + [{} for _ in text]
        for end in range(1, len(text) + 1):
            for size in range(1, min(16, end) + 1):
                piece = text[end - size : end]
                s, c = (vocabulary.pieces[piece][1], 1) if piece in vocabulary.pieces else (vocabulary.low * len(piece.encode()), len(piece.encode())) if size == 1 else (None, 0)
                if s is not None:
                    for k, v in best[end - size].items():
                        best[end][k + c] = max(best[end].get(k + c, -np.inf), v + s)
        assert best[-1][n] == pytest.approx(max(best[-1].values()))


def test_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_BYTES", 20_000)
    encoder = Encoder(vocabulary)
    for k in range(300):
        assert encoder.decode(encoder.encode(f"word{k} {'z' * 500}{k}")) == f"word{k} {'z' * 500}{k}"
        assert encoder.memo_bytes < 21_000 and max(map(len, encoder.memo)) <= pieces.LONG


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two", "a", "b", "c")], "doc_id int, text string, N_Words string, Piece_Ids string, `x.y` string")
    assert count_tokens(docs).columns == ["doc_id", "text", "Piece_Ids", "x.y", "n_words", "n_tokens"]
    assert [(r.doc_id, r.decoded, r["x.y"]) for r in encode_pieces(docs).collect()] == [(1, "one two", "c")]


def test_operators(spark, vocabulary):
    rows = [(k, t, "x", 1) for k, t in enumerate([*ODD, None])] + [(0, "again", "x", 1), (None, "no id", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, n_words int")
    got = encode_pieces(docs).collect()
    assert len(got) == len(rows) and all(r.decoded == (r.text or "") for r in got)
    counted = count_tokens(docs).collect()
    assert sorted(r.n_words for r in counted) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows)
    assert all((r.n_tokens > 0) == (r.n_words > 0) for r in counted)
    assert encode_pieces(docs.limit(0)).collect() == [] and count_tokens(docs.limit(0)).collect() == []
