"""A SentencePiece vocabulary, encoding and decoding by an Aho-Corasick automaton, and token counts by a shared trie.

The vocabulary is read from a public model file on the driver and goes to the tasks with their code; nothing is trained.
Both operators give each piece the score of the file and find the segmentation of the highest sum.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import _BASE, Columns, lists, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A character without a piece of its own is spelt in bytes, at this much under the lowest score for each byte.
PENALTY = 10.0
#: Bytes that a task's memory of segments or words may take; beyond, it starts anew. Ones of over LONG characters aren't kept.
MEMO_BYTES = 96 << 20
LONG = 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores, and the ids of the 256 byte pieces. Pieces with a space mark after another character aren't used: segments end there."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    spelt: tuple[bytes, ...]

    @property
    def low(self) -> float:
        return min(s for _, s in self.pieces.values()) - PENALTY


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, spelt = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            spelt.append(bytes([int(piece[1:-1], 16)]))
            continue
        spelt.append(piece.replace(SPACE, " ").encode())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > -1e8 and SPACE not in piece.lstrip(SPACE) and not set(piece) & {"\n", "\x00"}:
            pieces[piece] = (i, model.get_score(i))
    mark = model.piece_to_id(SPACE)
    pieces.setdefault(SPACE, (mark, min(s for _, s in pieces.values())))  # files may give the bare mark no usable score
    return Vocabulary(pieces, tuple(byte_ids), tuple(spelt))


class Encoder:
    """Single-pass Viterbi over the matches of an Aho-Corasick automaton, for texts of any length."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.singles = frozenset(p for p in vocabulary.pieces if len(p) == 1)
        self.low = vocabulary.low
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_bytes = 0

    def segment(self, text: str) -> tuple[int, ...]:
        """The ids of the best segmentation; of equally good last pieces, the longest."""
        n = len(text)
        best, back, span = array("d", [-np.inf]) * (n + 1), array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        bare = {} if self.singles.issuperset(text) else {k: c.encode().replace(SPACE.encode(), SPACE.encode()) for k, c in enumerate(text) if c not in self.singles}
        if not bare:
            for end, (i, size, score) in self.automaton.iter(text):
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1], back[end + 1], span[end + 1] = total, i, size
        else:
            done = 0

            def spell(upto: int) -> None:
                for k in range(done, upto):
                    if k in bare and best[k] + self.low * len(bare[k]) > best[k + 1]:
                        best[k + 1], back[k + 1], span[k + 1] = best[k] + self.low * len(bare[k]), -1, 1

            for end, (i, size, score) in self.automaton.iter(text):
                spell(end)  # all matches that end before this one are in
                done = max(done, end)
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1], back[end + 1], span[end + 1] = total, i, size
            spell(n)
        ids, at = [], n
        while at:
            i, size = back[at], span[at]
            if i < 0:
                ids += [self.v.byte_ids[b] for b in reversed(bare[at - 1])]
            else:
                ids.append(i)
            at -= size
        return tuple(ids[::-1])

    _segments = re.compile(f"{SPACE}*[^{SPACE}\n\x00]+|{SPACE}+|\n|\x00")

    def encode(self, text: str) -> list[int]:
        """Ids of a text: spaces are written as the space mark, with one put before it; a mark in the text itself is spelt in bytes."""
        marks = SPACE in text or "\x00" in text
        if marks:
            text = text.replace("\x00", "\x00z").replace(SPACE, "\x00m")
        out: list[int] = []
        memo = self.memo
        if self.memo_bytes > MEMO_BYTES:
            memo.clear()
            self.memo_bytes = 0
        literal = False
        for part in self._segments.findall(SPACE + text.replace(" ", SPACE)):
            if marks:
                if part == "\x00":
                    literal = True
                    continue
                if literal:
                    literal = False
                    out += [self.v.byte_ids[b] for b in (SPACE.encode() if part[0] == "m" else b"\x00")]
                    part = part[1:]
                    if not part:
                        continue
            ids = memo.get(part)
            if ids is None:
                ids = self.segment(part)
                if len(part) <= LONG:
                    memo[part] = ids
                    self.memo_bytes += 250 + 4 * len(part) + 8 * len(ids)
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of encode()'s ids."""
        spelt = self.v.spelt
        return b"".join([spelt[i] for i in ids]).decode("utf-8", "replace")[1:]


def _coded(vocabulary: Vocabulary, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = [x or "" for x in part.column(text_at).to_pylist()]
                ids = [encoder.encode(x) for x in texts]
                flat = np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists(flat, [len(x) for x in ids], pa.int32()), pa.array([encoder.decode(x) for x in ids], pa.string())], names)

    return run


def encode_pieces(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """``docs`` with piece_ids and decoded (the text read back from them, equal to it).

    Of equally good segmentations the one of the longest last piece is taken, back from the end. A null or empty text has the
    ids of the space mark alone. Columns named as the new ones, in any case, are replaced, others carried along under any
    name; repeated rows stay. An empty table gives an empty one.
    """
    own = Columns(docs, ("piece_ids", "decoded"))
    names = [*own.own, "piece_ids", "decoded"]
    return own.back(own.df.mapInArrow(_coded(load_vocabulary(model), own.own.index(own.at(text_col)), names), own.fields("piece_ids array<int>", "decoded string")))


class TrieCounter:
    """Pieces in the best segmentation of words. New words go into a trie, level by level; each node's forward score is
    computed once from its ancestors', so words share the work of their common prefixes, and their last nodes' counts are kept.
    Ties go to the longest last piece, as in the encoder, which counts words of over LONG characters: they share little.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.low = vocabulary.low
        by_size: dict[int, list[tuple[int, float]]] = {}
        for piece, (_, score) in vocabulary.pieces.items():
            by_size.setdefault(len(piece), []).append((self._hash(piece), score))
        self.longest = max(by_size)
        self.tables = {}
        for size, rows in by_size.items():
            keys = np.array([k for k, _ in rows], np.uint64)
            order = np.argsort(keys)
            self.tables[size] = keys[order], np.array([s for _, s in rows])[order]
        self.power = [pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)]
        self.counts: dict[bytes, int] = {}
        self.counts_bytes, self.single = 0, Encoder(vocabulary)

    @staticmethod
    def _char(points: np.ndarray) -> np.ndarray:
        return mix(points.astype(np.uint64) + np.uint64(1))

    def _hash(self, piece: str) -> int:
        h = 0
        for c in self._char(np.array([ord(c) for c in piece])).tolist():
            h = (h * int(_BASE) + c) % (1 << 64)
        return h

    def insert(self, words: list[bytes]) -> None:
        """Counts new distinct words (UTF-8, without white space)."""
        every = [SPACE + w.decode() for w in words]
        for w, text in zip(words, every):
            if len(text) > LONG:
                self.counts[w] = len(self.single.segment(text))
            self.counts_bytes += 150 + len(w)
        words, texts = [w for w, t in zip(words, every) if len(t) <= LONG], [t for t in every if len(t) <= LONG]
        if not texts:
            return
        texts_at = sorted(range(len(texts)), key=lambda k: len(texts[k]), reverse=True)
        sizes = np.array([len(texts[k]) for k in texts_at])
        flat = np.frombuffer("".join([texts[k] for k in texts_at]).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        node = np.zeros(len(texts), np.int64)
        # of the last levels, as many as the longest piece: parent, hash of the prefix, best score, its count
        levels = [(np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64))]
        for depth in range(1, int(sizes[0]) + 1):
            live = int(np.searchsorted(-sizes, -depth, "right"))
            points = flat[begin[:live] + depth - 1]
            keys, at = np.unique(node[:live] << 21 | points, return_inverse=True)
            node[:live] = at
            parent, points = keys >> 21, keys & 0x1FFFFF
            with np.errstate(over="ignore"):
                h = levels[-1][1][parent] * _BASE + self._char(points)
                best, count = np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
                above = parent
                for size in range(1, min(depth, self.longest) + 1):
                    _, h0, best0, count0 = levels[-size]
                    if size > 1:
                        above = levels[-size + 1][0][above]
                    found = np.zeros(len(keys), bool)
                    if size in self.tables:
                        own, scores = self.tables[size]
                        part = h - h0[above] * np.uint64(self.power[size])
                        k = np.minimum(np.searchsorted(own, part), len(own) - 1)
                        found = own[k] == part
                        total = np.where(found, best0[above] + scores[k], -np.inf)
                        better = found & (total >= best)
                        best, count = np.where(better, total, best), np.where(better, count0[above] + 1, count)
                    if size == 1 and not found.all():
                        octets = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
                        best, count = np.where(found, best, best0[above] + self.low * octets), np.where(found, count, count0[above] + octets)
            levels = [*levels[-self.longest :], (parent, h, best, count)]
            done = int(np.searchsorted(-sizes, -depth, "left"))
            for k, n in zip(texts_at[done:live], count[node[done:live]].tolist()):
                self.counts[words[k]] = n

    def total(self, words: list[bytes]) -> int:
        return sum(map(self.counts.__getitem__, words))


def _counted(vocabulary: Vocabulary, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieCounter(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [(x or "").encode().split() for x in part.column(text_at).to_pylist()]
                if trie.counts_bytes > MEMO_BYTES:
                    trie.counts.clear()
                    trie.counts_bytes = 0
                new = {w for row in rows for w in row}.difference(trie.counts)
                if new:
                    trie.insert(sorted(new))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(r) for r in rows], pa.int64()), pa.array([trie.total(r) for r in rows], pa.int64())], names)

    return run


def count_tokens(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words and n_tokens: the pieces of its words, each with a space mark before it.

    Words are runs of characters other than ASCII white space; a null or blank text has none. Of equally good segmentations
    of a word the count is that of encode_pieces(). Columns named as the new ones, in any case, are replaced, others carried
    along under any name; repeated rows stay. An empty table gives an empty one.
    """
    own = Columns(docs, ("n_words", "n_tokens"))
    names = [*own.own, "n_words", "n_tokens"]
    return own.back(own.df.mapInArrow(_counted(load_vocabulary(model), own.own.index(own.at(text_col)), names), own.fields("n_words bigint", "n_tokens bigint")))
