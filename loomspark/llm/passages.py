"""Substring dedup: every word of a passage that occurs elsewhere is removed, by repeated-phrase automata.

1. Anchors: of the phrases (PHRASE words) within each window of ``width`` words, the one of least hash. Equal windows have
   equal anchors, so only windows whose anchor occurs twice in the corpus can recur; the others go no further.
2. Confirmation: documents are dealt to shards of bounded size. Each shard sends the 96-bit hashes of its distinct
   windows with such an anchor, with a count and one place; those whose counts sum to two or more recur.
3. Location: the recurring windows of a shard's documents form its confirmed passages. Phrases cut from them at every STRIDE
   words, so that each window holds one, are compiled into a pyahocorasick automaton, and all documents of the shard stream
   through it. Each hit is held against the passage it was cut from and grows to both sides while the words are equal;
   what has ``width`` words or more is an occurrence and is removed.

A phrase goes to the shards that have a document with it and to no other, so the corpus streams once, not once for each
automaton. Rows gathered in one task are those of a shard; a window common to very many documents is one row a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import WORD_BASES, dropped, lists, mix, text_blocks, window_hashes, word_hashes, written

PHRASE = 8
CUT = 12
#: A phrase cut from more passages than this finds the one to be held against by the hash of the window around the hit.
FEW = 8


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` consecutive values (the first, if equal)."""
    return np.lib.stride_tricks.sliding_window_view(values, width).argmin(1) + np.arange(len(values) - width + 1)


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                words, rows = word_hashes(data, offsets)
                phrases = window_hashes(words, PHRASE)
                found = []
                for a, b in zip(rows[:-1], rows[1:]):
                    own = phrases[a : b - PHRASE + 1] if b - a >= width else phrases[:0]
                    found.append(own[np.unique(_least(own, width - PHRASE + 1))] if len(own) else own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists(np.concatenate(found).view(np.int64), [len(x) for x in found], pa.int64())], ["shard", "anchors"])

    return run


def _sorted_docs(docs: pa.Table) -> pa.Table:
    """One order of a shard's rows in every step."""
    return docs.sort_by([("row", "ascending"), ("text", "ascending")]).combine_chunks()


def _windows(width: int):
    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        hot = np.sort(anchors.column("anchor").to_numpy().view(np.uint64))
        hashes, checks, places, shard = [], [], [], None
        if docs.num_rows and len(hot):
            shard = docs.column("shard")[0].as_py()
            docs = _sorted_docs(docs.select(["shard", "row", "text"]))
            for lo, _, data, offsets in text_blocks(docs.column("text")):
                words, rows = word_hashes(data, offsets)
                phrases, full, check = window_hashes(words, PHRASE), window_hashes(words, width), (window_hashes(words, width, WORD_BASES[1]) >> np.uint64(32)).astype(np.int32)
                for k, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
                    if b - a < width:
                        continue
                    own = phrases[a : b - PHRASE + 1]
                    least = own[_least(own, width - PHRASE + 1)]
                    at = np.searchsorted(hot, least)
                    starts = np.flatnonzero(hot[np.minimum(at, len(hot) - 1)] == least)
                    hashes.append(full[a + starts])
                    checks.append(check[a + starts])
                    places.append((lo + k << 32) + starts)
        if not hashes:
            return pa.table({"window": pa.array([], pa.int64()), "check": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "place": pa.array([], pa.int64()), "n": pa.array([], pa.int32())})
        values, check, at = np.concatenate(hashes), np.concatenate(checks), np.concatenate(places)
        order = np.lexsort((check, values))
        values, check = values[order], check[order]
        first = np.flatnonzero(np.concatenate([[len(values) > 0], (values[1:] != values[:-1]) | (check[1:] != check[:-1])]))
        count = np.diff(np.append(first, len(values)))
        return pa.table({"window": values[first].view(np.int64), "check": check[first], "shard": pa.array(np.full(len(first), shard, np.int32)), "place": at[order][first].astype(np.int64), "n": np.minimum(count, 2).astype(np.int32)})

    return run


def _runs(places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first start, last start) of the runs of consecutive places."""
    places = np.sort(places)
    cuts = np.flatnonzero(np.diff(places) != 1) + 1
    for part in np.split(places, cuts):
        if len(part):
            yield int(part[0] >> 32), int(part[0] & 0xFFFFFFFF), int(part[-1] & 0xFFFFFFFF)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words the two begin with alike."""
    n, step = 0, 64
    while n < len(a):
        unlike = np.flatnonzero(a[n : n + step] != b[n : n + step])
        if len(unlike):
            return n + int(unlike[0])
        n, step = n + step, step * 4
    return len(a)


class _Passages:
    """The confirmed passages of a shard, given by the places of their windows, and the automaton of their phrases."""

    def __init__(self, words: list[list[bytes]], places: np.ndarray, width: int):
        numbers: dict[bytes, int] = {}
        self.words, self.width = words, width
        self.offsets = np.concatenate([[0], np.cumsum([len(own) for own in words])])
        self.numbers = np.fromiter((numbers.setdefault(w, len(numbers)) for own in words for w in own), np.int64, int(self.offsets[-1]))
        self.places = np.sort(self.offsets[places >> 32] + (places & 0xFFFFFFFF))
        self.spots: list[list[tuple[int, int, int]]] = []  # of each phrase: its place in a passage, the passage's begin and end
        self.automaton, self.known = ahocorasick.Automaton(), None
        phrases: dict[str, int] = {}
        for row, first, last in _runs(places):
            own, base = words[row], int(self.offsets[row])
            for at in range(first, last + width - CUT + 1, width - CUT + 1):
                k = phrases.setdefault(b" ".join([b"", *own[at : at + CUT], b""]).decode(), len(phrases))
                if k == len(self.spots):
                    self.spots.append([])
                self.spots[k].append((base + at, base + first, base + last + width))
        for phrase, k in phrases.items():
            self.automaton.add_word(phrase, k)
        self.automaton.make_automaton()

    def _by_window(self, starts: np.ndarray) -> np.ndarray:
        """Those of ``starts`` whose windows are passages' windows: found by hash, held against one another by words."""
        if self.known is None:
            hashes = window_hashes(mix(self.numbers.astype(np.uint64)), self.width)
            order = np.argsort(hashes[self.places])
            self.known = hashes, hashes[self.places][order], self.places[order]
        hashes, known, places = self.known
        at = np.minimum(np.searchsorted(known, hashes[starts]), len(known) - 1)
        span = np.arange(self.width)
        same = [(self.numbers[starts[k : k + 4096, None] + span] == self.numbers[places[at[k : k + 4096], None] + span]).all(1) for k in range(0, len(starts), 4096)]
        return starts[np.concatenate(same)] if same else starts

    def removed(self, row: int) -> np.ndarray | None:
        """Which words of a document occur in recurring windows; None if none does."""
        own, begin, end = self.words[row], int(self.offsets[row]), int(self.offsets[row + 1])
        if len(own) < self.width:
            return None
        stream = b" ".join([b"", *own, b""]).decode()
        hits = list(self.automaton.iter(stream))
        if not hits:
            return None
        spaces = np.flatnonzero(np.frombuffer(stream.encode("utf-32-le"), np.uint32) == 32)  # a word begins after each; the last ends the text
        first = (np.searchsorted(spaces, [at for at, _ in hits]) - CUT + begin).tolist()  # the first word of each hit
        edges, done, crowded, x = np.zeros(len(own) + 1, np.int64), {}, [], self.numbers
        for f, (_, k) in zip(first, hits):
            if len(self.spots[k]) > FEW:
                crowded.append(f)
                continue
            for at, low, high in self.spots[k]:
                if f < done.get((at - f, low), -1):
                    continue  # within what an earlier hit grew to
                back, on = min(f - begin, at - low), min(end - f, high - at)
                left, right = _common(x[f - back : f][::-1], x[at - back : at][::-1]), _common(x[f : f + on], x[at : at + on])
                done[at - f, low] = f + right
                if left + right >= self.width:
                    edges[f - left - begin] += 1
                    edges[f + right - begin] -= 1
        if crowded:
            near = np.unique(np.array(crowded)[:, None] - np.arange(self.width - CUT + 1))
            starts = self._by_window(near[(near >= begin) & (near + self.width <= end)])
            np.add.at(edges, starts - begin, 1)
            np.add.at(edges, starts - begin + self.width, -1)
        gone = np.cumsum(edges[:-1]) > 0
        return gone if gone.any() else None


def _removed(width: int):
    def run(docs: pa.Table, windows: pa.Table) -> pa.Table:
        docs = _sorted_docs(docs)
        words = [(x or "").encode().split() for x in docs.column("text").to_pylist()]
        gone = [None] * len(words)
        if windows.num_rows:
            passages = _Passages(words, windows.column("place").to_numpy(), width)
            gone = [passages.removed(k) for k in range(len(words))]
        kept = [b" ".join(own if out is None else [w for w, x in zip(own, out.tolist()) if not x]).decode() for own, out in zip(words, gone)]
        return pa.table({"row": docs.column("row"), "n_words": pa.array([len(x) for x in words], pa.int64()), "n_removed": pa.array([0 if x is None else int(x.sum()) for x in gone], pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return run


def remove_repeats(docs: DataFrame, width: int = 35, shard_mb: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept_text) of every row: without the words of windows that also start elsewhere.

    Words are runs of characters other than ASCII white space, unchanged; kept ones are joined by one space. A window is
    ``width`` consecutive words of one row, judged on the input; the same row and rows with the same id count as elsewhere.
    A null, empty or short text loses nothing. Rows without an id are treated like the others. Other columns aren't read.
    An empty table gives an empty one.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).cast("string").alias("text"))
    n_shards = int((plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (shard_mb << 20)) + 1
    plain = plain.select(F.pmod(F.xxhash64("row", "text"), F.lit(n_shards)).cast("int").alias("shard"), "row", "text")
    anchors = written(plain.select("shard", "text").mapInArrow(_anchors(width), "shard int, anchors array<bigint>"), "anchors")
    each = anchors.select("shard", F.explode("anchors").alias("anchor")).groupBy("anchor", "shard").agg(F.count("*").alias("n"))
    twice = each.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    routed = written(each.select("anchor", "shard").join(twice, "anchor").select("shard", "anchor"), "routed")
    dropped(anchors)

    found = plain.groupBy("shard").cogroup(routed.groupBy("shard")).applyInArrow(_windows(width), "window bigint, check int, shard int, place bigint, n int")
    recurring = found.select("*", F.sum("n").over(Window.partitionBy("window", "check")).alias("total")).where("total > 1").select("shard", "place")
    recurring = written(recurring, "recurring")  # the shuffles of texts and windows go before the texts are dealt again
    dropped(routed)
    out = plain.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(_removed(width), "row bigint, n_words bigint, n_removed bigint, kept_text string")
    return out.withColumnRenamed("row", id_col)
