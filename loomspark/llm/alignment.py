"""Cross-tokenizer alignment: union-find over the bipartite graph of overlapping tokens, and corpus-wide counts of linked pairs.

A is a byte-level BPE read by ``tokenizers``, B a SentencePiece model; both files are read on the driver and go to the tasks
with their code. Texts are encoded once, into a table of packed ids; everything after it reads that table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import dropped, lists, written

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Text that is encoded, and bytes of token text that are linked, at a time in a task.
ENCODE_CHARS, LINK_BYTES = 1 << 20, 4 << 20
#: Bytes that a task's memory of encoded runs may take; beyond, it starts anew.
MEMO_BYTES = 96 << 20
#: Where a text may be cut before encoding: at a space alone between two characters that are no space of any kind, if no piece of B
#: goes on after a word's end. A's pattern begins a token there, and no merge of B crosses it.
_BLANK = r"\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u2581\u3000\ufeff"
CUT = re.compile(f"(?<=[^{_BLANK}]) (?=[^{_BLANK}])")
#: Runs that can't be cut again from others: blank at an end, or with B's mark for a space, which it doesn't spell.
RAGGED = re.compile(f"\\A[{_BLANK}]|[{_BLANK}]\\Z|\u2581")
#: New runs that are encoded as one text.
JOINED = 256
#: Distinct pairs that a task holds before it hands on their counts.
HELD = 1 << 20
#: A link's pair as one number: A's id above this many bits, B's below.
SHIFT = 32


class Tokens:
    """The two tokenizers; spelt_a and spelt_b hold the bytes that each id stands for."""

    def __init__(self, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL):
        with open(byte_model, encoding="utf-8") as f:
            self.byte_json = f.read()
        with open(piece_model, "rb") as f:
            self.piece_proto = f.read()
        a, b = self.load()
        self.spelt_a = [b""] * a.get_vocab_size()
        octet = _octets()
        for token, i in a.get_vocab().items():
            self.spelt_a[i] = bytes(octet[c] for c in token) if all(c in octet for c in token) else token.encode()
        self.spelt_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(b.get_piece_size())]
        alone = a.normalizer is None and "ByteLevel(add_prefix_space=False" in str(a.pre_tokenizer) and "use_regex=True" in str(a.pre_tokenizer)
        self.by_run = alone and not any(SPACE in b.id_to_piece(i).lstrip(SPACE) for i in range(b.get_piece_size()))
        self.dtype = np.dtype("<u2") if max(len(self.spelt_a), len(self.spelt_b)) <= 1 << 16 else np.dtype("<u4")

    def load(self):
        """The tokenizers themselves, made anew in each task; one thread each, as Spark hands out the cores."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        a = tokenizers.Tokenizer.from_str(self.byte_json)
        a.encode_special_tokens = True
        return a, sentencepiece.SentencePieceProcessor(model_proto=self.piece_proto)


def _octets() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable Latin-1 for itself, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [k for k in range(256) if k not in set(shown)]
    return {chr(k): k for k in shown} | {chr(256 + n): k for n, k in enumerate(hidden)}


class Encoder:
    """Packed ids of both sides, run by run: each distinct run between two cuts is encoded once as long as memory allows."""

    def __init__(self, tokens: Tokens):
        self.tokens, (self.a, self.b) = tokens, tokens.load()
        self.packed_a: dict[str, bytes] = {}
        self.packed_b: dict[str, bytes] = {}
        self.odd: set[str] = set()  # runs that one side doesn't spell
        self.size, self.sizes = 0, _sizes(tokens)

    def learn(self, runs: list[str], together: int) -> None:
        """Encodes new runs, some ``together`` as one text that is cut again where they end; one by one if a side doesn't spell all of it."""
        want = [b" " + r.encode() for r in runs]
        texts = [" ".join(runs[k : k + together]) for k in range(0, len(runs), together)]
        encoded = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)
        whole = b"".join(want)
        for ids, packed, spelt, size in zip(encoded, (self.packed_a, self.packed_b), (self.tokens.spelt_a, self.tokens.spelt_b), self.sizes):
            flat = np.fromiter(chain.from_iterable(ids), self.tokens.dtype)
            if b"".join(map(spelt.__getitem__, flat.tolist())) == whole:
                ends = np.searchsorted(np.concatenate([[0], np.cumsum(size[flat])]), np.cumsum([0, *map(len, want)]))
            elif together > 1:
                return self.learn(runs, 1)
            else:
                self.odd.update(r for r, x, w in zip(runs, ids, want) if b"".join([spelt[i] for i in x]) != w)
                ends = np.cumsum([0, *map(len, ids)])
            raw, ends = flat.tobytes(), (ends * self.tokens.dtype.itemsize).tolist()
            packed.update(zip(runs, [raw[lo:hi] for lo, hi in zip(ends, ends[1:])]))
            self.size += 180 * len(runs) + len(raw)
        self.size += len(whole)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        if self.size > MEMO_BYTES:
            for memo in (self.packed_a, self.packed_b, self.odd):
                memo.clear()
            self.size = 0
        runs = [(CUT.split(t) if self.tokens.by_run else [t]) if t else [] for t in texts]
        new = set().union(*runs).difference(self.packed_a)
        if new:
            ragged = {r for r in new if RAGGED.search(r)} if self.tokens.by_run else new
            self.learn(sorted(new - ragged), JOINED)
            self.learn(sorted(ragged), 1)
        known_a, known_b, odd = self.packed_a.__getitem__, self.packed_b.__getitem__, self.odd
        return [(b"", b"") if odd and not odd.isdisjoint(r) else (b"".join(map(known_a, r)), b"".join(map(known_b, r))) for r in runs]


def _encoded(tokens: Tokens, names: list[str]):
    """(row, id, text) to (row, id, n_a, n_b, a_ids, b_ids); ids are packed in ``tokens.dtype``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = Encoder(tokens), tokens.dtype.itemsize
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            sizes = np.cumsum([0, *map(len, texts)])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + ENCODE_CHARS, "right")) - 1)
                a, b = zip(*encoder.encode(texts[at:end]))
                here = batch.slice(at, end - at)
                count = lambda ids: pa.array([len(x) // width for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), count(a), count(b), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names)
                at = end

    return run


class Block:
    """Links and groups of some texts' tokens, laid end to end; both sides spell the same bytes, so no link leaves a text.

    a and b are ids, n_a and n_b the tokens of each text. Link k joins token at_a[k] to token at_b[k].
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b = a, b
        self.rows_a, self.rows_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        ends_a = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, bool)
        ends_b = np.zeros_like(ends_a)
        ends_a[end_a], ends_b[end_b] = True, True
        cuts = np.flatnonzero(ends_a | ends_b)  # from one cut to the next lies one token of each side, and never the same two
        in_a, in_b = ends_a[cuts], ends_b[cuts]
        self.at_a, self.at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        self.links = np.searchsorted(self.at_a, self.rows_a, "left")  # each text begins with a link of its first token of A

    def pairs(self) -> np.ndarray:
        return (self.a[self.at_a].astype(np.int64) << SHIFT) | self.b[self.at_b].astype(np.int64)

    def roots(self) -> np.ndarray:
        """Union-find over the links, all at once: roots hook to smaller ones, paths are halved until every token points at its root."""
        parent = np.arange(len(self.a) + len(self.b))
        u, v = self.at_a, self.at_b + len(self.a)
        while len(u):
            np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
            while True:
                above = parent[parent]
                if np.array_equal(above, parent):
                    break
                parent = above
            u, v = parent[u], parent[v]
            u, v = u[u != v], v[u != v]
        return parent

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The component of each token of A and of B, numbered from 0 in their order."""
        root = self.roots()
        first = root[: len(self.a)] == np.arange(len(self.a))  # the least member of a component is its first token of A
        number = np.cumsum(first) - 1
        return number[root[: len(self.a)]], number[root[len(self.a) :]]


def _blocks(batch: pa.RecordBatch, tokens: Tokens, size_a: np.ndarray, size_b: np.ndarray) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, Block) of a batch with n_a, n_b, a_ids and b_ids as its last columns."""
    n_a, n_b, raw_a, raw_b = batch.columns[-4:]
    n_a, n_b, raw_a, raw_b = n_a.to_numpy(), n_b.to_numpy(), raw_a.to_pylist(), raw_b.to_pylist()
    weight, at = np.cumsum(np.concatenate([[0], n_a + n_b])), 0
    while at < len(n_a):
        end = max(at + 1, int(np.searchsorted(weight, weight[at] + LINK_BYTES // 4, "right")) - 1)
        a, b = (np.frombuffer(b"".join(raw[at:end]), tokens.dtype) for raw in (raw_a, raw_b))
        yield at, end, Block(a, b, n_a[at:end], n_b[at:end], size_a, size_b)
        at = end


def _sizes(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in spelt], np.int64) for spelt in (tokens.spelt_a, tokens.spelt_b))


def _counted(tokens: Tokens):
    """The links of each pair of ids, summed within a task as far as HELD pairs allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, held, counts = _sizes(tokens), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, block in _blocks(batch, tokens, *sizes):
                new, n = np.unique(block.pairs(), return_counts=True)
                held, back = np.unique(np.concatenate([held, new]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(held)).astype(np.int64)  # below 2 ** 53 in a task
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "n"])
                    held, counts = held[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "n"])

    return run


def pair_counts(encoded: DataFrame, tokens: Tokens) -> DataFrame:
    """(pair, n, best): how many links hold each pair of ids, and whether no pair with its id of B has more."""
    found = encoded.select("n_a", "n_b", "a_ids", "b_ids").mapInArrow(_counted(tokens), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # one id of B meets at most as many pairs as A has ids, so no group of the window outgrows the vocabulary
    return found.select("pair", "n", F.expr(f"n = max(n) OVER (PARTITION BY pair & {(1 << SHIFT) - 1})").alias("best"))


def _scored(tokens: Tokens, keys: np.ndarray, counts: np.ndarray, best: np.ndarray, names: list[str]):
    """(row, id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum, rest); the frequent pairs count here, rest are the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(tokens)
        text = {end: (_named(len(tokens.spelt_a), end), _named(len(tokens.spelt_b), end)) for end in ",|;"}
        for batch in batches:
            for at, end, block in _blocks(batch, tokens, *sizes):
                pairs, here, rows = block.pairs(), batch.slice(at, end - at), block.links
                if len(keys):
                    k = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    hit = keys[k] == pairs
                    n, top = np.where(hit, counts[k], 0), hit & best[k]
                else:
                    hit, n, top = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
                by_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[rows])
                of_a, of_b = block.groups()
                last_a, last_b = np.diff(of_a, append=-1) != 0, np.diff(of_b, append=-1) != 0
                begun = np.concatenate([[0], np.cumsum(last_a)])[block.rows_a]
                # a token of A comes after the tokens of B of earlier groups, one of B after those of A of its own and earlier groups
                out = np.empty(len(block.a) + len(block.b), object)
                out[np.arange(len(block.a)) + np.searchsorted(of_b, of_a, "left")] = np.where(last_a, text["|"][0][block.a], text[","][0][block.a])
                out[np.arange(len(block.b)) + np.searchsorted(of_a, of_b, "right")] = np.where(last_b, text[";"][1][block.b], text[","][1][block.b])
                ends, out = (block.rows_a + block.rows_b).tolist(), out.tolist()
                groups = ["".join(out[lo:hi])[:-1] for lo, hi in zip(ends, ends[1:])]
                columns = [np.diff(begun), np.diff(rows), groups, by_row(top), by_row(n), lists(pairs[~hit], by_row(~hit), pa.int64())]
                kinds = (pa.int64(), pa.int64(), pa.large_string(), pa.int64(), pa.int64(), None)
                yield pa.RecordBatch.from_arrays([*here.columns[:4], *[pa.array(c, t) if t else c for c, t in zip(columns, kinds)]], names)

    return run


def _named(size: int, end: str) -> np.ndarray:
    out = np.empty(size, object)
    out[:] = [f"{i}{end}" for i in range(size)]
    return out


def align_tokens(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text", kept: Callable[[Column], Column] = lambda groups: groups, frequent: int = 500_000) -> DataFrame:
    """One row for each of ``docs``: its id, n_a, n_b, n_groups, n_links, groups, n_best and count_sum.

    A encodes a space and the text, B the text (it adds the space itself); strings of special tokens in it are plain text.
    groups is ``a1,a2|b1;a3|b2,b3``: the ids of each minimal group in order, cut where tokens of both end. A link is two
    tokens whose bytes overlap; a pair's count is how many links of all rows hold its ids, n_best the links whose pair has
    the highest count of its id of B (ties too), count_sum the sum of the links' counts. ``kept`` is what stays of groups: a
    function of its column, by default the whole. A text that is null, empty or not spelt alike by both has zeros and ''.
    Repeated rows are counted and returned each; a null id is an id. Other columns, whatever their names, are left out. An
    empty table gives an empty one.

    Counts of the up to ``frequent`` most frequent pairs (of whole powers of two of the count, so that they are exactly those
    from some count on) go to the tasks; links of rarer ones are exploded and joined with the table of counts, where no pair
    is a hot key. That bound steers the cost alone.
    """
    tokens = Tokens(byte_model, piece_model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["row", "id", "n_a", "n_b", "a_ids", "b_ids"]
    encoded = written(rows.mapInArrow(_encoded(tokens, names), f"row bigint, id {kind}, n_a bigint, n_b bigint, a_ids binary, b_ids binary"), "encoded", "zstd")
    counts = written(pair_counts(encoded, tokens), "pairs")
    power = F.floor(F.log2("n")).cast("int")
    by_power = {r["power"]: r["pairs"] for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("pairs")).collect()}  # 63 rows at most
    least, room = 64, frequent
    for p in sorted(by_power, reverse=True):
        room -= by_power[p]
        if room < 0:
            break
        least = p
    often = counts.where(power >= least).toArrow()
    order = np.argsort(often["pair"].to_numpy())
    keys, n, best = (often[c].to_numpy()[order] for c in ("pair", "n", "best"))
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum", "rest"]
    fields = f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint, rest array<bigint>"
    scored = encoded.mapInArrow(_scored(tokens, keys, n, best.astype(bool), names), fields)
    scored = written(scored.withColumn("groups", kept(F.col("groups"))), "scored")
    dropped(encoded)
    rare = scored.where("size(rest) > 0").select("row", F.explode("rest").alias("pair")).join(counts.where(power < least), "pair")
    rare = rare.groupBy("row").agg(F.count_if("best").alias("more_best"), F.sum("n").alias("more"))
    total = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return scored.drop("rest").join(rare, "row", "left").select(F.col("id").alias(id_col), *names[2:7], total("n_best", "more_best"), total("count_sum", "more"))
