"""Quality rules: gradient-boosted trees over document statistics, held as flat numpy node arrays.

The trees are fitted on a bounded sample of labelled rows (``max_rows``, chosen by a hash of the id), with the monotonic
constraints of FEATURES: more symbols, repeats, duplicate lines or capitals never raise a document's score. Statistics and
scores are computed in one pass over whole texts, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import Columns, text_blocks, window_hashes, word_hashes

#: Feature -> its monotonic constraint: -1 if more of it may only lower the score, 0 if it is free.
FEATURES = {
    "log_words": 0, "chars_a_word": 0, "symbols_a_word": -1, "marks_a_word": 0, "capital_share": -1, "digit_share": 0,
    "dup_line_share": -1, "repeat_share": -1, "words_a_line": 0, "distinct_share": 0,
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _flags(of: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(of)] = 1
    return out


_SYMBOLS, _MARKS, _CAPITALS, _DIGITS = _flags(b"#*$%&|<>"), _flags(b"!?.,;:"), _flags(bytes(range(65, 91))), _flags(b"0123456789")
_FIRST = np.ones(256, np.uint8)  # bytes that begin a code point
_FIRST[0x80:0xC0] = 0
_IN_WORD = _FIRST.copy()
_IN_WORD[[9, 10, 11, 12, 13, 32]] = 0


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(STATS as integers, FEATURES as floats) of each row of a block of texts."""

    filled = np.flatnonzero(np.diff(offsets))

    def per_row(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, np.int64)
        if len(filled):
            out[filled] = np.add.reduceat(flags[data], offsets[filled], dtype=np.int64)
        return out

    words, rows = word_hashes(data, offsets)
    triples = window_hashes(words, 3)
    n = len(offsets) - 1
    n_words = np.diff(rows)
    dup, repeat, distinct, lines = (np.zeros(n, np.int64) for _ in range(4))
    raw = data.tobytes()
    for k in range(n):
        lo, hi = rows[k], rows[k + 1]
        if lo == hi:
            continue
        full = [x for x in raw[offsets[k] : offsets[k + 1]].split(b"\n") if x.strip()]
        lines[k] = len(full)
        dup[k] = len(full) - len(set(full))
        distinct[k] = len(np.unique(words[lo:hi]))
        if hi - lo > 3:
            _, at, count = np.unique(triples[lo : hi - 2], return_inverse=True, return_counts=True)
            twice = count[at] > 1
            if twice.any():
                covered = np.zeros(hi - lo, bool)
                for j in range(3):
                    covered[j : j + len(twice)] |= twice
                repeat[k] = covered.sum()
    chars, symbols = per_row(_IN_WORD), per_row(_SYMBOLS)
    stats = np.stack([n_words, chars, symbols, dup, repeat], 1)
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    features = np.stack(
        [np.log1p(n_words), chars / w, symbols / w, per_row(_MARKS) / w, per_row(_CAPITALS) / c, per_row(_DIGITS) / c, dup / np.maximum(lines, 1), repeat / w, n_words / np.maximum(lines, 1), distinct / w], 1
    )
    return stats, features


@dataclass(frozen=True)
class Trees:
    """Trees of one depth as arrays of shape (trees, nodes): node k has the children 2 k + 1 and 2 k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log-odds that each row is good."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node]
        return total


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for the logistic loss on binned features, with monotonic constraints ``signs``.

    A split on a constrained feature is taken only if its leaf values go the right way; its children's values are then
    bounded by the middle of the two, so that no later split undoes it.
    """
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.zeros((rounds, nodes), np.int64), np.full((rounds, nodes), np.inf), np.zeros((rounds, nodes))
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.999
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(feature, threshold, value, depth, base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(y), base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        work = [(0, np.arange(len(y)), -np.inf, np.inf, 0)]
        while work:
            node, rows, low, high, level = work.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            own = float(np.clip(total_g / (total_h + l2), low, high))
            best = (1e-9, 0, 0, 0.0, 0.0)
            if level < depth:
                for j, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(cut) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(cut) + 1))[:-1]
                    a = np.clip(left_g / (left_h + l2), low, high)
                    b = np.clip((total_g - left_g) / (total_h - left_h + l2), low, high)
                    gain = left_g * a - (left_h + l2) * a * a / 2 + (total_g - left_g) * b - (total_h - left_h + l2) * b * b / 2 - (total_g * own - (total_h + l2) * own * own / 2)
                    gain[(left_h < least) | (total_h - left_h < least)] = 0
                    if signs[j]:
                        gain[(b - a) * signs[j] < 0] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(a[k]), float(b[k]))
            if best[0] <= 1e-9:
                for _ in range(depth - level):
                    node = 2 * node + 1
                value[t, node] = rate * own  # an inner node without a split sends all rows to the left
                margin[rows] += rate * own
                continue
            _, j, k, a, b = best
            feature[t, node], threshold[t, node] = j, cuts[j][k]
            left = binned[rows, j] <= k
            middle = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
            work += [(2 * node + 1, rows[left], *bounds[0], level + 1), (2 * node + 2, rows[~left], *bounds[1], level + 1)]
    return Trees(feature, threshold, value, depth, base)


def _described(text_at: int, trees: Trees | None, names: list[str], cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(text_at)):
                stats, x = statistics(data, offsets)
                part = batch.slice(lo, hi - lo)
                if trees is None:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names)
                    continue
                failed = (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])
                score = trees.score(x)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(stats[:, j]) for j in range(len(STATS))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= cut))], names)

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees from the labelled documents: at most ``max_rows`` labels (least hash of the id first) reach the driver, as FEATURES."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(F.col(label_col).cast("double")).alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample.select("id")), "id", "left_semi")
    names = ["id", *FEATURES]
    rows = texts.mapInArrow(_described(1, None, names, 0), "id bigint, " + ", ".join(f"{x} double" for x in FEATURES)).join(F.broadcast(sample), "id").orderBy(F.xxhash64("id"), *names).limit(max_rows).toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in FEATURES], 1) if rows.num_rows else np.zeros((0, len(FEATURES)))
    y = (rows.column("label").to_numpy() > 0).astype(float)
    return fit(x, y, list(FEATURES.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, cut: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with STATS, base_failed, score (log-odds of good) and kept.

    Words are runs of characters other than ASCII white space. Kept: not base_failed (under 50 words, or over half of the
    words in repeated 3-word windows) and score >= ``cut``. A null or empty text has no words and fails. Without labels of
    both kinds the trees say nothing and the base rules decide alone. Columns of ``docs`` named as one of the new ones, in any
    case, are replaced; all others, under any name, and repeated rows are carried along. An empty table gives an empty one.
    """
    trees = fit_quality(docs, labels, max_rows, id_col, text_col)
    new = (*STATS, "base_failed", "score", "kept")
    own = Columns(docs, new)
    schema = own.fields(*(f"{x} bigint" for x in STATS), "base_failed boolean", "score double", "kept boolean")
    return own.back(own.df.mapInArrow(_described(own.own.index(own.at(text_col)), trees, [*own.own, *new], cut), schema))
