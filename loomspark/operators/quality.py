"""Text metrics of predictions against references, and report arithmetic."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of texts whose results a task hands on at once.
ROWS = 256
CJK = r"[\x{4e00}-\x{9fff}]"


def tokens(text: Column) -> Column:
    """Lower case, punctuation dropped; single characters if there is any CJK one, else words."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")
    return F.filter(F.when(F.regexp_like(bare, F.lit(CJK)), F.split(F.regexp_replace(bare, r"(?U)\s", ""), "")).otherwise(F.split(bare, r"(?U)\s+")), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` tokens, joined by a space; none if there are fewer."""
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _told(one: Callable[[list[str], list[str]], list[int]]):
    """(id, m) of batches (id, p, r), the numbers of ``one`` for each row; ROWS texts are made Python strings at a time, not a whole batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                ids, p, r = (c.slice(lo, ROWS) for c in batch.columns)
                found = [one(a.split(" ") if a else [], b.split(" ") if b else []) for a, b in zip(p.to_pylist(), r.to_pylist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.int64()))], ["id", "m"])

    return run


def _counted(pairs: DataFrame, one: Callable[[list[str], list[str]], list[int]], id_col: str) -> DataFrame:
    """(id_col, m): what ``one`` tells of the tokens of each row of ``pairs``."""
    joined = lambda c: F.array_join(tokens(F.col(c)), " ")
    x = pairs.select(F.col(id_col).alias("id"), joined("prediction").alias("p"), joined("reference").alias("r"))
    return x.mapInArrow(_told(one), f"id {x.schema['id'].dataType.simpleString()}, m array<bigint>").withColumnRenamed("id", id_col)


def matches(pairs: DataFrame, sizes: tuple[int, ...], id_col: str = "id") -> DataFrame:
    """(id, n_p, n_r, common): token counts of both sides, and the multiset intersection of their n-grams for each n of ``sizes``.

    Counted row by row in time linear in the texts, so whole documents are never dealt out by n-gram.
    """

    def one(p: list[str], r: list[str]) -> list[int]:
        out = [len(p), len(r)]
        for n in sizes:
            left, common = Counter(zip(*(r[k:] for k in range(n)))), 0
            for g in zip(*(p[k:] for k in range(n))):
                if left.get(g, 0):
                    left[g] -= 1
                    common += 1
            out.append(common)
        return out

    x = _counted(pairs, one, id_col)
    return x.select(id_col, F.col("m")[0].alias("n_p"), F.col("m")[1].alias("n_r"), F.slice("m", 3, len(sizes)).alias("common"))


def overlap(pairs: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """(id, common, n_prediction, n_reference): the multiset intersection of n-grams of ``pairs(id, prediction, reference)``."""
    grams = lambda c: F.greatest(F.col(c) - (n - 1), F.lit(0))
    return matches(pairs, (n,), id_col).select(id_col, F.col("common")[0].alias("common"), grams("n_p").alias("n_prediction"), grams("n_r").alias("n_reference"))


def token_f1(pairs: DataFrame) -> DataFrame:
    """F1 of the multisets of words; 1 if neither text has any, 0 if one of them has none."""
    x = overlap(pairs, 1)
    p, r = F.col("common") / F.nullif(F.col("n_prediction"), F.lit(0)), F.col("common") / F.nullif(F.col("n_reference"), F.lit(0))
    return x.select("id", F.when((F.col("n_prediction") == 0) & (F.col("n_reference") == 0), 1.0).otherwise(F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 6)).alias("f1"))


def rouge_recall(pairs: DataFrame, n: int) -> DataFrame:
    return overlap(pairs, n).select("id", F.round(F.coalesce(F.col("common") / F.nullif(F.col("n_reference"), F.lit(0)), F.lit(0.0)), 6).alias("rouge"))


def bleu(pairs: DataFrame) -> DataFrame:
    """BLEU-4: geometric mean of clipped precisions, 0 if any is 0, times min(1, exp(1 - r / p))."""
    x = matches(pairs, (1, 2, 3, 4)).withColumnsRenamed({"n_p": "p", "n_r": "r"})
    ps = [F.coalesce(F.col("common")[n] / F.nullif(F.greatest(F.col("p") - n, F.lit(0)), F.lit(0)), F.lit(0.0)) for n in range(4)]
    score = F.when(F.least(*ps) > 0, F.least(F.lit(1.0), F.exp(1 - F.col("r") / F.col("p"))) * F.exp(sum((F.log(p) for p in ps[1:]), F.log(ps[0])) / 4)).otherwise(0.0)
    return x.select("id", F.round(score, 6).alias("bleu"))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """ROUGE-L F-measure; a row of the table of common subsequences is the bits of one integer, so a long text costs a few additions a word."""

    def one(p: list[str], r: list[str]) -> list[int]:
        at: dict[str, int] = {}
        for k, w in enumerate(r):
            at[w] = at.get(w, 0) | 1 << k
        full = row = (1 << len(r)) - 1
        for w in p:
            if w in at:
                hit = row & at[w]
                row = (row + hit | row - hit) & full
        return [len(p), len(r), len(r) - row.bit_count()]

    x = _counted(pairs, one, "id")
    a, b = (F.col("m")[2] / F.nullif(F.col("m")[k], F.lit(0)) for k in (0, 1))
    return x.select("id", F.round(F.coalesce(2 * a * b / F.nullif(a + b, F.lit(0.0)), F.lit(0.0)), 6).alias("rouge_l"))


#: All characters that count as white space at the ends of a text.
BLANKS = "".join(chr(k) for k in range(0x3001) if chr(k).isspace())


def exact_match(pairs: DataFrame) -> DataFrame:
    """Whether both texts are equal without white space of any kind at their ends."""
    bare = lambda c: F.trim(F.col(c), F.lit(BLANKS))
    return pairs.select("id", (bare("prediction") == bare("reference")).alias("exact"))


def keyword_share(text: Column, keywords: Column) -> Column:
    """The share of keywords contained; 1 if there are none."""
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(F.filter(keywords, lambda k: F.contains(text, k))) / F.size(keywords))


def thresholds(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """``metrics(metric, value)`` with ok, by limits metric -> ('>=' or '<=', value)."""
    ok = F.lit(None).cast("boolean")
    for name, (sign, value) in limits.items():
        ok = F.when(F.col("metric") == name, F.col("value") >= value if sign == ">=" else F.col("value") <= value).otherwise(ok)
    return metrics.withColumn("ok", ok)


def compare_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta, improved) of two reports, 0 where one has no value."""
    x = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full").na.fill(0.0)
    return x.withColumn("delta", F.round(F.col("after") - F.col("before"), 6)).withColumn("improved", F.col("after") > F.col("before"))


def split_by_hash(items: DataFrame, id_col: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows whose seeded hash falls under ``share``, and the others; an id is always on the same side."""
    low = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    return items.where(low), items.where(~low)
