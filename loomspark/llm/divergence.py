"""Source divergence audit: distances between the word distributions of a language's sources, by inclusion-exclusion over supports.

For two sources a kept term is in one, both or neither. Every term is first priced as if it were in one alone, from each
group's histogram of counts; where both hold it, a join of postings puts that right; those that neither holds cost a constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import _LOWERED, dropped, text_blocks, written

#: Bytes of text whose terms a task counts at a time.
BLOCK = 4 << 20
_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(lower-cased terms, row of each) of a block of texts; a term is a run of letters a-z and of characters beyond ASCII."""
    inside = _TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]  # a term doesn't go on into the next row's text
    letters = _LOWERED[data[inside]]
    at = np.flatnonzero(first[inside])
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(letters)).astype(np.int64)), pa.py_buffer(letters)])
    return words.dictionary_encode(), np.searchsorted(offsets, np.flatnonzero(first), "right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs): occurrences and rows of each term in a group, by block of text."""
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
        group = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
        for lo, hi, data, offsets in text_blocks(batch.column(2), BLOCK):
            terms, rows = _terms(data, offsets)
            size = max(1, len(terms.dictionary))
            key, n = np.unique(rows * size + terms.indices.to_numpy(), return_counts=True)
            where, back = np.unique(group[lo:hi][key // size] * size + key % size, return_inverse=True)
            at, width = where // size, max(1, len(sources.dictionary))
            columns = [langs.dictionary.take(pa.array(at // width)), sources.dictionary.take(pa.array(at % width)), terms.dictionary.cast(pa.string()).take(pa.array(where % size))]
            sums = [pa.array(np.bincount(back, w, len(where)).astype(np.int64)) for w in (n, None)]  # a block's counts are exact in a double
            yield pa.RecordBatch.from_arrays([*columns, *sums], names)


def _price(count: str, total: str, terms: str) -> Column:
    """1 + floor(10 ** 9 * (count + 5) / (total + 5 * terms)) in exact integers; null where there are no terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (1000000000BD * CAST({count} + 5 AS DECIMAL(20, 0))) DIV CAST({total} + 5 * {terms} AS DECIMAL(20, 0)) END")


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and the rows that hold it; nulls are ''."""
    plain = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    rows = docs.select(plain(lang_col, "lang"), plain(source_col, "source"), plain(text_col, "text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(docs: DataFrame, least_docs: int = 30, ranks: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of rows with one lang and source, null ones read as ''.

    Terms are runs of letters, A-Z lower-cased; a lang keeps those in ``least_docs`` of its rows or more. A group's or lang's
    share of a kept term is p = 1 + floor(10 ** 9 * (count + 5) / (N + 5 * V)) for its count there, N the group's sum of them
    and V the lang's number of kept terms. Part ``pair`` has each other source of the lang with the sum of the terms'
    absolute differences of p, 0 if V is 0; part ``term`` the ``ranks`` kept terms of the group whose p is most above the
    lang's, with the difference. Ranks are by value downwards, then by item. A null or empty text has no terms, but its group
    counts. Repeated rows count each. Further columns, whatever their names, are left out. An empty table gives an empty one.

    Terms are counted by block inside the tasks, so the shuffle carries a row for each term and group of a task, and no hot
    source or word reaches one task whole. A group's one-sided prices come from one pass over its histogram, in the order of
    p, into which the other sources' prices of an absent term are merged. ``broadcast_rows`` bounds the number of groups
    whose totals are broadcast; beyond it they are joined by shuffle.
    """
    counts = written(term_counts(docs, lang_col, source_col, text_col), "terms")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    own = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all")
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("total"))
    by_group = own.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("held"))
    plain = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    groups = docs.select(plain(lang_col, "lang"), plain(source_col, "source")).distinct().join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left").na.fill(0, ["v", "total", "size", "held"])
    groups = written(groups.withColumn("absent", _price("0L", "size", "v")), "groups")
    small = F.broadcast if groups.count() <= broadcast_rows else lambda df: df
    posts = own.join(small(groups.select("lang", "source", "v", "total", "size", "absent")), ["lang", "source"])
    posts = written(posts.select("lang", "source", "term", "absent", _price("n", "size", "v").alias("p"), _price("all", "total", "v").alias("q")), "postings")
    dropped(counts, kept)

    # one-sided: all terms of a source against the other's price of an absent term; one pass over the prices in order
    pairs = groups.select("lang", "source", "v", "held", "absent").join(small(groups.select("lang", F.col("source").alias("other"), F.col("held").alias("other_held"), F.col("absent").alias("other_absent"))), "lang").where("source <> other")
    histogram = posts.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    null = lambda kind: F.lit(None).cast(kind)
    events = histogram.select("lang", "source", F.col("p").alias("at"), "k", null("string").alias("other"), F.lit(0).cast("bigint").alias("neither"))
    constant = F.when(F.col("source") < F.col("other"), (F.col("v") - F.col("held") - F.col("other_held")) * F.abs(F.col("absent") - F.col("other_absent"))).otherwise(0)
    events = events.unionByName(pairs.select("lang", "source", F.col("other_absent").alias("at"), F.lit(0).cast("bigint").alias("k"), "other", constant.alias("neither")))
    w = Window.partitionBy("lang", "source")
    below, within = w.orderBy("at").rangeBetween(Window.unboundedPreceding, 0), lambda x: F.sum(x).over(w)
    k, kp = F.col("k"), F.col("k") * F.coalesce("at", F.lit(0))
    priced = events.select("lang", "source", "other", "at", "neither", F.sum(k).over(below).alias("n_below"), F.sum(kp).over(below).alias("sum_below"), within(k).alias("n_all"), within(kp).alias("sum_all")).where("other is not null")
    one_sided = F.col("at") * (2 * F.col("n_below") - F.col("n_all")) + F.col("sum_all") - 2 * F.col("sum_below") + F.col("neither")
    priced = priced.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), F.coalesce(one_sided, F.lit(0)).alias("value"))
    # both: what those terms cost, less what the lines above took for them
    left, right = posts.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p1"), F.col("absent").alias("z1")), posts.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p2"), F.col("absent").alias("z2"))
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", F.expr("abs(p1 - p2) - abs(p1 - z2) - abs(p2 - z1) + abs(z1 - z2)").alias("value"))
    distance = priced.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    distance = distance.select("lang", "value", F.explode(ends).alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    terms = posts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(distance).unionByName(ranked(terms).where(F.col("rank") <= ranks))
