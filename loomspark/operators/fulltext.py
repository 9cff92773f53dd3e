"""Ranked full-text search over an inverted index kept as tables, and substring search by an index of character q-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.graph import _cut, _drop
from loomspark.operators.knowledge import few

#: BM25: how soon more occurrences stop to count, and how much a text's length does.
K1, B = 1.2, 0.75
#: Blocks of a term's postings: by the share of the greatest possible score that a posting has, in steps of one of these.
LEVELS = 32
#: Words that a task counts at a time.
COUNTED_WORDS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass(frozen=True)
class Index:
    """postings(term, level, id, impact) and blocks(term, level, n, most, least, idf), as tables.

    A posting's impact is its BM25 score without the term's weight idf; its block is its term's postings of about the same
    impact, so a block's bounds are close and no term's postings need be ranked.
    """

    postings: DataFrame
    blocks: DataFrame

    def drop(self) -> None:
        _drop(self.postings, self.blocks)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, term, tf) of the distinct words of each row's w, a list."""
    for b in batches:
        ends = np.cumsum(b["size"].to_numpy())
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + COUNTED_WORDS, "right")))
            part = b.slice(lo, hi - lo)
            size, terms = part["size"].to_numpy(), pc.dictionary_encode(part["w"].flatten())
            key, tf = np.unique(np.repeat(np.arange(len(size), dtype=np.int64), size) << 32 | terms.indices.to_numpy(), return_counts=True)
            row = pa.array(key >> 32)
            yield pa.RecordBatch.from_arrays([part["id"].take(row), part["size"].take(row), terms.dictionary.take(pa.array(key & 0xFFFFFFFF)), pa.array(tf)], ["id", "size", "term", "tf"])
            lo = hi


def build_index(texts: DataFrame, id_col: str, text_col: str) -> Index:
    """The index of ``texts``; ids are distinct, a null or empty text has no postings but counts as a text.

    A text's words are counted where it is read, so its counts alone are shuffled, once, and no sample of them is drawn before.
    Postings are sorted by term within their files.
    """
    each = texts.select(F.col(id_col).alias("id"), F.coalesce(words(F.col(text_col)), F.array().cast("array<string>")).alias("w")).withColumn("size", F.size("w"))
    total, mean = each.agg(F.count("*"), F.avg("size")).first()
    counted = each.select("id", "size", "w").mapInArrow(_counted, f"id {each.schema['id'].dataType.simpleString()}, size int, term string, tf bigint")
    impact = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
    leveled = counted.select("term", "id", impact.alias("impact")).withColumn("level", F.floor(F.col("impact") * LEVELS).cast("int"))
    postings = _cut(leveled.repartition("term", "level").sortWithinPartitions("term", "level").select("term", "level", "id", "impact"))
    blocks = postings.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("impact").alias("most"), F.min("impact").alias("least"))
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Index(postings, _cut(blocks.join(df, "term").select("term", "level", "n", "most", "least", weight.alias("idf"))))


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best texts for each of ``queries(query_id, text)``, by BM25; ties by id.

    A query's words count once each; one without known words has no rows. The result is exact: first the blocks alone tell a
    score that ``k`` texts of one term reach; a block leads to candidates only if its bound and the best of the query's
    other terms together can reach that. Candidates are then scored in full. Scores are rounded to nine decimals.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    own = _cut(terms.join(index.blocks, "term").select("query_id", "term", "level", "n", "idf", (F.col("most") * F.col("idf")).alias("most"), (F.col("least") * F.col("idf")).alias("least")))
    # a term's blocks and a query's terms are few: the windows hold LEVELS rows, and the words of one query
    above = Window.partitionBy("query_id", "term").orderBy(F.desc("level"))
    sure = own.withColumn("upto", F.sum("n").over(above)).where(F.col("upto") >= k).groupBy("query_id").agg(F.max("least").alias("sure"))
    best = own.groupBy("query_id", "term").agg(F.max("most").alias("top"))
    every = best.groupBy("query_id").agg(F.sum("top").alias("all"))
    reach = own.join(best, ["query_id", "term"]).join(every, "query_id").join(sure, "query_id", "left")
    open_blocks = reach.where(F.col("most") + F.col("all") - F.col("top") >= F.coalesce("sure", F.lit(0.0)) - 1e-6)
    candidates = index.postings.join(few(open_blocks.select("query_id", "term", "level")), ["term", "level"]).select("query_id", "id").distinct()
    weights = own.select("query_id", "term", "idf").distinct()
    hits = index.postings.join(few(weights), "term").join(candidates, ["query_id", "id"])
    scored = hits.groupBy("query_id", "id").agg(F.round(F.sum(F.col("impact") * F.col("idf")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_or_scan(index: Index, queries: DataFrame, texts: DataFrame, id_col: str, text_col: str, k: int = 20) -> DataFrame:
    """search(), and for the queries that it finds nothing for the first ``k`` texts that contain the query anywhere, with score 0."""
    found = _cut(search(index, queries, k))
    missed = queries.join(found.select("query_id").distinct(), "query_id", "left_anti").where("text <> ''")
    inside = containing(texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")), missed.select(F.lower("text").alias("keyword")).distinct())
    order = Window.partitionBy("query_id").orderBy("id")
    scan = missed.withColumn("keyword", F.lower("text")).join(inside, "keyword").select("query_id", "id", F.lit(0.0).alias("score"), F.row_number().over(order).alias("rank"))
    return found.unionByName(scan.where(F.col("rank") <= k))


def grams(text: Column, q: int) -> Column:
    """The distinct runs of ``q`` characters of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - q + 1, F.lit(1)))
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(starts, lambda k: F.substr(text, k, F.lit(q)))))


def containing(texts: DataFrame, keywords: DataFrame, q: int = 3) -> DataFrame:
    """(keyword, id) wherever a text of ``texts(id, text)`` contains a keyword of ``keywords(keyword)``, case kept; empty keywords and nulls are in none.

    A text is looked at only if it has the keyword's rarest run of ``q`` characters (fewer where a keyword is shorter); then
    the whole keyword is compared. A run that no text has ends the search for its keyword.
    """
    wanted = keywords.where("keyword <> ''").distinct()
    shortest = wanted.agg(F.min(F.least(F.length("keyword"), F.lit(q)))).first()[0] or q
    held = texts.select("id", "text", F.explode(grams(F.col("text"), shortest)).alias("gram"))
    frequency = held.groupBy("gram").agg(F.count("*").alias("n"))
    asked = wanted.select("keyword", F.explode(grams(F.col("keyword"), shortest)).alias("gram")).join(frequency, "gram", "left")
    rarest = asked.groupBy("keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("keyword", "r.gram")
    return held.join(few(rarest), "gram").where(F.contains("text", F.col("keyword"))).select("keyword", "id")
