"""Phrases of a dictionary in texts, and one set of entities from the mentions that several strategies found.

A mention is (id, name, type, start, end, confidence, strategy); places are characters from 0.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.knowledge import BROADCAST_ROWS, few

#: A token is a character of a script that is written without spaces, or a run of other letters and digits.
TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")
#: Rows that a task gathers before it hands them on.
ROWS = 50_000
#: What is added to the confidence of a name found more than once, by the number of strategies; 0.1 for any other number.
RAISED = {2: 0.03, 3: 0.05, 4: 0.08}


def _keys(dictionary: DataFrame) -> DataFrame:
    """(key, size, name, type): a name's lower-case tokens joined by spaces and their number; of names with one key the least."""

    @F.pandas_udf("string")
    def key(names: pd.Series) -> pd.Series:
        return names.map(lambda n: " ".join(TOKEN.findall(n.lower())), na_action="ignore")

    keyed = dictionary.where("name is not null").select(key("name").alias("key"), "name", "type").where("key <> ''")
    return keyed.groupBy("key").agg(F.min(F.struct("name", "type")).alias("x")).select("key", F.size(F.split("key", " ")).alias("size"), "x.name", "x.type")


def phrase_mentions(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, confidence: float = 0.95) -> DataFrame:
    """Every place where the tokens of a name of ``dictionary(name, type)`` stand one after the other, in any case; overlapping ones too.

    Tokens are whole, so a name isn't found inside a word. Of names with the same tokens one counts, the least. A null or empty text
    or name has no tokens. A text's tokens go through a task in parts, so its length doesn't matter.

    Runs of tokens are looked up by their text in an index of the names, for each number of tokens that a name has. Only
    runs that begin like a name leave the task, if the first tokens are few enough to be sent there.
    """
    index = _keys(dictionary).cache()
    sizes = sorted(r[0] for r in index.select("size").distinct().collect())  # the lengths of names, bounded by the longest
    first = index.select(F.substring_index("key", " ", 1).alias("first")).distinct()
    known = {r[0] for r in first.collect()} if first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else None
    longest = max(sizes, default=0)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        frame = lambda: pd.DataFrame(rows, columns=["id", "start", "end", "key"])
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"]):
                last: list[tuple[str, int]] = []  # the tokens before this one that a run may begin with, and their starts
                for found in TOKEN.finditer(text or ""):
                    last.append((found.group().lower(), found.start()))
                    if len(last) > longest:
                        del last[0]
                    for size in sizes:
                        if size <= len(last) and (known is None or last[-size][0] in known):
                            rows.append((doc, last[-size][1], found.end(), " ".join(w for w, _ in last[-size:])))
                    if len(rows) >= ROWS:
                        yield frame()
                        rows.clear()
        yield frame()

    kind = texts.schema[id_col].dataType.simpleString()
    each = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(runs, f"id {kind}, start int, end int, key string")
    return each.join(few(index), "key").select("id", "name", "type", "start", "end", F.lit(confidence).alias("confidence"), F.lit("exact_dict").alias("strategy"))


def cross_validated(mentions: DataFrame) -> DataFrame:
    """One mention for each (id, lower-case name, type): the one of the highest confidence, the first of those, raised by RAISED if there were several."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "start", "end", "name", "strategy"))
    x = mentions.groupBy("id", F.lower("name").alias("key"), "type").agg(best.alias("m"), F.count("*").alias("n"), F.countDistinct("strategy").alias("k"))
    more = F.lit(0.1)
    for k, value in RAISED.items():
        more = F.when(F.col("k") == k, value).otherwise(more)
    confidence = F.least(F.lit(1.0), -F.col("m.c") + F.when(F.col("n") > 1, more).otherwise(0.0))
    return x.select("id", "m.name", "type", "m.start", "m.end", F.round(confidence, 6).alias("confidence"), "m.strategy")


def without_overlaps(mentions: DataFrame) -> DataFrame:
    """The mentions that stay when they are taken by confidence, then start, the longer first, and those that overlap a taken one go.

    A document's mentions pass in the order of their starts; only those of one cluster of overlapping spans are held and
    settled at a time, by a binary search among the taken ones.
    """
    columns = ["id", "name", "type", "start", "end", "confidence", "strategy"]

    def settle(cluster: list[tuple]) -> list[tuple]:
        starts: list[int] = []
        taken: list[tuple] = []
        for m in sorted(cluster, key=lambda m: (-m[5], m[3], -m[4], m[1], m[2], m[6])):
            k = bisect(starts, m[3])
            if (k == 0 or taken[k - 1][4] <= m[3]) and (k == len(taken) or m[4] <= taken[k][3]):
                starts.insert(k, m[3])
                taken.insert(k, m)
        return taken

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cluster: list[tuple] = []
        until = -1
        for batch in batches:
            out: list[tuple] = []
            for m in batch.itertuples(index=False, name=None):
                if cluster and (m[0] != cluster[0][0] or m[3] >= until):
                    out += settle(cluster)
                    cluster, until = [], -1
                cluster.append(m)
                until = max(until, m[4])
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(settle(cluster), columns=columns)

    kind = mentions.schema["id"].dataType.simpleString()
    ordered = mentions.where("id is not null and start < end").select(*columns).repartition("id").sortWithinPartitions("id", "start", "end")
    return ordered.mapInPandas(sweep, f"id {kind}, name string, type string, start int, end int, confidence double, strategy string")


def abbreviations(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, confidence: float = 0.9) -> DataFrame:
    """The first place of each word of two to five capitals that is a key of ``dictionary(abbr, name, type)``, under its full name."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{2,5}(?![\p{L}\p{N}_])"), F.lit(0)))
    each = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.explode(found).alias("abbr"))
    each = each.select("id", "abbr", (F.instr(F.col("t"), F.col("abbr")) - 1).alias("start"))  # the first place of its letters, as they stand
    out = each.join(few(dictionary), "abbr")
    return out.select("id", "name", "type", "start", (F.col("start") + F.length("abbr")).alias("end"), F.lit(confidence).alias("confidence"), F.lit("abbreviation").alias("strategy"))


def entities(*strategies: DataFrame) -> DataFrame:
    """What the strategies found together: of equal spans the first strategy's, then cross-validated, then without overlaps."""
    found = None
    for place, part in enumerate(strategies):
        one = part.select("id", "name", "type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "confidence", "strategy", F.lit(place).alias("place"))
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("id", "start", "end").orderBy("place", "name", "type", "strategy")
    return without_overlaps(cross_validated(found.withColumn("rank", F.row_number().over(order)).where("rank = 1")))
