"""Mentions of entities in chunks and the joins over them, terminology lookups, query expansion and fusion.

Dictionaries are DataFrames that the caller brings; a side is broadcast only if its rows were counted first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.fusion import normal_name

BROADCAST_ROWS = 200_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; without one otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def mentions(chunks: DataFrame, dictionary: DataFrame, least: int = 2) -> DataFrame:
    """(chunk_id, document_id, chunk_index, name, type, n): how often each name of ``dictionary(name, type)`` is a word of a chunk.

    Words are runs of a-z after lower-casing, of ``least`` letters or more; shorter ones are never exploded.
    """
    words = F.regexp_extract_all(F.lower("content"), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    each = chunks.select("chunk_id", "document_id", "chunk_index", F.explode(words).alias("name"))
    return each.join(few(dictionary), "name").groupBy("chunk_id", "document_id", "chunk_index", "name", "type").agg(F.count("*").alias("n"))


def chunk_neighbours(chunks: DataFrame, k: int = 1) -> DataFrame:
    """(chunk_id, other_id, distance) of the chunks of one document up to ``k`` places apart: an interval join as an equi-join on the places."""
    steps = F.explode(F.array(*[F.lit(d) for d in range(-k, k + 1) if d])).alias("distance")
    near = chunks.select("chunk_id", "document_id", "chunk_index", steps).select("chunk_id", "document_id", (F.col("chunk_index") + F.col("distance")).alias("chunk_index"), "distance")
    return near.join(chunks.select("document_id", "chunk_index", F.col("chunk_id").alias("other_id")), ["document_id", "chunk_index"]).select("chunk_id", "other_id", "distance")


def pairs_by_type(found: DataFrame, ontology: DataFrame) -> DataFrame:
    """(a, b, n): chunks in which two names meet whose types ``ontology(src_type, dst_type)`` lets be related. A chunk's names are bounded by its length."""
    a = found.select("chunk_id", F.col("name").alias("a"), F.col("type").alias("src_type"))
    b = found.select("chunk_id", F.col("name").alias("b"), F.col("type").alias("dst_type"))
    return a.join(F.broadcast(ontology), "src_type").join(b, ["chunk_id", "dst_type"]).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def name_index(terms: DataFrame) -> DataFrame:
    """(key, code) from ``terms(code, name, synonyms array)``: normal names first, the last code of equal ones; then synonyms, the first code of equal ones."""
    names = terms.groupBy(normal_name(F.col("name")).alias("key")).agg(F.max("code").alias("named"))
    others = terms.select("code", F.explode("synonyms").alias("s")).groupBy(normal_name(F.col("s")).alias("key")).agg(F.min("code").alias("other"))
    return names.join(others, "key", "full").select("key", F.coalesce("named", "other").alias("code")).where("key <> ''")


def lookup(names: DataFrame, index: DataFrame) -> DataFrame:
    """``names(name)`` with the code of their normal form; null where there is none."""
    return names.withColumn("key", normal_name(F.col("name"))).join(few(index), "key", "left").drop("key")


def expand_names(names: DataFrame, terms: DataFrame) -> DataFrame:
    """``names(name)`` with expanded: the name, then its term's synonyms, each once."""
    found = lookup(names, name_index(terms)).join(terms.select("code", "synonyms"), "code", "left")
    return found.select("name", F.array_distinct(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("expanded"))


def term_scores(queries: DataFrame, terms: DataFrame, limit: int = 10) -> DataFrame:
    """(query, code, score): ``terms(code, name, synonyms, description)`` for each of a few ``queries(query)``, best first, ``limit`` a query.

    Equal code 1, code prefix 0.9, equal name 0.8, name prefix 0.7, in the name 0.6, a synonym or the description holds it 0.5.
    """
    q, code, name = F.lower("query"), F.lower("code"), F.lower("name")
    loose = F.exists("synonyms", lambda s: F.contains(F.lower(s), q)) | F.contains(F.lower("description"), q)
    score = F.when(code == q, 1.0).when(F.startswith(code, q), 0.9).when(name == q, 0.8).when(F.startswith(name, q), 0.7).when(F.contains(name, q), 0.6).when(loose, 0.5)
    found = terms.join(F.broadcast(queries), score.isNotNull()).withColumn("score", score)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "code")
    return found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= limit).select("query", "code", "score")


def link_codes(entities: DataFrame, codes: DataFrame, only: str) -> DataFrame:
    """``entities(name, types array)`` with the code of their name, for those of the type ``only``."""
    found = entities.join(few(codes.select("name", F.col("code").alias("_code"))), "name", "left")
    return found.withColumn("code", F.when(F.array_contains("types", only), F.col("_code"))).drop("_code")


def fuse(entities: DataFrame, relations: DataFrame, ontology: DataFrame) -> DataFrame:
    """``relations(source, target, type)`` whose ends are entities (name, types array) with a pair of types that ``ontology`` allows."""
    a = entities.select(F.col("name").alias("source"), F.explode("types").alias("src_type"))
    b = entities.select(F.col("name").alias("target"), F.explode("types").alias("dst_type"))
    allowed = ontology.select("src_type", F.col("relation").alias("type"), "dst_type")
    return relations.join(a, "source").join(b, "target").join(F.broadcast(allowed), ["src_type", "type", "dst_type"]).select("source", "target", "type").distinct()


def expand_query(question: Column, synonyms: dict[str, list[str]], limit: int = 6) -> Column:
    """The question and its variants, one term at a time by each of its synonyms; longer terms first, each variant once, ``limit`` at most."""
    variants = [F.array(question)]
    for term in sorted(synonyms, key=lambda t: (-len(t), t)):
        for other in synonyms[term]:
            variants.append(F.when(F.contains(question, F.lit(term)), F.array(F.replace(question, F.lit(term), F.lit(other)))).otherwise(F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.concat(*variants)), 1, limit)


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern is found in the text."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(F.regexp_like(text, F.lit(pattern)), name).otherwise(out)
    return out


def claims(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The reasons of all rules whose pattern is found in the text, in their order."""
    return F.filter(F.array(*[F.when(F.regexp_like(text, F.lit(p)), name) for name, p in rules]), lambda r: r.isNotNull())


def decompose(question: Column, conjunctions: list[str]) -> Column:
    """The parts of a question at the first conjunction of the list that it holds; blank parts out, the whole if there is none."""
    out = F.array(question)
    for word in reversed(conjunctions):
        parts = F.filter(F.transform(F.split(question, re.escape(word), -1), lambda p: F.trim(p)), lambda p: p != "")
        out = F.when(F.contains(question, F.lit(word)), parts).otherwise(out)
    return out


def shown(names: Column, top: int = 3) -> Column:
    """The first names of a list, and how many there are where some are left out."""
    return F.concat(F.array_join(F.slice(names, 1, top), "、"), F.when(F.size(names) > top, F.concat(F.lit("等"), F.size(names).cast("string"), F.lit("个"))).otherwise(""))


def entity_summaries(nodes: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """(node_id, summary): label and name, then each relation with its first targets. Targets of a relation are kept to ``top`` before they meet."""
    rank = Window.partitionBy("src", "type").orderBy("dst")
    first = edges.select("src", "type", "dst").distinct().withColumn("k", F.row_number().over(rank)).where(F.col("k") <= top)
    counts = edges.groupBy("src", "type").agg(F.countDistinct("dst").alias("n"))
    said = first.groupBy("src", "type").agg(F.array_join(F.array_sort(F.collect_list("dst")), "、").alias("t")).join(counts, ["src", "type"])
    said = said.select("src", "type", F.concat("type", F.lit(": "), "t", F.when(F.col("n") > top, F.concat(F.lit("等"), F.col("n").cast("string"), F.lit("个"))).otherwise("")).alias("part"))
    parts = said.groupBy(F.col("src").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "part"))), lambda x: x.part), "; ").alias("relations"))
    x = nodes.join(parts, "node_id", "left")
    return x.select("node_id", F.concat_ws(" | ", F.concat("label", F.lit(": "), "name"), F.when(F.col("relations").isNotNull(), F.concat(F.lit("关系: "), "relations"))).alias("summary"))


def community_summaries(partition: DataFrame, top: int = 10) -> DataFrame:
    """(community, size, summary) of ``partition(node, community, degree)``: its size and its ``top`` members by degree."""
    rank = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    first = partition.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= top)
    named = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x.node), "、").alias("members"))
    sizes = partition.groupBy("community").agg(F.count("*").alias("size"))
    return sizes.join(named, "community").select("community", "size", F.concat(F.lit("社区 "), "community", F.lit(" ("), F.col("size").cast("string"), F.lit("): "), "members").alias("summary"))
