"""Name normalisation, similarity, relation alignment and terminology search. Dictionaries are DataFrames that the caller brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    return F.replace(F.trim(F.lower(name)), F.lit(" "), F.lit(""))


def normalise(entities: DataFrame, abbreviations: DataFrame, synonyms: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``entities(name, type)`` with canonical: an abbreviation (exact), else a synonym of the type (any case), else the name; also the columns ``keep``."""
    x = entities.join(abbreviations.select(F.col("abbr").alias("name"), F.col("canonical").alias("_a")), "name", "left")
    s = synonyms.select(F.lower("synonym").alias("_s"), F.col("entity_type").alias("type"), F.col("canonical").alias("_c"))
    x = x.withColumn("_s", F.lower("name")).join(s, ["_s", "type"], "left")
    return x.select("name", "type", *keep, F.coalesce("_a", "_c", "name").alias("canonical"))


def similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if one contains the other, else the share of ``a``'s characters found in ``b`` of the longer length."""
    common = F.size(F.filter(F.split(a, ""), lambda c: (c != "") & F.contains(b, c)))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(common / F.greatest(F.length(a), F.length(b)))


def align_relations(relations: DataFrame, phrases: DataFrame) -> DataFrame:
    """``relations(id, text)`` with the relation of the longest phrase that contains or is contained; ties by ``ord``, else the text."""
    hit = F.contains(F.col("text"), F.col("phrase")) | F.contains(F.col("phrase"), F.col("text"))
    x = relations.join(phrases, hit, "left")
    w = Window.partitionBy("id").orderBy(F.desc(F.length("phrase")), "ord")
    return x.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("id", "text", F.coalesce("relation", "text").alias("relation"))


def disambiguate(entities: DataFrame) -> DataFrame:
    """``entities(canonical, name, type, ord)`` grouped by canonical name: ordered unique types and names."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "type", "name")))
    x = entities.groupBy("canonical").agg(rows.alias("r"))
    return x.select("canonical", F.array_join(F.array_distinct(F.transform("r", lambda e: e["type"])), ",").alias("types"), F.array_join(F.array_distinct(F.transform("r", lambda e: e["name"])), ",").alias("names"))


def valid_relations(relations: DataFrame, ontology: DataFrame, rows: int = 200_000) -> DataFrame:
    """Relations (src_type, relation, dst_type) that the ontology allows.

    Up to ``rows`` rows of it are broadcast: dealt by types, all relations of one kind would meet in one task.
    """
    small = ontology.limit(rows + 1).count() <= rows
    return relations.join(F.broadcast(ontology) if small else ontology, ["src_type", "relation", "dst_type"], "left_semi")


def search_terms(terms: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """``terms(code, name)`` ranked: equal code 1, code prefix 0.9, equal name 0.8, name prefix 0.7, name contains 0.6."""
    q = query.lower()
    code, name = F.lower("code"), F.lower("name")
    score = F.when(code == q, 1.0).when(F.startswith(code, F.lit(q)), 0.9).when(name == q, 0.8).when(F.startswith(name, F.lit(q)), 0.7).when(F.contains(name, F.lit(q)), 0.6)
    return terms.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "code").limit(limit)
