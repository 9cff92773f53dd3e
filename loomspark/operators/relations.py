"""Relation texts aligned with an ontology's relations, and the fusion of entities and relations as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.fulltext import containing
from loomspark.operators.fusion import normalise
from loomspark.operators.graph import _cut
from loomspark.operators.knowledge import few

#: Relation texts that are compared as literals; more are joined.
FEW_TEXTS = 1000


def align(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(text, relation) of each distinct text of ``texts(text)``: the relation of the longest phrase that it contains or is contained in.

    ``phrases(phrase, relation, ord)``: of phrases of one length the least ``ord`` goes first, then the least relation. Spaces at the ends
    of a text don't count; a text without a phrase is its own relation, an empty one is in every phrase. A null text has no row. Candidates of both directions
    come from indexes of q-grams, so no text meets a phrase with which it shares none.
    """
    each = _cut(texts.where("text is not null").select("text", F.trim("text").alias("bare")).distinct())  # the texts are read once
    held = containing(each.select(F.col("bare").alias("id"), F.col("bare").alias("text")).distinct(), phrases.select(F.col("phrase").alias("keyword")))
    holds = containing(phrases.select(F.col("phrase").alias("id"), F.col("phrase").alias("text")).distinct(), each.select(F.col("bare").alias("keyword")))
    pairs = held.select(F.col("id").alias("bare"), F.col("keyword").alias("phrase")).unionByName(holds.select(F.col("keyword").alias("bare"), F.col("id").alias("phrase"))).distinct()
    rank = F.struct((-F.length("phrase")).alias("size"), "ord", "relation")
    best = pairs.join(few(phrases), "phrase").groupBy("bare").agg(F.min(rank).alias("best")).select("bare", F.col("best.relation").alias("found"))
    longest = phrases.agg(F.min(rank).alias("best")).select(F.lit("").alias("bare"), F.col("best.relation").alias("found"))
    return each.join(best.unionByName(longest), "bare", "left").select("text", F.coalesce("found", "bare").alias("relation"))


def fuse(entities: DataFrame, relations: DataFrame, abbreviations: DataFrame, synonyms: DataFrame, phrases: DataFrame, ontology: DataFrame, source_type: str = "Disease", target_type: str = "Symptom", texts: DataFrame | None = None) -> DataFrame:
    """(source, target, relation), each once: ``relations(source, source_type, target, target_type, type)`` over fused ``entities(name, type)``.

    Names get their canonical form (fusion.normalise), where a relation's end without a type counts as ``source_type`` or
    ``target_type``; relation texts are aligned; and a relation stays if both ends are entities and the ontology
    (src_type, relation, dst_type) allows it for some of their types, a null dst_type for any. Entities of one canonical name share their types.
    ``texts(text)`` tells the relation texts, more than those if need be, where that is cheaper than from ``relations``.
    """
    abbreviations, synonyms = few(abbreviations), few(synonyms)
    known = normalise(entities.select("name", "type").distinct(), abbreviations, synonyms).select("canonical", "type").distinct()
    aligned = align(relations.select(F.col("type").alias("text")) if texts is None else texts, phrases)
    aligned = _cut(aligned.join(few(ontology.select("relation").distinct()), "relation", "left_semi"))  # no others can stay
    some = aligned.limit(FEW_TEXTS + 1).collect()
    if not some:
        x = relations.where(F.lit(False)).withColumn("relation", F.lit(""))
    elif len(some) <= FEW_TEXTS:  # as literals they go down to where the relations are read
        told = F.create_map(*[F.lit(v) for r in some for v in (r["text"], r["relation"])])
        x = relations.where(F.col("type").isin(*[r["text"] for r in some])).withColumn("relation", F.element_at(told, F.col("type")))
    else:
        x = relations.join(few(aligned.withColumnRenamed("text", "type")), "type")

    def named(df: DataFrame, name: str, kind: str, default: str) -> DataFrame:
        """``df`` with the canonical form of a name in its place."""
        others = tuple(c for c in df.columns if c not in (name, kind))
        each = df.select(F.col(name).alias("name"), F.coalesce(kind, F.lit(default)).alias("type"), *others)
        return normalise(each, abbreviations, synonyms, others).select(F.col("canonical").alias(f"{name}_name"), *others)

    x = x.select("source", "source_type", "target", "target_type", "relation")
    x = named(named(x, "source", "source_type", source_type), "target", "target_type", target_type)
    x = x.select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "relation").distinct()
    of = lambda name, kind: known.select(F.col("canonical").alias(name), F.col("type").alias(kind))
    rules = few(ontology.select("src_type", "relation", F.col("dst_type").alias("allowed")))
    fits = x.join(of("source", "src_type"), "source").join(rules, ["src_type", "relation"]).join(of("target", "dst_type"), "target").where("allowed is null or allowed = dst_type")
    return fits.select("source", "target", "relation").distinct()
