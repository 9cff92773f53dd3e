"""Vector top-k, hybrid ranking and rule-based routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHAS = {"disease_query": 0.6, "drug_query": 0.4, "symptom_query": 0.7}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector_topk(vectors: DataFrame, query: DataFrame, k: int = 10, threshold: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest by exact cosine to the one row of ``query(vector)``; ties by id. Its one row is broadcast."""
    scored = vectors.join(F.broadcast(query.limit(1))).select(id_col, F.round(cosine(F.col(vector_col), F.col("vector")), 6).alias("similarity"))
    scored = scored.where("similarity is not null" if threshold is None else F.col("similarity") > threshold)
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def hybrid_combine(vector_hits: DataFrame, graph_hits: DataFrame, alpha: float = 0.5, limit: int = 15) -> DataFrame:
    """Chunk-level merge: alpha * (similarity / best) + (1 - alpha) * entity_score, overlaps added; ties by chunk_id."""
    best = Window.partitionBy(F.lit(1))
    v = vector_hits.groupBy("chunk_id").agg(F.max("similarity").alias("similarity")).withColumn("v", F.col("similarity") / F.max("similarity").over(best))
    g = graph_hits.groupBy("chunk_id").agg(F.max("entity_score").alias("g"))
    x = v.join(g, "chunk_id", "full").select("chunk_id", F.coalesce("v", F.lit(0.0)).alias("vector_score"), F.coalesce("g", F.lit(0.0)).alias("graph_score"))
    return x.withColumn("combined", F.round(alpha * F.col("vector_score") + (1 - alpha) * F.col("graph_score"), 6)).orderBy(F.desc("combined"), "chunk_id").limit(limit)


def alpha_for(intent: Column) -> Column:
    """The weight of vectors by intent; 0.5 for others."""
    out = F.lit(0.5)
    for name, value in ALPHAS.items():
        out = F.when(intent == name, value).otherwise(out)
    return out


def route(question: Column, wide: list[str], narrow: list[str], numeric: list[str]) -> Column:
    """global, local or hybrid by counts of keywords: more wide ones, more narrow ones, any numeric one, a tie, none."""
    count = lambda words: sum((F.contains(F.lower(question), F.lit(w)).cast("int") for w in words), F.lit(0))
    g, n, x = count(wide), count(narrow), count(numeric)
    return F.when(g > n, "global").when(n > g, "local").when(x > 0, "local").when(g > 0, "local").otherwise("hybrid")


def route_alpha(routed: Column) -> Column:
    return F.when(routed == "global", 0.2).when(routed == "local", 0.7).otherwise(0.5)


def first_per(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def mean_vectors(vectors: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """The mean of each group's vectors."""
    each = vectors.select(by, F.posexplode(vector_col).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("vector"))


def entity_merge(vector_hits: DataFrame, entities: DataFrame, alpha: float = 0.5, limit: int = 20) -> DataFrame:
    """(id, origin, combined): chunks by alpha * similarity / best, entities(name, score) by (1 - alpha) * score, with no sums; a chunk's id goes before a name's."""
    best = vector_hits.agg(F.max("similarity").alias("best"))
    v = vector_hits.join(F.broadcast(best)).groupBy(F.col("chunk_id").alias("id")).agg(F.round(F.max(F.col("similarity") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)) * alpha, 6).alias("combined"))
    g = entities.groupBy(F.col("name").alias("id")).agg(F.round(F.max("score") * (1 - alpha), 6).alias("combined")).join(v.select("id"), "id", "left_anti")
    both = v.select("id", F.lit("vector").alias("origin"), "combined").unionByName(g.select("id", F.lit("graph").alias("origin"), "combined"))
    return both.orderBy(F.desc("combined"), "id").limit(limit)


def late_chunks(placed: DataFrame) -> DataFrame:
    """``placed(start, end, embedding)``, shares of a document and its vector, with lo, hi and pooled: the mean of that part of the vector, or of all of it if the part is empty."""
    n = F.size("embedding")
    x = placed.withColumns({"lo": F.floor(n * F.col("start")).cast("int"), "hi": F.floor(n * F.col("end")).cast("int")})
    part = F.when(F.col("hi") > F.col("lo"), F.slice("embedding", F.col("lo") + 1, F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))).otherwise(F.col("embedding"))
    return x.withColumn("pooled", F.aggregate(part, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(part))
