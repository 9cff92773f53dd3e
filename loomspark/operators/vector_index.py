"""A vector index of cells: k-means centres, a table partitioned by cell, and each cell's radius, which bounds what it can hold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.graph import _cut, _drop
from loomspark.operators.knowledge import few
from loomspark.operators.retrieval import dot

#: Most cells that an index may have: their centres are one table of a known size, which each search broadcasts.
MOST_CELLS = 4096
#: Vectors of a cell, and queries, that meet in one block.
BLOCK_MEMBERS, BLOCK_QUERIES = 4096, 4096


def _direction(vector) -> np.ndarray | None:
    if vector is None or not len(vector):
        return None
    x = np.array(vector, np.float64)  # a null in it becomes not a number
    most = np.abs(x).max()
    if not np.isfinite(most) or most == 0:
        return None
    x = x / most  # before any square, which could overflow
    return x / np.sqrt(x @ x)


def _unit(vector: Column) -> Column:
    """The vector in double precision, divided by its length; null where it is null, empty or zero or holds what is no number."""

    @F.pandas_udf("array<double>")
    def unit(vectors: pd.Series) -> pd.Series:
        return vectors.map(_direction)

    return unit(vector)


def _nearest(centres: np.ndarray):
    """A function of unit vectors that gives the cell of the nearest of ``centres``, the first of equally near ones, and its cosine."""

    @F.pandas_udf("cell int, cos double")
    def cell(units: pd.Series) -> pd.DataFrame:
        cos = np.stack(units.to_list()) @ centres.T if len(units) else np.zeros((0, len(centres)))
        best = cos.argmax(axis=1)
        return pd.DataFrame({"cell": best.astype(np.int32), "cos": cos[np.arange(len(best)), best]})

    return cell


def _angle(cosine: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


@dataclass(frozen=True)
class VectorIndex:
    """members(cell, id, unit), written in a folder for each cell, and cells(cell, centre, radius, n)."""

    members: DataFrame
    cells: DataFrame

    def drop(self) -> None:
        _drop(self.members, self.cells)


def build_vector_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, fit_rows: int = 200_000, seed: int = 1) -> VectorIndex:
    """The index of all ``vectors`` with a direction; null, zero and non-finite ones are in no cell.

    The centres are fitted on the ``fit_rows`` vectors of the least hashes, which is all of them in a smaller table; every vector
    is then put in the cell of its nearest centre. ``cells`` is the square root of their number by default; two at least, MOST_CELLS at most.
    """
    units = _cut(vectors.select(F.col(id_col).alias("id"), _unit(F.col(vector_col)).alias("unit")).where("unit is not null"))
    n = units.count()
    count = max(2, min(cells or round(n**0.5), MOST_CELLS, n))
    if n:
        sample = units if n <= fit_rows else units.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(fit_rows)
        model = KMeans(k=count, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample.select(array_to_vector("unit").alias("features")))
        centres = np.array([c for c in model.clusterCenters() if np.any(c)], np.float64)
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        put = units.select("id", "unit", _nearest(centres)("unit").alias("to")).select("to.cell", "id", "unit", "to.cos")
    else:
        centres = np.zeros((0, 1))
        put = units.select(F.lit(0).alias("cell"), "id", "unit", F.lit(0.0).alias("cos"))
    titles = vectors.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    members = _cut(put.repartition("cell"), "cell")
    sizes = members.groupBy("cell").agg(F.count("*").alias("n"), F.max(_angle(F.col("cos"))).alias("radius"))
    _drop(units)
    return VectorIndex(members, _cut(sizes.join(F.broadcast(titles), "cell").select("cell", "centre", "radius", "n")))


def _best_of_block(k: int):
    """(query_id, id, dot) of a block's members and queries: each query's ``k`` best, with all that six decimals can't tell from them, none below its ``sure``."""

    def best(members: pa.Table, asked: pa.Table) -> pa.Table:
        ids, query_ids, sure = members["id"].to_numpy(), asked["query_id"], asked["sure"].to_numpy()
        out_q, out_m, out = [], [], []
        if len(ids) and len(sure):
            rows = lambda c: c.combine_chunks().flatten().to_numpy().reshape(len(c), -1)
            a, b = rows(members["unit"]), rows(asked["q"])
            for at in range(0, len(b), 512):
                dots = b[at : at + 512] @ a.T
                least = np.partition(dots, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(dots), -np.inf)
                q, m = np.nonzero(dots >= np.maximum(least, sure[at : at + 512])[:, None] - 2e-6)
                out_q.append(q + at), out_m.append(m), out.append(dots[q, m])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query_id": query_ids.take(pa.array(join(out_q, np.int64))), "id": pa.array(ids[join(out_m, np.int64)]), "dot": pa.array(join(out, np.float64))})

    return best


def search_vectors(index: VectorIndex, queries: DataFrame, k: int = 10, share: float | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest to each of ``queries(query_id, vector)`` by cosine, rounded to six decimals, ties by id.

    With ``share`` the cells of that share of the centres are read, the nearest ones, rounded up; what recall it gives depends on
    the vectors. Without, the result is exact: the nearest cells that hold
    ``k`` vectors tell a similarity that the answer reaches, and then every cell is read that, by the angle to its centre and its radius,
    could hold one as near. Queries without a direction have no rows.
    """
    asked = _cut(queries.select("query_id", _unit(F.col("vector")).alias("q")).where("q is not null"))
    seen = asked.join(F.broadcast(index.cells)).select("query_id", "q", "cell", "n", dot(F.col("q"), F.col("centre")).alias("cos"), "radius")
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "cell")  # the cells of one query, MOST_CELLS at most
    seen = seen.withColumns({"place": F.row_number().over(order), "before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    seen = _cut(seen.withColumn("bound", F.cos(F.greatest(F.lit(0.0), _angle(F.col("cos")) - F.col("radius") - 1e-7))).drop("radius"))

    parts = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    members = index.members.join(F.broadcast(index.cells.select("cell", parts.alias("parts"))), "cell")
    sides = max(1, -(-asked.count() // BLOCK_QUERIES))
    members = members.select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"), "id", "unit")
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("query_id",)} | {"id": index.members.schema["id"].dataType.simpleString()}

    def nearest(cells: DataFrame) -> DataFrame:
        """Blocks of a cell's members meet blocks of queries, and hand on the best of each query alone."""
        side = F.pmod(F.xxhash64("query_id"), F.lit(sides)).cast("int").alias("side")
        wanted = cells.select("query_id", "q", F.coalesce("sure", F.lit(-2.0)).alias("sure"), "cell", side, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        key = ("cell", "part", "side")
        met = members.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(_best_of_block(k), f"query_id {kinds['query_id']}, id {kinds['id']}, dot double")
        hits = met.select("query_id", "id", F.round("dot", 6).alias("similarity"))
        top = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return hits.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)

    if share:
        seen = seen.where(F.col("place") < index.cells.count() * share + 1)
    first = nearest(seen.where(F.col("before") < k).withColumn("sure", F.lit(None).cast("double")))
    sure = first.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("sure"))
    return nearest(seen.join(few(_cut(sure)), "query_id", "left").where("sure is null or bound >= sure - 1e-6"))
