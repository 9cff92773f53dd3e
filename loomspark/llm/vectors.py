"""Embedding near-dedup: all pairs of equal label and a cosine over the threshold, by PCA-ordered tiles.

Vectors are rotated to their principal axes, so the leading dimensions hold most of the length. Two unit vectors can't be
nearer to one another than their angles to the first axis are, so a label's vectors are ordered by that angle in cells, and
only cells within the threshold's angle are compared. A cell's vectors are dealt to blocks of bounded size, and each pair of
blocks is a task's tile. In a tile the product over the leading dimensions is taken first; what the others can add is bounded
by the product of the suffix norms, and a pair is given up as soon as sum and bound stay under the threshold. Those left are
decided by the cosine of the original vectors in double precision, scaled by powers of two, so that no norm overflows.
A tile returns sums of links and one link to a representative for each of its vectors, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import components, written

STEPS = (8, 16, 32)
#: Cells to the threshold's angle; finer ones leave fewer pairs beside the band that is compared.
CELLS = 4
SLACK = 1e-9  # of rounding in the rotated products; the decision itself is exact


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows with a largest component between a half and one; powers of two change no cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, rows in _by_size(batch.column(0)):
            x = _unit(rows)
            sums[size] = sums.get(size, 0) + x.T @ x
    for size, total in sums.items():
        n = size * size
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(total.ravel())], ["size", "at", "value"])


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    rows = column.to_pylist()
    for size in sorted({len(r) for r in rows}):
        yield size, np.array([r for r in rows if len(r) == size], np.float64)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By length of vector: the axes as columns, the one of most variance first. Only length ** 2 sums reach the driver."""
    sums = vectors.select("embedding").mapInArrow(_moments, "size int, at int, value double").groupBy("size", "at").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for size, part in sums.groupby("size"):
        total = np.zeros(size * size)
        total[part["at"].to_numpy()] = part["value"].to_numpy()
        out[int(size)] = np.linalg.eigh(total.reshape(size, size))[1][:, ::-1].copy()
    return out


def _angles(axes: dict[int, np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, angle = batch.column(batch.num_columns - 1).to_pylist(), np.zeros(batch.num_rows)
            for size in {len(r) for r in rows}:
                own = [k for k, r in enumerate(rows) if len(r) == size]
                angle[own] = np.arccos(np.clip(_unit(np.array([rows[k] for k in own], np.float64)) @ axes[size][:, 0], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle)], names)

    return run


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The places (in x, in y) of the pairs whose cosine reaches the threshold; of one block with itself, each pair once."""
    x, y = scaled(x), scaled(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    tail = lambda w, k: np.sqrt(np.maximum((w[:, k:] ** 2).sum(1), 0))
    steps = [s for s in STEPS if s < x.shape[1]]
    first = steps[0] if steps else x.shape[1]
    bound = u[:, :first] @ v[:, :first].T
    bound += np.outer(tail(u, first), tail(v, first))
    bound = bound >= threshold - SLACK
    if same:
        bound = np.triu(bound, 1)
    a, b = np.nonzero(bound)
    out = [(a[:0], b[:0])]
    for lo in range(0, len(a), 1 << 15):
        p, q = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
        total = np.einsum("ij,ij->i", u[p, :first], v[q, :first])
        for k, s in enumerate(steps[1:]):
            total = total + np.einsum("ij,ij->i", u[p, steps[k] : s], v[q, steps[k] : s])
            keep = total + tail(u, s)[p] * tail(v, s)[q] >= threshold - SLACK
            p, q, total = p[keep], q[keep], total[keep]
        keep = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
        out.append((p[keep], q[keep]))
    return np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])


def _tile(axes: dict[int, np.ndarray], threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        ids, block, weight = (rows.column(c).to_numpy() for c in ("rep", "block", "copies"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        x = np.array(rows.column("embedding").to_pylist(), np.float64)
        cell, c, d = rows.column("cell").to_numpy(), rows.column("ci")[0].as_py(), rows.column("cj")[0].as_py()
        left, right = np.flatnonzero((cell == c) & (block == i)), np.flatnonzero((cell == d) & (block == j))
        p, q = linked_pairs(x[left], x[right], axes[x.shape[1]], threshold, (c, i) == (d, j))
        a, b = left[p], right[q]
        links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        low = np.argsort(np.argsort(ids))  # the least id of those connected, by its rank
        while True:
            before = low.copy()
            np.minimum.at(low, a, before[b])
            np.minimum.at(low, b, before[a])
            if (low == before).all():
                break
        some = np.flatnonzero(links > 0)
        return pa.table({"h1": rows.column("h1").take(pa.array(some)), "h2": rows.column("h2").take(pa.array(some)), "rep": ids[some], "links": links[some].astype(np.int64), "to": np.sort(ids)[low[some]]})

    return run


def dealt_tiles(classes: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """``classes(h1, h2, rep, copies, label, embedding, angle)`` once for each tile (label, ci, i, cj, j) that they are in.

    A cell of a label is a range of angles; cells further apart than the threshold's angle meet in no tile. A label that
    fits one block is one cell. The table of cells has a row for each of at most pi * CELLS / angle cells of a label.
    """
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    sizes = classes.groupBy("label").agg(F.count("*").alias("rows"))
    small = F.col("rows") <= block_rows
    cell = F.when(small, 0).otherwise(F.floor(F.col("angle") * (CELLS / reach))).cast("int")
    placed = classes.join(sizes, "label").withColumn("cell", cell)
    blocks = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    near = blocks.select("label", F.col("cell").alias("other"), F.col("blocks").alias("theirs"))
    ways = blocks.join(near, "label").where(F.abs(F.col("cell") - F.col("other")) <= CELLS).groupBy("label", "cell", "blocks").agg(F.collect_list(F.struct("other", "theirs")).alias("ways"))
    dealt = placed.join(ways, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep", "h1"), F.col("blocks")).cast("int"))
    met = F.flatten(F.transform("ways", lambda w: F.transform(F.sequence(F.lit(0), w.theirs - 1), lambda k: F.struct(w.other.alias("cell"), k.alias("block")))))
    own = F.struct("cell", "block")
    low, high = F.least(own, F.col("met")), F.greatest(own, F.col("met"))
    out = dealt.withColumn("met", F.explode(met))
    return out.select("h1", "h2", "rep", "copies", "label", "embedding", "cell", "block", low.cell.alias("ci"), low.block.alias("i"), high.cell.alias("cj"), high.block.alias("j"))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, block_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row: links are pairs of equal label with cosine >= ``threshold``.

    Vectors that are null, empty, zero or hold a null or a value that isn't finite, and those without a label or id, link with
    nothing; so do vectors of different lengths. Equal vectors of a label are compared once and counted as often as they
    occur; rows with one id are vectors of their own that share a component. Other columns aren't read. An empty table gives
    an empty one.
    """
    plain = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0)
    keyed = plain.select("id", "label", "embedding", F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "label", "embedding").alias("h2"))
    classes = keyed.where("usable").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = written(classes.select("h1", "h2", "rep", "copies", F.concat_ws(":", F.size("embedding"), F.col("label").cast("string")).alias("label"), "embedding"), "vectors")
    axes = principal_axes(classes)
    schema = "h1 bigint, h2 bigint, rep bigint, copies bigint, label string, embedding array<double>, angle double"
    tiles = dealt_tiles(classes.mapInArrow(_angles(axes, [x.split()[0] for x in schema.split(", ")]), schema), threshold, block_rows)
    found = written(tiles.groupBy("label", "ci", "i", "cj", "j").applyInArrow(_tile(axes, threshold), "h1 bigint, h2 bigint, rep bigint, links bigint, to bigint"), "found")
    copies = keyed.where("usable").join(classes.select("h1", "h2", "rep", "copies"), ["h1", "h2"])
    at = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")).unionByName(copies.where("copies > 1").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()))
    sums = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    linked = classes.join(sums, ["h1", "h2"], "left").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = keyed.select("id", F.when(F.col("usable"), F.col("h1")).alias("h1"), F.when(F.col("usable"), F.col("h2")).alias("h2")).join(linked, ["h1", "h2"], "left").join(at, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
