"""What several of the operators share: written tables that cut lineage, vectorised word hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words everywhere in this subpackage: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a new local one in local mode alone, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomspark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Spark removes the shuffle files of a query when it ends, if this is set; nothing reads those of a table that is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomspark_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later result reads."""
    for df in tables:
        path = getattr(df, "_loomspark_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Columns:
    """A table's columns under names of our own, so that no name of the caller's can clash with one of an operator's.

    ``df`` has c0, c1, ... for those kept; columns named as one of ``new`` (in any case) are left out. at() finds a column by
    its name, in the same case first; back() gives the kept columns their names again, followed by ``new``.
    """

    def __init__(self, docs: DataFrame, new: tuple[str, ...] = ()):
        self.names, self.new = docs.columns, new
        self.keep = [k for k, c in enumerate(self.names) if c.lower() not in {n.lower() for n in new}]
        self.own = [f"c{k}" for k in self.keep]
        self.df = docs.toDF(*[f"c{k}" for k in range(len(self.names))]).select(*self.own)

    def at(self, name: str) -> str:
        found = [k for k in self.keep if self.names[k] == name] or [k for k in self.keep if self.names[k].lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name} among {self.names}")
        return f"c{found[0]}"

    def fields(self, *more: str) -> str:
        return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in self.df.schema.fields), *more])

    def back(self, df: DataFrame) -> DataFrame:
        return df.toDF(*[self.names[k] for k in self.keep], *self.new)


# --- vectorised hashes ------------------------------------------------------------------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for the next call up to about a million."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        steps = np.full(max(n, 1 << 12), _U(base), _U)
        steps[0] = 1
        found = np.multiply.accumulate(steps)
        if n <= 1 << 20:
            _powers[base] = found
    return found[:n]


def text_blocks(texts: pa.Array, block: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offset of each row and of the end) for runs of rows of about ``block`` bytes. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, offset of each row among the words) of all words in a block of texts."""
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]  # a word doesn't go on into the next row's text
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_MASK = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 8)), (1 << 64) - 1], _U)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offset of each row among the words); ``lower`` folds A-Z.

    A word is read in blocks of eight bytes, each mixed with its place before they are summed: unlike a polynomial of the
    bytes, no regular pair of words is equal.
    """
    starts, ends, rows = words_of(data, offsets)
    if not len(starts):
        return np.zeros(0, _U), rows
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWERED[data] if lower else data
    every = np.ndarray((len(data),), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    blocks = (ends - starts + 7) >> 3
    first = np.cumsum(blocks) - blocks
    step = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * step
    with np.errstate(over="ignore"):
        values = (every[at] & _MASK[np.minimum(np.repeat(ends, blocks) - at, 8)]) ^ mix((step + 1).astype(_U) * _BASE)
        return mix(np.add.reduceat(mix(values), first) + (ends - starts).astype(_U) * _BASE), rows


def window_hashes(words: np.ndarray, width: int, base: int = WORD_BASES[0]) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive word hashes."""
    n = len(words)
    if n < width:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, _U)
        np.cumsum(words * powers(base, n), out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * powers(pow(base, -1, 1 << 64), n)[: n - width + 1])


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list array from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.int32()), pa.array(values, kind) if kind else pa.array(values))


# --- connected components ---------------------------------------------------------------------------------------------


@contextmanager
def partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffle partitions for a table of ``rows`` rows within the block, and the session's number at most: small steps needn't be many tasks."""
    conf = "spark.sql.shuffle.partitions"
    most = spark.conf.get(conf)
    spark.conf.set(conf, str(min(int(most), rows // 4096 + 1)))
    try:
        yield
    finally:
        spark.conf.set(conf, most)


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over ``edges(u > v)``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return large.join(least, "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component_id) of every node of ``links(a, b)``: the smallest id reachable. RuntimeError if ``max_rounds`` don't settle it.

    Each round joins links with the least neighbour of a node, which is found with partial sums on the map side; the rounds
    grow with the logarithm of the longest path. A hub's links (16 bytes each) meet in a join whose other side has one row a
    node, so adaptive execution splits a skewed hub. Shuffle partitions are set by the number of links, up to the session's.
    """
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    now = state(edges)
    with partitions_for(links.sparkSession, now[0]):
        for _ in range(max_rounds):
            before, edges = edges, written(_star_round(edges), "links")
            dropped(before)
            seen, now = now, state(edges)
            if now == seen:
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()
