"""N-gram Jaccard join: all documents whose word-shingle sets are similar, by universe partition and pigeonhole.

Every shingle is a 64-bit value, and its high bits deal it to one of m segments. For the smaller set of a pair, the size
band fixes m = H + 1, where H is the most elements in which two sets that reach the threshold can differ. So a linked
pair agrees entirely on a segment at least, and each segment's content (a sum of its values) is an index key.

Cost-based allocation: a segment of no or one element agrees with very many others by chance, so its key is not indexed
(weight 0). Each such segment is made good by giving weight 2 to another: the first good segments in a fixed order also
index their one-deletion neighbourhoods, which finds pairs that differ by one element there. If no heavier segment of a
linked pair agrees, all but e - 1 of the others, at most, differ by exactly one element (e: the light segments on which
they agree), so among the first e good segments one does; both sides index a prefix of the segments that holds as many
good ones as they have light ones, hence the shorter prefix is common to both. A set with too few good segments indexes
all its segments and neighbourhoods, the light ones too. Nothing is capped and no link is lost.

A segment of other elements can be common too, by a passage that many documents share. Keys whose holders fall into more
than a few components are set aside; the elements behind them then form one segment of weight 0, and the documents that
held such keys are indexed once more, by segments of their other elements. What is still common then is a family of sets
alike but not similar (far copies of one text); a family is compared block by block, in tiles of bounded size.

Verification is exact on the sets. Rows that share a key are first compared with the least of them alone; sets that are
connected by then need no further comparison among themselves, so a large group of near copies costs its size, not its
square. Copies (equal sets) are one set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import _BASE, WORD_BASES, components, dropped, lists, mix, partitions_for, text_blocks, window_hashes, word_hashes, written

_U = np.uint64

#: Index keys of all documents are counted and picked in so many parts, one after another, so that a part's shuffles alone are on disk.
KEY_PARTS = 4


@lru_cache(maxsize=None)
def band_edges(num: int, den: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(least size, number of segments) of each size band for the threshold num / den."""
    edges, segments, low = [], [], 1
    while low < 1 << 30:
        high = max(low + 1, int(low * 1.3))
        sizes = np.array([max(low, high - 2), high - 1], np.int64)
        most = 0
        for down in (0, 1):
            other = np.maximum(sizes * den // num - down, sizes)
            both = sizes + other
            most = max(most, int((both - 2 * -(-num * both // (num + den))).max()))
        edges.append(low)
        segments.append(most + 1)
        low = high
    return tuple(edges), tuple(segments)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row of a block; fewer words than ``width`` are one shingle, none are an empty set."""
    words, rows = word_hashes(data, offsets, lower=True)
    every = window_hashes(words, width)
    for lo, hi in zip(rows[:-1], rows[1:]):
        if hi - lo >= width:
            yield np.unique(every[lo : hi - width + 1])
        elif hi > lo:
            yield window_hashes(words[lo:hi], int(hi - lo), WORD_BASES[1])
        else:
            yield np.zeros(0, _U)


def _bands(n: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """(band, number of segments) of the bands in which a set of ``n`` meets similar ones: that of its size and those of smaller sets."""
    edges, segments = band_edges(num, den)
    for band in range(int(np.searchsorted(edges, n, "right")) - 1, -1, -1):
        if (edges[band + 1] - 1) * den < num * n:
            break
        yield band, segments[band]


def index_keys(values: np.ndarray, num: int, den: int, hot: np.ndarray | None = None, told: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the index keys of one set, elements behind the keys in ``told``); ``values`` are sorted and distinct.

    With ``hot`` (values of the set), these are a segment of their own that isn't indexed, and the others fill the rest.
    """
    n, out, behind = len(values), [], [np.zeros(0, _U)]
    if den * n < num * (n + 1):  # only an equal set is similar enough
        return np.zeros(0, _U), behind[0]
    cold = values if hot is None else values[~np.isin(values, hot)]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(cold) + 1, _U)
        np.cumsum(cold, out=sums[1:])
        for band, m in _bands(n, num, den):
            if hot is not None and m > 1:
                m -= 1
            elif hot is not None:
                out.append(mix(values.sum(dtype=_U, keepdims=True) + _U(band) * _BASE))
                continue
            at = np.searchsorted((cold >> _U(32)) * _U(m) >> _U(32), np.arange(m + 1))
            size = np.diff(at)
            total = sums[at[1:]] - sums[at[:-1]]
            label = mix(np.arange(m, dtype=_U) + _U(band) * _BASE + _U(1 if hot is None else 2))
            # hot elements apart, a key of one element is no more common than others
            light, good = (size <= 1, size >= 3) if hot is None else (size == 0, size >= 2)
            n_light = int(light.sum()) + (hot is not None)
            exact, segment, kept = total + label, np.zeros(0, np.int64), np.zeros(0, bool)
            places = np.flatnonzero(good)
            if not n_light:
                out.append(mix(exact))
            elif len(places) >= n_light:
                out.append(mix(exact[~light]))
                end = int(places[n_light - 1]) + 1
                segment = np.repeat(np.arange(end), size[:end])
                kept = good[segment]
            else:
                out.append(mix(exact))
                segment = np.repeat(np.arange(m), size)
                kept = np.ones(len(segment), bool)
                if hot is not None:
                    out.append(mix(values.sum(dtype=_U, keepdims=True) - cold.sum(dtype=_U, keepdims=True) + _U(band) * _BASE))
            less = mix(total[segment] - cold[: len(segment)] + label[segment])
            out.append(less[kept])
            if told is not None:
                behind.append(cold[np.isin(np.repeat(mix(exact), size), told)])
                behind += [cold[at[k] : at[k + 1]] for k in np.unique(segment[np.isin(less, told)])]
    return np.unique(np.concatenate(out)), np.unique(np.concatenate(behind))


def _signatures(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                sizes, one, two, keys = [], [], [], []
                for values in shingle_sets(data, offsets, width):
                    sizes.append(len(values))
                    with np.errstate(over="ignore"):
                        one.append(values.sum(dtype=_U))
                        two.append(mix(values ^ _BASE).sum(dtype=_U))
                    keys.append(index_keys(values, num, den)[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(np.array(one, _U).view(np.int64)), pa.array(np.array(two, _U).view(np.int64)), lists(np.concatenate(keys).view(np.int64), [len(k) for k in keys], pa.int64())],
                    ["id", "n", "s1", "s2", "keys"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                found = list(shingle_sets(data, offsets, width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists(np.concatenate(found).view(np.int64), [len(x) for x in found], pa.int64())], ["id", "shingles"])

    return run


def _elements(num: int, den: int):
    """(element) of the sets ``shingles`` behind their keys in ``told``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, told in zip(batch.column(0), batch.column(1)):
                found = index_keys(_unsigned(values), num, den, told=_unsigned(told))[1]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["element"])

    return run


def _cold_keys(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [index_keys(_unsigned(values), num, den, hot=_unsigned(hot))[0] for values, hot in zip(batch.column(1), batch.column(2))]
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.concatenate(keys).view(np.int64), [len(k) for k in keys], pa.int64())], ["id", "keys"])

    return run


def _unsigned(value: pa.Scalar) -> np.ndarray:
    return np.zeros(0, _U) if not value.is_valid else np.sort(value.values.to_numpy().view(_U))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", same.alias("same"), (F.size("x") + F.size("y")).alias("both")).where(f"{den} * same >= {num} * (both - same)").select("a", "b").distinct()


def _shared(keyed: list[DataFrame]) -> DataFrame:
    """A table of the keys of ``keyed(key, id, n)`` that two ids or more hold, with low and high (their least and greatest id) and members; each key is in one of the parts ``keyed`` alone.

    Keys are counted alone before rows meet them, so a key that very many hold is one row of the counts, and the joins with it
    are split by adaptive execution where they are skewed. Each step is a table, so the shuffle before it can go.
    """
    rows = []
    for part in keyed:
        twice = written(part.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "twice")
        rows.append(written(part.join(twice, "key"), "rows"))
        dropped(twice)
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    sums = every.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("members")).where("low <> high")
    posts = written(every.join(sums, "key"), "posts")
    dropped(*rows)
    return posts


def _parts(signed: DataFrame, copies: DataFrame, equal: list[str]) -> list[DataFrame]:
    """``signed`` without ``copies`` as (key, id, n), in KEY_PARTS parts by key; a part's keys are picked before anything is shuffled."""
    out = []
    for k in range(KEY_PARTS):
        own = signed.where("id is not null").select("id", *equal, F.filter("keys", lambda x: F.pmod(x, F.lit(KEY_PARTS)) == k).alias("keys"))  # noqa: B023
        out.append(own.join(copies, ["id", *equal], "left_anti").select(F.explode("keys").alias("key"), "id", "n"))
    return out


def _linked(posts: DataFrame, sets: DataFrame, sizes: DataFrame, num: int, den: int, hot_members: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, common keys): links enough to connect all that share a key and reach the threshold.

    Each holder of a key is compared with the least one; then, per key, those in different components with one another.
    Keys of more than ``hot_members`` components are given back instead of compared in the second step.
    """
    low, high = sizes.select(F.col("id").alias("a"), F.col("least_n").alias("a0"), F.col("most_n").alias("a1")), sizes.select(F.col("id").alias("b"), F.col("least_n").alias("b0"), F.col("most_n").alias("b1"))
    fits = f"{den} * b1 >= {num} * a0 and {den} * a1 >= {num} * b0"  # a repeated id may have more sizes than one
    star = posts.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct().join(high, "b").join(low, "a").where(fits).select("a", "b")
    first = _verified(star, sets, num, den)
    first = written(first if known is None else first.unionByName(known).distinct(), "links")
    at = written(components(first), "components")
    placed = posts.where("members > 2").select("key", "id", "n").join(at, "id", "left").select("key", "id", "n", F.coalesce("component_id", "id").alias("c"))
    counted = placed.groupBy("key").agg(F.countDistinct("c").alias("parts")).where("parts > 1")
    counted = written(placed.join(counted, "key"), "loose")
    wide = written(counted.where(F.col("parts") > hot_members).select("key").distinct(), "wide")
    loose = counted.where(F.col("parts") <= hot_members)
    a = loose.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    b = loose.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    near = f"a < b and ca <> cb and {den} * least(na, nb) >= {num} * greatest(na, nb)"
    rest = a.join(b, "key").where(near).select("a", "b").distinct()
    second = _verified(rest.join(star, ["a", "b"], "left_anti"), sets, num, den)
    links = written(first.unionByName(second), "links")
    dropped(first, at, counted)
    return links, wide


def _tile(num: int, den: int):
    """Links (a, b) that connect the similar sets of a pair of blocks: each set with the least id it is connected to there."""

    def run(rows: pa.Table) -> pa.Table:
        ids, block = rows.column("id").to_numpy(), rows.column("block").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        sets = [np.asarray(x.values.to_numpy()) for x in rows.column("shingles")]
        size = np.array([len(x) for x in sets])
        _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(sets)), size)
        of, at = of[count[at] > 1], at[count[at] > 1]  # an element of one set is in no intersection
        place = np.cumsum(count > 1) - 1
        at = place[at]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        same = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(at, kind="stable")
        of, at = of[order], at[order]
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            part = slice(*np.searchsorted(at, [lo, lo + 4096]))
            has = np.zeros((len(sets), 4096), np.float32)
            has[of[part], at[part] - lo] = 1
            same += has[left] @ has[right].T
        linked = (num + den) * same.astype(np.int64) >= num * (size[left][:, None] + size[right][None, :])
        p, q = np.nonzero(linked)
        a, b = left[p], right[q]
        low = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        while True:
            before = low.copy()
            np.minimum.at(low, a, before[b])
            np.minimum.at(low, b, before[a])
            if (low == before).all():
                break
        return pa.table({"a": ids, "b": np.sort(ids)[low]})

    return run


def _tiled(families: DataFrame, sets: DataFrame, num: int, den: int, broadcast_rows: int, block_rows: int = 1024, block_elements: int = 200_000) -> DataFrame:
    """Links that connect the similar sets of each family, compared block by block; a block is bounded in sets and elements."""
    members = sets.join(families.select("id", F.col("component_id").alias("family")), "id")
    sized = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.size("shingles")) / block_elements)).cast("int").alias("blocks"))
    sized = written(sized, "families")
    few = sized.count() <= broadcast_rows
    dealt = members.join(F.broadcast(sized) if few else sized, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = dealt.select("family", "id", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("family", "id", "block", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return tiles.groupBy("family", "i", "j").applyInArrow(_tile(num, den), "a bigint, b bigint").where("a <> b").distinct()


def _joined(plain: DataFrame, posts: DataFrame, copies: DataFrame, width: int, num: int, den: int, hot_members: int, broadcast_rows: int) -> DataFrame:
    """A table (id, component_id) of the documents that share a key and reach the threshold, directly or through others, and of copies."""
    wanted = posts.select("id").distinct()
    sets = written(plain.join(wanted, "id", "left_semi").mapInArrow(_sets(width), "id bigint, shingles array<bigint>"), "sets")

    sizes = written(posts.groupBy("id").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n")), "sizes")
    links, wide = _linked(posts, sets, sizes, num, den, hot_members)
    affected = written(posts.join(wide, "key").select("id", "key"), "affected")
    dropped(posts, wide)
    if affected.limit(1).count():
        # the elements behind the common keys, as one of their holders has them, become a segment of their own
        told = affected.groupBy("key").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("key").alias("told"))
        hot = written(sets.join(told, "id").select("shingles", "told").mapInArrow(_elements(num, den), "element bigint").distinct(), "hot")
        few = hot.count() <= broadcast_rows
        again = written(sets.join(affected.select("id").distinct(), "id", "left_semi").select("id", "shingles"), "again")
        own = again.select("id", F.explode("shingles").alias("element")).join(F.broadcast(hot) if few else hot, "element").groupBy("id").agg(F.collect_set("element").alias("hot"))
        keys = again.join(own, "id", "left").select("id", "shingles", "hot").mapInArrow(_cold_keys(num, den), "id bigint, keys array<bigint>")
        cold = keys.select("id", F.explode("keys").alias("key")).distinct().join(sizes.select("id", F.col("most_n").alias("n")), "id")
        cold = written(cold.select("key", "id", "n"), "cold")
        posts = _shared([cold])
        dropped(hot, again, cold)
        before = links
        links, wide = _linked(posts, sets, sizes, num, den, hot_members, links)
        # what is still common is a family of alike but not similar sets, such as far copies of one text
        families = components(posts.join(wide, "key").select(F.col("low").alias("a"), F.col("id").alias("b")))
        links = links.unionByName(_tiled(families, sets, num, den, broadcast_rows)).distinct()
        dropped(before)

    joined = written(components(links.unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))), "components")
    dropped(affected, sets, sizes, posts, copies)
    return joined


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, hot_members: int = 4, broadcast_rows: int = 200_000) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of ``docs``: documents link when intersection / union >= num / den.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased. A text of fewer than ``width`` words
    is one shingle; a null or blank text has none and links with nothing. Rows with the same id are one node: each row is
    returned, and a link of one is a link of all. A row without an id is returned with a null component. Other columns of
    ``docs`` are not read. An empty table gives an empty one. ``hot_members`` and ``broadcast_rows`` steer the cost alone.
    """
    schema = "id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>"
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(plain.mapInArrow(_signatures(width, num, den), schema), "signatures")
    meta = written(signed.select("id", "n", "s1", "s2"), "sizes")  # apart, so that the keys can go

    # equal sets: one of them stands for all
    equal = ["n", "s1", "s2"]
    reps = meta.where("n > 0 and id is not null").groupBy(*equal).agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    copies = written(meta.where("id is not null").join(reps.where("rep <> last"), equal).where("id <> rep").select("id", *equal, "rep").distinct(), "copies")

    few = copies.count() <= broadcast_rows
    posts = _shared(_parts(signed, F.broadcast(copies) if few else copies, equal))
    dropped(signed)
    with partitions_for(docs.sparkSession, posts.count()):
        joined = _joined(plain, posts, copies, width, num, den, hot_members, broadcast_rows)
    return meta.join(joined, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
