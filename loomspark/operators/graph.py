"""Graph pattern matching, bounded expansion and graph statistics as joins and aggregations."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways as (edge_id, at, next, type); a self-loop once."""
    back = edges.where("src <> dst").select("edge_id", F.col("dst").alias("at"), F.col("src").alias("next"), "type")
    return edges.select("edge_id", F.col("src").alias("at"), F.col("dst").alias("next"), "type").unionByName(back)


def expand(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None, target: str | None = None) -> DataFrame:
    """Trails of 1..depth undirected edges from ``seeds(node_id)``: (start, end, hops, path, types, edge_ids); no edge twice on a trail.

    Each step's ends are written and, up to BROADCAST_ROWS, broadcast to pick their edges before anything is shuffled; only
    steps from more ends than that join all edges. With a ``target`` only trails that end there are given, and the last step
    reads its edges alone.
    """
    steps = undirected(edges if types is None else edges.where(F.col("type").isin(types)))
    here = seeds.select(F.col("node_id").alias("start"), F.col("node_id").alias("end"), F.lit(0).alias("hops"), F.array("node_id").alias("path"), F.array().cast("array<string>").alias("types"), F.array().cast("array<string>").alias("edge_ids"))
    out = None
    for hop in range(1, depth + 1):
        near = steps.where(F.col("next") == target) if target is not None and hop == depth else steps
        ends = _cut(here.select(F.col("end").alias("at")).distinct())
        few = ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        if few:
            near = near.join(F.broadcast(ends), "at", "left_semi")
        here = here.join(near, here["end"] == near["at"]).where(~F.array_contains("edge_ids", F.col("edge_id"))).select(
            "start", F.col("next").alias("end"), (F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("next")).alias("path"), F.array_append("types", F.col("type")).alias("types"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids")
        )
        if hop < depth:
            here = _cut(here)
        found = here if target is None else here.where(F.col("end") == target)
        out = found if out is None else out.unionByName(found)
    return out


def find_paths(edges: DataFrame, a: DataFrame, target: str, max_depth: int = 3, limit: int = 5) -> DataFrame:
    """The ``limit`` shortest trails from a seed to ``target``, ties by path."""
    return expand(edges, a, max_depth, target=target).select("hops", F.array_join("path", ",").alias("path")).orderBy("hops", "path").limit(limit)


def multi_hop(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int = 2, types: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """(end, label, hops, types, frequency): how many trails reach each end by the same types; frequent first."""
    found = expand(edges, seeds, hops, types).join(nodes.select(F.col("node_id").alias("end"), "label"), "end")
    if labels:
        found = found.where(F.col("label").isin(labels))
    return found.groupBy("end", "label", "hops", F.array_join("types", ",").alias("types")).agg(F.count("*").alias("frequency"))


def related(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Ends other than the start by the type of the first edge: (first_type, entities, n)."""
    found = expand(edges, seeds, depth).where("end <> start").select(F.col("types")[0].alias("first_type"), "end").distinct()
    return found.groupBy("first_type").agg(F.array_join(F.array_sort(F.collect_list("end")), ",").alias("entities"), F.count("*").alias("n"))


def ego_network(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and distinct edges on any trail of up to ``depth`` from the seeds."""
    found = expand(edges, seeds, depth)
    return found.select(F.explode("path").alias("node_id")).distinct(), found.select(F.explode("edge_ids").alias("edge_id")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected degree of every node, 0 included; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    counted = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.join(counted, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def top_page(nodes: DataFrame, edges: DataFrame, limit: int, offset: int = 0, inner: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of nodes by degree, and the edges between two of its nodes; ``inner(page)`` tells these where that is cheaper than from all edges."""
    page = _cut(degrees(nodes, edges).orderBy(F.desc("degree"), "node_id").offset(offset).limit(limit))  # ``limit`` rows, used three times
    if inner:
        return page, inner(page)
    at = lambda c: F.broadcast(page.select(F.col("node_id").alias(c)))
    inside = edges.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi")
    return page, inside


def node_detail(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """The node with its incoming and outgoing edges and unique neighbours; empty lists where there are none."""
    incoming = edges.where(F.col("dst") == node).agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("incoming"))
    outgoing = edges.where(F.col("src") == node).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("outgoing"))
    return nodes.where(F.col("node_id") == node).join(incoming).join(outgoing)


def connected_nodes(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("src") == node) | (F.col("dst") == node)).select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("node_id")).distinct()


def co_occurring(edges: DataFrame, kind: str, node: str) -> DataFrame:
    """Sources that share a target with ``node`` by edges of a type: (other, n_shared), and what they share in order."""
    e = edges.where(F.col("type") == kind)
    mine = e.where(F.col("src") == node).select("dst")
    return e.where(F.col("src") != node).join(mine, "dst").groupBy(F.col("src").alias("other")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("shared"), F.countDistinct("dst").alias("n_shared"))


def typed_collect(edges: DataFrame, kind: str, outgoing: bool = True, top: int | None = None) -> DataFrame:
    """(node_id, n, targets) of one edge type, either way; ``top`` keeps the first names."""
    a, b = ("src", "dst") if outgoing else ("dst", "src")
    names = F.array_sort(F.collect_set(b))
    return edges.where(F.col("type") == kind).groupBy(F.col(a).alias("node_id")).agg(F.count_distinct(b).alias("n"), F.array_join(F.slice(names, 1, top) if top else names, ",").alias("targets"))


def simple_graph(edges: DataFrame) -> DataFrame:
    """Undirected simple graph (u < v), parallel edges and direction collapsed, self-loops dropped; weight counts them."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").alias("weight"))


def modularity(graph: DataFrame, partition: DataFrame) -> DataFrame:
    """Sum over communities of l / m - (d / 2 m) ** 2 for ``graph(u, v)`` and ``partition(node, community)``."""
    at = graph.join(partition.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(partition.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
    ends = at.select(F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    inner = at.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.count("*").alias("l"))
    total = graph.agg(F.count("*").alias("m"))
    x = ends.join(inner, "c", "left").join(F.broadcast(total))
    return x.agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def communities(graph: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, community) by label spreading to a fixed point: no label weighs more among a node's neighbours than its own.

    A node wants the heaviest label around it, ties to the least, if that beats its own. In each round those go over that
    gain most among the neighbours who want to move as well (ties by a hash drawn anew). No two of them are neighbours, so
    the weight inside communities rises by the sum of their gains and labels can't swing back. RuntimeError if ``rounds``
    don't settle it. Labels are pre-summed by (node, label) before the choice, so a hub's neighbours are never gathered in
    one row. An empty graph gives an empty table.
    """
    both = _cut(graph.select("u", "v", "weight").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")))
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node"))
    for k in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("v"), "community"), "v").groupBy("u", "community").agg(F.sum("weight").alias("w"))
        mine = votes.join(labels.select(F.col("node").alias("u"), F.col("community").alias("own")), "u")
        best = mine.groupBy(F.col("u").alias("node"), "own").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("best"), F.coalesce(F.max(F.when(F.col("community") == F.col("own"), F.col("w"))), F.lit(0)).alias("held"))
        state = _cut(best.select("node", "own", F.col("best.community").alias("next"), (-F.col("best.w") - F.col("held")).alias("gain")))
        wanting = state.where("gain > 0").select("node", F.struct("gain", F.xxhash64("node", F.lit(k)).alias("draw"), "node").alias("rank"))
        if not wanting.limit(1).count():
            return state.select("node", F.col("own").alias("community"))
        rivals = both.join(wanting.select(F.col("node").alias("u"), "rank"), "u").join(wanting.select(F.col("node").alias("v"), F.col("rank").alias("other")), "v")
        waiting = rivals.where("other > rank").select(F.col("u").alias("node"), F.lit(True).alias("waits")).distinct()
        moves = (F.col("gain") > 0) & F.col("waits").isNull()
        labels = _cut(state.join(waiting, "node", "left").select("node", F.when(moves, F.col("next")).otherwise(F.col("own")).alias("community")))
    raise RuntimeError(f"communities have not settled after {rounds} rounds")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; in local mode one is made if it is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomspark-"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a table written in the checkpoint folder, where its lineage ends; in a folder for each value of ``by``."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomspark_path = path
    return out


def _drop(*tables: DataFrame) -> None:
    """Deletes tables of _cut() that nothing later reads."""
    for df in tables:
        path = getattr(df, "_loomspark_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def community_sizes(partition: DataFrame, limit: int | None = None) -> DataFrame:
    out = partition.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community")
    return out.limit(limit) if limit else out


def contracted(graph: DataFrame, partition: DataFrame) -> DataFrame:
    """The graph of communities: an edge where some edge crosses, weighted by their number."""
    a = partition.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    b = partition.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    return graph.join(a, "u").join(b, "v").where("cu <> cv").groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("weight").alias("weight"))


def node_sizes(with_degree: DataFrame) -> DataFrame:
    """Display size 20 + log10(1 + 9 d / max d) * 40."""
    top = with_degree.agg(F.max("degree").alias("_top"))
    return with_degree.join(F.broadcast(top)).withColumn("size", F.round(20 + F.log10(1 + 9 * F.col("degree") / F.col("_top")) * 40, 6)).drop("_top")


def match_score(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Tiers by name: equal 1.0, prefix 0.9, contained 0.7 + 0.2 * share of the name, else 0.5 (only matches are kept)."""
    q, name = query.lower(), F.lower("name")
    score = F.when(name == q, 1.0).when(F.startswith(name, F.lit(q)), 0.9).when(F.contains(name, F.lit(q)), F.round(0.7 + 0.2 * F.lit(len(q)) / F.length("name"), 3)).otherwise(0.5)
    return nodes.where(F.contains(name, F.lit(q))).select("node_id", "label", "name", score.alias("score")).orderBy(F.desc("score"), "node_id").limit(limit)


def degree_centrality(graph: DataFrame) -> DataFrame:
    """(node, centrality) of ``graph(u, v)``: neighbours over the other nodes."""
    ends = graph.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    total = ends.agg((F.count("*") - 1).alias("others"))
    return ends.join(F.broadcast(total)).select("node", F.round(F.col("n") / F.col("others"), 9).alias("centrality"))
