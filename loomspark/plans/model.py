"""The property-graph model over the driver's tables: nodes(node_id, label, name) and edges(edge_id, src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.session import table

#: (table, key, name, label, letter of the node id)
NODE_TABLES = (("region", "r_regionkey", "r_name", "Region", "R"), ("nation", "n_nationkey", "n_name", "Nation", "N"), ("customer", "c_custkey", "c_name", "Customer", "C"), ("supplier", "s_suppkey", "s_name", "Supplier", "S"), ("part", "p_partkey", "p_name", "Part", "P"))


def _id(letter: str, key: str):
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, title, label, letter in NODE_TABLES:
        part = table(spark, sf_dir, name).select(_id(letter, key).alias("node_id"), F.lit(label).alias("label"), F.col(title).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN_REGION and IN_NATION."""

    def edge(name: str, a: tuple[str, str], b: tuple[str, str], kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(_id(*a).alias("src"), _id(*b).alias("dst"), F.lit(kind).alias("type"))

    out = edge("nation", ("N", "n_nationkey"), ("R", "n_regionkey"), "IN_REGION").unionByName(edge("customer", ("C", "c_custkey"), ("N", "c_nationkey"), "IN_NATION"))
    return out.unionByName(edge("supplier", ("S", "s_suppkey"), ("N", "s_nationkey"), "IN_NATION")).withColumn("edge_id", F.concat_ws(">", "src", "dst", "type"))


def trade_edges(spark: SparkSession, sf_dir: str, page: DataFrame | None = None, once: bool = True) -> DataFrame:
    """ORDERED customer - part and SUPPLIES supplier - part, each pair once, unless ``once`` is false; between two nodes of a small ``page(node_id)``, if it is given.

    A page picks its rows by their keys before anything is joined or made distinct.
    """
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")

    def on_page(df: DataFrame, letter: str, key: str) -> DataFrame:
        if page is None:
            return df
        keys = page.where(F.startswith("node_id", F.lit(letter))).select(F.substring("node_id", 2, 30).cast("bigint").alias("_key"))
        return df.join(F.broadcast(keys), F.col(key) == F.col("_key"), "left_semi")

    items = on_page(items, "P", "l_partkey")
    ordered = items.join(on_page(orders, "C", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    def edge(pairs: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: str) -> DataFrame:
        """Keys are made distinct before they become ids, which are three times as wide."""
        pairs = pairs.select(a[1], b[1])
        return (pairs.distinct() if once else pairs).select(_id(*a).alias("src"), _id(*b).alias("dst"), F.lit(kind).alias("type"))

    out = edge(ordered, ("C", "o_custkey"), ("P", "l_partkey"), "ORDERED").unionByName(edge(on_page(items, "S", "l_suppkey"), ("S", "l_suppkey"), ("P", "l_partkey"), "SUPPLIES"))
    return out.withColumn("edge_id", F.concat_ws(">", "src", "dst", "type"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_edges(spark, sf_dir).unionByName(trade_edges(spark, sf_dir))


def inner_edges(spark: SparkSession, sf_dir: str, page: DataFrame) -> DataFrame:
    """The edges between two nodes of a small ``page(node_id)``."""
    at = lambda c: F.broadcast(page.select(F.col("node_id").alias(c)))
    place = place_edges(spark, sf_dir).join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi")
    return place.unionByName(trade_edges(spark, sf_dir, page))


def edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type) of the edges whose ends are nodes, each once: told from keys, so no pair is made distinct, and none gets a name."""
    of = lambda name: table(spark, sf_dir, name)
    known = lambda df, key, name, own: df.join(of(name).select(F.col(own).alias("_key")), F.col(key) == F.col("_key"), "left_semi")
    items = known(of("lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), "l_partkey", "part", "p_partkey")
    orders = known(of("orders").select("o_orderkey", "o_custkey"), "o_custkey", "customer", "c_custkey")
    kinds = {
        "IN_REGION": known(of("nation"), "n_regionkey", "region", "r_regionkey"),
        "IN_NATION": known(of("customer").select(F.col("c_nationkey").alias("k")).unionByName(of("supplier").select(F.col("s_nationkey").alias("k"))), "k", "nation", "n_nationkey"),
        "ORDERED": items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"),
        "SUPPLIES": known(items, "l_suppkey", "supplier", "s_suppkey"),
    }
    out = None
    for kind, rows in kinds.items():
        part = rows.select(F.lit(kind).alias("type")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def unsummed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v) of all edges between two nodes; a pair may come several times."""
    every = place_edges(spark, sf_dir).unionByName(trade_edges(spark, sf_dir, once=False)).where("src <> dst")
    return every.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))


def repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, weight) of simple_edges() that weigh more than 1, less that 1."""
    return _places(spark, sf_dir).where("weight > 1").withColumn("weight", F.col("weight") - 1)


def edge_ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(name) of all keys that an edge may end in, each once, told from single columns; and how many rows unsummed_edges() has, but for keys of orders that are missing or come twice."""
    columns = (("nation", "N", "n_nationkey"), ("nation", "R", "n_regionkey"), ("customer", "C", "c_custkey"), ("customer", "N", "c_nationkey"), ("supplier", "S", "s_suppkey"), ("supplier", "N", "s_nationkey"), ("orders", "C", "o_custkey"), ("lineitem", "P", "l_partkey"), ("lineitem", "S", "l_suppkey"))
    out = None
    for name, letter, key in columns:
        part = table(spark, sf_dir, name).select(key).distinct().select(F.lit(letter).alias("letter"), F.col(key).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    sizes = {name: table(spark, sf_dir, name).count() for name in ("nation", "customer", "supplier", "lineitem")}
    return out.where("key IS NOT NULL").distinct().select(F.concat("letter", "key").alias("name")), sum(sizes.values()) + sizes["lineitem"]


def simple_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, weight) of ``graph.simple_graph(edges)``: types join different labels and trade has each pair once, so only places are summed; edges without an end are dropped."""
    ends = F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    return _places(spark, sf_dir).unionByName(trade_edges(spark, sf_dir).where("src <> dst").select(*ends, F.lit(1).cast("bigint").alias("weight")))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    return place_edges(spark, sf_dir).where("src <> dst").groupBy(*ends).agg(F.count("*").alias("weight"))


PLACE_SQL = """SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation
UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'IN_NATION' FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'IN_NATION' FROM supplier"""
TRADE_SQL = """SELECT DISTINCT 'C' || o_custkey AS src, 'P' || l_partkey AS dst, 'ORDERED' AS type FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey, 'SUPPLIES' FROM lineitem"""
NODES_SQL = " UNION ALL ".join(f"SELECT '{letter}' || {key} AS node_id, '{label}' AS label, {title} AS name FROM {name}" for name, key, title, label, letter in NODE_TABLES)
#: CTEs that the oracles begin with.
WITH = f"WITH RECURSIVE nodes AS ({NODES_SQL}), place AS (SELECT *, src || '>' || dst || '>' || type AS edge_id FROM ({PLACE_SQL})), trade AS (SELECT *, src || '>' || dst || '>' || type AS edge_id FROM ({TRADE_SQL})), edges AS (SELECT * FROM place UNION ALL SELECT * FROM trade)"
