"""The catalogue of named queries: one entry for each operator, with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import community, fusion, graph, merge, quality, retrieval, rollup, text
from loomspark.plans import model
from loomspark.plans.model import WITH
from loomspark.session import table
from loomspark.sources import load
from loomspark.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def seed(s: SparkSession, *ids: str) -> DataFrame:
    return s.createDataFrame([(i,) for i in ids], "node_id string")


# --- graph ------------------------------------------------------------------------------------------------------------

query("s16_label_scan", WITH + " SELECT * FROM nodes WHERE label = 'Supplier'")(lambda s, d: model.nodes(s, d).where("label = 'Supplier'"))
query("p01_find_entities", WITH + " SELECT * FROM nodes WHERE contains(name, '7') AND label = 'Customer' ORDER BY node_id LIMIT 10")(lambda s, d: model.nodes(s, d).where(F.contains("name", F.lit("7")) & (F.col("label") == "Customer")).orderBy("node_id").limit(10))
query("p02_any_property", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '.*[aeiou]') OR regexp_full_match(p_type, '.*[aeiou]') OR starts_with(p_brand, 'Brand#1')")(
    lambda s, d: table(s, d, "part").where("exists(array(p_name, p_type), x -> x rlike '^(?:.*[aeiou])$') or startswith(p_brand, 'Brand#1')").select("p_partkey", "p_name"))
query("p04_match_score", WITH + """ SELECT node_id, label, name, CASE WHEN lower(name) = 'ia' THEN 1.0 WHEN starts_with(lower(name), 'ia') THEN 0.9 ELSE round(0.7 + 0.2 * 2 / length(name), 3) END AS score
 FROM nodes WHERE contains(lower(name), 'ia') ORDER BY score DESC, node_id LIMIT 20""")(lambda s, d: graph.match_score(model.nodes(s, d), "ia"))
query("p13_sanitize", r"SELECT doc_id, md5(regexp_replace(trim(text), '[\x00-\x1f\x7f-\x{9f}]', '', 'g')) AS h FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.encode(text.sanitize(F.col("text")), "UTF-8")).alias("h")))
query("p15_ontology_filter", WITH + " SELECT type, count(*) AS n FROM edges e JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE (a.label, type, b.label) IN (('Nation','IN_REGION','Region'), ('Customer','ORDERED','Part')) GROUP BY type")(
    lambda s, d: fusion.valid_relations(
        model.edges(s, d).join(model.nodes(s, d).select(F.col("node_id").alias("src"), F.col("label").alias("src_type")), "src").join(model.nodes(s, d).select(F.col("node_id").alias("dst"), F.col("label").alias("dst_type")), "dst").withColumnRenamed("type", "relation"),
        s.createDataFrame([("Nation", "IN_REGION", "Region"), ("Customer", "ORDERED", "Part")], "src_type string, relation string, dst_type string"),
    ).groupBy(F.col("relation").alias("type")).agg(F.count("*").alias("n")))
query("j01_typed_hop", WITH + " SELECT a.name AS nation, b.name AS region FROM place JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE type = 'IN_REGION' AND b.name = (SELECT min(r_name) FROM region)")(
    lambda s, d: model.place_edges(s, d).where("type = 'IN_REGION'").join(model.nodes(s, d).select(F.col("node_id").alias("src"), F.col("name").alias("nation")), "src").join(model.nodes(s, d).select(F.col("node_id").alias("dst"), F.col("name").alias("region")), "dst")
    .join(F.broadcast(table(s, d, "region").agg(F.min("r_name").alias("region"))), "region").select("nation", "region"))
query("j02_co_occurrence", WITH + " SELECT b.src AS other, string_agg(DISTINCT b.dst, ',' ORDER BY b.dst) AS shared, count(DISTINCT b.dst) AS n_shared FROM trade a JOIN trade b ON a.dst = b.dst AND b.type = a.type WHERE a.src = 'S1' AND a.type = 'SUPPLIES' AND b.src <> 'S1' GROUP BY b.src")(
    lambda s, d: graph.co_occurring(model.trade_edges(s, d), "SUPPLIES", "S1"))

_WALK = """, steps AS (SELECT edge_id, src AS pt, dst AS nxt, type FROM edges UNION ALL SELECT edge_id, dst, src, type FROM edges WHERE src <> dst),
 walk AS (SELECT '{0}' AS start, '{0}' AS pt, 0 AS hops, ['{0}'] AS path, CAST([] AS VARCHAR[]) AS types, CAST([] AS VARCHAR[]) AS ids
 UNION ALL SELECT start, s.nxt, hops + 1, list_append(path, s.nxt), list_append(types, s.type), list_append(ids, s.edge_id) FROM walk w JOIN steps s ON s.pt = w.pt WHERE hops < {1} AND NOT list_contains(ids, s.edge_id)),
 t AS (SELECT * FROM walk WHERE hops > 0)"""
query("j03_expand", WITH + _WALK.format("R0", 2) + " SELECT pt AS \"end\", hops, array_to_string(path, ',') AS path, types[1] AS first_type FROM t")(
    lambda s, d: graph.expand(model.edges(s, d), seed(s, "R0"), 2).select("end", "hops", F.array_join("path", ",").alias("path"), F.col("types")[0].alias("first_type")))
query("j04_find_paths", WITH + _WALK.format("N1", 3) + " SELECT hops, array_to_string(path, ',') AS path FROM t WHERE pt = 'N6' ORDER BY hops, path LIMIT 5")(lambda s, d: graph.find_paths(model.edges(s, d), seed(s, "N1"), "N6"))
query("j05_multi_hop", WITH + _WALK.format("N3", 3) + " SELECT pt AS \"end\", label, hops, array_to_string(types, ',') AS types, count(*) AS frequency FROM t JOIN nodes ON node_id = pt WHERE label IN ('Region', 'Nation', 'Customer') GROUP BY ALL")(
    lambda s, d: graph.multi_hop(model.edges(s, d), model.nodes(s, d), seed(s, "N3"), 3, labels=["Region", "Nation", "Customer"]))
query("j06_related", WITH + _WALK.format("N2", 2) + " SELECT first_type, string_agg(e, ',' ORDER BY e) AS entities, count(*) AS n FROM (SELECT DISTINCT types[1] AS first_type, pt AS e FROM t WHERE pt <> start) GROUP BY first_type")(lambda s, d: graph.related(model.edges(s, d), seed(s, "N2")))
query("j07_ego_network", WITH + _WALK.format("R2", 2) + " SELECT DISTINCT unnest(path) AS node_id FROM t")(lambda s, d: graph.ego_network(model.edges(s, d), seed(s, "R2"), 2)[0])
query("j08_ego_union", WITH + " SELECT DISTINCT edge_id FROM edges WHERE src IN ('N1', 'R3', 'C1') OR dst IN ('N1', 'R3', 'C1')")(lambda s, d: graph.ego_network(model.edges(s, d), seed(s, "N1", "R3", "C1"), 1)[1])
query("j09_node_detail", WITH + " SELECT node_id, label, name, (SELECT coalesce(string_agg(src, ',' ORDER BY src), '') FROM edges WHERE dst = 'N4') AS incoming, (SELECT coalesce(string_agg(dst, ',' ORDER BY dst), '') FROM edges WHERE src = 'N4') AS outgoing FROM nodes WHERE node_id = 'N4'")(
    lambda s, d: graph.node_detail(model.nodes(s, d), model.edges(s, d), "N4"))
_DEG = ", ends AS (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges), deg AS (SELECT n.*, (CASE WHEN c IS NULL THEN 0 ELSE c END)::BIGINT AS degree FROM nodes n LEFT JOIN (SELECT node_id, count(*) AS c FROM ends GROUP BY 1) USING (node_id))"
query("a03_degree", WITH + _DEG + " SELECT * FROM deg")(lambda s, d: graph.degrees(model.nodes(s, d), model.edges(s, d)))
query("j10_induced_page", WITH + _DEG + ", page AS (SELECT * FROM deg ORDER BY degree DESC, node_id LIMIT 50 OFFSET 5) SELECT edge_id, src, dst, type FROM edges WHERE src IN (SELECT node_id FROM page) AND dst IN (SELECT node_id FROM page)")(
    lambda s, d: graph.top_page(model.nodes(s, d), model.edges(s, d), 50, 5, lambda page: model.inner_edges(s, d, page))[1].select("edge_id", "src", "dst", "type"))
query("g12_node_size", WITH + _DEG + " SELECT *, round(20 + log10(1 + 9 * degree / (max(degree) OVER ())) * 40, 6) AS size FROM deg")(lambda s, d: graph.node_sizes(graph.degrees(model.nodes(s, d), model.edges(s, d))))
query("j17_pivot_types", WITH + " SELECT src, count(*) FILTER (WHERE type = 'IN_NATION') AS n_in, count(*) FILTER (WHERE type = 'ORDERED') AS n_ordered, count(*) FILTER (WHERE type = 'SUPPLIES') AS n_supplies FROM edges GROUP BY src")(
    lambda s, d: model.edges(s, d).groupBy("src").agg(F.count_if(F.col("type") == "IN_NATION").alias("n_in"), F.count_if(F.col("type") == "ORDERED").alias("n_ordered"), F.count_if(F.col("type") == "SUPPLIES").alias("n_supplies")))
query("j18_typed_collect", WITH + " SELECT dst AS node_id, count(*) AS n, string_agg(src, ',' ORDER BY src) AS targets FROM trade WHERE type = 'SUPPLIES' GROUP BY dst")(lambda s, d: graph.typed_collect(model.trade_edges(s, d), "SUPPLIES", outgoing=False))
query("j19_two_hop_chain", WITH + " SELECT DISTINCT a.src AS a, b.dst AS c FROM place a JOIN place b ON a.dst = b.src WHERE a.type = 'IN_NATION' AND b.type = 'IN_REGION' AND a.src <> b.dst")(
    lambda s, d: model.place_edges(s, d).where("type = 'IN_NATION'").select(F.col("src").alias("a"), F.col("dst").alias("m")).join(model.place_edges(s, d).where("type = 'IN_REGION'").select(F.col("src").alias("m"), F.col("dst").alias("c")), "m").where("a <> c").select("a", "c").distinct())
query("j20_relation_rollup", WITH + " SELECT type, count(*) AS n, count(DISTINCT dst) AS n_targets FROM edges GROUP BY type")(lambda s, d: model.edges(s, d).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("n_targets")))
query("j25_connected", WITH + " SELECT DISTINCT CASE WHEN src = 'N7' THEN dst ELSE src END AS node_id FROM edges WHERE src = 'N7' OR dst = 'N7'")(lambda s, d: graph.connected_nodes(model.edges(s, d), "N7"))
query("a01_count_by_label", WITH + " SELECT label, count(*) AS n FROM nodes GROUP BY label")(lambda s, d: model.nodes(s, d).groupBy("label").agg(F.count("*").alias("n")))
query("a02_top_sources", WITH + " SELECT src, count(*) AS n FROM trade GROUP BY src ORDER BY n DESC, src LIMIT 10")(lambda s, d: model.trade_edges(s, d).groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(10))
query("a04_graph_stats", WITH + " SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM edges) AS types")(
    lambda s, d: model.edges(s, d).agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types")).join(model.nodes(s, d).agg(F.count("*").alias("n_nodes"))))
query("g01_simple_graph", WITH + " SELECT least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS weight FROM edges WHERE src <> dst GROUP BY 1, 2")(lambda s, d: graph.simple_graph(model.edges(s, d)))


def _levels(s: SparkSession, d: str) -> DataFrame:
    return community.community_levels(model.unsummed_edges(s, d), **_ends(s, d))


def _ends(s: SparkSession, d: str) -> dict:
    names, count = model.edge_ends(s, d)
    return {"names": names, "several": True, "count": count}


def _contracted(s: SparkSession, d: str) -> DataFrame:
    """graph.contracted() of the detected communities; the search ends with it, but for edges that weigh more than 1."""
    levels, between, _ = community.contracted_levels(model.unsummed_edges(s, d), **_ends(s, d))
    more = graph.contracted(model.repeated_edges(s, d), community.top_level(levels))
    return between.unionByName(more).groupBy("u", "v").agg(F.sum("weight").alias("weight"))


def _modularity(s: SparkSession, d: str) -> DataFrame:
    """graph.modularity() of the detected communities, which the search ends with."""
    value = community.contracted_levels(model.unsummed_edges(s, d), **_ends(s, d))[2]
    return s.range(1).select(F.round(F.lit(value).cast("double"), 6).alias("modularity"))


def _detected(s: SparkSession, d: str) -> DataFrame:
    return community.top_level(_levels(s, d))


def _centrality(s: SparkSession, d: str) -> DataFrame:
    """Betweenness and degree inside the communities of the first level."""
    found = community.level_betweenness(model.unsummed_edges(s, d), **_ends(s, d))
    return found.select("node", "community", F.round("betweenness", 9).alias("betweenness"), F.round("degree", 9).alias("degree"))


query("g02_communities")(_detected)
query("g02_levels")(lambda s, d: community.community_tree(_levels(s, d)))
query("g03_contracted")(_contracted)
query("g04_modularity")(_modularity)
query("a06_community_sizes")(lambda s, d: graph.community_sizes(_detected(s, d), 3))
query("g05_betweenness")(_centrality)
_PART = ", g AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v FROM edges GROUP BY 1, 2), p AS (SELECT node_id AS node, label AS c FROM nodes)"


def _by_label(s: SparkSession, d: str) -> DataFrame:
    return model.nodes(s, d).select(F.col("node_id").alias("node"), F.col("label").alias("community"))


query("g04_label_modularity", WITH + _PART + """, e AS (SELECT a.c AS cu, b.c AS cv FROM g JOIN p a ON a.node = u JOIN p b ON b.node = v), m AS (SELECT count(*) AS m FROM e),
 dd AS (SELECT c, count(*) AS d FROM (SELECT cu AS c FROM e UNION ALL SELECT cv FROM e) GROUP BY c), l AS (SELECT cu AS c, count(*) AS l FROM e WHERE cu = cv GROUP BY cu)
 SELECT round(sum(coalesce(l, 0) / m - power(d / (2 * m), 2)), 6) AS modularity FROM dd LEFT JOIN l USING (c), m""")(
    lambda s, d: graph.modularity(model.simple_edges(s, d), _by_label(s, d)).select(F.round("modularity", 6).alias("modularity")))
query("g03_label_contracted", WITH + _PART + " SELECT least(a.c, b.c) AS u, greatest(a.c, b.c) AS v, count(*) AS weight FROM g JOIN p a ON a.node = u JOIN p b ON b.node = v WHERE a.c <> b.c GROUP BY 1, 2")(
    lambda s, d: graph.contracted(model.simple_edges(s, d), _by_label(s, d)))

# --- vectors ----------------------------------------------------------------------------------------------------------


def _vector(s: SparkSession, d: str, i: int = 0) -> DataFrame:
    return table(s, d, "embeddings").where(F.col("vec_id") == i).select(F.col("embedding").alias("vector"))


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
query("v02_cosine_topk", f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY 2 DESC, 1 LIMIT 10")(lambda s, d: retrieval.vector_topk(table(s, d, "embeddings"), _vector(s, d)))
query("v05_threshold_topk", f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 3 AND round({_COS}, 6) > 0.2 ORDER BY 2 DESC, 1 LIMIT 20")(lambda s, d: retrieval.vector_topk(table(s, d, "embeddings"), _vector(s, d, 3), 20, 0.2))
query("v06_hybrid_combine", f"""WITH v AS (SELECT e.vec_id AS chunk_id, round({_COS}, 6) AS sim FROM embeddings e, embeddings q WHERE q.vec_id = 1 ORDER BY 2 DESC, 1 LIMIT 10),
 g AS (SELECT vec_id AS chunk_id, 0.5 + label / 20.0 AS es FROM embeddings), x AS (SELECT chunk_id, coalesce(sim / (SELECT max(sim) FROM v), 0.0) AS vector_score, coalesce(es, 0.0)::DOUBLE AS graph_score FROM v FULL JOIN g USING (chunk_id))
 SELECT *, round(0.5 * vector_score + 0.5 * graph_score, 6) AS combined FROM x ORDER BY combined DESC, chunk_id LIMIT 15""")(
    lambda s, d: retrieval.hybrid_combine(retrieval.vector_topk(table(s, d, "embeddings"), _vector(s, d, 1)).withColumnRenamed("vec_id", "chunk_id"), table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.lit(0.5) + F.col("label") / 20).alias("entity_score"))))
query("v20_community_vectors", """WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
 SELECT label, round(list_cosine_similarity(list(x ORDER BY i), (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM m GROUP BY label ORDER BY 2 DESC, 1 LIMIT 5""")(
    lambda s, d: retrieval.vector_topk(retrieval.mean_vectors(table(s, d, "embeddings"), "label").withColumnRenamed("vector", "mean"), _vector(s, d), 5, id_col="label", vector_col="mean"))
_WIDE, _NARROW, _NUM = ["the", "and"], ["of", "in"], ["1", "2"]


def _count_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + ")"


query("v11_route", f"""WITH c AS (SELECT item_id, {_count_sql(_WIDE)} AS g, {_count_sql(_NARROW)} AS n, {_count_sql(_NUM)} AS x FROM benchmark), r AS (SELECT item_id, CASE WHEN g > n THEN 'global' WHEN n > g THEN 'local' WHEN x > 0 THEN 'local' WHEN g > 0 THEN 'local' ELSE 'hybrid' END AS route FROM c)
 SELECT *, CASE route WHEN 'global' THEN 0.2 WHEN 'local' THEN 0.7 ELSE 0.5 END AS alpha FROM r""")(
    lambda s, d: table(s, d, "benchmark").select("item_id", retrieval.route(F.col("text"), _WIDE, _NARROW, _NUM).alias("route")).withColumn("alpha", retrieval.route_alpha(F.col("route"))))
query("w07_top_per_group", "SELECT label, vec_id FROM embeddings WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 5")(
    lambda s, d: retrieval.first_per(table(s, d, "embeddings").where("label is not null").select("label", "vec_id"), ["label"], [F.desc("vec_id")], 5).select("label", "vec_id"))

# --- text -------------------------------------------------------------------------------------------------------------

_CHUNKS = "WITH c AS (SELECT doc_id AS document_id, (u / 437)::INT AS chunk_index, doc_id || '_chunk_' || (u // 437) AS chunk_id, substring(text, u + 1, 512) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 437)) AS u FROM documents))"


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return text.fixed_windows(table(s, d, "documents"))


query("x11_fixed_windows", _CHUNKS + " SELECT chunk_id, document_id, chunk_index, md5(content) AS h FROM c")(lambda s, d: _chunks(s, d).select("chunk_id", "document_id", "chunk_index", F.md5(F.encode("content", "UTF-8")).alias("h")))
query("a09_split_stats", _CHUNKS + " SELECT count(*) AS n, sum(length(content))::BIGINT AS total, round(avg(length(content)), 6) AS mean, min(length(content)) AS least, max(length(content)) AS most FROM c")(lambda s, d: text.split_stats(_chunks(s, d)))
query("w01_chunk_context", _CHUNKS + " SELECT chunk_id, count(*) OVER w AS n_context, md5(string_agg(content, '|') OVER w) AS h FROM c WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)")(
    lambda s, d: text.chunk_context(_chunks(s, d)).select("chunk_id", F.size("context").cast("bigint").alias("n_context"), F.md5(F.encode(F.array_join("context.content", "|"), "UTF-8")).alias("h")))
query("j14_reconstruct", _CHUNKS + " SELECT document_id, count(*) AS n_chunks, md5(string_agg(content, '##' ORDER BY chunk_index)) AS h FROM c GROUP BY document_id")(
    lambda s, d: text.reconstruct(_chunks(s, d), "##").select("document_id", "n_chunks", F.md5(F.encode("content", "UTF-8")).alias("h")))
query("j11_chunk_parent", _CHUNKS + " SELECT chunk_id, lang, source FROM c JOIN documents ON doc_id = document_id")(lambda s, d: _chunks(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source"), "document_id").select("chunk_id", "lang", "source"))
query("n13_clean_text", r"SELECT doc_id, md5(translate(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')), ',;:', '，；：')) AS h FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.encode(text.clean_text(F.col("text")), "UTF-8")).alias("h")))
for _how in text.SPLITTERS:
    query(f"x0_split_{_how}")(lambda s, d, how=_how: text.split_documents(table(s, d, "documents"), 512, how))
query("n01_dictionary_mentions", "WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS name FROM documents) SELECT id, name, 'Word' AS type, count(*) AS n FROM w WHERE name IN ('the', 'and', 'der', 'les') GROUP BY ALL")(
    lambda s, d: text.dictionary_mentions(table(s, d, "documents"), s.createDataFrame([(w, "Word") for w in ("the", "and", "der", "les")], "name string, type string"), "doc_id", "text"))
query("n02_abbreviations", r"WITH a AS (SELECT doc_id AS id, text, unnest(list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,5}')))) AS abbr FROM documents) SELECT id, abbr, (strpos(text, abbr) - 1)::INT AS start, 0.9 AS confidence FROM a")(
    lambda s, d: text.abbreviation_mentions(table(s, d, "documents"), "doc_id", "text"))


query("w06_history", """WITH x AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
 y AS (SELECT *, back > 5 AND coalesce(nr = 'assistant', false) AS answered, left(coalesce(text, ''), 50) AS q FROM x), z AS (SELECT *, CASE WHEN answered THEN left(coalesce(nt, ''), 50) ELSE '' END AS a FROM y)
 SELECT conv_id, count(*) FILTER (WHERE back > 4) AS n_old, count(*) FILTER (WHERE role = 'user' AND back > 4 AND answered) AS n_pairs, (count(*) FILTER (WHERE back <= 4))::INT AS n_kept,
 md5('[对话摘要] ' || string_agg('问: ' || q || CASE WHEN a <> '' THEN '；答: ' || a ELSE '' END, '；' ORDER BY back DESC) FILTER (WHERE role = 'user' AND back > 4 AND q <> '')) AS summary,
 md5(string_agg(turn || ':' || coalesce(role, '') || ':' || coalesce(text, ''), chr(10) ORDER BY back DESC) FILTER (WHERE back <= 4)) AS kept FROM z GROUP BY conv_id""")(
    lambda s, d: text.history_summary(table(s, d, "conversations")).select("conv_id", "n_old", "n_pairs", F.size("kept").alias("n_kept"), F.md5(F.encode("summary", "UTF-8")).alias("summary"),
        F.md5(F.encode(F.array_join(F.transform("kept", lambda r: F.concat(r.turn.cast("string"), F.lit(":"), F.coalesce(r.role, F.lit("")), F.lit(":"), F.coalesce(r.text, F.lit("")))), "\n"), "UTF-8")).alias("kept")))
query("w08_session_titles", "SELECT conv_id, left(arg_min(text, turn), 30) AS title, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")(lambda s, d: table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 30).alias("title"), F.count("*").alias("n")))
query("s09_html_text")(lambda s, d: table(s, d, "pages").select("page_id", load.html_title(F.col("html")).alias("title"), load.html_text(F.col("html")).alias("content")))
query("s10_document_id", "SELECT page_id, md5(url) AS id FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", F.md5(F.encode("url", "UTF-8")).alias("id")))

# --- fusion -----------------------------------------------------------------------------------------------------------

query("k02_similarity", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(CASE WHEN a.n_name = b.n_name THEN 1.0 WHEN contains(a.n_name, b.n_name) OR contains(b.n_name, a.n_name) THEN 0.9 ELSE len(list_filter(string_split(a.n_name, ''), lambda c: c <> '' AND contains(b.n_name, c))) / greatest(length(a.n_name), length(b.n_name)) END, 6) AS score FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")(
    lambda s, d: table(s, d, "nation").alias("x").join(table(s, d, "nation").alias("y"), F.col("x.n_regionkey") == F.col("y.n_regionkey")).select(F.col("x.n_nationkey").alias("a"), F.col("y.n_nationkey").alias("b"), F.round(fusion.similarity(F.col("x.n_name"), F.col("y.n_name")), 6).alias("score")))
query("k11_search_terms", "WITH t AS (SELECT 'C' || p_partkey AS code, p_name AS name FROM part), x AS (SELECT *, CASE WHEN lower(code) = 'c1' THEN 1.0 WHEN starts_with(lower(code), 'c1') THEN 0.9 WHEN lower(name) = 'c1' THEN 0.8 WHEN starts_with(lower(name), 'c1') THEN 0.7 WHEN contains(lower(name), 'c1') THEN 0.6 END AS score FROM t) SELECT * FROM x WHERE score IS NOT NULL ORDER BY score DESC, code LIMIT 10")(
    lambda s, d: fusion.search_terms(table(s, d, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name")), "C1"))
query("k08_normal_names", "SELECT p_partkey, replace(trim(lower(p_type)), ' ', '') AS name FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", fusion.normal_name(F.col("p_type")).alias("name")))
query("k03_disambiguate", "SELECT c_mktsegment AS canonical, string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) AS types FROM customer GROUP BY 1")(
    lambda s, d: fusion.disambiguate(table(s, d, "customer").select(F.col("c_mktsegment").alias("canonical"), F.col("c_nationkey").cast("string").alias("type"), F.lit("x").alias("name"), F.col("c_nationkey").cast("string").alias("ord")).distinct()).select("canonical", "types"))

# --- evaluation -------------------------------------------------------------------------------------------------------

_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda t: t <> '')"
_GRAMS = "CASE WHEN len({0}) >= {1} THEN list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' ')) ELSE [] END"



def _all_pairs(s: SparkSession, d: str) -> DataFrame:
    """Every document, whole, with the benchmark item that its id selects by the number of items."""
    items = table(s, d, "benchmark")
    ranks = items.agg(F.array_sort(F.collect_list("item_id")).alias("ids")).select(F.posexplode("ids").alias("rank", "item_id"))
    refs = items.join(ranks, "item_id").select("rank", F.col("text").alias("reference"))
    docs = table(s, d, "documents").join(F.broadcast(items.agg(F.count("*").alias("n_items"))))
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("prediction"), F.pmod("doc_id", "n_items").cast("int").alias("rank")).join(refs, "rank").select("id", "prediction", "reference")


def _overlap_sql(n: int) -> str:
    return f"""w{n} AS (SELECT id, {_GRAMS.format("p", n)} AS p, {_GRAMS.format("r", n)} AS r FROM w),
 c{n} AS (SELECT id, g, sum(a) AS a, sum(b) AS b FROM (SELECT id, unnest(p) AS g, 1 AS a, 0 AS b FROM w{n} UNION ALL SELECT id, unnest(r), 0, 1 FROM w{n}) GROUP BY ALL),
 o{n} AS (SELECT w.id, coalesce(sum(least(a, b)), 0) AS common, coalesce(sum(a), 0) AS np, coalesce(sum(b), 0) AS nr FROM w LEFT JOIN c{n} USING (id) GROUP BY w.id)"""


_BLANKS = " || ".join(f"chr({ord(c)})" for c in quality.BLANKS)
_PAIRS_SQL = f"""WITH q AS (SELECT doc_id AS id, d.text AS prediction, b.text AS reference FROM documents d JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark) b ON k = doc_id % (SELECT count(*) FROM benchmark)), w AS (SELECT id, {_WORDS.format("prediction")} AS p, {_WORDS.format("reference")} AS r FROM q), """
query("e03_bleu")(lambda s, d: quality.bleu(_all_pairs(s, d)))
query("e05_rouge_l")(lambda s, d: quality.rouge_l(_all_pairs(s, d)))
query("e01_exact_match", _PAIRS_SQL + f"z AS (SELECT {_BLANKS} AS b) SELECT id, trim(prediction, b) = trim(reference, b) AS exact FROM q, z")(lambda s, d: quality.exact_match(_all_pairs(s, d)))
query("e02_token_f1", _PAIRS_SQL + _overlap_sql(1) + " SELECT id, CASE WHEN np + nr = 0 THEN 1.0 ELSE round(coalesce(2.0 * common / nullif(np + nr, 0), 0), 6) END AS f1 FROM o1")(lambda s, d: quality.token_f1(_all_pairs(s, d)))
query("e04_rouge_2", _PAIRS_SQL + _overlap_sql(2) + " SELECT id, round(coalesce(common / nullif(nr, 0), 0), 6) AS rouge FROM o2")(lambda s, d: quality.rouge_recall(_all_pairs(s, d), 2))
query("a12_grouping_sets", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY GROUPING SETS ((lang), ())")(lambda s, d: table(s, d, "documents").rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean")))
query("a28_compare_reports", "WITH b AS (SELECT lang AS metric, count(*)::DOUBLE AS v FROM documents WHERE source < 'src3' GROUP BY 1), a AS (SELECT lang AS metric, count(*)::DOUBLE AS v FROM documents GROUP BY 1) SELECT metric, coalesce(b.v, 0) AS before, coalesce(a.v, 0) AS after, round(coalesce(a.v, 0) - coalesce(b.v, 0), 6) AS delta, coalesce(a.v, 0) > coalesce(b.v, 0) AS improved FROM b FULL JOIN a USING (metric)")(
    lambda s, d: quality.compare_reports(*(x.groupBy(F.col("lang").alias("metric")).agg(F.count("*").cast("double").alias("value")) for x in (table(s, d, "documents").where("source < 'src3'"), table(s, d, "documents")))))
query("e12_thresholds", "SELECT event_type AS metric, round(avg(value), 6) AS value, CASE event_type WHEN 'click' THEN round(avg(value), 6) >= 10 WHEN 'error' THEN round(avg(value), 6) <= 60 END AS ok FROM events GROUP BY 1")(
    lambda s, d: quality.thresholds(table(s, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value")), {"click": (">=", 10.0), "error": ("<=", 60.0)}))

# --- rollups ----------------------------------------------------------------------------------------------------------

query("a16_metric_summary", "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")(lambda s, d: rollup.summary(table(s, d, "events"), "event_type", "value"))
query("a17_histogram", "WITH b AS (SELECT unnest([" + ", ".join(f"'{b}'" for b in rollup.BUCKETS) + ", 'Inf']) AS le) SELECT event_type, le, count(*) FILTER (WHERE value IS NOT NULL AND (le = 'Inf' OR value <= try_cast(le AS DOUBLE))) AS n FROM events, b GROUP BY 1, 2")(lambda s, d: rollup.histogram(table(s, d, "events"), "event_type", "value"))
query("s22_prometheus", f"WITH x AS ({ORACLES['a17_histogram']}) SELECT event_type || '_bucket{{le=\"' || le || '\"}} ' || n AS line FROM x")(lambda s, d: rollup.prometheus(rollup.histogram(table(s, d, "events").withColumnRenamed("event_type", "metric"), "metric", "value")))
query("a14_p95", "WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value AS quantile FROM x WHERE k = least(floor(n * 0.95), n - 1) + 1")(lambda s, d: rollup.indexed_quantile(table(s, d, "events"), "event_type", "value", 0.95))
_ERR = "SELECT left(md5(event_type || ':' || (user_id % 50)), 16) AS fingerprint, count(*) AS n, floor(epoch(min(ts)))::BIGINT AS first_seen, floor(epoch(max(ts)))::BIGINT AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1"
query("a19_error_rollup", _ERR)(lambda s, d: rollup.error_rollup(table(s, d, "events").where("event_type = 'error'").select(F.col("event_type").alias("type"), (F.col("user_id") % 50).cast("string").alias("message"), "ts", F.col("props").alias("stack"))).select("fingerprint", "n", F.unix_timestamp("first_seen").alias("first_seen"), F.unix_timestamp("last_seen").alias("last_seen")))
query("a21_top_errors", _ERR.replace("GROUP BY 1", "GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"))(lambda s, d: QUERIES["a19_error_rollup"](s, d).orderBy(F.desc("n"), "fingerprint").limit(5))
query("a20_error_sets", "SELECT event_type, user_id % 7 AS source, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 7), ())")(
    lambda s, d: s.sql("SELECT event_type, source, count(*) AS n FROM (SELECT event_type, user_id % 7 AS source FROM {e}) GROUP BY GROUPING SETS ((event_type), (source), ())", e=table(s, d, "events")))


def _feedback(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select((1 + F.col("event_id") % 5).alias("rating"), F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "B").alias("variant"))


_FB = "WITH f AS (SELECT 1 + event_id % 5 AS rating, CASE event_id % 3 WHEN 1 THEN 'B' ELSE 'A' END AS v FROM events) "
query("a22_feedback", _FB + "SELECT round(avg(rating), 2) AS mean, " + ", ".join(f"count(*) FILTER (WHERE rating = {k}) AS n{k}" for k in range(1, 6)) + " FROM f")(lambda s, d: rollup.feedback_stats(_feedback(s, d)))
query("a23_ab_test", _FB + ", x AS (SELECT avg(rating) FILTER (WHERE v = 'A') AS a, avg(rating) FILTER (WHERE v = 'B') AS b, count(*) FILTER (WHERE v = 'A') AS n_a, count(*) FILTER (WHERE v = 'B') AS n_b FROM f) SELECT round(a, 6) AS mean_a, round(b, 6) AS mean_b, n_a, n_b, round((b - a) / a * 100, 4) AS improvement FROM x".replace(", x AS", ", x AS"))(lambda s, d: rollup.ab_stats(_feedback(s, d)))
ORACLES["a23_ab_test"] = ORACLES["a23_ab_test"].replace("FROM events) , x", "FROM events), x")
query("w09_sliding_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW) AS recent FROM events")(lambda s, d: rollup.sliding_count(table(s, d, "events"), "user_id", "ts", 3600).select("event_id", "recent"))
query("r08_ring", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")(lambda s, d: rollup.newest(table(s, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 100).select("event_id"))
query("r03_cache_key", "SELECT event_id, md5('{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}') AS key FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.md5(F.encode(F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))), "UTF-8")).alias("key")))
query("r04_rate_limit")(lambda s, d: state.rate_limit_batch(table(s, d, "events").select(F.col("user_id").cast("string").alias("key"), "ts"), 3, 86400.0))
query("r06_error_windows", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: state.error_counts(table(s, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n"))
query("t02_page", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")(lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), "event_id").offset(40).limit(20).select("event_id"))

# --- mutations --------------------------------------------------------------------------------------------------------


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as they were (content: language) and as they come (content: source; English ones alone)."""
    x = table(s, d, "documents")
    stamp = lambda c, t: (F.col(c).alias("content"), F.lit(t).alias("created_at"), F.lit(t).alias("updated_at"))
    return x.where("lang <> 'fr'").select(F.col("doc_id").alias("id"), *stamp("lang", 1)), x.where("lang in ('en', 'fr')").select(F.col("doc_id").alias("id"), *stamp("source", 2))


query("m01_upsert_documents", "SELECT doc_id AS id, CASE WHEN lang IN ('en', 'fr') THEN source ELSE lang END AS content, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS created_at, CASE WHEN lang IN ('en', 'fr') THEN 2 ELSE 1 END AS updated_at FROM documents")(lambda s, d: merge.upsert_documents(*_halves(s, d)))
query("m09_detach_delete", WITH + " SELECT edge_id, src, dst, type FROM edges WHERE src NOT LIKE 'N1%' AND dst NOT LIKE 'N1%'")(
    lambda s, d: merge.detach_delete(model.nodes(s, d), model.edges(s, d), model.nodes(s, d).where("node_id like 'N1%'").select("node_id"))[1].select("edge_id", "src", "dst", "type"))
query("m03_upsert_relations", WITH + " SELECT DISTINCT src, dst, type FROM edges UNION SELECT src, dst, 'NEW' FROM edges WHERE type = 'IN_REGION'")(
    lambda s, d: merge.upsert_relations(model.edges(s, d), model.edges(s, d).where("type = 'IN_REGION'").select("src", "dst", F.lit("NEW").alias("type")).unionByName(s.createDataFrame([("N1", "nowhere", "NEW")], "src string, dst string, type string")), model.nodes(s, d)))
query("m06_replace_documents", _CHUNKS + " SELECT chunk_id, CASE WHEN lang = 'de' THEN 'new' ELSE 'old' END AS state FROM c JOIN documents ON doc_id = document_id WHERE lang <> 'de' OR chunk_index = 0")(
    lambda s, d: merge.replace_documents(_chunks(s, d).select("chunk_id", "document_id", F.lit("old").alias("state")), text.fixed_windows(table(s, d, "documents").where("lang = 'de'")).where("chunk_index = 0").select("chunk_id", "document_id", F.lit("new").alias("state"))).select("chunk_id", "state"))
query("j26_new_documents", "WITH k AS (SELECT * FROM documents WHERE lang = 'en'), x AS (SELECT *, sha256(text) AS h FROM documents WHERE lang <> 'en' AND sha256(text) NOT IN (SELECT sha256(text) FROM k)) SELECT min(doc_id) AS id FROM x GROUP BY h")(
    lambda s, d: merge.new_documents(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))).select("id"))
