"""More of the catalogue: mentions and terminology, retrieval end to end, evaluation layers, summaries and rollups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.catalog import _BLANKS, _CHUNKS, _COS, _DEG, _chunks, _vector, query
from loomspark.operators import fulltext, graph, knowledge, merge, phrases, quality, relations, report, retrieval, text, vector_index
from loomspark.plans import model
from loomspark.plans.model import WITH
from loomspark.session import table
from loomspark.streaming import ingest

# --- mentions: long words of the benchmark are the entities, typed by their length ------------------------------------

_DICT_SQL = "dict AS (SELECT name, 'T' || length(name) % 3 AS type FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS name FROM benchmark))"
_MENTIONS = f"{_CHUNKS}, {_DICT_SQL}, w AS (SELECT chunk_id, document_id, chunk_index, unnest(regexp_extract_all(lower(content), '[a-z]{{8,}}')) AS name FROM c), m AS (SELECT chunk_id, document_id, chunk_index, name, type, count(*) AS n FROM w JOIN dict USING (name) GROUP BY ALL)"


def _dictionary(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("name")).distinct()
    return names.select("name", F.concat(F.lit("T"), (F.length("name") % 3).cast("string")).alias("type"))


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return knowledge.mentions(_chunks(s, d), _dictionary(s, d), 8)


def _ontology(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("T0", "T1"), ("T1", "T2"), ("T2", "T2")], "src_type string, dst_type string")


query("n01_mentions", f"{_MENTIONS} SELECT chunk_id, name, type, n FROM m")(lambda s, d: _mentions(s, d).select("chunk_id", "name", "type", "n"))
query("j12_chunk_neighbours", f"{_CHUNKS} SELECT a.chunk_id, b.chunk_id AS other_id, b.chunk_index - a.chunk_index AS distance FROM c a JOIN c b ON a.document_id = b.document_id AND b.chunk_index BETWEEN a.chunk_index - 2 AND a.chunk_index + 2 AND a.chunk_index <> b.chunk_index")(
    lambda s, d: knowledge.chunk_neighbours(_chunks(s, d), 2).withColumn("distance", -F.col("distance")).select(F.col("other_id").alias("chunk_id"), F.col("chunk_id").alias("other_id"), "distance"))
query("j15_entity_documents", f"{_MENTIONS} SELECT name, document_id, lang, chunk_index, row_number() OVER (PARTITION BY name ORDER BY source, document_id, chunk_index) AS place FROM m JOIN documents ON doc_id = document_id")(
    lambda s, d: _mentions(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source"), "document_id").select("name", "document_id", "lang", "chunk_index", F.row_number().over(Window.partitionBy("name").orderBy("source", "document_id", "chunk_index")).alias("place")))
query("j16_top_chunks", f"{_MENTIONS} SELECT name, chunk_id, n FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, chunk_id) <= 5")(
    lambda s, d: retrieval.first_per(_mentions(s, d), ["name"], [F.desc("n"), "chunk_id"], 5).select("name", "chunk_id", "n"))
query("j24_ontology_pairs", f"{_MENTIONS} SELECT a.name AS a, b.name AS b, count(*) AS n FROM m a JOIN m b USING (chunk_id) WHERE a.name <> b.name AND (a.type, b.type) IN (('T0','T1'), ('T1','T2'), ('T2','T2')) GROUP BY ALL")(
    lambda s, d: knowledge.pairs_by_type(_mentions(s, d), _ontology(s)))
query("a30_mentions_by_document", f"{_MENTIONS} SELECT document_id, count(*) AS n, string_agg(name || ':' || n, ',' ORDER BY name, chunk_index) AS found FROM m GROUP BY document_id")(
    lambda s, d: _mentions(s, d).groupBy("document_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("name", "chunk_index", "n"))).alias("f")).select("document_id", "n", F.array_join(F.transform("f", lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",").alias("found")))
query("t05_longest_first", f"WITH {_DICT_SQL} SELECT name, length(name) AS size FROM dict ORDER BY size DESC, name LIMIT 20")(lambda s, d: _dictionary(s, d).select("name", F.length("name").alias("size")).orderBy(F.desc("size"), "name").limit(20))

# --- terminology: parts are terms, their types and brands synonyms ----------------------------------------------------

_TERMS_SQL = "terms AS (SELECT 'C' || p_partkey AS code, p_name AS name, [p_type || ' ' || p_size, p_brand || ' ' || p_name] AS synonyms, p_type AS description FROM part)"
_INDEX_SQL = f"""{_TERMS_SQL}, nm AS (SELECT replace(trim(lower(name)), ' ', '') AS key, max(code) AS named FROM terms GROUP BY 1), sy AS (SELECT replace(trim(lower(x)), ' ', '') AS key, min(code) AS other FROM (SELECT code, unnest(synonyms) AS x FROM terms) GROUP BY 1),
 idx AS (SELECT key, coalesce(named, other) AS code FROM nm FULL JOIN sy USING (key) WHERE key <> '')"""


def _terms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")), F.concat_ws(" ", "p_brand", "p_name")).alias("synonyms"), F.col("p_type").alias("description"))


def _names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.upper("p_name").alias("name")).union(table(s, d, "part").select(F.concat_ws("  ", "p_type", (F.col("p_size") + 9).cast("string")))).distinct()


_NAMES_SQL = "names AS (SELECT upper(p_name) AS name FROM part UNION SELECT p_type || '  ' || (p_size + 9) FROM part)"
query("k07_name_index", f"WITH {_INDEX_SQL} SELECT * FROM idx")(lambda s, d: knowledge.name_index(_terms(s, d)))
query("j22_dictionary_join", f"WITH {_INDEX_SQL}, {_NAMES_SQL} SELECT name, code FROM names LEFT JOIN idx ON key = replace(trim(lower(name)), ' ', '')")(lambda s, d: knowledge.lookup(_names(s, d), knowledge.name_index(_terms(s, d))).select("name", "code"))
query("k09_expand_synonyms", f"WITH {_INDEX_SQL}, {_NAMES_SQL} SELECT n.name, array_to_string(list_distinct([n.name] || coalesce(t.synonyms, [])).list_sort(), '|') AS expanded FROM names n LEFT JOIN idx ON key = replace(trim(lower(n.name)), ' ', '') LEFT JOIN terms t USING (code)")(
    lambda s, d: knowledge.expand_names(_names(s, d), _terms(s, d)).select("name", F.array_join(F.array_sort("expanded"), "|").alias("expanded")))
query("k10_lookup_code", f"WITH {_TERMS_SQL} SELECT code, name FROM terms WHERE lower(code) = 'c17' OR lower(name) = 'small ring'")(lambda s, d: _terms(s, d).where((F.lower("code") == "c17") | (F.lower("name") == "small ring")).select("code", "name"))
_SCORE_SQL = "CASE WHEN lower(code) = q THEN 1.0 WHEN starts_with(lower(code), q) THEN 0.9 WHEN lower(name) = q THEN 0.8 WHEN starts_with(lower(name), q) THEN 0.7 WHEN contains(lower(name), q) THEN 0.6 WHEN len(list_filter(synonyms, lambda x: contains(lower(x), q))) > 0 OR contains(lower(description), q) THEN 0.5 END"
_ASKED = ("C17", "small ring", "red", "widget", "brand#4", "economy", "nothing")
query("j23_scored_terms", f"WITH {_TERMS_SQL}, a AS (SELECT unnest([{', '.join(repr(x) for x in _ASKED)}]) AS query), x AS (SELECT query, code, {_SCORE_SQL.replace('q)', 'lower(query))').replace('= q', '= lower(query)')} AS score FROM terms, a) SELECT query, code, score FROM x WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, code) <= 10")(
    lambda s, d: knowledge.term_scores(s.createDataFrame([(x,) for x in _ASKED], "query string"), _terms(s, d)))
query("a31_term_stats", f"WITH {_INDEX_SQL} SELECT (SELECT count(*) FROM terms) AS n_codes, (SELECT count(*) FROM idx) AS n_names")(lambda s, d: knowledge.name_index(_terms(s, d)).agg(F.count("*").alias("n_names")).join(_terms(s, d).agg(F.count("*").alias("n_codes"))).select("n_codes", "n_names"))
query("k06_link_codes", "SELECT name, CASE WHEN list_contains(types, 'ECONOMY') THEN code END AS code, array_to_string(types, ',') AS types FROM (SELECT p_name AS name, list_sort(list_distinct(list(p_type))) AS types FROM part GROUP BY 1) LEFT JOIN (SELECT p_name AS name, min('C' || p_partkey) AS code FROM part WHERE p_size < 20 GROUP BY 1) USING (name)")(
    lambda s, d: knowledge.link_codes(table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_set("p_type")).alias("types")), table(s, d, "part").where("p_size < 20").groupBy(F.col("p_name").alias("name")).agg(F.min(F.concat(F.lit("C"), F.col("p_partkey").cast("string"))).alias("code")), "ECONOMY").select("name", "code", F.array_join("types", ",").alias("types")))
query("k05_fuse", WITH + " SELECT DISTINCT src AS source, dst AS target, e.type FROM edges e JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE (a.label, e.type, b.label) IN (('Supplier', 'SUPPLIES', 'Part'), ('Nation', 'IN_REGION', 'Region'), ('Customer', 'IN_NATION', 'Region'))")(
    lambda s, d: knowledge.fuse(model.nodes(s, d).select(F.col("node_id").alias("name"), F.array("label").alias("types")), model.edges(s, d).select(F.col("src").alias("source"), F.col("dst").alias("target"), "type"), s.createDataFrame([("Supplier", "SUPPLIES", "Part"), ("Nation", "IN_REGION", "Region"), ("Customer", "IN_NATION", "Region")], "src_type string, relation string, dst_type string")))

# --- predicates -------------------------------------------------------------------------------------------------------

_PROPS = ("p_name", "p_brand", "p_type")
query("p03_matched_property", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'r') THEN 'p_name' WHEN contains(lower(p_brand), 'd#1') THEN 'p_brand' WHEN contains(lower(p_type), 'con') THEN 'p_type' END AS property FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.coalesce(*[F.when(F.contains(F.lower(c), F.lit(q)), F.lit(c)) for c, q in zip(_PROPS, ("r", "d#1", "con"))]).alias("property")))


def _word_hits(s: SparkSession, d: str, word: str) -> DataFrame:
    """Items with the word; where none has it, those that contain it anywhere."""
    items = table(s, d, "benchmark").select("item_id", F.lower("text").alias("t"))
    whole = items.where(F.array_contains(F.regexp_extract_all("t", F.lit("[a-z]+"), F.lit(0)), word)).select("item_id", F.lit("word").alias("how"))
    none = whole.agg((F.count("*") == 0).alias("none"))
    return whole.unionByName(items.where(F.contains("t", F.lit(word))).join(F.broadcast(none)).where("none").select("item_id", F.lit("part").alias("how")))


for _name, _word in (("p05_fulltext", "with"), ("p05_fallback", "eroun")):
    query(_name, f"WITH t AS (SELECT item_id, lower(text) AS t FROM benchmark), w AS (SELECT item_id, 'word' AS how FROM t WHERE list_contains(regexp_extract_all(t, '[a-z]+'), '{_word}')) SELECT * FROM w UNION ALL SELECT item_id, 'part' FROM t WHERE contains(t, '{_word}') AND NOT EXISTS (SELECT 1 FROM w)")(lambda s, d, word=_word: _word_hits(s, d, word))
query("p06_chunk_filter", f"{_CHUNKS} SELECT chunk_id FROM c JOIN documents ON doc_id = document_id WHERE lang = 'fr' AND source = 'src3' AND chunk_index = 1")(
    lambda s, d: _chunks(s, d).where("chunk_index = 1").join(table(s, d, "documents").where("lang = 'fr' and source = 'src3'").select(F.col("doc_id").alias("document_id")), "document_id").select("chunk_id"))
query("p07_text_contains", f"{_CHUNKS} SELECT chunk_id, 1.0 AS similarity FROM c WHERE contains(lower(content), 'and the') ORDER BY chunk_id LIMIT 10")(
    lambda s, d: _chunks(s, d).where(F.contains(F.lower("content"), F.lit("and the"))).select("chunk_id", F.lit(1.0).alias("similarity")).orderBy("chunk_id").limit(10))
query("p08_keywords", "WITH k AS (SELECT DISTINCT unnest(list_filter(string_split(p_name, ' '), lambda w: length(w) > 3)) AS keyword FROM part) SELECT keyword, count(*) AS n FROM k JOIN part ON contains(p_name, keyword) GROUP BY 1")(
    lambda s, d: fulltext.containing(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), table(s, d, "part").select(F.explode(F.filter(F.split("p_name", " "), lambda w: F.length(w) > 3)).alias("keyword"))).groupBy("keyword").agg(F.count("*").alias("n")))
# every item is a query for its words of six letters or more; every document is indexed
_QUERY_WORDS = "[a-z]{6,}"
query("p05_ranked", f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), n AS (SELECT count(*) AS total, avg(len(w)) AS mean FROM d),
 p AS (SELECT id, any_value(size) AS size, term, count(*) AS tf FROM (SELECT id, len(w) AS size, unnest(w) AS term FROM d) GROUP BY id, term), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_QUERY_WORDS}')) AS term FROM benchmark),
 s AS (SELECT query_id, id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 9) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY 1, 2),
 r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 20""")(
    lambda s, d: fulltext.search(fulltext.build_index(table(s, d, "documents"), "doc_id", "text"), table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(_QUERY_WORDS), F.lit(0)), " ").alias("text"))).withColumn("score", F.round("score", 6)))
query("p11_error_page", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 7 = 3 AND value > 1 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 5")(lambda s, d: table(s, d, "events").where("event_type = 'error' and user_id % 7 = 3 and value > 1").orderBy(F.desc("ts"), "event_id").offset(5).limit(20).select("event_id"))
query("p12_items", "SELECT item_id, CASE WHEN length(text) < 150 THEN 'easy' ELSE 'hard' END AS difficulty FROM benchmark WHERE item_id % 3 = 1")(lambda s, d: table(s, d, "benchmark").where("item_id % 3 = 1").select("item_id", F.when(F.length("text") < 150, "easy").otherwise("hard").alias("difficulty")))
query("p16_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")(lambda s, d: table(s, d, "orders").where("o_orderdate >= timestamp'1997-01-01'").select("o_orderkey"))
#: Claims that an answer mustn't make, and why.
CLAIMS = [("absolute promise", r"绝对安全|保证治愈|包好|100%|肯定没问题"), ("against seeing a doctor", r"不用(看医生|去医院|就医|检查)"), ("own change of medicine", r"自己(停药|减药|加药|调药)"), ("folk remedy", r"偏方|秘方|祖传")]
#: The same shape over the words of the tables, which hold no Chinese text.
OWN_CLAIMS = [("shouts", r"!!|[A-Z]{4,}"), ("numbers", r"\d{3}"), ("address", r"@|https?:")]
query("p18_claims", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in OWN_CLAIMS) + "], lambda r: r IS NOT NULL), ',') AS reasons FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(knowledge.claims(F.col("text"), OWN_CLAIMS), ",").alias("reasons")))

# --- graph ------------------------------------------------------------------------------------------------------------

_BRANCHES = [(t, way) for t in ("IN_REGION", "IN_NATION", "ORDERED", "SUPPLIES") for way in ("out", "in")]
query("j17_branches", WITH + ", x AS (SELECT src AS node_id, type || '_out' AS branch, dst AS other FROM edges UNION ALL SELECT dst, type || '_in', src FROM edges) SELECT node_id, label, " + ", ".join(f"count(DISTINCT other) FILTER (WHERE branch = '{t}_{w}') AS n_{t.lower()}_{w}" for t, w in _BRANCHES) + " FROM nodes LEFT JOIN x USING (node_id) GROUP BY node_id, label")(
    lambda s, d: model.nodes(s, d).join(model.edges(s, d).select(F.col("src").alias("node_id"), F.concat("type", F.lit("_out")).alias("branch"), F.col("dst").alias("other")).unionByName(model.edges(s, d).select(F.col("dst").alias("node_id"), F.concat("type", F.lit("_in")).alias("branch"), F.col("src").alias("other"))).groupBy("node_id", "branch").agg(F.countDistinct("other").alias("n")), "node_id", "left")
    .groupBy("node_id", "label").agg(*[F.coalesce(F.max(F.when(F.col("branch") == f"{t}_{w}", F.col("n"))), F.lit(0)).cast("bigint").alias(f"n_{t.lower()}_{w}") for t, w in _BRANCHES]))
query("j18_typed_collects", WITH + " SELECT src AS node_id, type, count(DISTINCT dst) AS n, array_to_string(list_sort(list_distinct(list(dst)))[1:5], ',') AS targets FROM edges GROUP BY ALL")(
    lambda s, d: model.edges(s, d).select("src", "type", "dst").distinct().withColumn("k", F.row_number().over(Window.partitionBy("src", "type").orderBy("dst"))).groupBy(F.col("src").alias("node_id"), "type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("dst")))), ",").alias("targets")))
query("j21_optional_relations", WITH + " SELECT node_id, label, type, dst FROM nodes LEFT JOIN edges ON src = node_id")(lambda s, d: model.nodes(s, d).join(model.edges(s, d).select(F.col("src").alias("node_id"), "type", "dst"), "node_id", "left").select("node_id", "label", "type", "dst"))
query("j10_inner_page", WITH + _DEG + ", page AS (SELECT * FROM deg ORDER BY degree DESC, node_id LIMIT 400) SELECT edge_id, src, dst, type FROM edges WHERE src IN (SELECT node_id FROM page) AND dst IN (SELECT node_id FROM page)")(
    lambda s, d: graph.top_page(model.nodes(s, d), model.edges(s, d), 400, inner=lambda page: model.inner_edges(s, d, page))[1].select("edge_id", "src", "dst", "type"))
query("a05_schema", WITH + " SELECT label AS kind, count(*) AS n, array_to_string(list_sort(list_distinct(list(name)))[1:3], ',') AS samples FROM nodes GROUP BY 1 UNION ALL SELECT type, count(*), NULL FROM edges GROUP BY 1")(
    lambda s, d: model.nodes(s, d).groupBy("label", "name").agg(F.count("*").alias("c")).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("name"))).groupBy(F.col("label").alias("kind")).agg(F.sum("c").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("name")))), ",").alias("samples")).unionByName(model.edges(s, d).groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("samples"))))
_LEVELS_SQL = ", l AS (SELECT 0 AS level, src AS node, dst AS community FROM place WHERE type = 'IN_NATION' UNION ALL SELECT 1, a.src, b.dst FROM place a JOIN place b ON a.dst = b.src WHERE a.type = 'IN_NATION')"


def _levels(s: SparkSession, d: str) -> DataFrame:
    """Communities by place: nations at level 0, regions at level 1."""
    place = model.place_edges(s, d)
    low = place.where("type = 'IN_NATION'").select(F.col("src").alias("node"), F.col("dst").alias("community"))
    high = low.join(place.select(F.col("src").alias("community"), F.col("dst").alias("up")), "community").select("node", F.col("up").alias("community"))
    return low.withColumn("level", F.lit(0)).unionByName(high.withColumn("level", F.lit(1)))


query("a07_members", WITH + _LEVELS_SQL + " SELECT level, community, count(*) AS n, min(node) AS first_node, max(node) AS last_node FROM l GROUP BY ALL")(lambda s, d: _levels(s, d).groupBy("level", "community").agg(F.count("*").alias("n"), F.min("node").alias("first_node"), F.max("node").alias("last_node")))
query("a08_hierarchy", WITH + _LEVELS_SQL + " SELECT level, count(DISTINCT community) AS communities, count(*) AS entities FROM l GROUP BY level")(lambda s, d: _levels(s, d).groupBy("level").agg(F.countDistinct("community").alias("communities"), F.count("*").alias("entities")))
query("g06_community_of", WITH + _LEVELS_SQL + " SELECT node_id, coalesce(community, '-1') AS community FROM nodes LEFT JOIN l ON node = node_id AND level = 1")(lambda s, d: model.nodes(s, d).select("node_id").join(_levels(s, d).where("level = 1").select(F.col("node").alias("node_id"), "community"), "node_id", "left").select("node_id", F.coalesce("community", F.lit("-1")).alias("community")))
query("g05_degree_centrality", WITH + ", g AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst), e AS (SELECT u AS node FROM g UNION ALL SELECT v FROM g), n AS (SELECT count(DISTINCT node) AS n FROM e) SELECT node, round(count(*) / (any_value(n) - 1), 9) AS centrality FROM e, n GROUP BY node")(
    lambda s, d: graph.degree_centrality(graph.simple_graph(model.edges(s, d))))
query("g10_entity_summary", WITH + """, t AS (SELECT src, type, count(DISTINCT dst) AS n, list_sort(list_distinct(list(dst)))[1:3] AS f FROM edges GROUP BY ALL), p AS (SELECT src, string_agg(type || ': ' || array_to_string(f, '、') || CASE WHEN n > 3 THEN '等' || n || '个' ELSE '' END, '; ' ORDER BY type) AS r FROM t GROUP BY src)
 SELECT node_id, label || ': ' || name || coalesce(' | 关系: ' || r, '') AS summary FROM nodes LEFT JOIN p ON src = node_id""")(lambda s, d: knowledge.entity_summaries(model.nodes(s, d), model.edges(s, d)))
_SUMMED = _LEVELS_SQL + _DEG + """, r AS (SELECT community, node, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS k FROM l JOIN deg ON node = node_id WHERE level = 0),
 cs AS (SELECT community, count(*) AS size, '社区 ' || community || ' (' || count(*) || '): ' || string_agg(node, '、' ORDER BY k) FILTER (WHERE k <= 10) AS summary FROM r GROUP BY community)"""


def _community_summaries(s: SparkSession, d: str) -> DataFrame:
    degree = graph.degrees(model.nodes(s, d), model.edges(s, d)).select(F.col("node_id").alias("node"), "degree")
    return knowledge.community_summaries(_levels(s, d).where("level = 0").join(degree, "node"))


query("g07_community_summary", WITH + _SUMMED + " SELECT * FROM cs")(_community_summaries)
query("g08_global_summary", WITH + _SUMMED + " SELECT string_agg(summary, chr(10) ORDER BY size DESC, community) AS summary FROM (SELECT * FROM cs ORDER BY size DESC, community LIMIT 3)")(
    lambda s, d: _community_summaries(s, d).orderBy(F.desc("size"), "community").limit(3).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("k"), "community", "summary"))).alias("x")).select(F.array_join("x.summary", "\n").alias("summary")))

# --- retrieval --------------------------------------------------------------------------------------------------------

_DOC_CHUNKS = f"{_CHUNKS}, v AS (SELECT c.chunk_id, c.document_id, c.content, e.embedding, lang FROM c JOIN embeddings e ON vec_id = document_id JOIN documents ON doc_id = document_id)"
_HITS = f"{_DOC_CHUNKS}, h AS (SELECT e.chunk_id, e.document_id, round({_COS}, 6) AS similarity FROM v e, embeddings q WHERE q.vec_id = 2 ORDER BY 3 DESC, 1 LIMIT 10)"


def _chunk_vectors(s: SparkSession, d: str) -> DataFrame:
    """Every chunk with the vector of its document's number."""
    first = _chunks(s, d)
    meta = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    return first.join(table(s, d, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding"), "document_id").join(meta, "document_id")


def _chunk_hits(s: SparkSession, d: str) -> DataFrame:
    hits = retrieval.vector_topk(_chunk_vectors(s, d), _vector(s, d, 2), id_col="chunk_id")
    return hits.withColumn("document_id", F.substring_index("chunk_id", "_", 1).cast("bigint"))


query("v01_chunk_search", f"{_HITS} SELECT * FROM h")(lambda s, d: _chunk_hits(s, d).select("chunk_id", "document_id", "similarity"))
_GRAPH_HITS = "g AS (SELECT m.chunk_id, max(length(name) / 20.0) AS entity_score FROM m GROUP BY 1)"


def _graph_hits(s: SparkSession, d: str) -> DataFrame:
    return _mentions(s, d).groupBy("chunk_id").agg(F.max(F.length("name") / 20).alias("entity_score"))


query("v08_hybrid_search", _HITS.replace(", v AS", ", " + _MENTIONS[len(_CHUNKS) + 2:] + ", v AS", 1) + f""", {_GRAPH_HITS}, x AS (SELECT chunk_id, coalesce(similarity / (SELECT max(similarity) FROM h), 0.0) AS vector_score, coalesce(entity_score, 0.0)::DOUBLE AS graph_score FROM h FULL JOIN g USING (chunk_id))
 SELECT *, round(0.7 * vector_score + (1 - 0.7) * graph_score, 6) AS combined FROM x ORDER BY combined DESC, chunk_id LIMIT 15""")(lambda s, d: retrieval.hybrid_combine(_chunk_hits(s, d), _graph_hits(s, d), 0.7))
query("v07_entity_merge", _HITS.replace(", v AS", f", {_DICT_SQL}, v AS", 1) + """, x AS (SELECT chunk_id AS id, 'vector' AS origin, round(similarity / (SELECT max(similarity) FROM h) * 0.5, 6) AS combined FROM h UNION ALL SELECT name, 'graph', round(length(name) / 20.0 * 0.5, 6) FROM dict)
 SELECT * FROM x ORDER BY combined DESC, id LIMIT 20""")(
    lambda s, d: retrieval.entity_merge(_chunk_hits(s, d), _dictionary(s, d).select("name", (F.length("name") / 20).alias("score")), 0.5, 20))
_NEAR = f"""SELECT query_id, id, similarity, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id))::INT AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"""


def _near(s: SparkSession, d: str, share: float | None = None) -> DataFrame:
    """The ten nearest vectors of all those whose id is divisible by 20, among all."""
    vectors = table(s, d, "embeddings")
    return vector_index.search_vectors(vector_index.build_vector_index(vectors), vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10, share)


query("v03_index_exact", f"SELECT * FROM ({_NEAR}) WHERE rank <= 10")(_near)
query("v03_index_probes")(lambda s, d: _near(s, d, 0.7))
query("v04_vector_cells")(lambda s, d: vector_index.build_vector_index(table(s, d, "embeddings")).cells.select("cell", "n", F.round("radius", 6).alias("radius")))
query("v24_late_chunks", f"{_DOC_CHUNKS}, r AS (SELECT c.chunk_id, (sum(length(c.content)) OVER w - length(c.content)) / sum(length(c.content)) OVER (PARTITION BY c.document_id) AS a, sum(length(c.content)) OVER w / sum(length(c.content)) OVER (PARTITION BY c.document_id) AS b FROM c WINDOW w AS (PARTITION BY c.document_id ORDER BY c.chunk_index)), z AS (SELECT chunk_id, floor(64 * round(a, 6))::INT AS lo, floor(64 * round(b, 6))::INT AS hi, embedding FROM v JOIN r USING (chunk_id)) SELECT chunk_id, lo, hi, round(CASE WHEN hi > lo THEN list_avg(embedding[lo + 1:hi]::DOUBLE[]) ELSE list_avg(embedding::DOUBLE[]) END, 5) AS pooled FROM z")(
    lambda s, d: retrieval.late_chunks(report.start_ratios(_chunks(s, d)).join(_chunks(s, d).select("chunk_id", "document_id"), "chunk_id").join(table(s, d, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding"), "document_id")).select("chunk_id", "lo", "hi", F.round("pooled", 5).alias("pooled")))
query("w05_start_ratios", f"{_CHUNKS} SELECT chunk_id, round((sum(length(content)) OVER w - length(content)) / sum(length(content)) OVER (PARTITION BY document_id), 6) AS start, round(sum(length(content)) OVER w / sum(length(content)) OVER (PARTITION BY document_id), 6) AS \"end\" FROM c WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)")(lambda s, d: report.start_ratios(_chunks(s, d)))
_NEXT = f"n AS (SELECT e.label, e.vec_id, round({_COS.replace('q.embedding', 'e.after')}, 6) AS similarity FROM (SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS after FROM embeddings) e WHERE after IS NOT NULL)"


def _next_similarity(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "embeddings").withColumn("after", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("after is not null")
    return x.select("label", "vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("after")), 6).alias("similarity"))


query("w03_next_similarity", f"WITH {_NEXT} SELECT * FROM n")(_next_similarity)
query("w02_smoothed_similarity", f"WITH {_NEXT} SELECT label, vec_id, round(avg(similarity) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS smooth FROM n")(lambda s, d: report.smoothed(_next_similarity(s, d), "label", "vec_id", "similarity").select("label", "vec_id", "smooth"))
query("x09_semantic_breaks", f"WITH {_NEXT}, w AS (SELECT *, round(avg(similarity) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS smooth FROM n), p AS (SELECT label, quantile_cont(similarity, 0.25) AS cut FROM n GROUP BY label) SELECT label, vec_id, smooth < cut AS breaks FROM w JOIN p USING (label)")(
    lambda s, d: report.smoothed(_next_similarity(s, d), "label", "vec_id", "similarity").join(F.broadcast(_next_similarity(s, d).groupBy("label").agg(F.percentile("similarity", 0.25).alias("cut"))), "label").select("label", "vec_id", (F.col("smooth") < F.col("cut")).alias("breaks")))
_INTENTS = [("code", r"[A-Z]{2,}\d"), ("number", r"\d"), ("joined", r"\band\b"), ("asking", r"\?")]
query("v13_first_rule", "SELECT item_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _INTENTS) + " ELSE 'general' END AS intent FROM benchmark")(lambda s, d: table(s, d, "benchmark").select("item_id", knowledge.first_rule(F.col("text"), _INTENTS, "general").alias("intent")))
query("v10_intent_alpha", "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 ELSE 0.5 END AS alpha FROM benchmark")(lambda s, d: table(s, d, "benchmark").select("item_id", retrieval.alpha_for(F.element_at(F.array(*map(F.lit, ("disease_query", "drug_query", "symptom_query", "other"))), (F.col("item_id") % 4 + 1).cast("int"))).alias("alpha")))
_SYNONYMS = {"with": ["by", "near"], "ring": ["band"], "the": ["a"]}
query("v18_expand_query", "SELECT item_id, array_to_string(list_transform(list_distinct([text] || " + " || ".join(f"(CASE WHEN contains(text, '{t}') THEN [replace(text, '{t}', '{o}')] ELSE [] END)" for t in sorted(_SYNONYMS, key=lambda t: (-len(t), t)) for o in _SYNONYMS[t]) + "), lambda v: md5(v)).list_sort(), ',') AS variants FROM benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(F.transform(knowledge.expand_query(F.col("text"), _SYNONYMS), lambda v: F.md5(F.encode(v, "UTF-8")))), ",").alias("variants")))
query("n19_decompose", "SELECT item_id, array_to_string(CASE WHEN contains(text, ' and ') THEN list_filter(list_transform(string_split(text, ' and '), lambda p: trim(p)), lambda p: p <> '') WHEN contains(text, ', ') THEN list_filter(list_transform(string_split(text, ', '), lambda p: trim(p)), lambda p: p <> '') ELSE [text] END, '|') AS parts FROM benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(knowledge.decompose(F.col("text"), [" and ", ", "]), "|").alias("parts")))
query("n03_pattern_mentions", r"SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+\.[0-9]+|[0-9]{3,}')).list_sort().array_to_string(',') AS found FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+|[0-9]{3,}"), F.lit(0)))), ",").alias("found")))
_SUFFIXES = {"Action": ("tion", "ing"), "Quality": ("ly", "ble"), "Agent": ("er", "or")}
query("n09_suffix_types", f"WITH {_DICT_SQL} SELECT name, CASE " + " ".join("WHEN " + " OR ".join(f"suffix(name, '{e}')" for e in ends) + f" THEN '{t}'" for t, ends in _SUFFIXES.items()) + " ELSE 'Other' END AS kind FROM dict")(
    lambda s, d: _dictionary(s, d).select("name", knowledge.first_rule(F.col("name"), [(t, f"(?:{'|'.join(ends)})$") for t, ends in _SUFFIXES.items()], "Other").alias("kind")))
query("n12_entity_context", f"{_MENTIONS} SELECT chunk_id, name, md5(substring(content, greatest(strpos(lower(content), name) - 50, 1), least(strpos(lower(content), name) - 1, 50) + length(name) + 50)) AS context FROM m JOIN c USING (chunk_id)")(
    lambda s, d: _mentions(s, d).join(_chunks(s, d).select("chunk_id", "content"), "chunk_id").withColumn("p", F.instr(F.lower("content"), F.col("name"))).select("chunk_id", "name", F.md5(F.encode(F.substring("content", F.greatest(F.col("p") - 50, F.lit(1)), F.least(F.col("p") - 1, F.lit(50)) + F.length("name") + 50), "UTF-8")).alias("context")))

# --- evaluation -------------------------------------------------------------------------------------------------------

_PAIR = "q AS (SELECT d.doc_id AS id, d.text AS prediction, b.text AS reference, list_distinct(regexp_extract_all(lower(b.text), '[a-z]{8,}')) AS keywords FROM documents d JOIN benchmark b ON item_id = d.doc_id % (SELECT count(*) FROM benchmark))"


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Every document as the answer to the benchmark item of its number; the item's long words are the keywords."""
    items = table(s, d, "benchmark")
    docs = table(s, d, "documents").join(F.broadcast(items.agg(F.count("*").alias("n")))).select("doc_id", "text", F.pmod("doc_id", "n").alias("item_id"))
    refs = items.select("item_id", F.col("text").alias("reference"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("keywords"))
    return docs.join(F.broadcast(refs) if items.count() <= 10_000 else refs, "item_id").select(F.col("doc_id").alias("id"), F.col("text").alias("prediction"), "reference", "keywords")


_KW = "CASE WHEN len(keywords) = 0 THEN 1.0 ELSE len(list_filter(keywords, lambda k: contains(lower(prediction), k))) / len(keywords) END"
query("e06_keyword_matching", f"WITH {_PAIR} SELECT id, round({_KW}, 6) AS share FROM q")(lambda s, d: _answers(s, d).select("id", F.round(report.share_found(F.col("prediction"), F.col("keywords")), 6).alias("share")))
query("e07_retrieval_recall", rf"WITH {_PAIR}, t AS (SELECT *, regexp_extract_all(reference, '[（(]([A-Z]{{2,}})[）)]', 1) || regexp_extract_all(reference, '[A-Z]\d{{2}}(?:\.\d+)?') || regexp_extract_all(reference, '\d+\.?\d*\s*(?:mmHg|mg|ml|g|IU|U|%|次/分|mmol)') AS terms FROM q) SELECT id, round(CASE WHEN len(keywords) = 0 THEN 1.0 ELSE 0.6 * {_KW} + 0.4 * CASE WHEN len(terms) = 0 THEN 1.0 ELSE len(list_filter(terms, lambda k: contains(lower(prediction), lower(k)))) / len(terms) END END, 6) AS recall FROM t")(
    lambda s, d: _answers(s, d).select("id", F.round(report.retrieval_recall(F.col("prediction"), F.col("keywords"), F.col("reference")), 6).alias("recall")))
query("f22_char_sets", f"WITH {_PAIR} SELECT id, round(len(list_intersect(list_distinct(string_split(prediction, '')), list_distinct(string_split(reference, '')))) / len(list_distinct(string_split(prediction, '') || string_split(reference, ''))), 6) AS jaccard FROM q")(lambda s, d: _answers(s, d).select("id", F.round(report.char_sets(F.col("prediction"), F.col("reference")), 6).alias("jaccard")))
query("f21_char_f1", f"WITH {_PAIR}, x AS (SELECT id, regexp_replace(prediction, '\\s', '', 'g') AS p, regexp_replace(reference, '\\s', '', 'g') AS r FROM q), y AS (SELECT *, list_sum(list_transform(list_intersect(list_distinct(string_split(p, '')), list_distinct(string_split(r, ''))), lambda c: least(length(p) - length(replace(p, c, '')), length(r) - length(replace(r, c, ''))))) AS common FROM x) SELECT id, round(CASE WHEN length(r) = 0 THEN 1.0 WHEN length(p) = 0 OR coalesce(common, 0) = 0 THEN 0.0 ELSE 2.0 * common / (length(p) + length(r)) END, 6) AS f1 FROM y")(lambda s, d: report.char_f1(_answers(s, d)))
_ITEMS = f"""i AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'x' ELSE 'y' END AS intent, CASE WHEN id % 7 = 0 THEN 'x' ELSE 'y' END AS expected_intent, keywords AS expected, list_filter(keywords, lambda k: contains(lower(prediction), k) OR length(k) = 9) || ['other' || id % 3] AS found FROM q)"""


def _judged(s: SparkSession, d: str) -> DataFrame:
    side = lambda n: F.when(F.col("id") % n == 0, "x").otherwise("y")
    found = F.concat(F.filter("keywords", lambda k: F.contains(F.lower("prediction"), k) | (F.length(k) == 9)), F.array(F.concat(F.lit("other"), (F.col("id") % 3).cast("string"))))
    return _answers(s, d).select("id", side(5).alias("intent"), side(7).alias("expected_intent"), F.col("keywords").alias("expected"), found.alias("found"))


_LAYER = f"WITH {_PAIR}, {_ITEMS}, u AS (SELECT id, intent = expected_intent AS ok, len(expected) AS n_expected, len(list_intersect(expected, found)) AS tp, len(list_filter(list_distinct(found), lambda f: NOT list_contains(expected, f))) AS fp FROM i)"
query("u05_true_and_false", f"{_LAYER} SELECT id, n_expected, tp, fp FROM u")(lambda s, d: report.found_counts(_judged(s, d)).select("id", "n_expected", "tp", "fp"))
query("e13_component_layer", f"{_LAYER}, a AS (SELECT avg(ok::INT) AS x, sum(tp) / sum(n_expected) AS y, sum(tp) / (sum(tp) + sum(fp)) AS z FROM u) SELECT round(x, 6) AS intent_accuracy, round(y, 6) AS entity_recall, round(z, 6) AS ner_precision, round(0.35 * x + 0.35 * y + 0.3 * z, 6) AS score, x >= 0.8 AND y >= 0.7 AND z >= 0.75 AS passed FROM a")(lambda s, d: report.component_layer(_judged(s, d)))
query("a11_micro_recall", f"{_LAYER} SELECT round(sum(tp) / sum(n_expected), 6) AS entity_recall, round(avg(ok::INT), 6) AS intent_accuracy FROM u")(lambda s, d: report.component_layer(_judged(s, d)).select("entity_recall", "intent_accuracy"))
_LAYERS = "l AS (SELECT unnest(['component', 'retrieval', 'generation', 'system', 'other']) AS layer, unnest([0.91, 0.72, 0.5, 1.0, 0.3]) AS score, unnest([true, true, false, true, true]) AS passed)"
query("a27_overall_score", f"WITH {_LAYERS} SELECT round(sum(score * CASE layer WHEN 'generation' THEN 0.3 WHEN 'system' THEN 0.2 WHEN 'other' THEN 0 ELSE 0.25 END), 6) AS score, bool_and(passed) AS passed FROM l")(
    lambda s, d: report.overall_score(s.createDataFrame([("component", 0.91, True), ("retrieval", 0.72, True), ("generation", 0.5, False), ("system", 1.0, True), ("other", 0.3, True)], "layer string, score double, passed boolean")))


def _calls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where("value is not null").select("event_type", (F.col("value") / 10).alias("seconds"), (F.col("event_type") != "error").alias("ok"))


_CALLS = "c AS (SELECT event_type, value / 10 AS seconds, event_type <> 'error' AS ok FROM events WHERE value IS NOT NULL)"
query("a13_latency_summary", f"WITH {_CALLS} SELECT count(*) AS n, round(avg(seconds), 6) AS mean, max(seconds) AS most, min(seconds) AS least, round(sum(seconds), 6) AS total, round(count(*) / sum(seconds), 6) AS throughput FROM c")(lambda s, d: report.latency_summary(_calls(s, d)))
query("a18_process_stats", f"WITH {_CALLS} SELECT event_type, count(*) AS n, round(sum(seconds), 6) AS total, min(seconds) AS least, max(seconds) AS most, count(*) FILTER (WHERE NOT ok) AS errors, count(*) FILTER (WHERE ok) AS successes, round(avg(seconds), 6) AS mean FROM c GROUP BY 1")(lambda s, d: report.process_stats(_calls(s, d), "event_type"))
query("e16_system_layer", f"WITH {_CALLS}, p AS (SELECT seconds AS p95 FROM c ORDER BY seconds LIMIT 1 OFFSET (SELECT least(floor(count(*) * 0.95), count(*) - 1)::BIGINT FROM c)), a AS (SELECT avg(seconds) AS m, any_value(p95) AS q, avg((NOT ok)::INT) AS e FROM c, p) SELECT round(greatest(0.0, 1 - m / 10), 6) AS latency, m <= 10 AS latency_ok, round(greatest(0.0, 1 - q / 30), 6) AS p95, q <= 30 AS p95_ok, round(1 - e, 6) AS success FROM a")(
    lambda s, d: report.system_layer(_calls(s, d).join(F.broadcast(_rollup_quantile(_calls(s, d)))), 10.0, 30.0))
query("e25_load_stats", f"WITH {_CALLS} SELECT event_type, quantile_cont(seconds, 0.5) AS median, max(seconds) AS most, round(100.0 * count(*) FILTER (WHERE NOT ok) / count(*), 4) AS error_rate FROM c GROUP BY 1")(
    lambda s, d: _calls(s, d).groupBy("event_type").agg(F.percentile("seconds", 0.5).alias("median"), F.max("seconds").alias("most"), F.round(100 * F.count_if(~F.col("ok")) / F.count("*"), 4).alias("error_rate")))
query("a24_hit_rate", "SELECT round(count(*) FILTER (WHERE event_type = 'view') / count(*) FILTER (WHERE event_type IN ('view', 'click')), 6) AS hit_rate FROM events")(lambda s, d: table(s, d, "events").agg(F.round(F.count_if(F.col("event_type") == "view") / F.count_if(F.col("event_type").isin("view", "click")), 6).alias("hit_rate")))
query("a25_ingestion", f"{_CHUNKS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM documents WHERE coalesce(length(trim(text)), 0) < 10) AS skipped")(
    lambda s, d: table(s, d, "documents").agg(F.count("*").alias("documents"), F.count_if(F.coalesce(F.length(F.trim("text")), F.lit(0)) < 10).alias("skipped")).join(_chunks(s, d).agg(F.count("*").alias("chunks"))).select("documents", "chunks", "skipped"))
query("a26_ragas_summary", "WITH x AS (SELECT vec_id % 11 / 10.0 AS f, vec_id % 7 / 6.0 AS r, vec_id % 5 / 4.0 AS c, vec_id % 9 / 8.0 AS s FROM embeddings) SELECT round(avg(f), 6) AS avg_faithfulness, round(avg(r), 6) AS avg_relevancy, round(avg(c), 6) AS avg_correctness, round(avg(s), 6) AS avg_safety, round(avg((s >= 0.8)::INT), 6) AS safety_pass_rate, round(avg((f >= 0.7)::INT), 6) AS faithfulness_pass_rate FROM x")(
    lambda s, d: report.ragas_summary(table(s, d, "embeddings").select(*[(F.col("vec_id") % n / (n - 1)).alias(c) for c, n in (("faithfulness", 11), ("relevancy", 7), ("correctness", 5), ("safety", 9))])))
query("a32_rejections", "SELECT round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS rate, count(*) AS n FROM events")(lambda s, d: table(s, d, "events").agg(F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("rate"), F.count("*").alias("n")))
_QUALITY = f"""{_CHUNKS}, n AS (SELECT *, lead(content) OVER (PARTITION BY document_id ORDER BY chunk_index) AS after FROM c), o AS (SELECT *, CASE WHEN after IS NULL THEN NULL WHEN length(content) >= 75 AND length(after) >= 75 THEN len(list_intersect(list_distinct(string_split(right(content, 75), '')), list_distinct(string_split(left(after, 75), '')))) / len(list_distinct(string_split(right(content, 75), '') || string_split(left(after, 75), ''))) ELSE 0.0 END AS shared FROM n)
, z AS (SELECT document_id, count(*) AS n, round(avg(regexp_matches(rtrim(content), '[。！？；.!?]$')::INT), 6) AS clean_ends, round(stddev_pop(length(content)) / avg(length(content)), 6) AS stability, round(coalesce(avg(shared), 1.0), 6) AS overlap FROM o GROUP BY 1)"""
query("x18_chunk_quality", f"{_QUALITY} SELECT * FROM z")(lambda s, d: report.chunk_quality(_chunks(s, d)))
query("a29_strategy_ranking", f"{_QUALITY} SELECT lang, round(avg(clean_ends), 5) AS score, count(*) FILTER (WHERE stability < 0.5) AS passed, count(*) AS total FROM z JOIN documents ON doc_id = document_id GROUP BY 1")(
    lambda s, d: report.chunk_quality(_chunks(s, d)).join(table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "lang"), "document_id").groupBy("lang").agg(F.round(F.avg("clean_ends"), 5).alias("score"), F.count_if(F.col("stability") < 0.5).alias("passed"), F.count("*").alias("total")))
query("a10_macro_average", f"WITH {_PAIR}, x AS (SELECT round({_KW}, 6) AS kw, (trim(prediction, {_BLANKS}) = trim(reference, {_BLANKS}))::INT AS exact FROM q) SELECT round(avg(kw), 5) AS keyword_matching, round(avg(exact), 5) AS exact_match FROM x")(
    lambda s, d: _answers(s, d).agg(F.round(F.avg(F.round(report.share_found(F.col("prediction"), F.col("keywords")), 6)), 5).alias("keyword_matching"), F.round(F.avg((F.trim(F.col("prediction"), F.lit(quality.BLANKS)) == F.trim(F.col("reference"), F.lit(quality.BLANKS))).cast("int")), 5).alias("exact_match")))

# --- sets, lists and splits -------------------------------------------------------------------------------------------

query("u07_first_question", "SELECT md5(text) AS text, min(doc_id) AS doc_id FROM (SELECT lower(trim(text)) AS text, doc_id FROM documents) GROUP BY 1")(lambda s, d: table(s, d, "documents").groupBy(F.md5(F.encode(F.lower(F.trim("text")), "UTF-8")).alias("text")).agg(F.min("doc_id").alias("doc_id")))
query("u10_split", "SELECT count(*) AS n FROM documents")(lambda s, d: _split_sizes(s, d))
query("w08_sessions", "SELECT conv_id, left(arg_min(text, turn) FILTER (WHERE role = 'user'), 30) AS title, max(turn) AS last_turn, row_number() OVER (ORDER BY max(turn) DESC, conv_id) AS place FROM conversations GROUP BY conv_id ORDER BY place LIMIT 50")(
    lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.substring(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))), 1, 30).alias("title"), F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").limit(50).withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_turn"), "conv_id"))))
query("f20_shown_list", WITH + " SELECT dst, array_to_string(list_sort(list(src))[1:3], '、') || CASE WHEN count(*) > 3 THEN '等' || count(*) || '个' ELSE '' END AS shown FROM place WHERE type = 'IN_REGION' GROUP BY dst")(lambda s, d: model.place_edges(s, d).where("type = 'IN_REGION'").groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("names")).select("dst", knowledge.shown(F.col("names")).alias("shown")))
query("a20_error_sets_all", "SELECT event_type, user_id % 7 AS source, floor(value / 10)::BIGINT AS severity, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value IS NOT NULL GROUP BY GROUPING SETS ((event_type), (user_id % 7), (floor(value / 10)::BIGINT), ())")(
    lambda s, d: s.sql("SELECT event_type, source, severity, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT event_type, user_id, user_id % 7 AS source, CAST(floor(value / 10) AS BIGINT) AS severity FROM {e} WHERE value IS NOT NULL) GROUP BY GROUPING SETS ((event_type), (source), (severity), ())", e=table(s, d, "events")))


def _rollup_quantile(calls: DataFrame) -> DataFrame:
    from loomspark.operators.rollup import indexed_quantile

    return indexed_quantile(calls.withColumn("all", F.lit(1)), "all", "seconds", 0.95).select(F.col("quantile").alias("p95"))


def _split_sizes(s: SparkSession, d: str) -> DataFrame:
    """Both sides of a seeded split together: no row is lost or doubled."""
    train, test = quality.split_by_hash(table(s, d, "documents"), "doc_id", 0.8, 7)
    return train.unionByName(test).agg(F.count("*").alias("n"))


# --- strategies, extraction and upserts -------------------------------------------------------------------------------

_HEADS = "len(regexp_extract_all(text, '(?m)^{0}[ \\t\\n\\f\\r]+')) > 0"
query("x14_select_strategy", rf"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '(?m)^#{{1,6}}\s+.+$')) >= 3 THEN 'markdown' WHEN length(text) > 5000 AND NOT regexp_matches(text, '第[一二三四五六七八九十\d]+[章节部分篇]|【.+】|\d+\.\s+[A-Z\x{{4e00}}-\x{{9fff}}]') THEN 'semantic'
 WHEN ({_HEADS.format('#')} AND {_HEADS.format('##')}) OR ({_HEADS.format('##')} AND {_HEADS.format('###')}) THEN 'hierarchical' ELSE 'recursive' END AS strategy FROM documents""")(lambda s, d: table(s, d, "documents").select("doc_id", text.select_strategy(F.col("text")).alias("strategy")))
query("x14_strategy", rf"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '(?m)^#{{1,6}}\s+.+$')) >= 3 THEN 'markdown' WHEN length(text) > 5000 AND NOT regexp_matches(text, '第[一二三四五六七八九十\d]+[章节部分篇]|【.+】|\d+\.\s+[A-Z\x{{4e00}}-\x{{9fff}}]') THEN 'paragraph'
 WHEN ({_HEADS.format('#')} AND {_HEADS.format('##')}) OR ({_HEADS.format('##')} AND {_HEADS.format('###')}) THEN 'hierarchical' ELSE 'recursive' END AS strategy FROM documents""")(lambda s, d: table(s, d, "documents").select("doc_id", text.run_strategy(F.col("text")).alias("strategy")))
query("x15_contextual", f"{_CHUNKS} SELECT chunk_id, md5('[上下文] ' || left(lang || ' ' || source, 200) || chr(10) || content) AS h FROM c JOIN documents ON doc_id = document_id")(
    lambda s, d: text.contextual(_chunks(s, d), table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat_ws(" ", "lang", "source").alias("context"))).select("chunk_id", F.md5(F.encode("content", "UTF-8")).alias("h")))
_PATTERNS = [(r"[0-9]{3,}", "Number", 0.75), (r"[A-Z][a-z]{9,}", "Name", 0.7), (r"[0-9]+\.[0-9]+", "Decimal", 0.8), (r"[A-Za-z]{12,}", "Name", 0.6)]
query("n04_pattern_entities", "SELECT id, name, type, strpos(text, name) - 1 AS start FROM (" + " UNION ALL ".join(f"SELECT doc_id AS id, text, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS name, '{t}' AS type FROM documents" for p, t, _ in _PATTERNS) + ")")(
    lambda s, d: text.pattern_mentions(table(s, d, "documents"), _PATTERNS, "doc_id", "text").select("id", "name", "type", "start"))
for _how in text.REPEATING:
    query(f"x0_split_{_how}")(lambda s, d, how=_how: text.split_documents(table(s, d, "documents"), 512, how))
_FOLD_SQL = """WITH RECURSIVE p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM
 (SELECT doc_id, list_filter(list_transform({parts}, lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32))), lambda x: x <> '') AS parts FROM documents)),
f AS (SELECT doc_id, 0::BIGINT AS k, NULL::VARCHAR AS held, 0::BIGINT AS n, []::VARCHAR[] AS made FROM documents
 UNION ALL SELECT doc_id, g.k, CASE WHEN big THEN NULL WHEN cut THEN concat_ws(chr(10) || chr(10), tail, part) ELSE concat_ws(chr(10) || chr(10), held, part) END,
  CASE WHEN big THEN 0 WHEN cut THEN coalesce(length(tail), 0) + length(part) ELSE n + length(part) END,
  CASE WHEN big THEN list_concat(CASE WHEN held IS NULL THEN [] ELSE [held] END, list_transform(range(0, length(part), 437), lambda u: substring(part, u + 1, 512))) WHEN cut THEN [held] ELSE [] END
 FROM (SELECT f.doc_id, p.k, held, n, part, length(part) > 512 AS big, held IS NOT NULL AND n >= 384 AS cut, nullif(CASE WHEN trim(right(held, 75), chr(9) || chr(10) || chr(13) || chr(32)) = '' THEN '' ELSE right(held, 75) END, '') AS tail FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1) g),
e AS (SELECT doc_id, k, unnest(made) AS content, generate_subscripts(made, 1) AS j FROM f UNION ALL SELECT doc_id, max(k) + 1, arg_max(coalesce(held, ''), k), 1 FROM f GROUP BY doc_id),
c AS (SELECT doc_id, content, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::INT AS chunk_index FROM e WHERE trim(content) <> '')
SELECT doc_id || '_chunk_' || chunk_index AS chunk_id, doc_id AS document_id, '{how}' AS strategy, chunk_index, content FROM c"""
for _how, _parts in (("sentence", "regexp_extract_all(text, '[^。！？；.!?]*[。！？；.!?]|[^。！？；.!?]+')"), ("paragraph", r"string_split_regex(text, '\n\s*\n')")):
    query(f"x0_split_{_how}", _FOLD_SQL.format(parts=_parts, how=_how))(lambda s, d, how=_how: text.split_documents(table(s, d, "documents"), 512, how))
# phrases: pairs of neighbouring words of the benchmark's texts, of four letters or more, and single ones of eight
_PHRASES_SQL = """w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark), p AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w)),
 dict AS (SELECT DISTINCT name, 'T' || length(name) % 3 AS type FROM (SELECT a || ' ' || b AS name FROM p WHERE length(a) > 3 AND length(b) > 3 UNION ALL SELECT a FROM p WHERE length(a) > 7)),
 c AS (SELECT doc_id, piece, k, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS x FROM documents))),
 t AS (SELECT doc_id, piece AS a, (upto - length(piece))::INT AS start, upto::INT AS "end", lead(piece) OVER v AS b, (lead(upto) OVER v)::INT AS end2 FROM c WHERE regexp_matches(piece, '^[\\p{L}\\p{N}]') WINDOW v AS (PARTITION BY doc_id ORDER BY k)),
 m AS (SELECT doc_id AS id, a AS name, start, "end" FROM t UNION ALL SELECT doc_id, a || ' ' || b, start, end2 FROM t WHERE b IS NOT NULL)"""


def _phrases(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    p = w.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b"))).alias("p")).select("p.a", "p.b")
    names = p.where("length(a) > 3 and length(b) > 3").select(F.concat_ws(" ", "a", "b").alias("name")).unionByName(p.where("length(a) > 7").select(F.col("a").alias("name"))).distinct()
    return names.select("name", F.concat(F.lit("T"), (F.length("name") % 3).cast("string")).alias("type"))


def _phrase_mentions(s: SparkSession, d: str) -> DataFrame:
    return phrases.phrase_mentions(table(s, d, "documents"), _phrases(s, d), "doc_id", "text")


query("n01_phrases", f"WITH {_PHRASES_SQL} SELECT id, name, type, start, \"end\", 0.95 AS confidence FROM m JOIN dict USING (name)")(lambda s, d: _phrase_mentions(s, d).drop("strategy"))
query("n05_cross_validated", f"WITH {_PHRASES_SQL}, f AS (SELECT id, name, type, start, \"end\" FROM m JOIN dict USING (name)) SELECT id, name, type, min(start) AS start, arg_min(\"end\", start) AS \"end\", CASE WHEN count(*) > 1 THEN 1.0 ELSE 0.95 END AS confidence FROM f GROUP BY id, name, type")(
    lambda s, d: phrases.cross_validated(_phrase_mentions(s, d)).drop("strategy"))
_SHORT = ["AND", "THE", "MIT", "GNU", "CC", "NC"]


def _extracted(s: SparkSession, d: str) -> DataFrame:
    """All strategies over all documents: phrases, abbreviations, and the patterns of _PATTERNS."""
    docs = table(s, d, "documents")
    short = s.createDataFrame([(a, a.lower(), "Short") for a in _SHORT], "abbr string, name string, type string")
    return phrases.entities(_phrase_mentions(s, d), phrases.abbreviations(docs, short, "doc_id", "text"), text.pattern_mentions(docs, _PATTERNS, "doc_id", "text"))


query("n07_extract")(_extracted)


def _entities(s: SparkSession, d: str, where: str, kind: str, confidence: float) -> DataFrame:
    part = table(s, d, "part").where(where).groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    return part.select("name", F.lit(kind).alias("type"), "types", F.lit(1).cast("bigint").alias("version"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("source"))


_SIDES = "o AS (SELECT p_name AS name, list_distinct(list(p_type)) AS types FROM part WHERE p_size < 10 GROUP BY 1), n AS (SELECT p_name AS name, list_distinct(list(p_type)) AS types FROM part WHERE p_size BETWEEN 9 AND 12 GROUP BY 1)"
query("m07_versioned_entities", f"WITH {_SIDES} SELECT name, CASE WHEN o.types IS NULL THEN 'new' ELSE 'old' END AS type, array_to_string(list_sort(list_distinct(coalesce(o.types, []) || coalesce(n.types, []))), ',') AS types, CASE WHEN o.types IS NULL OR n.types IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN n.types IS NULL THEN 0.9 ELSE 0.4 END AS confidence, CASE WHEN n.types IS NULL THEN 'old' ELSE 'new' END AS source FROM o FULL JOIN n USING (name)")(
    lambda s, d: merge.upsert_versioned(_entities(s, d, "p_size < 10", "old", 0.9), _entities(s, d, "p_size between 9 and 12", "new", 0.4)).withColumn("types", F.array_join("types", ",")))
query("m02_upsert_entities", f"WITH {_SIDES} SELECT name, CASE WHEN o.types IS NULL THEN 'new' ELSE 'old' END AS type, array_to_string(list_sort(list_distinct(coalesce(o.types, []) || coalesce(n.types, []))), ',') AS types, CASE WHEN o.types IS NULL OR n.types IS NULL THEN 1 ELSE 2 END AS version FROM o FULL JOIN n USING (name)")(
    lambda s, d: merge.upsert_entities(_entities(s, d, "p_size < 10", "old", 0.9), _entities(s, d, "p_size between 9 and 12", "new", 0.4)).withColumn("types", F.array_join("types", ",")))
query("m08_stamped_relations", WITH + ", n AS (SELECT DISTINCT src, dst, type FROM edges WHERE type = 'SUPPLIES' UNION SELECT 'S1', 'R0', 'NEW' UNION SELECT 'S1', 'Q9', 'NEW') SELECT src, dst, type, CASE WHEN p.edge_id IS NULL THEN 9 ELSE 1 END AS created_at, CASE WHEN n.src IS NULL THEN 1 ELSE 9 END AS updated_at FROM (SELECT * FROM edges WHERE type <> 'ORDERED') p FULL JOIN (SELECT * FROM n WHERE dst <> 'Q9') n USING (src, dst, type)")(
    lambda s, d: merge.upsert_stamped(model.edges(s, d).where("type <> 'ORDERED'").select("src", "dst", "type", F.lit(1).alias("created_at"), F.lit(1).alias("updated_at")), model.edges(s, d).where("type = 'SUPPLIES'").select("src", "dst", "type").union(s.createDataFrame([("S1", "R0", "NEW"), ("S1", "Q9", "NEW")], "src string, dst string, type string")), model.nodes(s, d), 9))
query("m04_link_upserts", f"{_MENTIONS}, o AS (SELECT chunk_id, name FROM m WHERE document_id % 2 = 0), n AS (SELECT chunk_id, name FROM m WHERE document_id % 3 = 0) SELECT chunk_id, name FROM o UNION SELECT chunk_id, name FROM n")(
    lambda s, d: _mentions(s, d).where("document_id % 2 = 0").select("chunk_id", "name").union(_mentions(s, d).where("document_id % 3 = 0").select("chunk_id", "name")).distinct())
query("m10_version_records", "SELECT doc_id AS document_id, CASE WHEN lang = 'fr' OR lang <> 'de' THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS version, CASE WHEN lang = 'de' THEN 7 ELSE 1 END AS created_at, CASE WHEN lang IN ('en', 'de') THEN 7 ELSE 1 END AS updated_at FROM documents WHERE lang <> 'de'")(
    lambda s, d: merge.upsert_versions(table(s, d, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("document_id"), F.lit(1).cast("bigint").alias("version"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at")), table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("document_id")), 7))
query("r09_feedback_ring", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")(lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id"))
query("n21_context_lines", "SELECT item_id, '  ' || row_number() OVER (ORDER BY item_id) || '. id: ' || item_id || ', text: ' || text AS line FROM benchmark ORDER BY item_id LIMIT 10")(
    lambda s, d: table(s, d, "benchmark").orderBy("item_id").limit(10).withColumn("k", F.row_number().over(Window.orderBy("item_id"))).select("item_id", F.concat(F.lit("  "), F.col("k").cast("string"), F.lit(". id: "), F.col("item_id").cast("string"), F.lit(", text: "), "text").alias("line")))
query("t06_list_caps", WITH + " SELECT dst AS node_id, array_to_string(list_sort(list(src))[1:5], ',') AS shown, count(*) AS n FROM edges GROUP BY dst")(
    lambda s, d: retrieval.first_per(model.edges(s, d), ["dst"], ["src"], 5).groupBy(F.col("dst").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("shown")).join(model.edges(s, d).groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n")), "node_id"))

# --- fusion whole: nodes are entities, edges relations whose types are texts to align -----------------------------------

_ALIGN = [("nation", "LOCATED_IN", 0), ("in region of", "PART_OF", 1), ("supplies parts", "SUPPLIES", 2), ("order", "ORDERS", 3), ("in", "IN", 4), ("ordered", "HAS_ORDERED", 5)]
_ALLOWED = [("Customer", "LOCATED_IN", "Nation"), ("Supplier", "LOCATED_IN", "Nation"), ("Nation", "PART_OF", "Region"), ("Supplier", "SUPPLIES", None), ("Nation", "ORDERS", "Part")]
_CANONICAL = [("FRANCE", "Nation", "Frankreich"), ("ASIA", "Symptom", "Asien")]
_rows = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
_FUSE_SQL = f"""ph(phrase, relation, ord) AS (VALUES {_rows(_ALIGN)}), onto(s, r, t) AS (VALUES {_rows(_ALLOWED)}), syn(name, type, canonical) AS (VALUES {_rows(_CANONICAL)}),
 rel AS (SELECT a.name AS source, a.label AS st, b.name AS target, CASE WHEN b.label = 'Region' THEN NULL ELSE b.label END AS tt, lower(replace(type, '_', ' ')) AS text FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst),
 al AS (SELECT DISTINCT text, coalesce((SELECT relation FROM ph WHERE contains(text, phrase) OR contains(phrase, text) ORDER BY length(phrase) DESC, ord, relation LIMIT 1), text) AS relation FROM rel)"""


def _graph_relations(s: SparkSession, d: str) -> DataFrame:
    """Relations with no type for regions, which so count as the default type."""
    of = lambda key, name, kind: model.nodes(s, d).select(F.col("node_id").alias(key), F.col("name").alias(name), F.col("label").alias(kind))
    x = model.edges(s, d).join(of("src", "source", "source_type"), "src").join(of("dst", "target", "target_type"), "dst")
    return x.select("source", "source_type", "target", F.when(F.col("target_type") != "Region", F.col("target_type")).alias("target_type"), F.lower(F.replace("type", F.lit("_"), F.lit(" "))).alias("type"))


def _texts(types: DataFrame) -> DataFrame:
    return types.select(F.lower(F.replace("type", F.lit("_"), F.lit(" "))).alias("text"))


query("k04_align", WITH + f", {_FUSE_SQL} SELECT * FROM al")(lambda s, d: relations.align(_texts(model.edge_types(s, d)), s.createDataFrame(_ALIGN, "phrase string, relation string, ord int")))
query("k05_fuse_whole", WITH + f""", {_FUSE_SQL},
 ent AS (SELECT DISTINCT coalesce(canonical, n.name) AS c, label AS type FROM nodes n LEFT JOIN syn ON lower(syn.name) = lower(n.name) AND syn.type = n.label),
 x AS (SELECT DISTINCT coalesce(a.canonical, rel.source) AS source, coalesce(b.canonical, rel.target) AS target, relation FROM rel JOIN al USING (text) LEFT JOIN syn a ON lower(a.name) = lower(rel.source) AND a.type = st LEFT JOIN syn b ON lower(b.name) = lower(rel.target) AND b.type = coalesce(tt, 'Symptom'))
 SELECT DISTINCT source, target, relation FROM x JOIN ent e ON e.c = source JOIN ent f ON f.c = target JOIN onto ON s = e.type AND r = relation AND (t IS NULL OR t = f.type)""")(
    lambda s, d: relations.fuse(model.nodes(s, d).select("name", F.col("label").alias("type")), _graph_relations(s, d), s.createDataFrame([], "abbr string, canonical string"), s.createDataFrame(_CANONICAL, "synonym string, entity_type string, canonical string"),
        s.createDataFrame(_ALIGN, "phrase string, relation string, ord int"), s.createDataFrame(_ALLOWED, "src_type string, relation string, dst_type string"), texts=_texts(model.edge_types(s, d))))

# --- ingest in batches: all documents, then all again with the German ones changed ------------------------------------

_CLEAN = r"nullif(translate(trim(regexp_replace({0}, '[ \t\n\x0b\f\r]+', ' ', 'g')), ',;:', '，；：'), '')"
_BATCHES = f"""WITH d AS (SELECT doc_id::VARCHAR AS id, {_CLEAN.format('text')} AS a, {_CLEAN.format("CASE WHEN lang = 'de' THEN text || ' v2' ELSE text END")} AS b FROM documents),
 one AS (SELECT id, a AS c, CASE WHEN a IS NULL THEN 'failed' WHEN id = min(id) OVER (PARTITION BY a) THEN 'added' ELSE 'duplicate' END AS status FROM d),
 known AS (SELECT id, c FROM one WHERE status = 'added'),
 two AS (SELECT d.id, b AS c, CASE WHEN b IS NULL THEN 'failed' WHEN known.c = b THEN 'unchanged' WHEN b IN (SELECT c FROM known) OR d.id <> min(d.id) OVER (PARTITION BY b) THEN 'duplicate' WHEN known.id IS NOT NULL THEN 'updated' ELSE 'added' END AS status FROM d LEFT JOIN known USING (id)),
 every AS (SELECT 0::BIGINT AS seq, * FROM one UNION ALL SELECT 1, * FROM two)"""


def _ingested(s: SparkSession, d: str) -> str:
    """The folder of a log of two batches, of which the first is handed in twice."""
    root, docs = f"{graph.shared_folder(s)}/ingest-{uuid.uuid4().hex}", table(s, d, "documents").withColumn("document_id", F.col("doc_id").cast("string"))
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    for key, content in (("all", F.col("text")), ("all", F.col("text")), ("again", changed)):
        ingest.ingest_batch(docs.select("document_id", content.alias("content")), key, root)
    return root


query("m12_ingest_results", _BATCHES + " SELECT seq, id AS document_id, status, CASE WHEN status IN ('added', 'updated') THEN (length(c) - 1) // 437 + 1 ELSE 0 END::BIGINT AS n_chunks FROM every")(
    lambda s, d: ingest.results(s, _ingested(s, d)).select("seq", "document_id", "status", "n_chunks"))
query("m05_ingested_chunks", _BATCHES + """, now AS (SELECT id, arg_max(c, seq) AS c FROM every WHERE status IN ('added', 'updated') GROUP BY id)
 SELECT id AS document_id, (u // 437)::INT AS chunk_index, id || '_chunk_' || (u // 437) AS chunk_id, md5(substring(c, u + 1, 512)) AS h FROM (SELECT id, c, unnest(range(0, length(c), 437)) AS u FROM now)""")(
    lambda s, d: ingest.snapshot(s, _ingested(s, d)).select("document_id", "chunk_index", "chunk_id", F.md5(F.encode("content", "UTF-8")).alias("h")))
