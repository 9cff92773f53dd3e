"""The catalogue's searches for whole tables of questions, intents, variants and golden sets. The questions are the users' turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.catalog import _count_sql, query
from loomspark.catalog_more import _MENTIONS, _SUMMED, _community_summaries, _dictionary, _mentions, _ontology
from loomspark.operators import fulltext, intents, knowledge, retrieval, search
from loomspark.plans import model
from loomspark.plans.model import WITH
from loomspark.session import table
from loomspark.sources import encodings, records

#: Words that tell how to search these four languages' turns.
WIDE, NARROW, NUMERIC = ["the", "les", "los", "die"], ["of", "dans", "para", "mit"], ["was", "par"]
_WORD = r"[\p{L}]{9,}"

_Q = "q AS (SELECT conv_id || ':' || turn AS query_id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL)"
_R = f"""{_Q}, rc AS (SELECT *, {_count_sql(WIDE)} AS g, {_count_sql(NARROW)} AS n, {_count_sql(NUMERIC)} AS x FROM q),
 rt AS (SELECT query_id, text, CASE WHEN g > n THEN 'global' WHEN n > g THEN 'local' WHEN x > 0 THEN 'local' WHEN g > 0 THEN 'local' ELSE 'hybrid' END AS strategy FROM rc)"""


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").where("role = 'user' and text is not null").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "text")


def _routed(s: SparkSession, d: str) -> DataFrame:
    return _questions(s, d).withColumn("strategy", retrieval.route(F.col("text"), WIDE, NARROW, NUMERIC)).withColumn("alpha", retrieval.route_alpha(F.col("strategy")))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return knowledge.pairs_by_type(_mentions(s, d), _ontology(s))


# names in a question of {q}, or names that contain its words
_HITS = """w8 AS (SELECT query_id, name, count(*) AS n FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z]{{8,}}')) AS name FROM {q}) JOIN dict USING (name) GROUP BY ALL),
 w5 AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS keyword FROM {q} WHERE query_id NOT IN (SELECT query_id FROM w8)),
 ha AS (SELECT query_id, name, round(n / max(n) OVER (PARTITION BY query_id), 6) AS score FROM w8 UNION ALL SELECT query_id, name, round(max(length(keyword) / length(name)), 6) FROM w5 JOIN dict ON contains(name, keyword) GROUP BY ALL),
 h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name)::INT AS rank FROM ha QUALIFY rank <= 10)"""
_PATHS = """pr AS (SELECT a.name AS a, b.name AS b, count(*) AS n FROM m a JOIN m b USING (chunk_id) WHERE a.name <> b.name AND (a.type, b.type) IN (('T0','T1'), ('T1','T2'), ('T2','T2')) GROUP BY ALL),
 ne AS (SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT a, b, n FROM pr UNION ALL SELECT b, a, n FROM pr) GROUP BY ALL),
 pa AS (SELECT a AS name, 1 AS hops, n AS n1, b AS via, 0 AS n2, b AS "end" FROM ne UNION ALL SELECT x.a, 2, x.n, x.b, y.n, y.b FROM ne x JOIN ne y ON y.a = x.b AND y.b <> x.a),
 ps AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY hops, n1 DESC, via, n2 DESC, "end")::INT AS step, hops, via, "end" FROM pa WHERE name IN (SELECT name FROM h) QUALIFY step <= 5)"""
query("v15_local_search", f"{_MENTIONS}, {_R}, {_HITS.format(q='q')}, {_PATHS} SELECT query_id, name, score, rank, step, hops, via, \"end\" FROM h LEFT JOIN ps USING (name)")(
    lambda s, d: search.local_search(search.entity_hits(_questions(s, d), _dictionary(s, d)), _edges(s, d)).select("query_id", "name", "score", "rank", "step", "hops", "via", "end"))

query("v14_global_search", WITH + _SUMMED + f", {_R}, t AS (SELECT *, row_number() OVER (ORDER BY size DESC, community)::INT AS rank FROM cs QUALIFY rank <= 3) SELECT query_id, community, size, summary, rank FROM rt, t WHERE strategy = 'global'")(
    lambda s, d: search.global_search(_routed(s, d).where("strategy = 'global'"), _community_summaries(s, d)))

query("v17_explained", f"WITH {_R} SELECT query_id, strategy, CASE strategy WHEN 'global' THEN 0.2 WHEN 'local' THEN 0.7 ELSE 0.5 END AS alpha, CASE strategy WHEN 'global' THEN 'words that ask for a whole' WHEN 'local' THEN 'words that ask for a detail' ELSE 'no words that tell' END AS reason FROM rt")(
    lambda s, d: _routed(s, d).select("query_id", "strategy", "alpha", search.explained(F.col("strategy")).alias("reason")))

# --- variants: names that begin alike are synonyms of one another -----------------------------------------------------

_SYN = "sy AS (SELECT a.name AS term, b.name AS synonym, row_number() OVER (PARTITION BY a.name ORDER BY b.name) AS place FROM dict a JOIN dict b ON a.name <> b.name AND left(a.name, 6) = left(b.name, 6))"
_VARIANTS = """vi AS (SELECT query_id, text, -9999 AS size, '' AS term, 0 AS place FROM q UNION ALL SELECT query_id, replace(text, term, synonym), -length(term), term, place FROM q JOIN sy ON contains(text, term)),
 va AS (SELECT query_id, text, k AS place FROM (SELECT query_id, text, (row_number() OVER (PARTITION BY query_id ORDER BY min(row(size, term, place))) - 1)::INT AS k FROM vi GROUP BY query_id, text) WHERE k < 4)"""


def _synonyms(s: SparkSession, d: str) -> DataFrame:
    names = _dictionary(s, d).select("name", F.substring("name", 1, 6).alias("stem"))
    pairs = names.select(F.col("name").alias("term"), "stem").join(names.select(F.col("name").alias("synonym"), "stem"), "stem").where("term <> synonym")
    return search.first(pairs, ["term"], ["synonym"], 6).select("term", F.col("rank").alias("place"), "synonym")  # a question has six texts at most


query("v18_variants", f"{_MENTIONS}, {_Q}, {_SYN}, {_VARIANTS} SELECT query_id, place, md5(text) AS h FROM va")(
    lambda s, d: search.variants(_questions(s, d), _synonyms(s, d), k=4).select("query_id", "place", F.md5(F.encode("text", "UTF-8")).alias("h")))


def _expanded(s: SparkSession, d: str, questions: DataFrame) -> DataFrame:
    """Names found for the questions, then new ones for three variants of each."""
    names = _dictionary(s, d)
    others = search.variants(questions, _synonyms(s, d), k=4).where("place > 0")
    asked = others.select(F.concat_ws("#", "query_id", "place").alias("query_id"), "text")
    more = search.entity_hits(asked, names).select(F.split_part("query_id", F.lit("#"), F.lit(1)).alias("query_id"), F.split_part("query_id", F.lit("#"), F.lit(2)).cast("int").alias("place"), "name", "score", "rank")
    return search.with_variants(search.entity_hits(questions, names), more)


# the hits of {q} and of its variants, as ex
_EXPANDED = _VARIANTS.replace("FROM q", "FROM {q}") + ", al AS (SELECT query_id || '#' || place AS query_id, text FROM va), " + _HITS.replace("{q}", "al") + """,
 pl AS (SELECT split_part(query_id, '#', 1) AS query_id, split_part(query_id, '#', 2)::INT AS place, name, score, rank FROM h),
 ex AS (SELECT query_id, place, name, score, row_number() OVER (PARTITION BY query_id ORDER BY place, rank, name)::INT AS rank FROM (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY query_id, lower(name) ORDER BY place, rank) = 1))"""
query("u08_expanded_search", f"{_MENTIONS}, {_Q}, {_SYN}, {_EXPANDED.format(q='q')} SELECT query_id, place, name, score, rank FROM ex")(lambda s, d: _expanded(s, d, _questions(s, d)).select("query_id", "place", "name", "score", "rank"))


# --- the dispatcher ---------------------------------------------------------------------------------------------------

_BM25 = f"""bd AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), bn AS (SELECT count(*) AS total, avg(len(w)) AS mean FROM bd),
 bp AS (SELECT id, any_value(size) AS size, term, count(*) AS tf FROM (SELECT id, len(w) AS size, unnest(w) AS term FROM bd) GROUP BY id, term), bf AS (SELECT term, count(*) AS df FROM bp GROUP BY 1),
 bq AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM rt WHERE strategy = 'hybrid'),
 bs AS (SELECT query_id, id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 9) AS score FROM bq JOIN bp USING (term) JOIN bf USING (term), bn GROUP BY 1, 2),
 bt AS (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5)"""
_LOCAL = _EXPANDED.format(q="(SELECT * FROM rt WHERE strategy = 'local')")


def _dispatched(s: SparkSession, d: str) -> DataFrame:
    """Each question by its way: names with variants, communities, or texts by words with names."""
    routed = _routed(s, d)
    local, hybrid = routed.where("strategy = 'local'"), routed.where("strategy = 'hybrid'")
    words = hybrid.select("query_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)), " ").alias("text"))
    texts = fulltext.search(fulltext.build_index(table(s, d, "documents"), "doc_id", "text"), words, 5)
    both = search.hybrid_search(hybrid, texts, search.entity_hits(hybrid, _dictionary(s, d)), 15)
    wide = search.global_search(routed.where("strategy = 'global'"), _community_summaries(s, d))
    row = lambda df, strategy, item, origin, score: df.select("query_id", F.lit(strategy).alias("strategy"), "rank", item.alias("item"), origin.alias("origin"), score.cast("double").alias("score"))
    found = row(_expanded(s, d, local), "local", F.col("name"), F.concat(F.lit("variant "), F.col("place").cast("string")), F.col("score"))
    return found.unionByName(row(wide, "global", F.col("community"), F.lit("community"), F.col("size"))).unionByName(row(both, "hybrid", F.col("item"), F.col("origin"), F.col("score")))


query("v16_routed_search", WITH + ", " + _MENTIONS[len("WITH "):] + _SUMMED + f""", {_R}, {_SYN}, {_LOCAL}, {_BM25},
 hh AS (SELECT * FROM ({"{0}"})), hs AS (SELECT query_id, id::VARCHAR AS item, 'text' AS origin, round(score / max(score) OVER (PARTITION BY query_id) * 0.5, 6) AS score FROM bt
  UNION ALL SELECT query_id, name, 'name', round(score * 0.5, 6) FROM hh),
 t AS (SELECT *, row_number() OVER (ORDER BY size DESC, community)::INT AS rank FROM cs QUALIFY rank <= 3)
 SELECT query_id, 'local' AS strategy, rank, name AS item, 'variant ' || place AS origin, score FROM ex UNION ALL SELECT query_id, strategy, rank, community, 'community', size::DOUBLE FROM rt, t WHERE strategy = 'global'
 UNION ALL SELECT query_id, 'hybrid', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item)::INT AS rank, item, origin, score FROM hs QUALIFY rank <= 15""".replace("{0}", "WITH " + _HITS.format(q="(SELECT * FROM rt WHERE strategy = 'hybrid')") + " SELECT * FROM h"))(_dispatched)

# --- intents: the same rules over words of the turns' languages -------------------------------------------------------

WORDS = intents.Words(diseases=("tion", "ment"), drugs=("ción", "heit"), symptoms=("the", "les"), examinations=("ing", "ung"))
RULES = [
    intents.Rule("drug_query", 0.9, (WORDS.drugs, ("que", "und"))),
    intents.Rule("diagnosis_assist", 0.85, (WORDS.symptoms,), "A"),
    intents.Rule("symptom_query", 0.8, (WORDS.symptoms, ("with", "dans"))),
    intents.Rule("disease_query", 0.85, (WORDS.diseases,)),
    intents.Rule("treatment_query", 0.8, (WORDS.examinations,)),
]


def _rule_sql(rule: intents.Rule) -> str:
    parts = [f"starts_with(text, '{rule.start}')"] * bool(rule.start) + ["(" + " OR ".join(f"contains(text, '{w}')" for w in g) + ")" for g in rule.groups]
    return f"WHEN {' AND '.join(parts)} THEN '{rule.intent}|{rule.confidence}'"


_ALL = (*WORDS.diseases, *WORDS.drugs, *WORDS.symptoms, *WORDS.examinations)
query("n14_intents", f"WITH {_Q}, c AS (SELECT *, CASE {' '.join(map(_rule_sql, RULES))} END AS k FROM q), i AS (SELECT query_id, text, nullif(split_part(k, '|', 1), '') AS intent, nullif(split_part(k, '|', 2), '')::DOUBLE AS confidence FROM c)"
      " SELECT query_id, intent, confidence, CASE intent WHEN 'symptom_query' THEN 'symptom_agent' WHEN 'disease_query' THEN 'disease_agent' WHEN 'drug_query' THEN 'drug_agent' WHEN 'treatment_query' THEN 'treatment_agent' ELSE 'general_agent' END AS agent FROM i")(
    lambda s, d: _questions(s, d).withColumn("c", intents.classified(F.col("text"), RULES)).select("query_id", "c.intent", "c.confidence").withColumn("agent", intents.agent(F.col("intent"))))
query("n16_question_entities", f"{_MENTIONS}, {_Q}, f AS (SELECT query_id, name FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z]{{8,}}')) AS name FROM q) JOIN dict USING (name)"
      + "".join(f" UNION ALL SELECT query_id, '{w}' FROM q WHERE contains(text, '{w}')" for w in _ALL) + ") SELECT query_id, string_agg(DISTINCT name, ',' ORDER BY name) AS entities, count(DISTINCT name) AS n FROM f GROUP BY query_id")(
    lambda s, d: _questions(s, d).join(_question_names(s, d), "query_id", "left").withColumn("e", intents.named(F.col("text"), WORDS, F.col("found"))).where("size(e) > 0").select("query_id", F.array_join("e", ",").alias("entities"), F.size("e").cast("bigint").alias("n")))


def _question_names(s: SparkSession, d: str) -> DataFrame:
    """The dictionary's names in a question; a question's words bound them."""
    words = _questions(s, d).select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))).alias("name"))
    return words.join(knowledge.few(_dictionary(s, d)), "name").groupBy("query_id").agg(F.collect_list("name").alias("found"))


# --- golden sets ------------------------------------------------------------------------------------------------------

TEMPLATES = {"IN_NATION": "Where is {src}?", "IN_REGION": "Which region has {src}?", "ORDERED": "What has {src} ordered?", "SUPPLIES": "What does {src} supply?"}
query("e24_golden_set", WITH + """, o AS (SELECT DISTINCT type, src, dst FROM edges), g AS (SELECT type, src, count(*) AS n_answers FROM o GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY md5('1|' || type || '|' || src), src) AS k FROM g), c AS (SELECT * FROM k ORDER BY k, type LIMIT 500),
 a AS (SELECT type, src, n_answers, dst FROM c JOIN o USING (type, src) QUALIFY row_number() OVER (PARTITION BY type, src ORDER BY dst) <= 5)
 SELECT type, src, replace(CASE type """ + " ".join(f"WHEN '{t}' THEN '{q}'" for t, q in TEMPLATES.items()) + """ END, '{src}', src) AS question, string_agg(dst, ',' ORDER BY dst) AS expected, n_answers FROM a GROUP BY type, src, n_answers""")(
    lambda s, d: search.golden_set(model.edges(s, d), TEMPLATES, 500))

# --- sources: texts written in three encodings and read back, and a report in Markdown ---------------------------------

query("s07_encodings", """WITH x AS (SELECT doc_id, text, text <> '' AND doc_id % 3 = 1 AS wide, doc_id % 3 = 2 AND regexp_matches(text, '[\\x{80}-\\x{ff}]') AND NOT regexp_matches(text, '[^\\x00-\\x{ff}]') AS latin FROM documents)
 SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN wide THEN 'utf-16-le' WHEN latin THEN 'latin-1' ELSE 'utf-8' END AS encoding, md5(text) AS h FROM x""")(
    lambda s, d: table(s, d, "documents").select("doc_id", encodings.decoded(F.when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16LE")).when((F.col("doc_id") % 3 == 2) & ~F.col("text").rlike(r"[^\x00-\xFF]"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))).alias("x"))
    .select("doc_id", "x.encoding", F.md5(F.encode("x.text", "UTF-8")).alias("h")))
query("s21_markdown_report", """WITH g AS (SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL), b AS (SELECT row_number() OVER (ORDER BY lang NULLS FIRST, source NULLS FIRST) + 1 AS line_no, '| ' || coalesce(lang, '') || ' | ' || coalesce(source, '') || ' | ' || n || ' | ' || coalesce(chars::VARCHAR, '') || ' |' AS line FROM g)
 SELECT line_no, line FROM b UNION ALL SELECT 0, '| lang | source | n | chars |' UNION ALL SELECT 1, '|---|---|---|---|'""")(
    lambda s, d: records.markdown(table(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), ["lang", "source"]))
