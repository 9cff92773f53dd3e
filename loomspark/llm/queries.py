"""The query opN_<name> of each operator, over its whole table with production parameters, and oracle SQL where it can be told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.alignment import align_tokens
from loomspark.llm.chat import canonical_records, format_chats, read_chats
from loomspark.llm.divergence import source_divergence
from loomspark.llm.jaccard import jaccard_components
from loomspark.llm.licenses import scan_licenses
from loomspark.llm.lines import dedup_lines
from loomspark.llm.mixing import mix_sources
from loomspark.llm.passages import remove_repeats
from loomspark.llm.pieces import count_tokens, encode_pieces
from loomspark.llm.quality import STATS, quality_rules
from loomspark.llm.urls import filter_urls
from loomspark.llm.vectors import near_vectors

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Weights of the mix by level; names that aren't here weigh 1.
MIX_WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 3.0, "fr": 2.0, "de": 2.0}, "source": {"src0": 2.0, "src5": 0.5}}
SPOKEN = "</s>[INST] ok [/INST]"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text's UTF-8."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def mix_domain() -> Column:
    """Sources are dealt to four domains by the number in their name."""
    return F.concat(F.lit("d"), F.pmod(F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0)), F.lit(4)).cast("string"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"), URL_RULES)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, _read(spark, sf_dir, "labels")).select("doc_id", *STATS, "base_failed", "kept", F.round("score", 9).alias("score"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_read(spark, sf_dir, "documents"), mix_domain(), share=0.5, weights=MIX_WEIGHTS, max_epochs=2, seed=1)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_read(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", digest(F.col("kept_text")).alias("kept_sha256"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of turns and a record of messages go in as JSON of mixed layouts; each is mapped by its fingerprint."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    spoken = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(SPOKEN).alias("content")) for role in ("user", "assistant")])
    extra = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), spoken.alias("messages"))
    record = lambda df: df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    records = record(rows).unionByName(record(extra))
    back = read_chats(format_chats(canonical_records(records, "record", keep_empty=True)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), digest(said).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), digest(loss).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, least_docs=3, least_chars=20).select("doc_id", "n_lines", "n_dropped", digest(F.col("text")).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), digest(F.array_join(F.col("piece_ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokens(_read(spark, sf_dir, "documents"), kept=lambda groups: F.when(groups == "", "").otherwise(digest(groups)))
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_read(spark, sf_dir, "documents"), least_docs=30, ranks=50)


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "spans")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_ngram_jaccard_join, op3_quality_rules, op4_mixing, op5_substring_dedup, op6_chat_formatting, op7_token_counts, op8_embedding_near_dedup, op9_line_dedup, op10_sentencepiece, op11_tokenizer_alignment, op12_source_divergence, op13_license_scans)}

_LOW = "translate(trim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONTROL = r"([<\[])(~*)(/?s>|/?INST\]|\|im_start\|>|\|im_end\|>)"

ORACLES = {
    "op6_chat_formatting": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SPOKEN}' UNION ALL SELECT -7, 1, 'assistant', '{SPOKEN}'),
x AS (SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{_CONTROL}', '\1~\2\3', 'g') AS r, regexp_replace(text, '{_CONTROL}', '\1~\2\3', 'g') AS b FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(b) + 24) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id""",
    "op9_line_dedup": rf"""
WITH l AS (SELECT doc_id, pos, line, {_LOW.format("line")} AS key FROM
  (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, k.key IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS size FROM k GROUP BY lang),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS size FROM f GROUP BY ALL),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (CAST(1000000000 AS HUGEINT) * (f.n + 5)) // CAST(s.size + 5 * v.v AS HUGEINT) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (f.total + 5)) // CAST(v.size + 5 * v.v AS HUGEINT) AS q
  FROM f JOIN s USING (lang, source) JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
z AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM y)
SELECT * FROM z WHERE part = 'pair' OR rank <= 50""",
}
