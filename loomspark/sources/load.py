"""Loading files of mixed kinds as documents(id, path, kind, title, content, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.encodings import decoded

KINDS = {"txt": "text", "md": "markdown", "csv": "csv", "tsv": "csv", "json": "json", "html": "html", "htm": "html", "xml": "xml"}


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, five entities read, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def csv_markdown(content: Column) -> Column:
    """A CSV text as a Markdown table: the most frequent delimiter of ``, ; tab |`` in 4,096 characters, blank rows out, short rows padded."""
    head = F.substring(content, 1, 4096)
    count = lambda d: F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))
    counts = {d: count(d) for d in (",", ";", "\t", "|")}
    most = F.greatest(*counts.values())
    pattern = F.when(counts[","] == most, ",").when(counts[";"] == most, ";").when(counts["\t"] == most, "\t").otherwise("\\|")
    rows = F.transform(F.filter(F.split(content, r"\r?\n"), lambda r: F.trim(r) != ""), lambda r: F.split(r, pattern, -1))
    width = F.size(rows[0])
    padded = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, F.greatest(width, F.size(r))), " | "), F.lit(" |")))
    rule = F.array(F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |")))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.slice(padded, 1, 1), rule, F.slice(padded, 2, 1 << 30)), "\n"))


def load_documents(spark: SparkSession, path: str, least_chars: int = 10) -> DataFrame:
    """All files below ``path`` (recursively) of a known suffix, one row each, in any encoding of encodings.decode(); short or unknown ones carry an error instead of a content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit(None).cast("string")
    for name, value in KINDS.items():
        kind = F.when(suffix == name, value).otherwise(kind)
    raw = decoded(F.col("content"))["text"]
    x = files.select(F.md5(F.encode("path", "UTF-8")).alias("id"), "path", kind.alias("kind"), raw.alias("raw"))
    text = F.when(F.col("kind") == "html", html_text(F.col("raw"))).when(F.col("kind") == "csv", csv_markdown(F.col("raw"))).when(F.col("kind") == "xml", F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))).otherwise(F.col("raw"))
    title = F.when(F.col("kind") == "html", html_title(F.col("raw"))).when(F.col("kind") == "markdown", F.regexp_extract("raw", r"(?m)^#\s+(.+)$", 1)).otherwise(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1))
    error = F.when(F.col("kind").isNull(), "unknown kind").when(F.length(F.trim("text")) < least_chars, "too short")
    return x.withColumn("text", text).select("id", "path", "kind", title.alias("title"), F.when(error.isNull(), F.col("text")).alias("content"), error.alias("error"))


def load_stats(loaded: DataFrame) -> DataFrame:
    return loaded.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def read_terms(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(code, name, synonyms array) from json (multi-line), csv (header; synonyms split at pipes) or xml (rowTag code)."""
    if kind == "json":
        return spark.read.option("multiLine", True).schema("code string, name string, synonyms array<string>").json(path)
    if kind == "xml":
        return spark.read.format("xml").option("rowTag", "code").schema("code string, name string, synonyms string").load(path).select("code", "name", _listed("synonyms"))
    return spark.read.option("header", True).schema("code string, name string, synonyms string").csv(path).select("code", "name", _listed("synonyms"))


def _listed(column: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "").alias(column)
