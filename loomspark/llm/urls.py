"""URL filters: host and path rules first, then association rules that Spark's FP-growth mines from labelled URLs.

DataFrame operations only. Itemsets of URL tokens and the class token are mined from the labelled pages; the rules kept
(token set => bad) have the least support and confidence asked for, and no subset among them that is as confident. Tokens that
occur in just the same labelled pages say the same, so they are mined as one class: URLs of one template, which share a long run
of tokens, don't multiply the itemsets. Rules match by an inverted index: each is listed under the tokens of its rarest
class, pages are joined to it by token, and the rule's other classes are then looked for in the page's own tokens.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import LOWER, UPPER, written

BAD = "\x00bad"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: each label of the host and each part of the path, marked by where it stands."""
    parts = lambda of, mark, cut: F.transform(F.filter(F.split(of, cut), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(parts(host, "h:", r"\."), parts(F.translate(path, UPPER, LOWER), "p:", r"[/._-]")))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest ``host/path`` rule that fits: the host or a subdomain, and the path's beginning."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


RULES = "tokens array<string>, confidence double, support double, classes array<array<string>>, rarest array<string>"


def mine_rules(pages: DataFrame, min_support: float, min_confidence: float, least_pages: int = 5, prior: float = 1.0) -> DataFrame:
    """RULES ``tokens => bad`` from ``pages(id, tokens array, bad boolean)``: a token stands for its class in ``classes``.

    A rule holds in ``min_support`` of the pages, and in ``least_pages`` at least. Its confidence is drawn to the share of bad
    pages by the weight of ``prior`` pages, since a few pages alone prove little. A page that is repeated counts once.
    """
    items = written(pages.where(F.size("tokens") > 0).distinct().select("bad", "tokens", F.xxhash64("id", "tokens").alias("page")), "items")
    total, n_bad = items.agg(F.count("*"), F.count_if("bad")).first()
    if not n_bad:
        return pages.sparkSession.createDataFrame([], RULES)
    least = max(math.ceil(min_support * total), least_pages)
    # the pages of a token are told by their number and two sums of hashes
    each = items.select("page", "bad", F.explode("tokens").alias("token"))
    sums = [F.sum(F.xxhash64("page", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)]
    held = each.groupBy("token").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    classes = written(held.groupBy("n", "s0", "s1").agg(F.array_sort(F.collect_set("token")).alias("members")).select(F.col("members")[0].alias("token"), "members", "n"), "classes")
    baskets = each.join(classes.select("token"), "token").groupBy("page", "bad").agg(F.collect_set("token").alias("items"))
    baskets = written(baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "baskets")
    n = baskets.count()
    if n < least:
        return pages.sparkSession.createDataFrame([], RULES)
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = written(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    bad = sets.where(F.array_contains("items", F.lit(BAD)) & (F.size("items") > 1)).select(F.array_remove("items", F.lit(BAD)).alias("tokens"), F.col("freq").alias("hits"))
    confidence = (F.col("hits") + prior * n_bad / total) / (F.col("freq") + prior)
    rules = bad.join(sets.select(F.col("items").alias("tokens"), "freq"), "tokens").select("tokens", confidence.alias("confidence"), (F.col("hits") / total).alias("support")).where(F.col("confidence") >= min_confidence)
    # a rule with a more general one as confident says nothing new; candidates share the general one's tokens, one of which is its first
    wide = rules.select(F.col("tokens").alias("w"), F.col("confidence").alias("wc"), F.element_at("tokens", 1).alias("t"))
    told = rules.select("tokens", "confidence", F.explode("tokens").alias("t")).join(wide, "t").where((F.size("w") < F.size("tokens")) & (F.size(F.array_except("w", "tokens")) == 0) & (F.col("wc") >= F.col("confidence"))).select("tokens").distinct()
    kept = rules.join(told, "tokens", "left_anti").withColumn("token", F.explode("tokens")).join(classes, "token")
    return kept.groupBy("tokens", "confidence", "support").agg(F.collect_list("members").alias("classes"), F.min_by("members", F.struct("n", "token")).alias("rarest"))


def match_rules(pages: DataFrame, rules: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """(key, confidence) of ``pages(key, tokens)`` that a rule fits, with the best confidence. ``broadcast_rows`` steers the cost alone."""
    index = written(rules.select("classes", "confidence", F.explode("rarest").alias("token")), "rules")
    few = index.count() <= broadcast_rows
    found = pages.select("key", F.col("tokens").alias("own"), F.explode("tokens").alias("token")).join(F.broadcast(index) if few else index, "token").where(F.forall("classes", lambda c: F.arrays_overlap(c, F.col("own"))))
    return found.groupBy("key").agg(F.max("confidence").alias("confidence"))


def filter_urls(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], min_support: float = 0.002, min_confidence: float = 0.8, least_pages: int = 5, prior: float = 1.0, bad: str = "toxic = 1", id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """(id_col, host, path, rule, verdict, confidence) of every row of ``pages``.

    ``labels`` of the same ids say which URLs are bad (``bad``, a condition on its columns; null is not bad). A URL that is null or has no ``://`` has
    an empty host and path, fits no rule and is allowed; so is every URL where no labels are. Repeated rows are each
    returned. Rules have any number of tokens, and URLs any length. Other columns aren't read. An empty table gives an empty one.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path")).select("*", url_tokens(F.col("host"), F.col("path")).alias("tokens"))
    marked = labels.where(F.col(label_id).isNotNull()).select(F.col(label_id).alias("id"), F.coalesce(F.expr(bad), F.lit(False)).alias("bad")).groupBy("id").agg(F.max("bad").alias("bad"))
    mined = mine_rules(read.join(marked, "id").select("id", "tokens", "bad"), min_support, min_confidence, least_pages, prior)
    distinct = read.select(F.concat_ws("\x00", "host", "path").alias("key"), "tokens").dropDuplicates(["key"])
    hits = match_rules(distinct, mined)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = read.select("id", "host", "path", F.concat_ws("\x00", "host", "path").alias("key"), rule.alias("rule"), verdict.alias("ruled")).join(hits, "key", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
