"""Evaluation layers, answer scores, chunk quality and operational summaries as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The layers' shares of the overall score, and the weights of the metrics within them.
LAYER_WEIGHTS = {"component": 0.25, "retrieval": 0.25, "generation": 0.30, "system": 0.20}
COMPONENT = {"intent_accuracy": (0.35, 0.80), "entity_recall": (0.35, 0.70), "ner_precision": (0.30, 0.75)}
#: What counts as a term of a reference: an abbreviation in brackets, a code, a number with a unit.
ABBREVIATION = r"[（(]([A-Z]{2,})[）)]"
CODE = r"[A-Z]\d{2}(?:\.\d+)?"
MEASURE = r"\d+\.?\d*\s*(?:mmHg|mg|ml|g|IU|U|%|次/分|mmol)"


def reference_terms(text: Column) -> Column:
    """Abbreviations, codes and measures of a text, in this order, as often as they occur."""
    found = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.concat(found(ABBREVIATION, 1), found(CODE, 0), found(MEASURE, 0))


def share_found(text: Column, words: Column) -> Column:
    """The share of the words that the text holds in any case; 1 if there are none."""
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.filter(words, lambda w: F.contains(F.lower(text), F.lower(w)))) / F.size(words))


def retrieval_recall(text: Column, keywords: Column, reference: Column) -> Column:
    """0.6 of the keywords' share and 0.4 of the reference's terms'; 1 without keywords."""
    return F.when(F.size(keywords) == 0, 1.0).otherwise(0.6 * share_found(text, keywords) + 0.4 * share_found(text, reference_terms(reference)))


def char_sets(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; null if both are empty."""
    x, y = (F.array_distinct(F.filter(F.split(c, ""), lambda v: v != "")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))


def char_f1(pairs: DataFrame) -> DataFrame:
    """(id, f1) of ``pairs(id, prediction, reference)`` on characters other than white space: 1 for an empty reference, 0 for an empty prediction.

    Characters are counted one by one within the row, over the distinct characters of both.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s", "")
    x = pairs.select("id", bare("prediction").alias("p"), bare("reference").alias("r"))
    both = F.array_intersect(F.split("p", ""), F.filter(F.split("r", ""), lambda c: c != ""))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    x = x.withColumn("common", F.aggregate(both, F.lit(0), lambda n, c: n + F.least(count(F.col("p"), c), count(F.col("r"), c))))
    score = F.when(F.length("r") == 0, 1.0).when((F.length("p") == 0) | (F.col("common") == 0), 0.0).otherwise(2 * F.col("common") / (F.length("p") + F.length("r")))
    return x.select("id", F.round(score, 6).alias("f1"))


def found_counts(items: DataFrame) -> DataFrame:
    """``items(expected, found)`` (arrays) with n_expected, tp and fp of their sets."""
    want, got = F.array_distinct("expected"), F.array_distinct("found")
    return items.withColumns({"n_expected": F.size(want), "tp": F.size(F.array_intersect(want, got)), "fp": F.size(F.array_except(got, want))})


def component_layer(items: DataFrame) -> DataFrame:
    """One row of intent_accuracy, entity_recall, ner_precision, score and passed from ``items(intent, expected_intent, expected, found)``."""
    x = found_counts(items).agg(F.avg((F.col("intent") == F.col("expected_intent")).cast("double")).alias("intent_accuracy"), F.coalesce(F.sum("tp") / F.nullif(F.sum("n_expected"), F.lit(0)), F.lit(0.0)).alias("entity_recall"), F.coalesce(F.sum("tp") / F.nullif(F.sum("tp") + F.sum("fp"), F.lit(0)), F.lit(0.0)).alias("ner_precision"))
    return weighted(x, COMPONENT)


def weighted(metrics: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """``metrics`` (a column each) with score, their mean by weight, and passed: all reach their limits. ``limits``: name -> (weight, limit)."""
    total = sum(w for w, _ in limits.values())
    score = sum((F.col(name) * w for name, (w, _) in limits.items()), F.lit(0.0)) / total
    passed = F.lit(True)
    for name, (_, limit) in limits.items():
        passed = passed & (F.col(name) >= limit)
    return metrics.select(*[F.round(name, 6).alias(name) for name in limits], F.round(score, 6).alias("score"), passed.alias("passed"))


def overall_score(layers: DataFrame) -> DataFrame:
    """(score, passed) over ``layers(layer, score, passed)``: shares by LAYER_WEIGHTS, others count nothing."""
    weight = F.coalesce(F.create_map(*[F.lit(v) for kv in LAYER_WEIGHTS.items() for v in kv])[F.col("layer")], F.lit(0.0))
    return layers.agg(F.round(F.sum(weight * F.col("score")), 6).alias("score"), F.bool_and("passed").alias("passed"))


def latency_summary(calls: DataFrame) -> DataFrame:
    """n, mean, max, min, total and throughput (calls a second) of ``calls(seconds)``."""
    s = F.sum("seconds")
    return calls.agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("mean"), F.max("seconds").alias("most"), F.min("seconds").alias("least"), F.round(s, 6).alias("total"), F.round(F.coalesce(F.count("*") / F.nullif(s, F.lit(0.0)), F.lit(0.0)), 6).alias("throughput"))


def system_layer(calls: DataFrame, mean_limit: float, p95_limit: float) -> DataFrame:
    """One row of latency, p95 and error scores (1 is best) of ``calls(seconds, ok)`` and whether each passes; p95 is given as a column of ``calls``."""
    norm = lambda value, limit: F.greatest(F.lit(0.0), 1 - value / limit)
    x = calls.agg(F.avg("seconds").alias("mean"), F.max("p95").alias("p95"), F.avg((~F.col("ok")).cast("double")).alias("errors"))
    return x.select(F.round(norm(F.col("mean"), mean_limit), 6).alias("latency"), (F.col("mean") <= mean_limit).alias("latency_ok"), F.round(norm(F.col("p95"), p95_limit), 6).alias("p95"), (F.col("p95") <= p95_limit).alias("p95_ok"), F.round(1 - F.col("errors"), 6).alias("success"))


def process_stats(calls: DataFrame, by: str) -> DataFrame:
    """Calls(seconds, ok) by name: count, total, least, most, errors, successes and mean."""
    return calls.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 6).alias("total"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.count_if(~F.col("ok")).alias("errors"), F.count_if("ok").alias("successes"), F.round(F.avg("seconds"), 6).alias("mean"))


def ragas_summary(scores: DataFrame) -> DataFrame:
    """Means of ``scores(faithfulness, relevancy, correctness, safety)`` and the shares of safe (0.8) and faithful (0.7) answers."""
    names = ("faithfulness", "relevancy", "correctness", "safety")
    rate = lambda c, limit: F.round(F.avg((F.col(c) >= limit).cast("double")), 6)
    return scores.agg(*[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in names], rate("safety", 0.8).alias("safety_pass_rate"), rate("faithfulness", 0.7).alias("faithfulness_pass_rate"))


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """(document_id, n, clean_ends, stability, overlap) of ``chunks``: the share that ends at a sentence's end, the spread of lengths over their mean, and the mean Jaccard similarity of characters at neighbours' ends."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    size = F.length("content")
    x = chunks.withColumn("after", F.lead("content").over(w))
    shared = F.when((size >= 75) & (F.length("after") >= 75), char_sets(F.substring("content", -75, 75), F.substring("after", 1, 75))).when(F.col("after").isNotNull(), 0.0)
    ends = F.regexp_like(F.rtrim("content"), F.lit(r"[。！？；.!?]\z"))
    return x.groupBy("document_id").agg(F.count("*").alias("n"), F.round(F.avg(ends.cast("double")), 6).alias("clean_ends"), F.round(F.stddev_pop(size) / F.avg(size), 6).alias("stability"), F.round(F.coalesce(F.avg(shared), F.lit(1.0)), 6).alias("overlap"))


def start_ratios(chunks: DataFrame) -> DataFrame:
    """(chunk_id, start, end): the share of the document's characters before and up to each chunk."""
    w = Window.partitionBy("document_id")
    upto = F.sum(F.length("content")).over(w.orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0))
    total = F.greatest(F.sum(F.length("content")).over(w), F.lit(1))
    return chunks.select("chunk_id", F.round((upto - F.length("content")) / total, 6).alias("start"), F.round(upto / total, 6).alias("end"))


def smoothed(values: DataFrame, by: str, order: str, value: str, k: int = 1) -> DataFrame:
    """``values`` with smooth: the mean of the value and those up to ``k`` places before and after it."""
    return values.withColumn("smooth", F.round(F.avg(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(-k, k)), 9))
