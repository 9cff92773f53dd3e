"""Search for a table of questions at once: over communities, from entities outwards, or over texts and entities together.

Each question goes the way that its words tell, and questions are rows, so a million of them are joins and not calls. What
a question gets is bounded by ``k``, and windows keep the first rows of a group alone, which Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators import fulltext
from loomspark.operators.knowledge import few

#: Why a question is searched as it is.
REASONS = {"global": "words that ask for a whole", "local": "words that ask for a detail", "hybrid": "no words that tell"}


def first(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group by a total order, with rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def explained(strategy: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), strategy)


def entity_hits(questions: DataFrame, names: DataFrame, least: int = 8, part: int = 5, k: int = 10) -> DataFrame:
    """(query_id, name, score, rank): names that are words of ``questions(query_id, text)``, by how often against the most frequent.

    A question that names none gets the ``names(name)`` that contain one of its words of ``part`` letters or more, by the
    share of the name that the longest of them is. Words are a-z after lower-casing; ``least`` letters or more for whole names.
    """
    words = lambda n: F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{n},}}"), F.lit(0)))
    whole = questions.select("query_id", words(least).alias("name")).join(few(names.select("name").distinct()), "name").groupBy("query_id", "name").agg(F.count("*").alias("n"))
    most = whole.groupBy("query_id").agg(F.max("n").alias("most"))
    whole = whole.join(most, "query_id").select("query_id", "name", F.round(F.col("n") / F.col("most"), 6).alias("score"))
    missed = questions.join(most, "query_id", "left_anti").select("query_id", words(part).alias("keyword")).distinct()
    inside = fulltext.containing(names.select(F.col("name").alias("id"), F.col("name").alias("text")).distinct(), missed.select("keyword"))
    parts = missed.join(inside, "keyword").groupBy("query_id", F.col("id").alias("name")).agg(F.round(F.max(F.length("keyword") / F.length("id")), 6).alias("score"))
    return first(whole.unionByName(parts), ["query_id"], [F.desc("score"), "name"], k)


def strongest_paths(names: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(name, rank, hops, via, end): the first ``k`` paths of one or two steps from each of ``names(name)`` over undirected ``edges(a, b, n)``.

    One step comes before two; then the stronger first step, its end, the stronger second step, its end. Two steps are looked
    for only from names of fewer than ``k`` neighbours, and only to the k + 1 strongest of each (one may be the start), so a
    hub's neighbours are never listed.
    """
    both = edges.select("a", "b", "n").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    near = first(both, ["a"], [F.desc("n"), "b"], k + 1)
    one = names.select("name").distinct().join(near, F.col("name") == F.col("a")).select("name", F.lit(1).alias("hops"), F.col("n").alias("n1"), F.col("b").alias("via"), F.lit(0).cast("bigint").alias("n2"), F.col("b").alias("end"))
    poor = one.groupBy("name").agg(F.count("*").alias("c")).where(F.col("c") < k).select("name")
    two = one.join(poor, "name", "left_semi").select("name", F.col("n1"), F.col("via")).join(near.select(F.col("a").alias("via"), F.col("b").alias("end"), F.col("n").alias("n2")), "via").where("end <> name")
    every = one.unionByName(two.select("name", F.lit(2).alias("hops"), "n1", "via", "n2", "end"))
    return first(every, ["name"], ["hops", F.desc("n1"), "via", F.desc("n2"), "end"], k).select("name", "rank", "hops", "via", "end")


def local_search(hits: DataFrame, edges: DataFrame, per_entity: int = 5) -> DataFrame:
    """``hits(query_id, name, score, rank)`` with step, hops, via and end of each one's paths; null for a name without any. Paths are found once a name."""
    paths = strongest_paths(hits, edges, per_entity).withColumnRenamed("rank", "step")
    return hits.join(paths, "name", "left")


def global_search(questions: DataFrame, summaries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, community, size, summary, rank): the ``k`` greatest of ``summaries(community, size, summary)`` for each question."""
    top = summaries.select("community", "size", "summary").orderBy(F.desc("size"), "community").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "community")))  # k rows
    return questions.select("query_id").join(F.broadcast(ranked))


def hybrid_search(questions: DataFrame, texts: DataFrame, hits: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, item, origin, score, rank) by ``questions(query_id, alpha)``: texts by alpha * score / best, names by (1 - alpha) * score.

    ``texts(query_id, id, score)`` and ``hits(query_id, name, score)`` are bounded for each question. Nothing is summed: a
    text's id goes before an equal name.
    """
    best = texts.groupBy("query_id").agg(F.max("score").alias("best"))
    found = texts.join(best, "query_id").select("query_id", F.col("id").cast("string").alias("item"), F.lit("text").alias("origin"), (F.col("score") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)).alias("part"))
    named = hits.select("query_id", F.col("name").alias("item"), F.lit("name").alias("origin"), F.col("score").alias("part")).join(found.select("query_id", "item"), ["query_id", "item"], "left_anti")
    every = found.unionByName(named).join(questions.select("query_id", "alpha"), "query_id")
    weight = F.when(F.col("origin") == "text", F.col("alpha")).otherwise(1 - F.col("alpha"))
    scored = every.select("query_id", "item", "origin", F.round(F.col("part") * weight, 6).alias("score"))
    return first(scored, ["query_id"], [F.desc("score"), "item"], k)


def variants(questions: DataFrame, synonyms: DataFrame, templates: dict[str, str] | None = None, k: int = 6) -> DataFrame:
    """(query_id, place, text): a question at place 0, then with each term it contains replaced by each of its synonyms.

    ``synonyms(term, place, synonym)``; longer terms come first, equal ones by name. With ``templates`` and a column intents
    (an array) in ``questions``, the question in each one's template follows. Equal texts are one, and at most ``k`` stay.
    Terms are found by an index of q-grams, so the list of synonyms may be long.
    """
    terms = synonyms.select("term").distinct()
    inside = fulltext.containing(questions.select(F.col("query_id").alias("id"), "text"), terms.select(F.col("term").alias("keyword"))).select(F.col("keyword").alias("term"), F.col("id").alias("query_id"))
    swapped = inside.join(synonyms, "term").join(questions.select("query_id", "text"), "query_id").select(
        "query_id", F.struct((-F.length("term")).alias("size"), "term", F.col("place").cast("int").alias("place")).alias("order"), F.replace("text", F.col("term"), F.col("synonym")).alias("text"))
    key = lambda size, term, place: F.struct(F.lit(size).alias("size"), F.lit(term).alias("term"), place.cast("int").alias("place"))
    every = swapped.unionByName(questions.select("query_id", key(-(1 << 30), "", F.lit(0)).alias("order"), "text"))
    if templates:
        known = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
        asked = questions.select("query_id", "text", F.posexplode("intents").alias("place", "intent")).withColumn("template", F.element_at(known, F.col("intent"))).where("template is not null")
        every = every.unionByName(asked.select("query_id", key(1, "", F.col("place")).alias("order"), F.replace("template", F.lit("{query}"), F.col("text")).alias("text")))
    distinct = every.groupBy("query_id", "text").agg(F.min("order").alias("order"))
    return first(distinct, ["query_id"], ["order"], k).select("query_id", (F.col("rank") - 1).alias("place"), "text")


def with_variants(hits: DataFrame, more: DataFrame) -> DataFrame:
    """``hits(query_id, name, score, rank)`` and, after them, those of ``more(query_id, place, name, score, rank)`` whose name in lower case is new; the first place keeps a name.

    place tells the variant that found a name; 0 for the question itself.
    """
    every = hits.withColumn("place", F.lit(0)).select("query_id", "place", "rank", "name", "score").unionByName(more.select("query_id", F.col("place").cast("int").alias("place"), "rank", "name", "score"))
    once = every.groupBy("query_id", F.lower("name").alias("key")).agg(F.min(F.struct("place", "rank", "name", "score")).alias("m")).select("query_id", "m.*")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "rank", "name")))


def golden_set(edges: DataFrame, templates: dict[str, str], total: int, answers: int = 5, seed: int = 1) -> DataFrame:
    """(type, src, question, expected, n_answers): ``total`` questions on ``edges(src, type, dst)``, as even over the types as they allow.

    A question asks for a source's targets by its type's template; expected holds the first ``answers`` of them by name.
    Sources are in seeded order within a type, and types take turns, so what one type lacks is dealt to the others. A type
    without a template has no questions. No group is gathered: a type's first ``total`` sources are kept inside the tasks.
    """
    known = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    own = edges.where(F.col("type").isin(*templates)).select("type", "src", "dst").distinct()
    asked = own.groupBy("type", "src").agg(F.count("*").alias("n_answers")).withColumn("order", F.md5(F.concat_ws("|", F.lit(str(seed)), "type", "src")))
    chosen = first(asked, ["type"], ["order", "src"], total).orderBy("rank", "type").limit(total)
    chosen = chosen.select("type", "src", "n_answers")
    told = first(own.join(F.broadcast(chosen), ["type", "src"]) if total <= 200_000 else own.join(chosen, ["type", "src"]), ["type", "src"], ["dst"], answers)
    lists = told.groupBy("type", "src", "n_answers").agg(F.array_sort(F.collect_list("dst")).alias("expected"))
    return lists.select("type", "src", F.replace(F.element_at(known, F.col("type")), F.lit("{src}"), F.col("src")).alias("question"), F.array_join("expected", ",").alias("expected"), "n_answers")
