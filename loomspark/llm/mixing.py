"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

A token budget goes down the tree domain - language - source. At each node it is dealt among the children by weight; a
child whose whole subtree holds too little takes what it has, and its shortage goes to its siblings (water-filling), and
only what all of them can't take is left to the parent's siblings. Each leaf then takes whole seeded epochs of its
documents and of the last one a prefix by tokens. A prefix is found in two steps, by sums of hash slices and then within
one slice, so that no leaf's documents are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import Columns, written

LEVELS = ("domain", "lang", "source")
#: Places in which the rows of one leaf meet its budget, so that a leaf with a third of all rows isn't one task's.
SALTS = 32
NEW = ("mix_domain", "mix_tokens", "mix_copies")


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def deal(children: DataFrame, parents: list[str]) -> DataFrame:
    """``children`` (parents..., weight, capacity, budget of the parent) with ``share``: min(capacity, level * weight), summing to the budget where capacity allows."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    ordered = Window.partitionBy(*parents).orderBy(F.col("_ratio").asc_nulls_last(), *[c for c in LEVELS if c in children.columns])
    every = Window.partitionBy(*parents)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    x = children.withColumn("_ratio", ratio)
    x = x.withColumn("_filled", F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).over(before), F.lit(0.0)))
    x = x.withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # full: if all before it and it are full, the level that the rest asks for is no lower than its ratio
    x = x.withColumn("_full", (F.col("weight") > 0) & (F.col("_filled") + F.col("_ratio") * F.col("_open") <= F.col("budget")))
    x = x.withColumn("_spent", F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0.0)).over(every)).withColumn("_rest", F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0.0)).over(every))
    share = F.when(F.col("weight") <= 0, 0.0).when(F.col("_full"), F.col("capacity")).otherwise(F.least("capacity", F.col("weight") * (F.col("budget") - F.col("_spent")) / F.col("_rest")))
    return x.withColumn("share", share).drop("_ratio", "_filled", "_open", "_full", "_spent", "_rest")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """``leaves`` (LEVELS, tokens) with ``take``: whole tokens for each leaf. A name not in ``weights[level]`` weighs 1."""

    def weight(level: str) -> Column:
        out = F.lit(1.0)
        for name, w in sorted(weights.get(level, {}).items()):
            out = F.when(F.col(level) == name, float(w)).otherwise(out)
        return out

    x = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("double"))
    for level in LEVELS:  # a subtree under a weight of 0 has no capacity
        x = x.withColumn("capacity", F.when(weight(level) > 0, F.col("capacity")).otherwise(0.0))
    up, tables = x, []
    for depth in (2, 1, 0):
        keys = list(LEVELS[: depth + 1])
        up = up.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        tables.append(up)
    above = tables[2].agg(F.sum("capacity").alias("_all")).select(budget.cast("double").alias("budget"), F.lit(0).alias("_root"))
    parents: list[str] = ["_root"]
    for depth, level in enumerate(LEVELS):
        here = tables[2 - depth].withColumn("weight", weight(level)).withColumn("_root", F.lit(0)).join(above, parents)
        above = deal(here, parents).drop("budget", "weight", "capacity").withColumnRenamed("share", "budget")
        parents = ["_root", *LEVELS[: depth + 1]]
    return leaves.join(above.select(*LEVELS, F.floor(F.col("budget") + 1e-6).cast("bigint").alias("take")), list(LEVELS))


def mix_sources(docs: DataFrame, domain: Column, share: float = 0.5, weights: dict[str, dict[str, float]] | None = None, max_epochs: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with mix_domain, mix_tokens and mix_copies (how often the document is in the mix; 0: not at all).

    The budget is ``share`` of all tokens (words). ``weights`` maps a level (domain, lang, source) to the weights of its names;
    others weigh 1, and 0 takes none. Each epoch orders a leaf by md5(seed, epoch, id, text); of the last one the
    documents that end within what is left are taken. Null names are the name ''. Rows with the same id and text in a leaf
    are ordered as one and taken together. ``domain`` is an expression on the columns of ``docs``. Columns named as one of the
    new ones, in any case, are replaced, others carried along under any name. An empty table gives an empty one.
    """
    own = Columns(docs.withColumns({"mix_domain": domain.cast("string")}), ("mix_tokens", "mix_copies"))
    named = lambda c: F.coalesce(F.col(own.at(c)).cast("string"), F.lit(""))
    text = F.coalesce(F.col(own.at(text_col)).cast("string"), F.lit(""))
    tag = F.when(F.col(own.at(id_col)).isNull(), F.md5(F.encode(text, "UTF-8"))).otherwise(F.col(own.at(id_col)).cast("string"))
    keys = {"domain": named("mix_domain"), "lang": named("lang"), "source": named("source"), "_tag": tag, "_text": F.xxhash64(text)}
    slim = written(own.df.select(*[v.alias(k) for k, v in keys.items()], count_words(text).alias("tokens")), "slim")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = leaves.groupBy().agg(F.sum("tokens").alias("total"))
    budget = float(total.first()[0] or 0) * share
    plan = leaf_budgets(leaves, F.lit(budget), weights or {}, max_epochs).select(*LEVELS, F.when(F.col("tokens") > 0, F.floor(F.col("take") / F.col("tokens"))).otherwise(0).cast("bigint").alias("epochs"), F.when(F.col("tokens") > 0, F.col("take") % F.col("tokens")).otherwise(0).alias("left"))

    # a leaf's documents meet its budget in SALTS places; the leaves are repeated there, the documents are not
    dealt = slim.groupBy(*LEVELS, "_tag").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").withColumn("_salt", F.pmod(F.xxhash64("_tag"), F.lit(SALTS)).cast("int"))
    found = dealt.join(plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*LEVELS, "_salt"]).drop("_salt")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), "_tag"))
    planned = written(found.where("epochs > 0 or left > 0").withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, 3)), "planned")
    units = planned.where("left > 0")
    slices = units.groupBy(*LEVELS, "_slice").agg(F.sum("tokens").alias("tokens"))
    upto = slices.select(*LEVELS, "_slice", F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.col("tokens").alias("_all"))
    placed = units.join(upto, [*LEVELS, "_slice"]).where(F.col("_before") < F.col("left"))
    whole = placed.where(F.col("_before") + F.col("_all") <= F.col("left")).select(*LEVELS, "_tag")
    within = Window.partitionBy(*LEVELS, "_slice").orderBy("_key", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    part = placed.where(F.col("_before") + F.col("_all") > F.col("left")).withColumn("_end", F.col("_before") + F.sum("tokens").over(within)).where(F.col("_end") <= F.col("left")).select(*LEVELS, "_tag")
    chosen = whole.unionByName(part).withColumn("_more", F.lit(1))

    # the words are counted once: rows get theirs back by id and text
    copied = planned.join(chosen, [*LEVELS, "_tag"], "left").select(*LEVELS, "_tag", (F.col("epochs") + F.coalesce("_more", F.lit(0))).alias("_copies")).where("_copies > 0")
    told = slim.groupBy(*LEVELS, "_tag", "_text").agg(F.max("tokens").alias("_tokens")).join(copied, [*LEVELS, "_tag"], "left")
    out = own.df.withColumns(keys).join(told, list(keys))
    copies = F.when(F.col("_tokens") > 0, F.coalesce("_copies", F.lit(0))).otherwise(0).cast("bigint")
    back = own.back(out.select(*[named("mix_domain").alias(c) if c == own.at("mix_domain") else F.col(c) for c in own.own], F.col("_tokens").alias("mix_tokens"), copies.alias("mix_copies")))
    return back.select(*[F.col(f"`{c}`") for c in back.columns if c.lower() not in NEW], *NEW)
