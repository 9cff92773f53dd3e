"""Files of drugs, of question items, and reports: nested JSON and XML read by row tag, written as JSON lines or Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a drug; a dash or an underscore joins the words of a tag.
TEXTS = ("drugbank_id", "name", "name_cn", "cas_number", "atc_code", "formula", "weight", "description")
LISTS = ("indications", "contraindications", "side_effects", "synonyms")
LINK = ("drug_name", "drugbank_id", "description", "severity")
_LINKS = f"array<struct<{', '.join(f'{f}: string' for f in LINK)}>>"
DRUGS = ", ".join([*(f"{f} string" for f in TEXTS), *(f"{f} array<string>" for f in LISTS), f"interactions {_LINKS}"])
ITEMS = "question string, reference_answer string, expected_intent string, expected_entities array<string>, keywords array<string>, category string, difficulty string"


def _tags(name: str) -> list[str]:
    return list(dict.fromkeys((name.replace("_", "-"), name)))


def _either(name: str, of: Column | None = None) -> Column:
    """The first tag of a field that has a text."""
    at = [of[t] if of is not None else F.col(f"`{t}`") for t in _tags(name)]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in at])


def read_drugs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Drugs with error: null, or why a record isn't one (no id, no name, a weight that is no number).

    ``kind`` json: {"drugs": [...]} in files of any number of lines; xml: elements drug at any depth, read in parallel by
    row tag. Lists are empty where a file has none, items without text are left out, weight is a double.
    """
    if kind == "json":
        rows = spark.read.option("multiLine", True).schema(f"drugs array<struct<{DRUGS}>>").json(path).select(F.inline("drugs"))
    else:
        fields = [*(f"`{t}` string" for f in TEXTS for t in _tags(f)), *(f"`{t}` struct<item: array<string>>" for f in LISTS for t in _tags(f))]
        link = ", ".join(f"`{t}`: string" for f in LINK for t in _tags(f))
        read = spark.read.format("xml").option("rowTag", "drug").schema(", ".join([*fields, f"interactions struct<interaction: array<struct<{link}>>>"])).load(path)
        links = F.transform("interactions.interaction", lambda x: F.struct(*[_either(f, x).alias(f) for f in LINK]))
        rows = read.select(*[_either(f).alias(f) for f in TEXTS], *[F.coalesce(*[F.col(f"`{t}`.item") for t in _tags(f)]).alias(f) for f in LISTS], links.alias("interactions"))
    listed = lambda f: F.filter(F.coalesce(f, F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False))).alias(f)
    weight = F.expr("try_cast(weight as double)")
    error = F.when(F.coalesce("drugbank_id", F.lit("")) == "", "no id").when(F.coalesce("name", F.lit("")) == "", "no name").when(F.col("weight").isNotNull() & weight.isNull(), "weight")
    return rows.select(*[weight.alias(f) if f == "weight" else F.col(f) for f in TEXTS], *map(listed, LISTS), F.coalesce("interactions", F.array().cast(_LINKS)).alias("interactions"), error.alias("error"))


def drug_links(drugs: DataFrame) -> DataFrame:
    """(drugbank_id, other, description, severity, known): a row an interaction; other is the id it names, or the one of the drug of that name, and known whether it is among ``drugs``.

    Names are compared in lower case; the least id of equal ones counts.
    """
    own = drugs.where("error is null")
    each = own.select("drugbank_id", F.explode("interactions").alias("i")).select("drugbank_id", F.nullif(F.col("i.drugbank_id"), F.lit("")).alias("told"), F.lower("i.drug_name").alias("key"), "i.description", "i.severity")
    names = own.groupBy(F.lower("name").alias("key")).agg(F.min("drugbank_id").alias("named"))
    found = each.join(names, "key", "left").select("drugbank_id", F.coalesce("told", "named").alias("other"), "description", "severity")
    known = own.select(F.col("drugbank_id").alias("other"), F.lit(True).alias("known")).distinct()
    return found.join(known, "other", "left").select("drugbank_id", "other", "description", "severity", F.coalesce("known", F.lit(False)).alias("known"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a golden set: {"name": ..., "items": [...]} in files of any number of lines, or the JSON lines of save_items()."""
    whole = spark.read.option("multiLine", True).schema(f"items array<struct<{ITEMS}>>, {ITEMS}").json(path)
    if whole.where("items is not null").limit(1).count():
        return whole.select(F.inline("items"))
    return spark.read.schema(ITEMS).json(path)


def save_items(items: DataFrame, path: str) -> None:
    """The columns of a golden set as JSON lines, by all tasks at once; a field without a value is written as null."""
    items.select(*[c.split()[0] for c in ITEMS.split(", ")]).write.option("ignoreNullFields", False).json(path)


def markdown(rows: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line): ``rows`` as a Markdown table in the order of those columns. Pipes and line ends inside values are escaped, null is empty; line_no starts at 0.

    Rows are numbered by ranges of the order, so no task holds all of them.
    """
    cell = lambda c: F.coalesce(F.regexp_replace(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>"), F.lit(""))
    names = rows.columns
    lines = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, names)), F.lit(" |")).alias("line"))
    placed = lines.select(F.shiftright(F.monotonically_increasing_id(), 33).alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "line")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(counts.select(F.col("part").alias("p"), F.col("n").alias("m")), F.col("p") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    body = placed.join(F.broadcast(before), "part").select((F.col("before") + F.col("at") + 2).alias("line_no"), "line")  # a row a partition
    head = rows.sparkSession.range(2).select(F.col("id").alias("line_no"), F.when(F.col("id") == 0, F.lit("| " + " | ".join(names) + " |")).otherwise(F.lit("|" + "---|" * len(names))).alias("line"))
    return head.unionByName(body)


def save_report(rows: DataFrame, path: str, kind: str, order: list[str]) -> None:
    """``rows`` as JSON lines or as a Markdown table (files in order)."""
    if kind == "json":
        rows.orderBy(*order).write.option("ignoreNullFields", False).json(path)
    elif kind == "markdown":
        markdown(rows, order).orderBy("line_no").select("line").write.text(path)
    else:
        raise ValueError(f"no kind {kind} of report")
