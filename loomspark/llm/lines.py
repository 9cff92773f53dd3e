"""Line dedup: explode normalised lines, hash, count distinct documents a hash, drop the frequent ones, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import LOWER, SPACES, UPPER, Columns, written

#: Parts of a frequent hash's lines in the join with the table of frequent hashes, where that is too large to broadcast.
SALTS = 16


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def dedup_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with its texts' repeated lines dropped, and n_lines (before) and n_dropped.

    A line's key of ``least_chars`` code points or more that occurs in ``least_docs`` documents or more loses its lines in
    all documents but the largest id that holds it, which keeps all of them. A null or empty text is one empty line and
    comes back as an empty text; so does a text whose lines all went. Rows with one id are one document to the count, and each is cleaned. A row
    without an id counts as no document and is left as it is. Columns named n_lines or n_dropped, in any case, are replaced; others
    may have any name. An empty table gives an empty one. ``broadcast_rows`` steers the cost alone.

    Only places and hashes are exploded: the lines that go come back to the texts as places, and each text is put together
    from the places that stay.
    """
    own = Columns(docs, ("n_lines", "n_dropped"))
    at_id, at_text = own.at(id_col), own.at(text_col)
    text, row = F.coalesce(F.col(at_text).cast("string"), F.lit("")), [F.col(at_id).alias("id"), F.xxhash64(at_text).alias("mark")]
    cut = own.df.where(F.col(at_id).isNotNull()).select(*row, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select("id", "mark", "pos", line_key(F.col("line")).alias("key"))
    lines = written(cut.where(F.length("key") >= least_chars).select("id", "mark", "pos", F.unhex(F.md5(F.encode("key", "UTF-8"))).alias("hash")), "lines")
    often = lines.groupBy("hash", "id").agg(F.count("*").alias("_n")).groupBy("hash").agg(F.count("*").alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= least_docs)
    often = written(often.select("hash", "keeper"), "often")
    if often.count() <= broadcast_rows:
        found = lines.join(F.broadcast(often), "hash")
    else:
        salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = lines.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    drops = found.where("id <> keeper").groupBy("id", "mark").agg(F.collect_set("pos").alias("drop"))

    joined = own.df.withColumn("mark", F.xxhash64(at_text)).withColumnRenamed(at_id, "id").join(drops, ["id", "mark"], "left").withColumnRenamed("id", at_id)
    stay = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drop"))
    # the parts are a lambda's variable, so a text is split once and not for each of its lines
    again = F.transform(F.array(F.split(text, "\n", -1)), lambda parts: F.array_join(F.transform(stay(parts), lambda k: F.get(parts, k)), "\n"))
    kept = F.when(F.col("drop").isNull(), text).otherwise(again[0])
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    out = [kept.alias(c) if c == at_text else F.col(c) for c in own.own]
    return own.back(joined.select(*out, n_lines.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped")))
