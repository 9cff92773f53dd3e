"""Cleaning, chunking, chunk context, entity matching and intent rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, tried in this order; the empty one stands for a cut at the size.
SEPARATORS = ("\n\n", "\n", "。", "．", "！", "？", "；", "；\n", ". ", "! ", "? ", "，", "、", "：", " ", "")


def clean_text(text: Column) -> Column:
    """White space collapsed; comma, semicolon and colon in full width."""
    return F.translate(F.trim(F.regexp_replace(text, r"\s+", " ")), ",;:", "，；：")


def sanitize(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[\x00-\x1f\x7f-\x9f]", "")


def fixed_windows(docs: DataFrame, size: int = 512, overlap: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, document_id, chunk_index, content): windows of ``size`` characters, ``size - overlap`` apart. No text, no chunk."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(step))
    x = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("document_id"), text_col, F.posexplode(starts).alias("chunk_index", "at"))
    return x.select(F.concat_ws("_chunk_", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "chunk_index", F.substring(F.col(text_col), F.col("at") + 1, F.lit(size)).alias("content"))


def split_recursive(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that helps; nothing is lost, separators stay at the ends."""
    if len(text) <= size:
        return [text] if text else []
    for k, sep in enumerate(separators):
        if sep and sep in text:
            parts = [p + sep for p in text.split(sep)]
            parts[-1] = parts[-1][: -len(sep)]
            out, held = [], ""
            for part in parts:
                if len(held) + len(part) <= size:
                    held += part
                    continue
                out += [held] if held else []
                held = ""
                if len(part) <= size:
                    held = part
                else:
                    out += split_recursive(part, size, separators[k + 1 :])
            return out + ([held] if held else [])
    return [text[k : k + size] for k in range(0, len(text), size)]


def split_markdown(text: str, size: int) -> list[str]:
    """Sections from heading to heading (not inside fences), split further where too long."""
    sections, fenced = [""], False
    for line in text.splitlines(keepends=True):
        fenced ^= line.lstrip().startswith("```")
        if not fenced and re.match(r"#{1,6}\s", line) and sections[-1]:
            sections.append("")
        sections[-1] += line
    return [p for s in sections for p in split_recursive(s, size)]


def split_hybrid(text: str, size: int) -> list[str]:
    """As Markdown where there is a heading's mark or a fence, else recursively."""
    return split_markdown(text, size) if "#" in text or "```" in text else split_recursive(text, size)


def split_headed(text: str, size: int, headings: tuple[str, ...] = ()) -> list[str]:
    """Sections from heading to heading (any of the patterns ``headings``), long ones further recursively; without headings recursively."""
    marks = [m.start() for m in re.finditer("|".join(headings), text)] if headings else []
    if not marks:
        return split_recursive(text, size)
    sections = [text[a:b].strip() for a, b in zip([0, *marks], [*marks, len(text)])]
    return [p for s in sections if s for p in ([s] if len(s) <= size else split_recursive(s, size))]


def split_hierarchical(text: str, size: int, parent: int = 1024) -> list[str]:
    """Parents of whole paragraphs of at least ``parent`` characters (the last may be shorter), each followed by its children: whole sentences of at least ``size``."""
    out, held = [], []
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    for k, paragraph in enumerate(paragraphs):
        held.append(paragraph)
        whole = "\n\n".join(held)
        if len(whole) >= parent or k == len(paragraphs) - 1:
            out.append(whole)
            child, sentences = "", [x for x in re.split(r"(?<=[。！？；.!?])\s+", whole) if x.strip()]
            for j, sentence in enumerate(sentences):
                child += sentence
                if len(child) >= size or j == len(sentences) - 1:
                    out.append(child)
                    child = ""
            held = []
    return out


def split_streaming(text: str, size: int, overlap: int = 75, back: int = 100) -> list[str]:
    """Windows ``size - overlap`` apart, each ending after the last sentence's end within its last ``back`` characters, if there is one."""
    out = []
    for at in range(0, len(text), max(1, size - overlap)):
        end = min(at + size, len(text))
        if end < len(text):
            region = text[max(at, end - back) : end]
            last = max(region.rfind(c) for c in "。！？；\n.!?;\r")
            end = end if last < 0 else end - len(region) + last + 1
        out.append(text[at:end].strip())
    return out


SPLITTERS = {"recursive": split_recursive, "markdown": split_markdown, "hybrid": split_hybrid}
#: These give some of the text more than once: in a parent and its children, or where windows overlap.
REPEATING = {"hierarchical": split_hierarchical, "streaming": split_streaming}
_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
#: Where texts are parted before the parts are merged again into chunks with an overlap; at a sentence's end whatever follows.
FOLDED = {"sentence": rf"(?<=[。！？；.!?]){_SPACE}*", "paragraph": rf"\n{_SPACE}*\n"}


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+\z", "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """``size`` characters each, ``size - overlap`` apart; of an empty text none."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(text, at + 1, F.lit(size)))


def merged_parts(parts: Column, size: int = 512, overlap: int = 75, soft: int | None = None, separator: str = "\n\n") -> Column:
    """Chunks of the array ``parts``, by one fold over it.

    Parts gather in a chunk until they have ``soft`` characters (0.75 of ``size`` if null), separators not counted; the next
    chunk then begins with the last ``overlap`` characters of that one as a part of its own, unless these are blank. A part of
    over ``size`` characters ends the chunk and is cut into windows, after which nothing is carried over. So a chunk has fewer
    than ``soft + size`` characters and its separators. No parts, no chunks; a null array gives null.
    """
    soft = int(size * 0.75) if soft is None else soft
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n"))
    with_held = lambda s: F.array_compact(F.array_append(s.done, s.held))

    def step(s: Column, part: Column) -> Column:
        tail = F.right(s.held, F.lit(overlap)) if overlap > 0 else F.lit("")
        carried = F.when(F.length(stripped(tail)) > 0, tail)
        begun = F.struct(with_held(s).alias("done"), F.concat_ws(separator, carried, part).alias("held"), (F.coalesce(F.length(carried), F.lit(0)) + F.length(part)).alias("n"))
        grown = F.struct(s.done.alias("done"), F.concat_ws(separator, s.held, part).alias("held"), (s.n + F.length(part)).alias("n"))
        cut = F.struct(F.concat(with_held(s), windows(part, size, overlap)).alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n"))
        return F.when(F.length(part) > size, cut).when(s.held.isNotNull() & (s.n >= soft), begun).otherwise(grown)

    return F.aggregate(parts, none, step, with_held)


def folded_chunks(docs: DataFrame, size: int, strategy: str, overlap: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of whole sentences or paragraphs (``strategy`` of FOLDED), see merged_parts(). Null and blank texts have none; rows without an id go."""
    parts = F.filter(F.transform(F.split(F.col("text"), FOLDED[strategy]), stripped), lambda p: p != "")
    x = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("document_id"), F.col(text_col).alias("text"))
    x = x.select("document_id", F.filter(merged_parts(parts, size, overlap), lambda p: stripped(p) != "").alias("chunks")).select("document_id", F.posexplode("chunks").alias("chunk_index", "content"))
    return x.select(F.concat_ws("_chunk_", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", F.lit(strategy).alias("strategy"), "chunk_index", "content")


def select_strategy(text: Column, sections: str | None = None) -> Column:
    """section (if one of the words ``sections`` is there), markdown for three headings, semantic for long texts without clear structure, hierarchical for headings of two levels, else recursive."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    clear = F.regexp_like(text, F.lit(r"第[一二三四五六七八九十\d]+[章节部分篇]|【.+】|\d+\.\s+[A-Z\x{4e00}-\x{9fff}]"))
    one, two, three = (count(rf"(?m)^{'#' * k}\s+") > 0 for k in (1, 2, 3))
    out = F.when(count(r"(?m)^#{1,6}\s+.+$") >= 3, "markdown").when((F.length(text) > 5000) & ~clear, "semantic").when((one & two) | (two & three), "hierarchical").otherwise("recursive")
    return F.when(F.regexp_like(text, F.lit(sections)), "section").otherwise(out) if sections else out


def contextual(chunks: DataFrame, contexts: DataFrame, longest: int = 200) -> DataFrame:
    """``chunks`` whose content begins with the context of their document (``contexts(document_id, context)``), cut to ``longest`` characters; without one they stay."""
    x = chunks.join(contexts, "document_id", "left")
    said = F.concat(F.lit("[上下文] "), F.substring(F.regexp_replace(F.trim("context"), "^[\"']+|[\"']+$", ""), 1, longest), F.lit("\n"), "content")
    return x.withColumn("content", F.coalesce(said, "content")).drop("context")


def pattern_mentions(texts: DataFrame, patterns: list[tuple[str, str, float]], id_col: str, text_col: str) -> DataFrame:
    """(id, name, type, start, end, confidence, strategy) of every distinct match of ``patterns(pattern, type, confidence)`` at its first place."""
    out = None
    for pattern, kind, confidence in patterns:
        found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)))).alias("name")
        one = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), found).where("name <> ''")
        one = one.select("id", "name", F.lit(kind).alias("type"), (F.instr(F.col("t"), F.col("name")) - 1).alias("start"), F.lit(confidence).alias("confidence"), F.lit(pattern).alias("strategy"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("end", F.col("start") + F.length("name"))


def extracted(mentions: DataFrame) -> DataFrame:
    """The pipeline over the strategies' mentions: in each document one row for each (name, type) with a raised confidence, then no two that overlap."""
    raised = F.element_at(F.array(F.lit(0.0), F.lit(0.03), F.lit(0.05), F.lit(0.08)), F.least(F.col("k"), F.lit(4)).cast("int"))
    x = mentions.groupBy("id", F.lower("name").alias("name"), "type").agg(F.max("confidence").alias("c"), F.countDistinct("strategy").alias("k"), F.min(F.struct("start", "end")).alias("at"))
    return non_overlapping(x.select("id", "name", F.col("at.start").alias("start"), F.col("at.end").alias("end"), F.round(F.least(F.lit(1.0), F.col("c") + raised), 6).alias("confidence")))


def run_strategy(text: Column) -> Column:
    """The strategy by which split_documents() splits a text: select_strategy()'s, with paragraphs for semantic, which needs vectors."""
    how = select_strategy(F.coalesce(text, F.lit("")))
    return F.when(how == "semantic", "paragraph").otherwise(how)


#: Chunks, or their characters, at which a splitting task hands on what it holds.
HELD_ROWS, HELD_CHARS = 8192, 4_000_000


def split_documents(docs: DataFrame, size: int = 512, strategy: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks by one strategy, or by the one chosen for each text; blank chunks are skipped and the index is dense.

    Sentences and paragraphs are folded by SQL functions; the others, sequential inside a text, read Arrow batches and hand on
    the chunks of as many whole texts as reach HELD_ROWS or HELD_CHARS, since a frame for each text takes longer than its split.
    """
    if strategy in FOLDED:
        return folded_chunks(docs, size, strategy, id_col=id_col, text_col=text_col)
    every = {**SPLITTERS, **REPEATING}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows, held = ["chunk_id", "document_id", "strategy", "chunk_index", "content"], [], 0
        for pdf in batches:
            for doc, text, how in zip(pdf["id"], pdf["text"], pdf["how"]):
                more = [(f"{doc}_chunk_{k}", doc, how, k, part) for k, part in enumerate(p for p in every[how](text or "", size) if p.strip())]
                rows += more
                held += sum(len(r[4]) for r in more)
                if len(rows) >= HELD_ROWS or held >= HELD_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    how = F.lit(strategy) if strategy else run_strategy(F.col(text_col))
    x = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), how.alias("how"))
    out = (x if strategy else x.where(~F.col("how").isin([*FOLDED]))).mapInPandas(run, "chunk_id string, document_id bigint, strategy string, chunk_index int, content string")
    return out if strategy else out.unionByName(folded_chunks(x.where("how = 'paragraph'"), size, "paragraph", id_col="id"))


def split_stats(chunks: DataFrame) -> DataFrame:
    n = F.length("content")
    return chunks.agg(F.count("*").alias("n"), F.sum(n).cast("bigint").alias("total"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))


def chunk_context(chunks: DataFrame, k: int = 1) -> DataFrame:
    """(chunk_id, document_id, context): each chunk with its whole neighbours up to ``k`` away in its document, itself among them, in order.

    ``context`` is an array of (chunk_index, chunk_id, content, is_target).
    """
    w = Window.partitionBy("document_id").orderBy("chunk_index").rangeBetween(-k, k)
    near = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content")).over(w))
    x = chunks.select("chunk_id", "document_id", near.alias("near"))
    return x.select("chunk_id", "document_id", F.transform("near", lambda c: F.struct(c.chunk_index, c.chunk_id, c.content, (c.chunk_id == F.col("chunk_id")).alias("is_target"))).alias("context"))


def reconstruct(chunks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Documents from their chunks in order; empty ones are skipped but counted."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    texts = F.filter(F.transform("rows", lambda r: r.content), lambda t: t != "")
    return chunks.groupBy("document_id").agg(rows.alias("rows")).select("document_id", F.size("rows").cast("bigint").alias("n_chunks"), F.array_join(texts, separator).alias("content"))


def dictionary_mentions(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, type, n) of dictionary names (one lower-case word each) among a text's words; the dictionary side is left to the optimiser."""
    words = texts.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+")).alias("word"))
    return words.join(dictionary, F.col("word") == F.col("name")).groupBy("id", "name", "type").agg(F.count("*").alias("n"))


def abbreviation_mentions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, abbr, start, confidence) of distinct words of 2 to 5 capitals; start is the first position. Letters and digits of any script bound no word."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{2,5}(?![\p{L}\p{N}_])"), F.lit(0)))
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.explode(found).alias("abbr")).select("id", "abbr", (F.instr(F.col("t"), F.col("abbr")) - 1).alias("start"), F.lit(0.9).alias("confidence"))


def validated(entities: DataFrame) -> DataFrame:
    """One row per (lower name, type): the best confidence, raised by 0.03, 0.05 or 0.08 for 2, 3 or more strategies, at most 1."""
    x = entities.groupBy(F.lower("name").alias("name"), "type").agg(F.max("confidence").alias("c"), F.countDistinct("strategy").alias("k"))
    raised = F.when(F.col("k") >= 4, 0.08).when(F.col("k") == 3, 0.05).when(F.col("k") == 2, 0.03).otherwise(0.0)
    return x.select("name", "type", F.round(F.least(F.lit(1.0), F.col("c") + raised), 6).alias("confidence"))


def non_overlapping(entities: DataFrame) -> DataFrame:
    """Greedy choice in each document: by confidence, then start; spans that touch a chosen one go. One document's spans are a group."""
    row = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "start", "end", "name")))
    free = lambda chosen, x: ~F.exists(chosen, lambda y: (x.start < y.end) & (y.start < x.end))
    start = F.array().cast("array<struct<c double, start int, end int, name string>>")
    kept = F.aggregate("rows", start, lambda chosen, x: F.when(free(chosen, x), F.array_append(chosen, x)).otherwise(chosen))
    return entities.groupBy("id").agg(row.alias("rows")).select("id", F.explode(kept).alias("e")).select("id", "e.name", "e.start", "e.end", (-F.col("e.c")).alias("confidence"))


def history_summary(turns: DataFrame, keep: int = 4, longest: int = 50) -> DataFrame:
    """(conv_id, n_old, n_pairs, summary, kept): the last ``keep`` turns whole, and one text that sums up those before.

    ``summary`` lists old user turns, each with the assistant turn right after it if that is old too, cut to ``longest`` characters;
    null where there are none. ``kept`` is an array of (turn, role, text). Turns are ordered by turn, then role, then text.
    """
    by = ["turn", "role", "text"]
    x = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(*map(F.desc, by))))
    order = Window.partitionBy("conv_id").orderBy(*by)
    old, asks = F.col("back") > keep, (F.col("back") > keep) & (F.col("role") == "user")
    answered = (F.col("back") > keep + 1) & F.equal_null(F.lead("role").over(order), F.lit("assistant"))
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, longest)
    x = x.select("conv_id", *by, "back", (asks & answered).alias("pair"), cut(F.col("text")).alias("q"), F.when(answered, cut(F.lead("text").over(order))).otherwise("").alias("a"))
    part = F.concat(F.lit("问: "), "q", F.when(F.col("a") != "", F.concat(F.lit("；答: "), "a")).otherwise(""))
    parts = F.array_sort(F.collect_list(F.when(asks & (F.col("q") != ""), F.struct((-F.col("back")).alias("k"), part.alias("part")))))
    kept = F.array_sort(F.collect_list(F.when(~old, F.struct((-F.col("back")).alias("k"), *by))))
    out = x.groupBy("conv_id").agg(F.count_if(old).alias("n_old"), F.count_if("pair").alias("n_pairs"), parts.alias("parts"), kept.alias("kept"))
    summary = F.when(F.size("parts") > 0, F.concat(F.lit("[对话摘要] "), F.array_join("parts.part", "；")))
    return out.select("conv_id", "n_old", "n_pairs", summary.alias("summary"), F.transform("kept", lambda r: F.struct(r.turn, r.role, r.text)).alias("kept"))
