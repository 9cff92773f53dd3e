"""The fold that merges parts into chunks with an overlap, against the rule told by positions."""

import random
import re

from pyspark.sql import functions as F

from loomspark.operators import text


def chunks_of(parts, size, overlap, soft):
    """Runs of parts by index: a run ends where it has ``soft`` characters or a part is too long; each is then written out."""
    runs, at = [], 0
    while at < len(parts):
        if len(parts[at]) > size:
            runs.append(parts[at])
            at += 1
            continue
        before = runs[-1] if runs and isinstance(runs[-1], list) and len(parts[at - 1]) <= size else None
        tail = "\n\n".join(before)[-overlap:] if before and overlap else ""
        run = [tail] if tail.strip() else []
        end = at
        while end < len(parts) and len(parts[end]) <= size and (not run or end == at or sum(map(len, run)) < soft):
            run.append(parts[end])
            end += 1
        runs.append(run)
        at = end
    out = []
    for run in runs:
        out += ["\n\n".join(run)] if isinstance(run, list) else [run[k : k + size] for k in range(0, len(run), size - overlap)]
    return out


def test_fold_matches_the_rule(spark):
    rnd = random.Random(5)
    cases = [["".join(rnd.choices("ab 词", k=rnd.choice([1, 3, 9, 10, 30]))) for _ in range(rnd.randrange(14))] for _ in range(150)] + [[], ["x" * 11], ["a" * 7] * 5, ["ab" + " " * 8, "c"], ["z" * 2000]]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, parts array<string>")
    for size, overlap, soft in ((10, 3, 7), (10, 0, 7), (20, 6, 1), (9, 3, 20)):
        got = {r.id: r.c for r in df.select("id", text.merged_parts(F.col("parts"), size, overlap, soft).alias("c")).collect()}
        assert got == {k: chunks_of(v, size, overlap, soft) for k, v in enumerate(cases)}, (size, overlap, soft)


def test_sentences_and_paragraphs_overlap(spark):
    body = " ".join(f"Sentence number {k} of some words." for k in range(60)) + "词。词！\n\n \n" + "p" * 700 + "\n\nlast"
    docs = spark.createDataFrame([(1, body, "x"), (2, None, "x"), (3, " \n ", "x"), (4, "3.14", "x"), (None, "gone", "x"), (5, "a. " * 20_000, "x")], "doc_id bigint, text string, content string")
    parted = {"sentence": lambda t: re.split(r"(?<=[。！？；.!?])\s*", t), "paragraph": lambda t: re.split(r"\n\s*\n", t)}
    for how, cut in parted.items():
        got = {}
        for r in text.split_documents(docs, 512, how).orderBy("document_id", "chunk_index").collect():
            got.setdefault(r.document_id, []).append(r.content)
            assert r.chunk_id == f"{r.document_id}_chunk_{len(got[r.document_id]) - 1}"
        want = {k: chunks_of([p.strip() for p in cut(t) if p.strip()], 512, 75, 384) for k, t in ((1, body), (4, "3.14"), (5, "a. " * 20_000))}
        assert got == want, how
    sentences = [c for c in chunks_of([p.strip() for p in parted["sentence"](body) if p.strip()], 512, 75, 384)]
    assert sentences[1].startswith(sentences[0][-75:])


def test_strategies_of_mixed_texts(spark):
    docs = spark.createDataFrame([(1, "# a\n\n# b\n\n# c\n"), (2, "word " * 1200), (3, "short"), (4, "# a\n## b\n"), (5, None)], "doc_id bigint, text string")
    got = text.split_documents(docs, 512)
    assert {(r.document_id, r.strategy) for r in got.collect()} == {(1, "markdown"), (2, "paragraph"), (3, "recursive"), (4, "hierarchical")}
