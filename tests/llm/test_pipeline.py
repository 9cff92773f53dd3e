import collections
import hashlib
import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from loomspark.llm import queries as llm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = r"[^\x20\x09-\x0D]+"
SHARED = "this notice stands at the foot of many documents"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def texts():
    """Plain texts, exact and near copies, texts with a shared line, short, blank and null ones."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdeilnorst", k=rnd.randrange(2, 9)))
    out = []
    for k in range(60):
        lines = [" ".join(word() for _ in range(rnd.randrange(6, 14))) for _ in range(10)]
        out.append("\n".join([*lines, *([SHARED.title() if k % 2 else f"  {SHARED}\t"] if k % 4 == 0 else [])]))
    for k in range(12):
        words = out[k].split(" ")
        words[len(words) // 2] = f"changed{k}"
        out += [out[k], " ".join(words)]
    return [*out, None, "", " \n\t", "three short words", "three short words", "é 𝒳 " * 40, "\n".join([SHARED] * 2)]


@pytest.fixture(scope="module")
def rows():
    return [(k, t, ("en", "fr", "de")[k % 3], f"src{k % 7}", len(t or "")) for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_quality_stage(spark, docs, rows, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.quality(spark, docs, str(tmp_path))
    assert got.columns == list(pipeline.COLUMNS)

    def kept(text):
        words = re.findall(WORD, text or "")
        threes = collections.Counter(zip(words, words[1:], words[2:]))
        twice = {i + j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(3)}
        return len(words) >= 50 and 100 * len(twice) <= 50 * len(words)

    assert sorted(tuple(r) for r in got.collect()) == [r for r in rows if kept(r[1])]


def test_line_stage(spark, docs, rows):
    key = lambda line: lowered(line.strip(" \t\n\v\f\r"))
    held = collections.defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    want = []
    for i, text, lang, source, _ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        now = "\n".join(left)
        if len(left) == len(lines) or now.strip(" "):
            want.append((i, now, lang, source, len(now)))
    got = pipeline.lines(spark, docs, "")
    assert got.columns == list(pipeline.COLUMNS)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_near_copy_stage(spark, docs, rows):
    sets = {}
    for i, text, *_ in rows:
        words = re.findall(WORD, lowered(text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 20
    for _ in rows:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = pipeline.near_copies(spark, docs, "")
    assert got.columns == list(pipeline.COLUMNS)
    assert sorted(r.doc_id for r in got.collect()) == [i for i in sets if least[i] == i]


def test_mixing_stage(spark, docs, rows):
    """Copies are mix_sources', which has its own brute force; each row is an input row, and the mix is near its budget."""
    got = [tuple(r) for r in pipeline.mixing(spark, docs, "").collect()]
    words = {r[0]: len(re.findall(WORD, r[1] or "")) for r in rows}
    assert set(got) <= {r for r in rows if words[r[0]]} and max(collections.Counter(got).values()) <= 2
    copies = {r.doc_id: r.mix_copies for r in llm.mix_sources(docs, llm.mix_domain(), share=0.5, weights=llm.MIX_WEIGHTS, max_epochs=2, seed=1).collect()}
    assert collections.Counter(r[0] for r in got) == collections.Counter({i: n for i, n in copies.items() if n})
    assert sum(words[r[0]] for r in got) <= 0.5 * sum(words.values())


def test_encoding_stage(spark, docs, rows):
    got = {r.doc_id: r for r in pipeline.encoding(spark, docs, "").collect()}
    assert len(got) == len(rows) and all(r.exact and r.n_pieces == len(r.piece_ids) for r in got.values())
    assert {i: r.decoded_sha256 for i, r in got.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in rows}


def test_run_chains_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(pipeline.COLUMNS) or k == len(pipeline.STAGES) - 1
    pick = lambda df: sorted((r.doc_id, r.n_pieces, r.decoded_sha256, r.exact) for r in df.collect())
    got = pick(entry.queries()["pipeline"](spark, sf_dir))
    assert got and got == pick(docs) and all(r[3] for r in got)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_matches_its_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    got = llm.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(llm.ORACLES[name])
    assert sorted(want.columns) == columns
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.project(", ".join(columns)).fetchall())
