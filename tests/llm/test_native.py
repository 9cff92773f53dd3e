import collections
import hashlib
import itertools
import json
import math
import random
import re

from pyspark.sql import functions as F

from loomspark.llm.chat import canonical_records, canonical_turns, escape, escape_role, format_chats, read_chats, unescape, unescape_role, unmapped_records
from loomspark.llm.mixing import LEVELS, mix_sources
from loomspark.llm.queries import URL_RULES
from loomspark.llm.urls import filter_urls, url_host, url_path


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "://x", "HTTP://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/ES/1", "https://notexample.org/es/1", "ftp://org", "http://a.org?q=/x", "http://b.com/fr/é", "http://com/de/",
            "http://b.net://c/de/", "http://É.Com/fr/\n/x", "http://spam.net/buy/cheap", "http://h.net/ok"]
    urls += [f"http://spam.net/buy/{k}" for k in range(40)] + [f"http://fine{k}.net/read/{k}" for k in range(40)]
    pages = spark.createDataFrame([(k, u, "t") for k, u in enumerate(urls)] + [(3, urls[8], "t"), (None, urls[5], "t")], "page_id bigint, url string, tokens string")
    labels = spark.createDataFrame([(k, int("spam" in (u or "")), None) for k, u in enumerate(urls) if k % 3], "doc_id bigint, toxic int, quality int")
    got = filter_urls(spark, pages, labels, URL_RULES, min_support=0.05, min_confidence=0.9).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r.page_id is None or r.page_id == 3:
            continue
        host, path = parts(urls[r.page_id])
        fits = [(t, v) for t, v in URL_RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "block" if "spam.net" in host else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert filter_urls(spark, pages.limit(0), labels, URL_RULES).collect() == []
    assert {r.verdict for r in filter_urls(spark, pages, labels.limit(0), URL_RULES).where("rule is null").collect()} == {"allow"}
    assert pages.select(url_host("url").alias("h"), url_path("url").alias("p")).count() == len(urls) + 2


def test_mined_rules_match_brute_force(spark):
    rnd = random.Random(12)
    hosts, words = ["a.net", "b.net", "c.b.net"], ["x", "y", "z", "shop", "ads", "win"]
    urls = [f"http://{rnd.choice(hosts)}/{'/'.join(rnd.sample(words, rnd.randrange(1, 5)))}" for _ in range(260)]
    urls += [f"http://t.org/{'/'.join(f's{j}' for j in range(25))}/{k % 3}" for k in range(12)] + ["http://t.org/s3/s4", "http://long.net/" + "/".join(f"r{j}" for j in range(4000))]
    own = [set([f"h:{x}" for x in u.split("://")[1].split("/")[0].split(".")] + [f"p:{x}" for x in u.split("://")[1].split("/")[1:]]) for u in urls]
    bad = [int({"p:shop", "p:ads", "p:win", "p:x"} <= t or ("h:a" in t and "p:z" in t and rnd.random() < 0.9) or "p:s7" in t) for t in own]
    labelled = [k for k in range(len(urls)) if k % 4]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([(k, bad[k]) for k in labelled], "doc_id bigint, toxic int")
    got = {r.page_id: r for r in filter_urls(spark, pages, labels, [], min_support=0.01, min_confidence=0.7, least_pages=4, prior=1.0).collect()}

    base, fired = sum(bad[k] for k in labelled) / len(labelled), collections.defaultdict(float)
    template = {f"p:s{j}" for j in range(25)}
    for k, tokens in enumerate(own):
        for size in range(1, 7):
            for subset in itertools.combinations(sorted(tokens if len(tokens) < 20 else tokens & {"h:t", "h:org", "p:s3", "p:s7", "p:0", "p:1", "p:2"}), size):
                having = [j for j in labelled if own[j] >= set(subset)]
                hits = sum(bad[j] for j in having)
                if hits >= max(4, math.ceil(0.01 * len(labelled))) and (hits + base) / (len(having) + 1) >= 0.7:
                    fired[k] = max(fired[k], (hits + base) / (len(having) + 1))
    assert 0 < len(fired) < len(urls) and any(own[k] & template for k in fired)
    for k in range(len(urls)):
        assert (got[k].verdict, round(got[k].confidence or 0, 9)) == ("block" if k in fired else "allow", round(fired.get(k, 0), 9)), urls[k]


def test_chat_escapes(spark):
    rnd = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "~", "<", "[", "\n", "x", "\\", "\\n", "|>", "<~s>", "s>"]
    texts = ["".join(rnd.choices(bits, k=rnd.randrange(12))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"), escape_role(F.col("t")).alias("r"), unescape_role(escape_role(F.col("t"))).alias("v")).collect()
    for r in rows:
        assert r.u == r.t and r.v == r.t and "\n" not in r.r
        assert not re.search(r"</?s>|\[/?INST\]|<\|im_(start|end)\|>", r.e)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi\n<|im_end|>\n<|im_start|>user\n"), (1, 1, "assistant", None), (1, 2, None, "x"), (2, 1, "assistant", "b" * 70_000), (2, 0, "a\nb<s>", ""), (2, 1, "assistant", "</s>"), (2, None, "assistant", "𝒳"), (None, 0, "assistant", "z"), (3, 0, "assistant", "\n")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, mask int")
    got = {r.conv_id: r for r in read_chats(format_chats(canonical_turns(turns))).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == dict(want)
    assert {c: r.losses for c, r in got.items()} == {c: [t for role, t in v if role == "assistant"] for c, v in want.items()}
    assert read_chats(format_chats(canonical_turns(turns.limit(0)))).collect() == []


def test_chat_layouts(spark):
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"conv_id": 2, "conversations": [{"from": "human", "value": "c"}, {"from": "gpt", "value": "d"}]},
        {"conv_id": 3, "prompt": "e", "completion": "f"}, {"instruction": "g", "conv_id": 4, "input": "h", "output": "i"}, {"conv_id": 5, "instruction": "j", "input": "", "output": "k"}, {"conv_id": 6, "strange": 1},
        {"conv_id": 8, "turn": 4, "role": "tool", "text": "l\n\u0000"}, {"conv_id": 9, "turn": 0, "role": None, "text": None},
        {"conv_id": 10, "id": "x", "source": None, "messages": [{"role": "user", "content": "m", "name": "n"}, {"role": "assistant", "content": None}]},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [(None,), ("no json",)], "record string")
    got = sorted(((int(r.conv_id), r.turn, r.role, r.text) for r in canonical_records(df, "record").collect()), key=lambda r: r[:2])
    assert {r.record for r in unmapped_records(df, "record").collect()} == {json.dumps(records[5]), None, "no json"}
    pair = lambda c, a, b: [(c, 0, "user", a), (c, 1, "assistant", b)]
    assert got == pair(1, "a", "b") + pair(2, "c", "d") + pair(3, "e", "f") + pair(4, "g\n\nh", "i") + pair(5, "j", "k") + [(8, 4, "tool", "l\n\0"), (9, 0, None, None), (10, 0, "user", "m"), (10, 1, "assistant", None)]
    table = spark.createDataFrame([(7, "q", "r")], "conv_id bigint, question string, answer string")
    assert sorted((r.role, r.text) for r in canonical_turns(table).collect()) == [("assistant", "r"), ("user", "q")]


def test_chat_records_are_not_lost(spark):
    """Ids of any kind, empty arrays, messages of differing fields, null elements, and texts that look like arrays."""
    said = [{"role": "user", "content": "a"}]
    records = [
        {"conv_id": "x6", "messages": said}, {"conv_id": "x7", "messages": said}, {"conv_id": "e1", "messages": []}, {"conv_id": 2, "conversations": []},
        {"conv_id": "f", "messages": [{"role": "system"}, None, {"name": "n", "role": "user", "content": "b"}]},
        {"conv_id": "t", "prompt": "[]", "completion": '[{"a": 1}]'}, {"conv_id": "x6", "turn": 9, "role": "user", "text": "late"},
        {"conv_id": None, "messages": said}, {"conv_id": "g", "messages": [{"role": "user"}]}, {"conv_id": "h", "messages": ["a"]}, {"conv_id": "i", "messages": None},
        {"conv_id": None, "turn": 0, "role": "user", "text": "row"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
    assert {r.record for r in unmapped_records(df, "record").collect()} == {json.dumps(r) for r in records[7:11]}
    every = canonical_records(df, "record", keep_empty=True)
    assert {r.conv_id for r in every.where("empty").collect()} == {"e1", "2"} and every.where("not empty").count() == canonical_records(df, "record").count()
    back = read_chats(format_chats(every)).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in back} == {
        "x6": [("user", "a"), ("user", "late")], "x7": [("user", "a")], "e1": [], "2": [], "f": [("system", ""), ("", ""), ("user", "b")],
        "t": [("user", "[]"), ("assistant", '[{"a": 1}]')], None: [("user", "row")],
    }
    assert {r.conv_id: r.losses for r in back}["t"] == ['[{"a": 1}]'] and {r.formatted for r in back if r.conv_id in ("e1", "2")} == {""}
    assert format_chats(canonical_records(df.limit(0), "record", keep_empty=True)).collect() == []


def fill(budget, children):
    """[(weight, capacity)] -> shares, by filling round after round."""
    shares, open_ = [0.0] * len(children), {k for k, (w, c) in enumerate(children) if w > 0 and c > 0}
    while open_ and budget > 1e-9:
        w = sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] <= budget * children[k][0] / w}
        if not full:
            for k in open_:
                shares[k] = budget * children[k][0] / w
            break
        for k in full:
            shares[k] = children[k][1]
        budget -= sum(children[k][1] for k in full)
        open_ -= full
    return shares


def test_mixing_matches_brute_force(spark):
    rnd = random.Random(9)
    rows = [(k, " ".join(["w"] * rnd.choice([0, 1, 5, 30, 200])), rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s0", "s0", "s1", "s2", "s3", "s4"])) for k in range(500)]
    rows += [(500, None, "en", "s1"), (3, rows[3][1], rows[3][2], rows[3][3]), (None, "no id here", "en", "s2")]
    weights = {"domain": {"a": 5.0, "b": 1.0}, "lang": {"en": 3.0}, "source": {"s3": 0.0, "s1": 4.0}}
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, source string, mix_copies int")
    domain = F.when(F.col("source") < "s2", "a").otherwise("b")
    got = mix_sources(docs, domain, share=0.7, weights=weights, max_epochs=2, seed=3).collect()
    assert len(got) == len(rows)

    named = [("a" if s < "s2" else "b", lang or "", s, i, t or "") for i, t, lang, s in rows]
    n = lambda t: len(t.split())
    w = lambda depth, name: weights[LEVELS[depth]].get(name, 1.0)
    sums = collections.Counter()
    for d, lang, s, _, t in named:
        sums[d, lang, s] += n(t)
    cap = lambda p: sum(2 * v for k, v in sums.items() if k[: len(p)] == p and all(w(j, x) > 0 for j, x in enumerate(k)))
    level = {(): 0.7 * sum(sums.values())}
    for depth in range(3):
        below = {}
        for p, b in level.items():
            kids = sorted({k[: depth + 1] for k in sums if k[:depth] == p})
            below |= dict(zip(kids, fill(b, [(w(depth, k[-1]), cap(k)) for k in kids])))
        level = below
    want = collections.Counter()
    for leaf, total in sums.items():
        take = int(level[leaf] + 1e-6)
        epochs, left = divmod(take, total) if total else (0, 0)
        own = collections.Counter()
        for d, lang, s, i, t in named:
            if (d, lang, s) == leaf and n(t):
                own[hashlib.md5(t.encode()).hexdigest() if i is None else str(i)] += n(t)
        used = 0
        for _, tag, tokens in sorted((hashlib.md5(f"3|{epochs}|{tag}".encode()).hexdigest(), tag, v) for tag, v in own.items()):
            used += tokens
            want[leaf, tag] = epochs + (used <= left)
    for r in got:
        key = hashlib.md5((r.text or "").encode()).hexdigest() if r.doc_id is None else str(r.doc_id)
        assert r.mix_copies == want[(r.mix_domain, r.lang or "", r.source), key]
    assert mix_sources(docs.limit(0), domain).collect() == []
