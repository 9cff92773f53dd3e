import random
from collections import defaultdict

import pytest

from loomspark.operators import phrases

WORDS = ["heart", "failure", "Heart", "flu", "influenza", "acute", "é", "ACE", "COPD", "12mg", "心", "力", "衰竭", "-", "\n", "x_y"]
NAMES = [("heart failure", "Disease"), ("acute heart failure", "Disease"), ("HEART", "Organ"), ("failure", "Word"), ("failure acute", "Odd"), ("flu", "Disease"), ("心力衰竭", "Disease"), ("心", "Organ"), ("Heart Failure", "Twin"), ("", "None"), (None, "None"), ("é flu", "Odd")]


def texts():
    rnd = random.Random(8)
    made = ["".join(rnd.choice(WORDS) + rnd.choice([" ", " ", "  ", ""]) for _ in range(rnd.randrange(40))) for _ in range(120)]
    return [None, "", "heart failure heart failure", "acute  heart\nfailure acute", "flu" * 3, "心力衰竭心", "heart " * 40_000 + "failure", *made]


def brute_mentions(text):
    tokens = [(m.group().lower(), m.start(), m.end()) for m in phrases.TOKEN.finditer(text or "")]
    index = defaultdict(list)
    for name, kind in NAMES:
        key = tuple(phrases.TOKEN.findall((name or "").lower()))
        if key:
            index[key].append((name, kind))
    out = set()
    for key, entries in index.items():
        for k in range(len(tokens) - len(key) + 1):
            if tuple(w for w, _, _ in tokens[k : k + len(key)]) == key:
                out.add((*min(entries), tokens[k][1], tokens[k + len(key) - 1][2]))
    return out


@pytest.mark.parametrize("few", [200_000, 2])
def test_phrases_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", few)
    every = texts()
    got = defaultdict(list)
    found = phrases.phrase_mentions(spark.createDataFrame(list(enumerate(every)), "id bigint, text string"), spark.createDataFrame(NAMES, "name string, type string"), "id", "text")
    for r in found.collect():
        got[r.id].append((r.name, r.type, r.start, r.end))
    for k, text in enumerate(every):
        assert len(got[k]) == len(set(got[k])) and set(got[k]) == brute_mentions(text), k
    assert phrases.phrase_mentions(spark.createDataFrame([("a", "b")], "id string, text string"), spark.createDataFrame([], "name string, type string"), "id", "text").count() == 0


def brute_entities(mentions):
    """Equal spans once, cross-validation and the greedy choice, by plain loops."""
    by_doc, out = defaultdict(list), set()
    for m in mentions:
        by_doc[m[0]].append(m)
    for doc, rows in by_doc.items():
        seen, groups = {}, defaultdict(list)
        for m in sorted(rows, key=lambda m: (m[7], m[1], m[2], m[6])):
            seen.setdefault((m[3], m[4]), m)
        for m in seen.values():
            groups[m[1].lower(), m[2]].append(m)
        best = []
        for found in groups.values():
            m = min(found, key=lambda m: (-m[5], m[3], m[4], m[1], m[6]))
            more = {2: 0.03, 3: 0.05, 4: 0.08}.get(len({x[6] for x in found}), 0.1) if len(found) > 1 else 0
            best.append((*m[:5], round(min(1.0, m[5] + more), 6), m[6]))
        taken = []
        for m in sorted(best, key=lambda m: (-m[5], m[3], -m[4], m[1], m[2], m[6])):
            if all(m[4] <= t[3] or t[4] <= m[3] for t in taken):
                taken.append(m)
        out |= set(taken)
    return out


def test_entities_equal_brute_force(spark):
    rnd = random.Random(3)
    mentions = []
    for _ in range(1500):
        start = rnd.randrange(400)
        mentions.append((rnd.randrange(6), rnd.choice("abcdefgh") * 3 + rnd.choice(["", "X"]), rnd.choice(["T", "U"]), start, start + rnd.randrange(1, 12), rnd.choice([0.7, 0.75, 0.9, 0.95]), rnd.choice(["p", "q", "r", "s", "t"]), rnd.randrange(3)))
    mentions += [(9, f"n{k}", "T", k, k + 3, 0.7, "p", 0) for k in range(3000)]  # one chain of overlapping spans
    schema = "id int, name string, type string, start int, end int, confidence double, strategy string, place int"
    parts = [spark.createDataFrame([m for m in mentions if m[7] == k], schema).drop("place") for k in range(3)]
    got = [tuple(r) for r in phrases.entities(*parts).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_entities(mentions)
    assert len([m for m in got if m[0] == 9]) == 1000


def test_abbreviations_have_their_full_name(spark):
    found = phrases.abbreviations(spark.createDataFrame([(1, "xACE ACE, ACE and COPD"), (2, None)], "id int, text string"), spark.createDataFrame([("ACE", "enzyme", "Drug")], "abbr string, name string, type string"), "id", "text")
    assert [tuple(r) for r in found.select("id", "name", "start", "end").collect()] == [(1, "enzyme", 1, 4)]
