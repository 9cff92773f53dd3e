import random
import re

import pytest

from loomspark.llm import queries
from loomspark.llm.licenses import BASE, CLAIMS, EXCEPTIONS, NOTICES, evaluate, family, phrase_automaton, scan, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    """(words, base places, base labels, labels of notices) by comparing words at every place."""
    words, starts, base, labels = WORD.findall((text or "").translate(LOWER)), [], set(), set()
    for phrases, is_base in ((BASE, True), (NOTICES, False)):
        for phrase, label in phrases.items():
            p = phrase.split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            labels |= {label} if at else set()
            if is_base:
                starts += at
                base |= {label} if at else set()
    return len(words), starts, ",".join(sorted(base)), ",".join(sorted(labels))


TEXTS = [
    None, "", "   ", "CC-BY", "cc by cc by", "cc  by.nc", "CCBY", "cc\nBY", "ccé by", "General Public\tLicense; general public license", "All rights reserved. All Rights Reserved", "x" * 100_000 + " cc by", "cc by " * 5000,
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Tous droits réservés", "generally public license", "lesser general public license", "cc0", "公 cc by 公",
]


def test_places_equal_brute_force(spark, tmp_path):
    rnd = random.Random(13)
    pool = sorted({w for p in [*BASE, *NOTICES] for w in p.split()}) + ["CC", "By", "xyz", "é"]
    every = TEXTS + ["".join(rnd.choice(pool) + rnd.choice([" ", "-", "\n", ", ", ""]) for _ in range(rnd.randrange(400))) for _ in range(60)]
    every += [" ".join(rnd.choices([*BASE, *NOTICES, "and", "z"], k=20)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(every)), "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_license_scans(spark, str(tmp_path)).collect()}
    assert len(got) == len(every)
    for k, text in enumerate(every):
        n, starts, base, labels = brute(text)
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (n, len(starts), min(starts, default=None), max(starts, default=None), base, labels), text
        assert 0 <= r.score <= 1 and (r.score == 0) <= (not set(labels.split(",")) - {"", "cc0", "public-domain", "unlicense"})


@pytest.mark.parametrize("expression,claim,labels", [
    ("MIT", 0.2, {"mit"}), ("MIT OR GPL-3.0-only", 0.2, {"mit", "gpl"}), ("MIT AND GPL-3.0-only", 0.6, {"mit", "gpl"}),
    ("MIT OR Apache-2.0 AND GPL-2.0+", 0.2, {"mit", "apache", "gpl"}), ("( MIT OR Apache-2.0 ) AND GPL-2.0+", 0.6, {"mit", "apache", "gpl"}),
    ("GPL-2.0-only WITH Classpath-exception-2.0", 0.5, {"gpl"}), ("GPL-2.0 WITH x AND AGPL-3.0", 0.7, {"gpl", "agpl"}), ("MIT AND", 0.2, {"mit"}), ("( MIT OR ( GPL-3.0", 0.2, {"mit", "gpl"}),
    ("MIT ) AND GPL-3.0", 0.2, {"mit"}), ("MIT MIT GPL-3.0", 0.2, {"mit"}), ("CC-BY-NC-SA-4.0 and made-up", 0.8, {"cc-by-nc-sa", "other"}), ("MIT OR ( ", 0.2, {"mit"}),
])
def test_expressions(expression, claim, labels):
    said = evaluate(iter(expression.split()))
    assert said[:2] == (labels, claim)


def test_no_expression():
    assert evaluate(iter([])) is None and evaluate(iter(["and", "MIT"])) is None and evaluate(iter([")"])) is None


def test_random_expressions_equal_a_recursive_parser():
    rnd = random.Random(5)
    names = ["MIT", "GPL-3.0", "AGPL-3.0", "CC-BY-4.0", "CC0-1.0"]

    def make(depth):
        kind = rnd.choice(["id", "or", "and", "with"]) if depth else "id"
        if kind in ("id", "with"):
            name = rnd.choice(names)
            claim = CLAIMS[family(name)]
            return ([name, "WITH", "Some-exception"], max(0, round(claim - 0.1, 6)), 3) if kind == "with" else ([name], claim, 3)
        rank, pick = (1, min) if kind == "or" else (2, max)
        sides = [make(depth - 1), make(depth - 1)]
        parts = [p if r >= rank else ["(", *p, ")"] for p, _, r in sides]
        return [*parts[0], kind, *parts[1]], pick(sides[0][1], sides[1][1]), rank

    for _ in range(300):
        parts, claim, _ = make(4)
        assert evaluate(iter(parts))[1] == claim and evaluate(iter(parts))[2] == len(parts)


def told(text):
    n, starts, base, labels, score, spans = scan(text.encode(), phrase_automaton())
    return labels, score


def test_tags_and_joined_notices():
    assert told("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND ISC */\nnext MIT License") == ({"mit", "gpl", "isc"}, 0.2)
    assert told("# SPDX-License-Identifier: MIT OR CC-BY-NC-4.0") == ({"mit", "cc-by-nc", "cc-by"}, 0.2)  # the phrase's own label stays, its claim is the expression's
    assert told("SPDX-License-Identifier:\nGPL-3.0") == (set(), 0.0)
    assert told("License-Expression: Foo-1.0") == ({"other"}, 0.5)
    assert told("under the MIT License or the GNU General Public License, version 2") == ({"mit", "gpl"}, 0.2)
    assert told("under the MIT License. See also the GNU General Public License") == ({"mit", "gpl"}, 0.6)
    assert told("GNU General Public License with the classpath exception") == ({"gpl"}, 0.5)
    assert told("CC BY-NC-SA") == ({"cc-by", "cc-by-nc", "cc-by-nc-sa"}, 0.8) and told("nothing here") == (set(), 0.0)
    assert len(EXCEPTIONS) and told("SPDX-License-Identifier: MIT") == ({"mit"}, 0.2)


def test_columns_spans_and_no_rows(spark):
    df = spark.createDataFrame([("a", "by cc by", 1, None), ("a", "by cc by", 1, None)], "TEXT2 string, text string, Score int, c0 string")
    out = scan_licenses(df)
    assert out.columns == ["TEXT2", "text", "c0", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    rows = out.collect()
    assert len(rows) == 2 and [tuple(s) for s in rows[0].spans] == [(1, 2, "cc-by")]
    assert scan_licenses(df.limit(0)).count() == 0
