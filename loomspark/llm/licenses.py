"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates AND, OR and WITH.

Phrases are matched word by word: a text becomes its lower-cased words with single spaces, and each phrase is looked for with
a space at both ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm.common import Columns

#: Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: How much a licence asks of those who use the text: 0 nothing, 1 that they don't.
CLAIMS = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.0, "mit": 0.2, "isc": 0.2, "bsd": 0.2, "zlib": 0.2, "boost": 0.2, "python": 0.2, "apache": 0.2, "cc-by": 0.3, "artistic": 0.3,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.4, "cc-by-sa": 0.5, "other": 0.5, "gpl": 0.6, "gfdl": 0.6, "agpl": 0.7, "cc-by-nc": 0.8, "cc-by-nc-sa": 0.8, "cc-by-nd": 0.9, "cc-by-nc-nd": 0.9, "proprietary": 1.0, "reserved": 1.0,
}
#: What an exception (WITH) takes off its licence's claim.
RELIEF = 0.1
#: Notice phrases of the method's own. One inside a longer one at the same place doesn't count towards the score.
NOTICES = {
    "mit license": "mit", "mit licence": "mit", "permission is hereby granted free of charge": "mit", "isc license": "isc", "zlib license": "zlib", "boost software license": "boost", "python software foundation license": "python",
    "bsd license": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "redistribution and use in source and binary forms": "bsd",
    "apache license": "apache", "artistic license": "artistic", "mozilla public license": "mpl", "eclipse public license": "epl", "gnu general public license": "gpl", "gnu gpl": "gpl",
    "lesser general public license": "lgpl", "library general public license": "lgpl", "gnu lgpl": "lgpl", "affero general public license": "agpl", "gnu agpl": "agpl", "free documentation license": "gfdl",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "cc0": "cc0", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "attribution sharealike": "cc-by-sa", "attribution noncommercial": "cc-by-nc", "attribution noderivatives": "cc-by-nd", "attribution noncommercial sharealike": "cc-by-nc-sa", "attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "public domain": "public-domain", "free and unencumbered software": "unlicense", "proprietary and confidential": "proprietary", "no part of this publication may be reproduced": "reserved", "tous droits réservés": "reserved", "alle rechte vorbehalten": "reserved", "todos los derechos reservados": "reserved",
}
#: Phrases of the exceptions that WITH may add to a licence.
EXCEPTIONS = ("classpath exception", "linking exception", "runtime library exception", "font exception", "autoconf exception", "bison exception", "llvm exception")
#: Tags after which an expression of identifiers stands on the same line.
TAGS = ("spdx license identifier", "license expression")
#: Identifiers that don't begin with their label.
IDENTIFIERS = {"bsl": "boost", "psf": "python", "zlib-acknowledgement": "zlib", "pddl": "public-domain"}
#: Two notices with at most this many words between them, one of which joins them, are one expression.
GAP = 6

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KEPT = bytes(k + 32 if 0x41 <= k <= 0x5A else k if 0x30 <= k <= 0x39 or 0x61 <= k <= 0x7A or k >= 0x80 else 0x20 for k in range(256))
_LOWER = bytes(k + 32 if 0x41 <= k <= 0x5A else k for k in range(256))
_PART = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of a licence identifier: the longest label that it begins with, part by part; ``other`` if there is none."""
    parts = identifier.lower().rstrip("+").split("-")
    for n in range(len(parts), 0, -1):
        name = "-".join(parts[:n])
        if name in CLAIMS or name in IDENTIFIERS:
            return IDENTIFIERS.get(name, name)
    return "other"


def evaluate(parts: Iterator[str]) -> tuple[set[str], float, int] | None:
    """(labels, claim, parts read) of an expression of identifiers, AND, OR, WITH and parentheses; None if it has no operand.

    Shunting-yard: operands go to one stack, operators wait on another until one that binds no closer comes. Who may choose
    (OR) takes the lesser claim, who must heed both (AND) the greater, an exception (WITH) takes RELIEF off. Reading ends
    before the first part that can't follow; an operator without a right side is left out, open parentheses are closed.
    """
    values: list[tuple[set[str], float]] = []
    waiting: list[str] = []
    operand, done = False, 0  # whether the last part was an operand, parts of the whole expression so far

    def apply() -> None:
        op, (right, y), (left, x) = waiting.pop(), values.pop(), values.pop()
        values.append((left, max(0.0, round(x - RELIEF, 6))) if op == "with" else (left | right, min(x, y) if op == "or" else max(x, y)))

    read = 0
    for part in parts:
        low = part.lower()
        if part == "(":
            if operand or waiting[-1:] == ["with"]:
                break
            waiting.append(part)
        elif part == ")":
            if not operand or "(" not in waiting:
                break
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        elif low in _BINDS:
            if not operand:
                break
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                apply()
            waiting.append(low)
            operand = False
        else:
            if operand:
                break
            label = family(part)
            values.append(({label}, CLAIMS[label]))
            operand = True
        read += 1
        done = read if operand else done
    if not values:
        return None
    if not operand:
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    while waiting:
        if waiting[-1] == "(":
            waiting.pop()
        else:
            apply()
    return values[-1][0], values[-1][1], done


def phrase_automaton(base: dict[str, str] = BASE) -> ahocorasick.Automaton:
    """Every phrase with a space at both ends, as its UTF-8's bytes: (words, base label or None, notice label or None, kind)."""
    phrases: dict[str, list] = {}
    for phrase, label in base.items():
        phrases[phrase] = [label, label, "notice"]
    for phrase, label in NOTICES.items():
        phrases.setdefault(phrase, [None, label, "notice"])
    for kind, more in (("exception", EXCEPTIONS), ("tag", TAGS)):
        for phrase in more:
            phrases.setdefault(phrase, [None, None, kind])
    out = ahocorasick.Automaton()
    for phrase, found in phrases.items():
        out.add_word(f" {phrase} ".encode().decode("latin-1"), (phrase.count(" ") + 1, *found))
    out.make_automaton()
    return out


def _after_tag(raw: bytes, word: int, words: int) -> tuple[tuple[set[str], float] | None, int]:
    """What the expression after a tag's last word says, and how many words it has."""
    place = next(islice(_WORD.finditer(raw.translate(_LOWER)), word + words - 1, None)).end()
    line = raw[place : (raw + b"\n").index(b"\n", place)]
    begin = re.match(rb"[ \t\"']*[:=]?[ \t\"']*", line).end()
    ends: list[int] = []

    def parts() -> Iterator[str]:
        at = begin
        while found := _PART.match(line, at):
            at = found.end()
            ends.append(at)
            yield found.group(1).decode("latin-1")

    said = evaluate(parts())
    if said is None:
        return None, 0
    return said[:2], len(_WORD.findall(line[begin : ends[said[2] - 1]].translate(_LOWER)))


def scan(raw: bytes, automaton: ahocorasick.Automaton) -> tuple[int, list[int], set[str], set[str], float, list[tuple[int, int, str]]]:
    """(words, starts of the base phrases, base labels, labels, score, spans as (start, words, label)) of one text."""
    words = raw.translate(_KEPT).split()
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    starts, labels, base_labels, spans, hits = [], set(), set(), [], []
    seen = at = 0
    for end, (size, base, label, kind) in automaton.iter(text):
        seen, at = seen + text.count(" ", at, end + 1), end + 1  # spaces up to the end of this phrase
        start = seen - 1 - size
        if base:
            starts.append(start)
            base_labels.add(base)
        if label:
            labels.add(label)
            spans.append((start, size, label))
        hits.append((start, size, label, kind))
    if not hits:
        return len(words), starts, base_labels, labels, 0.0, spans
    claim, covered = 0.0, -1
    run: list[str] = []
    hits.sort(key=lambda h: (h[0], -h[1]))
    for start, size, label, kind in hits:
        if start + size <= covered:
            continue  # inside a longer phrase, or inside an expression after a tag
        gap = words[max(covered, 0) : start] if covered >= 0 and 0 < start - covered <= GAP else []
        covered = max(covered, start + size)
        if kind == "tag":
            said, size_said = _after_tag(raw, start, size)
            if said:
                labels |= said[0]
                claim = max(claim, said[1])
                spans += [(start, size + size_said, x) for x in sorted(said[0])]
                covered = start + size + size_said
            continue
        joined = next((w.decode() for w in gap if w in (b"or", b"and", b"with")), None)
        if kind == "exception":
            run += ["with", "exception"] if joined == "with" and run else []
            continue
        if run and joined in ("or", "and"):
            run += [joined, label]
        else:
            claim = max(claim, evaluate(iter(run))[1]) if run else claim
            run = [label]
    return len(words), starts, base_labels, labels, max(claim, evaluate(iter(run))[1]) if run else claim, spans


def _scanned(text_at: int, names: list[str], base: dict[str, str]):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = phrase_automaton(base)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for raw in part.column(text_at).cast(pa.large_binary()).to_pylist():
                    n, starts, base_labels, labels, score, spans = scan(raw or b"", automaton)
                    said = [{"start": s, "words": w, "label": x} for s, w, x in sorted(spans)]
                    rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, said))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names)

    return run


def scan_licenses(docs: DataFrame, text_col: str = "text", base: dict[str, str] = BASE) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII, numbered from 0. n_base counts the
    places where the words of a phrase of ``base`` stand one after the other, overlapping ones too; first_word and last_word are the least
    and greatest of their starts, null without one. labels has base_labels and what NOTICES and the expressions after TAGS
    say, both sorted and joined by commas; spans are the places of all of them. score is the greatest claim (CLAIMS) of the
    text's statements, 0 without any: notices joined by a word or, and, with, and expressions after tags, are evaluated as
    expressions. A null or empty text has no words and ''. Columns named as the new ones, in any case, are replaced, others
    carried along under any name; repeated rows stay. An empty table gives an empty one. Texts are read whole, one at a time.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    own = Columns(docs, new)
    fields = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<start: bigint, words: bigint, label: string>>"
    return own.back(own.df.mapInArrow(_scanned(own.own.index(own.at(text_col)), [*own.own, *new], base), own.fields(fields)))
