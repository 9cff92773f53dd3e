"""Texts of bytes whose encoding isn't told: UTF-8, UTF-16, UTF-32, GB18030 or Latin-1, found from all bytes of a file."""

from __future__ import annotations

import codecs
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: High bytes of UTF-16 units in the texts meant: Latin, CJK punctuation, Han, full-width forms.
_HIGH = np.zeros(256, bool)
_HIGH[[0x00, 0x20, 0x30, 0xFF, *range(0x4E, 0xA0)]] = True
#: Bytes of Latin words, and control bytes, which no text in Latin-1 or Windows-1252 holds.
_WORDS, _CONTROLS = np.zeros(256, bool), np.zeros(256, bool)
_WORDS[[*b" .,", *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CONTROLS[[c for c in range(0x20) if c not in b"\t\n\r"] + [0x7F]] = True


def _wide(data: bytes, zeros: bool) -> str | None:
    """UTF-16 without a mark: half of one byte of the units are zeros and fewer of the other; or, in eight units or more, nearly all of one are high bytes and the other isn't, nor one of Latin words or spaces without any control byte."""
    if len(data) < 2 or len(data) % 2:
        return None
    halves = np.frombuffer(data, np.uint8).reshape(-1, 2)
    zero, high, words = (halves == 0).mean(0), _HIGH[halves].mean(0), _WORDS[halves].mean(0)
    spaced, latin = 12 * data.count(b" ") >= len(data), not _CONTROLS[halves].any()
    for at, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        if zero[at] >= 0.5 > zero[1 - at] if zeros else len(halves) >= 8 and high[at] >= 0.9 and high[1 - at] <= 0.7 and not (latin and (spaced or words[1 - at] >= 0.5)):
            return name
    return None


def _common_han(text: str) -> float:
    """The share of a text's characters beyond ASCII that are symbols or frequent characters of GB 2312 (rows 1 to 9 and 16 to 55)."""
    beyond = "".join(c for c in text if c > "\x7f")
    rows = np.frombuffer(beyond.encode("gb2312", "ignore"), np.uint8)[::2]
    return float(((rows >= 0xA1) & (rows <= 0xA9) | (rows >= 0xB0) & (rows <= 0xD7)).sum()) / max(len(beyond), 1)


def _han_run(text: str) -> bool:
    """Whether characters beyond ASCII stand together anywhere, or there are no Latin letters: one alone among letters is rather two accented ones."""
    return bool(re.search("[^\x00-\x7f]{2}", text)) or not re.search("[A-Za-z]", text)


_UPPER, _LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
#: A word with accents as Latin texts have it: in lower case but for its first letter, or in capitals with plain ones among them, or of two capitals.
_CASED = re.compile(f"[{_UPPER}]?[{_LOWER}]+|[{_UPPER}]*[A-Z][{_UPPER}]*|[{_UPPER}]{{1,2}}")


def _latin_words(data: bytes) -> bool:
    """Whether the bytes make a Latin-1 text: with a plain mark or letter, no accents but in words of usual case, and no digit touching these. Bytes of Han rarely do beyond single characters, as the rows of their first bytes are capitals."""
    text = data.decode("latin-1")
    words = re.findall(f"[0-9\x80-\xff{_UPPER}{_LOWER}]+", text)
    return bool(re.search("[!-/:-~]", text)) and all(_CASED.fullmatch(w) for w in words if not w.isascii())


def decode(data: bytes) -> tuple[str, str]:
    """(encoding, text). Bytes that fit none of the others are Latin-1 (Windows-1252 if all of 80 to 9F in them are its own), so no file is lost."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, data.decode(name, "replace")
    for name in (_wide(data, True), "utf-8", "gb18030", _wide(data, False)):
        if name is None:
            continue
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if name != "gb18030" or _common_han(text) >= 0.6 and _han_run(text) and not _latin_words(data):
            return name, text
    if any(0x80 <= b < 0xA0 for b in data):
        try:
            return "cp1252", data.decode("cp1252")
        except UnicodeDecodeError:
            pass
    return "latin-1", data.decode("latin-1")


@F.pandas_udf(StructType().add("encoding", StringType()).add("text", StringType()))
def decoded(content: pd.Series) -> pd.DataFrame:
    """struct(encoding, text) of a binary column; null fields for null, an empty text in UTF-8 for no bytes."""
    return pd.DataFrame([(None, None) if data is None else decode(bytes(data)) for data in content], columns=["encoding", "text"])
