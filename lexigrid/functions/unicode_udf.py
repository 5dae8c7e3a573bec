"""Text functions beyond Spark's own, as vectorized UDFs."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

# The Latin spelling of each Thai sign; signs without a sound have none.
ROMAN = {
    "ก": "k", "ข": "kh", "ฃ": "kh", "ค": "kh", "ฅ": "kh", "ฆ": "kh", "ง": "ng", "จ": "ch", "ฉ": "ch", "ช": "ch",
    "ซ": "s", "ฌ": "ch", "ญ": "y", "ฎ": "d", "ฏ": "t", "ฐ": "th", "ฑ": "th", "ฒ": "th", "ณ": "n", "ด": "d",
    "ต": "t", "ถ": "th", "ท": "th", "ธ": "th", "น": "n", "บ": "b", "ป": "p", "ผ": "ph", "ฝ": "f", "พ": "ph",
    "ฟ": "f", "ภ": "ph", "ม": "m", "ย": "y", "ร": "r", "ฤ": "rue", "ล": "l", "ฦ": "lue", "ว": "w", "ศ": "s",
    "ษ": "s", "ส": "s", "ห": "h", "ฬ": "l", "อ": "o", "ฮ": "h", "ฯ": ".", "ะ": "a", "ั": "a", "า": "a",
    "ำ": "am", "ิ": "i", "ี": "i", "ึ": "ue", "ื": "ue", "ุ": "u", "ู": "u", "ฺ": "", "฿": "THB", "เ": "e",
    "แ": "ae", "โ": "o", "ใ": "ai", "ไ": "ai", "ๅ": "a", "ๆ": "", "็": "", "่": "", "้": "", "๊": "", "๋": "",
    "์": "", "ํ": "", "๎": "", "๏": ".", "๚": ";", "๛": ".",
}
_THAI_RUN = re.compile("[฀-๿]+")


def exact_key(text: str | None) -> str | None:
    if text is None:
        return None
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).strip().casefold())


def roman(text: str | None) -> str | None:
    """Thai left in a text, spelled out; one sounded sign on its own in capitals."""

    def spell(m: re.Match) -> str:
        run = m[0]
        out = "".join(ROMAN.get(c, f"TH{ord(c):04X}") for c in run)
        alone = len(run) == 1 and bool(ROMAN.get(run))
        return out.upper() if alone else out or "TH"

    return None if text is None else _THAI_RUN.sub(spell, text)


def ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


def reading_similarity(a: str | None, b: str | None) -> float:
    """Of the consonants of two readings: the ratio of lengths if one holds the other, else that of matching blocks."""
    x, y = ("".join(c for c in s or "" if "ก" <= c <= "ฮ") for s in (a, b))
    if not x or not y:
        return 0.0
    return min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else ratio(x, y)


def thai_key_of(text: str | None, ignore_marks: bool = False) -> str:
    own = (c for c in unicodedata.normalize("NFC", text or "") if "฀" <= c <= "๿")
    return "".join(c for c in own if not (ignore_marks and unicodedata.category(c) in ("Mn", "Me")))


def decoded(content: bytes | None) -> str | None:
    """The first of UTF-8, with or without a mark, and GB18030 that reads; null if none does."""
    for code in ("utf-8-sig", "utf-8", "gb18030"):
        try:
            return None if content is None else bytes(content).decode(code)
        except UnicodeDecodeError:
            continue
    return None


def glossary_key_exact(x):
    return _udf(exact_key, "string")(x)


def _udf(f, kind: str):
    """A vectorized UDF of one or two columns from a plain function."""
    if f.__code__.co_argcount >= 2:

        @F.pandas_udf(kind)
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)])

        return two

    @F.pandas_udf(kind)
    def one(a: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in a], dtype=object)

    return one


def romanize(x):
    return _udf(roman, "string")(x)


def similarity(a, b):
    return _udf(ratio, "double")(a, b)


def thai_similarity(a, b):
    return _udf(reading_similarity, "double")(a, b)


def thai_key(x, ignore_marks: bool = False):
    def key(text):
        return thai_key_of(text, ignore_marks)

    return _udf(key, "string")(x)


def decode_text(x):
    return _udf(decoded, "string")(x)
