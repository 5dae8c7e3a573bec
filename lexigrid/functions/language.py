"""Language votes over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import CJK, THAI, _c

LANGUAGES = ("zh", "th", "en")
ENGLISH_WORD = r"[A-Za-z]+(?:['-][A-Za-z]+)*"
PAGE_CHINESE = r"㐀-䶿一-鿿豈-﫿"


def _vote(th: Column, zh: Column, en: Column, nothing: str) -> Column:
    """Ties go to Thai, then Chinese, then English."""
    most = F.greatest(th, zh, en)
    return F.when(most == 0, nothing).when(th == most, "th").when(zh == most, "zh").otherwise("en")


def detect_language(x) -> Column:
    """Thai characters against Chinese characters against English words; English if there is nothing."""
    x = _c(x)
    counts = [F.regexp_count(x, F.lit(p)) for p in (f"[{THAI}]", f"[{CJK}]", ENGLISH_WORD)]
    return _vote(*counts, "en")


def page_language(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, language): a vote by characters over all lines of a page; ``auto`` if there is nothing."""
    counts = [
        F.sum(F.regexp_count(F.col(text), F.lit(p))).alias(n)
        for n, p in (("th", f"[{THAI}]"), ("zh", f"[{PAGE_CHINESE}]"), ("en", "[A-Za-z]"))
    ]
    votes = lines.groupBy(*keys).agg(*counts)
    return votes.select(*keys, _vote(F.coalesce("th", F.lit(0)), F.coalesce("zh", F.lit(0)), F.coalesce("en", F.lit(0)), "auto").alias("language"))


def valid_direction(source, target) -> Column:
    """A known pair of different languages; the source may be ``auto``."""
    s, t = _c(source), _c(target)
    return s.isin("auto", *LANGUAGES) & t.isin(*LANGUAGES) & (s != t)
