"""String columns: normalization, keys, number checks, character classes.  All JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, code point ranges and patterns that results must agree with.
THAI_DIGITS, DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
THAI, CONSONANT, CJK = r"฀-๿", r"ก-ฮ", r"㐀-鿿"
SPACE_ENTITY = r"(?i)(?:&#x0*20;|&#0*32;|&nbsp;)"
PAGE_MARKER = r"(?U)【第\s*\d+\s*页】"
NUMBER = r"(?U)(\d+(?:[.,]\d+)*%?)"
# ASCII, Latin-1 letters but the sharp s, common CJK, and Thai but the vowel that normalization takes apart, end to end
PLAIN_KEY = r"^[\x00-\x1B\x20-\x7FÀ-ÖØ-Þà-öø-ÿ一-鿿ก-าิ-ฺเ-๛]*+\z"
BULLET = r"^[❖◆◇•●▪▫◊✓✔☑➢➤►]"
TIMED_STEP = rf"(?U)^\(\s*\d+\s+[A-Za-z{THAI}{CJK}]+\s*\)"
MISSING_NUMBERS, TOO_SHORT = "请复核数字：译文中未找到 ", "译文长度明显偏短，可能存在漏译"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def collapse(x) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(_c(x), r"(?U)\s+", " ")


def squeeze(x) -> Column:
    """Without white space."""
    return F.regexp_replace(_c(x), r"(?U)\s+", "")


def glossary_key(x) -> Column:
    """Key of a term: compatibility-normalized, trimmed, case-folded, spaces collapsed.

    Text of characters that neither normalization nor folding changes beyond lower case stays in the JVM; only other
    text goes to the vectorized function.
    """
    own = _c(x)
    plain = own.rlike(PLAIN_KEY)
    return F.when(plain, collapse(F.lower(strip(own)))).otherwise(_exact_key(F.when(~plain, own)))


def _exact_key(x) -> Column:
    from lexigrid.functions.unicode_udf import glossary_key_exact

    return glossary_key_exact(x)


def translation_text(x) -> Column:
    """Space entities as spaces, Thai digits as ASCII digits."""
    return F.translate(F.regexp_replace(_c(x), SPACE_ENTITY, " "), THAI_DIGITS, DIGITS)


def without_markers(x) -> Column:
    return F.regexp_replace(_c(x), PAGE_MARKER, "")


def numeric_key(x) -> Column:
    """One key for the notations of a number: no commas, no percent sign, no trailing zeros; else the raw string."""
    raw = F.regexp_replace(F.replace(_c(x), F.lit(","), F.lit("")), "%$", "")
    value = F.regexp_replace(F.regexp_replace(raw, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1")
    value = F.regexp_replace(value, r"\.$", "")
    return F.when(raw.rlike(r"^\d+(\.\d+)?$"), value).otherwise(raw)


def numbers(x) -> Column:
    """The numbers of a text, in order, after normalization."""
    return F.regexp_extract_all(without_markers(translation_text(x)), F.lit(NUMBER), 1)


def missing_numbers(source, translated) -> Column:
    """Numbers of the source, first seen first, whose key the translation lacks."""
    keys = F.transform(numbers(translated), numeric_key)
    return F.filter(F.array_distinct(numbers(source)), lambda v: ~F.array_contains(keys, numeric_key(v)))


def is_short(source, translated) -> Column:
    n = F.char_length(strip(source))
    return (n > 80) & (F.char_length(strip(translated)) < n * F.lit(0.15))


def quality_warnings(source, translated) -> Column:
    """The warnings about a translation: numbers not found (five shown), and a text that is too short."""
    missing = missing_numbers(source, translated)
    numbers_ = F.concat(F.lit(MISSING_NUMBERS), F.array_join(F.slice(missing, 1, 5), ", "))
    both = F.array(F.when(F.size(missing) > 0, numbers_), F.when(is_short(source, translated), F.lit(TOO_SHORT)))
    return F.array_compact(both)


def has_thai(x) -> Column:
    return _c(x).rlike(f"[{THAI}]")


def consonants(x) -> Column:
    return F.regexp_replace(_c(x), f"[^{CONSONANT}]", "")


def ocr_match_key(x) -> Column:
    return F.lower(F.regexp_replace(_c(x), f"[^A-Za-z0-9{THAI}]+", ""))


def layout_key(x) -> Column:
    return F.regexp_replace(F.lower(_c(x)), rf"[^0-9A-Za-z㐀-鿿{THAI}]+", "")


def bilingual_key(x) -> Column:
    return F.lower(F.regexp_replace(_c(x), r"(?U)[\s　，。,:：;；()（）\[\]]+", ""))


def join_thai_gaps(x) -> Column:
    """Spaces collapsed, and dropped between two Thai characters."""
    return F.regexp_replace(strip(collapse(x)), rf"(?<=[{THAI}])\s+(?=[{THAI}])", "")


def repair_outline(x) -> Column:
    """Four repairs of outline text, in this order: a Thai letter for W, O for 0, L for a Thai letter, a stray title."""
    out = F.regexp_replace(strip(x), rf"^พ(?=\d{{1,2}}(?:\s|[{THAI}]))", "W")
    out = F.regexp_replace(out, rf"^WO(?=\s+[{THAI}])", "W0")
    out = F.regexp_replace(out, rf"(?<=[{THAI}])L$", "ม")
    title = r"(?i)(?:E(?:LE)?CTRICAL|MECHANICAL|CIVIL|STRUCTURAL)\s+ENGINEERS?\s*$"
    return F.regexp_replace(F.regexp_replace(out, title, ""), r"(?U)\s+$", "")


def outline_key(x) -> Column:
    return F.lower(squeeze(x))


def drawing_code(x) -> Column:
    """struct<code, rest> of a drawing label; null where there is no code."""
    pattern = rf"^\s*([A-Za-z]{{1,4}}\d*\s*[-–—]\s*\d+(?:\s*[-–—]\s*\d+)?)(?:\s+|(?=[{CJK}]))(.+?)\s*$"
    x = _c(x)
    found = F.struct(strip(F.regexp_extract(x, pattern, 1)).alias("code"), strip(F.regexp_extract(x, pattern, 2)).alias("rest"))
    return F.when(x.rlike(pattern), found)


def grapheme_count(x) -> Column:
    """Clusters of a text but for white space."""
    x = _c(x)
    return F.regexp_count(x, F.lit(r"\X")) - F.regexp_count(x, F.lit(r"(?U)\r\n|\s"))


def separate_list_items(a, b) -> Column:
    """Both start with a bullet, or both with a timed step."""
    a, b = F.ltrim(_c(a)), F.ltrim(_c(b))
    return (a.rlike(BULLET) & b.rlike(BULLET)) | (a.rlike(TIMED_STEP) & b.rlike(TIMED_STEP))


def is_translatable(x) -> Column:
    v = squeeze(x)
    letters = F.regexp_count(v, F.lit(f"[A-Za-z{THAI}]"))
    return v.rlike(rf"[A-Za-z{THAI}一-鿿]") & (v.rlike(r"[一-鿿]") | (letters >= 2))


def needs_replacement(source, translated, collapse_only: bool = True) -> Column:
    """A translation that isn't blank and differs from its source, spaces collapsed or, else, deleted."""
    norm = (lambda v: strip(collapse(v))) if collapse_only else squeeze
    s, t = norm(F.coalesce(_c(source), F.lit(""))), norm(F.coalesce(_c(translated), F.lit("")))
    return (t != "") & (s != t)


def visual_cache_key(fingerprint, hint, confidence) -> Column:
    """``hex64:hint`` where the fingerprint is one, the hint holds Thai and the confidence is 40 or more; else null."""
    mark, said = F.lower(strip(fingerprint)), strip(collapse(hint))
    ok = mark.rlike("^[0-9a-f]{64}$") & has_thai(said) & (_c(confidence) >= 40)
    return F.when(ok, F.concat_ws(":", mark, said))


def base_name(x) -> Column:
    return F.regexp_extract(_c(x), r"([^/\\]*)[/\\]*$", 1)


def suffix(x) -> Column:
    """Lower-cased file suffix with its dot, empty without one."""
    return F.lower(F.regexp_extract(base_name(x), r"[^.](\.[^.]+)$", 1))


def stem(x) -> Column:
    return F.regexp_replace(base_name(x), r"(?<=[^.])\.[^.]+$", "")


def archive_suffix(x) -> Column:
    """The suffix under which a source is archived."""
    return F.when(suffix(x).rlike(r"^\.[a-z0-9]{1,10}$"), suffix(x)).otherwise(".bin")


def is_client_id(x) -> Column:
    return F.lower(_c(x)).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def cell_text(x) -> Column:
    """A spreadsheet cell as text: null is empty, true and false lower-case, whole floats as integers."""
    s = strip(F.coalesce(_c(x).cast("string"), F.lit("")))
    return F.when(s.rlike(r"^-?\d+\.0$"), F.regexp_replace(s, r"\.0$", "")).otherwise(s)


def preferred(revised, translated) -> Column:
    return F.coalesce(F.nullif(strip(revised), F.lit("")), strip(translated))


def txt_download(x) -> Column:
    return F.concat(F.lit("﻿"), strip(x), F.lit("\n"))


def context_instructions(context) -> Column:
    """The context block of a request; empty without a context."""
    c = strip(F.coalesce(_c(context), F.lit("")))
    return F.when(c == "", "").otherwise(F.concat(F.lit("\n\n"), c))


def split_columns(x) -> Column:
    """The cells of a line set apart by two spaces or more."""
    return F.split(strip(x), r"(?U)\s{2,}")
