"""A three-language glossary keyed by its Thai text: imports, upserts, directional entries, lookups, context blocks.

Items are (thai_normalized, thai_text, chinese_text, english_text, source_filename, created_seq, updated_seq); writes
carry a ``seq`` that gives their order.  Entries are (source_language, target_language, source_text, translated_text,
source_normalized, translation_normalized, thai_normalized, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.language import LANGUAGES
from lexigrid.functions.text import glossary_key, strip

MATCH_LIMIT, LIST_LIMIT, CONTEXT_CHARACTERS = 40, 60, 4000
MAX_ROWS, MAX_SOURCE, MAX_TRANSLATION = 10_000, 2_000, 5_000
CONTEXT_HEAD = "知识库中已有以下对应译法。仅在原文出现对应词语时优先采用：\n"
#: A glossary side of more bytes than this is not broadcast.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, *columns: str) -> DataFrame:
    """Broadcast, if its own text columns together are small; else as it is, for a shuffled join."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(64))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def directional_row_is_valid() -> Column:
    """Of an imported row: two different known languages, one of them Thai, and texts of allowed length."""
    s, t = F.lower(strip("source_language")), F.lower(strip("target_language"))
    a, b = F.char_length(strip("source_text")), F.char_length(strip("translated_text"))
    ok = s.isin(*LANGUAGES) & t.isin(*LANGUAGES) & (s != t) & ((s == "th") | (t == "th"))
    return F.coalesce(ok & a.between(1, MAX_SOURCE) & b.between(1, MAX_TRANSLATION), F.lit(False))


def multilingual_row_is_valid() -> Column:
    """Of a row th, zh, en: a Thai text and at least one translation, of allowed length."""
    th, zh, en = (F.char_length(strip(F.coalesce(F.col(c), F.lit("")))) for c in ("th", "zh", "en"))
    return th.between(1, MAX_SOURCE) & ((zh > 0) | (en > 0)) & (zh <= MAX_TRANSLATION) & (en <= MAX_TRANSLATION)


def to_multilingual(rows: DataFrame) -> DataFrame:
    """Directional rows that touch Thai as (th, zh, en, seq, source_filename)."""
    own = lambda lang: F.when(F.col("source_language") == lang, strip("source_text")).when(
        F.col("target_language") == lang, strip("translated_text")
    )
    touched = rows.where("source_language = 'th' or target_language = 'th'")
    return touched.select(*(own(x).alias(x) for x in ("th", "zh", "en")), "seq", "source_filename")


def upsert(writes: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Items after all writes (th, zh, en, seq, source_filename) in the order of seq.

    The Thai text and file of the last write win; a blank translation never overwrites; created_seq stays the first.
    """
    blank = lambda c: F.nullif(strip(c), F.lit(""))
    rows = writes.select(
        strip("th").alias("thai_text"), blank("zh").alias("zh"), blank("en").alias("en"), "seq", "source_filename"
    ).withColumn("thai_normalized", glossary_key("thai_text"))
    rows = rows.withColumn("first", F.col("seq"))
    if items is not None:
        old = items.select(
            "thai_text", F.col("chinese_text").alias("zh"), F.col("english_text").alias("en"),
            F.col("updated_seq").alias("seq"), "source_filename", "thai_normalized", F.col("created_seq").alias("first"),
        )
        rows = old.unionByName(rows)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return rows.groupBy("thai_normalized").agg(
        F.max_by("thai_text", "seq").alias("thai_text"),
        latest("zh").alias("chinese_text"),
        latest("en").alias("english_text"),
        F.max_by("source_filename", "seq").alias("source_filename"),
        F.min("first").alias("created_seq"),
        F.max("seq").alias("updated_seq"),
    )


def directional_entries(items: DataFrame) -> DataFrame:
    """Every ordered pair of an item's languages; of entries with one source the item written last wins."""
    texts = items.select(
        "thai_normalized",
        F.col("updated_seq").alias("seq"),
        F.expr("array(struct('th' as l, thai_text as t), struct('zh' as l, chinese_text as t), struct('en' as l, english_text as t))").alias("x"),
    )
    one = texts.select("*", F.explode("x").alias("s")).select("*", F.explode("x").alias("d")).where("s.l <> d.l and s.t <> '' and d.t <> ''")
    rows = one.select(
        F.col("s.l").alias("source_language"), F.col("d.l").alias("target_language"), F.col("s.t").alias("source_text"),
        F.col("d.t").alias("translated_text"), glossary_key("s.t").alias("source_normalized"),
        glossary_key("d.t").alias("translation_normalized"), "thai_normalized", "seq",
    )
    key = ["source_language", "target_language", "source_normalized"]
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("v")).select(*key, "v.*")


def import_counts(rows: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(total, invalid, inserted, updated) of an import of directional rows with a seq; one row."""
    marked = rows.withColumn("ok", directional_row_is_valid())
    valid = to_multilingual(marked.where("ok")).withColumn("k", glossary_key("th"))
    keys = valid.select("k").distinct()
    if items is not None:
        keys = keys.join(items.select(F.col("thai_normalized").alias("k")), "k", "left_anti")
    counts = marked.agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("invalid"))
    return counts.crossJoin(keys.agg(F.count("*").alias("inserted"))).withColumn(
        "updated", F.col("total") - F.col("invalid") - F.col("inserted")
    )


def exact_lookup(texts: DataFrame, entries: DataFrame, source: str, target: str, text: str = "text") -> DataFrame:
    """``texts`` with translated_text, null where the glossary has no equal key.  Equal keys are looked up once."""
    own = entries.where((F.col("source_language") == source) & (F.col("target_language") == target))
    own = own.select(F.col("source_normalized").alias("_k"), "translated_text")
    return texts.withColumn("_k", glossary_key(text)).join(sized(own, "_k", "translated_text"), "_k", "left").drop("_k")


def containment_join(texts: DataFrame, terms: DataFrame, text_key: str = "text_key", term_key: str = "term_key") -> DataFrame:
    """Pairs where the term's key is a substring of the text's key; both sides hold normalized keys.

    A term of three words or more holds a word that must stand whole in the text: the longest but for the first and the
    last.  Such terms meet texts by an equality join on that word and are checked then.  Shorter terms meet on the first
    ``GRAM`` characters of the term, against the grams of the text; still shorter ones, few by nature, are compared with
    every text if they are small enough to broadcast.
    """
    inner = F.slice(F.split(F.col(term_key), " "), 2, F.greatest(F.lit(0), F.size(F.split(F.col(term_key), " ")) - 2))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))), 1)
    marked = terms.where(F.char_length(term_key) > 0).withColumn("_w", F.when(F.size(inner) > 0, longest["w"]))
    worded, short = marked.where("_w <> ''"), marked.where("_w is null or _w = ''")
    words = texts.withColumn("_w", F.explode(F.array_distinct(F.split(text_key, " "))))
    holds = F.contains(F.col(text_key), F.col(term_key))
    found = words.join(sized(worded, term_key), "_w").where(holds).drop("_w")
    grams = short.where(F.char_length(term_key) >= GRAM).withColumn("_w", F.substring(term_key, 1, GRAM))
    slid = texts.withColumn(
        "_w",
        F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text_key) - GRAM + 1)), lambda i: F.substring(F.col(text_key), i, F.lit(GRAM))
        ))),
    )
    tiny = short.where(F.char_length(term_key) < GRAM).drop("_w")
    if not short.isEmpty():
        found = found.unionByName(slid.join(sized(grams, term_key), "_w").where(holds).drop("_w"))
        found = found.unionByName(texts.join(sized(tiny, term_key), holds))
    return found


GRAM = 8


def top_matches(pairs: DataFrame, text_id: str, order: list[Column], limit: int = MATCH_LIMIT) -> DataFrame:
    """The best ``limit`` terms of each text, with their rank: the longest keys first, then ``order``."""
    w = Window.partitionBy(text_id).orderBy(F.char_length("term_key").desc(), *order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def within_budget(ranked: DataFrame, text_id: str, line: Column, budget: int = CONTEXT_CHARACTERS) -> DataFrame:
    """The lines of each text, in rank order, up to the first that would pass the budget of characters."""
    w = Window.partitionBy(text_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("line", line).withColumn("used", F.sum(F.char_length("line")).over(w)).where(F.col("used") <= budget)


def context_block(lines: DataFrame, text_id: str) -> DataFrame:
    """(text_id, context): the lines of each text under the heading."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    joined = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return lines.groupBy(text_id).agg(F.concat(F.lit(CONTEXT_HEAD), joined).alias("context"))


def for_direction(entries: DataFrame, target: str, source: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest entries into a language."""
    own = entries.where(F.col("target_language") == target)
    own = own.where(F.col("source_language") == source) if source else own
    return own.orderBy(F.desc("seq"), "source_language", "source_normalized").limit(limit)


def newest(rows: DataFrame, seq: str, *ties: str, limit: int = 100) -> DataFrame:
    return rows.orderBy(F.desc(seq), *ties).limit(limit)
