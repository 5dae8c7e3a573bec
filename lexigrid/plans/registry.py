"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import geometry as g
from lexigrid.functions import language as lang
from lexigrid.functions import text as tx
from lexigrid.functions import unicode_udf as uni
from lexigrid.operators import glossary, history, layout, provider, reports, responses, routing, segments, similar, spatial
from lexigrid.plans import cases  # noqa: F401, registers its queries
from lexigrid.plans.base import BOXES, EMB, HELD, ORACLES, QUERIES, boxed, query, table, vector_boxes  # noqa: F401
from lexigrid.plans.inline import frame
from lexigrid.sources import files

KEY = r"regexp_replace(replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), 'ß', 'ss'), '\s+', ' ', 'g')"
DOC_KEY, ITEM_KEY = KEY.format("d.text"), KEY.format("b.text")
PAIRS = f"""
WITH d AS (SELECT doc_id, {DOC_KEY} AS k FROM documents d), b AS (SELECT item_id, text, {ITEM_KEY} AS t FROM benchmark b),
p AS (SELECT doc_id, item_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY length(t) DESC, item_id) AS rank
      FROM d JOIN b ON contains(k, t))"""
INTER = "(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))"
AREA = "(greatest({0}.x1 - {0}.x0, 0) * greatest({0}.y1 - {0}.y0, 0))"
THAI_CLASS, CONS = "[\\x{0E00}-\\x{0E7F}]", "[\\x{0E01}-\\x{0E2E}]"


# Glossary


def _ranked(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tx.glossary_key("text").alias("text_key"))
    terms = table(spark, sf, "benchmark").select("item_id", "text", tx.glossary_key("text").alias("term_key"))
    return glossary.top_matches(glossary.containment_join(docs, terms), "doc_id", [F.col("item_id")])


@query(PAIRS + " SELECT doc_id, item_id, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 40")
def glossary_containment_topk(spark, sf):
    return _ranked(spark, sf).select("doc_id", "item_id", "rank")


@query(PAIRS + """, l AS (SELECT doc_id, rank, sum(length(text) + 4 + length(CAST(item_id AS VARCHAR))) OVER (PARTITION BY doc_id ORDER BY rank) AS used FROM p WHERE rank <= 40)
SELECT doc_id, count(*) AS n_lines, CAST(max(used) AS BIGINT) AS used FROM l WHERE used <= 500 GROUP BY doc_id""")
def glossary_context_budget(spark, sf):
    line = F.concat_ws(" => ", "text", F.col("item_id").cast("string"))
    kept = glossary.within_budget(_ranked(spark, sf), "doc_id", line, 500)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("used").alias("used"))


def _items(spark):
    return glossary.upsert(frame(spark, "writes"))


ITEMS_SQL = """
w AS (SELECT seq, trim(th) AS th, nullif(trim(zh), '') AS zh, nullif(trim(en), '') AS en, source_filename FROM @writes),
items AS (SELECT th AS thai_normalized, arg_max(zh, seq) FILTER (zh IS NOT NULL) AS chinese_text, arg_max(en, seq) FILTER (en IS NOT NULL) AS english_text,
  arg_max(source_filename, seq) AS source_filename, min(seq) AS created_seq, max(seq) AS updated_seq FROM w GROUP BY th),
l AS (SELECT thai_normalized, updated_seq AS seq, 'th' AS lang, thai_normalized AS t FROM items UNION ALL
  SELECT thai_normalized, updated_seq, 'zh', chinese_text FROM items WHERE chinese_text IS NOT NULL UNION ALL
  SELECT thai_normalized, updated_seq, 'en', english_text FROM items WHERE english_text IS NOT NULL),
e AS (SELECT a.lang AS source_language, b.lang AS target_language, lower(a.t) AS source_normalized, arg_max(b.t, a.seq) AS translated_text, max(a.seq) AS seq
  FROM l a JOIN l b USING (thai_normalized) WHERE a.lang <> b.lang GROUP BY 1, 2, 3)"""


@query(f"WITH {ITEMS_SQL} SELECT * FROM items")
def glossary_upsert(spark, sf):
    return _items(spark).select("thai_normalized", "chinese_text", "english_text", "source_filename", "created_seq", "updated_seq")


@query(f"WITH {ITEMS_SQL} SELECT * FROM e")
def glossary_directions(spark, sf):
    return glossary.directional_entries(_items(spark)).select("source_language", "target_language", "source_normalized", "translated_text", "seq")


@query(f"""WITH v AS (SELECT *, coalesce(lower(trim(source_language)) IN ('zh', 'th', 'en') AND lower(trim(target_language)) IN ('zh', 'th', 'en') AND lower(trim(source_language)) <> lower(trim(target_language))
 AND 'th' IN (lower(trim(source_language)), lower(trim(target_language))) AND length(trim(source_text)) BETWEEN 1 AND {glossary.MAX_SOURCE} AND length(trim(translated_text)) BETWEEN 1 AND {glossary.MAX_TRANSLATION}, false) AS ok FROM @imports),
c AS (SELECT count(*) AS total, count(*) FILTER (NOT ok) AS invalid, count(DISTINCT CASE WHEN source_language = 'th' THEN trim(source_text) ELSE trim(translated_text) END) FILTER (ok) AS inserted FROM v)
SELECT *, total - invalid - inserted AS updated FROM c""")
def glossary_import_counts(spark, sf):
    return glossary.import_counts(frame(spark, "imports"))


@query(f"""WITH {ITEMS_SQL}, q AS (SELECT id, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS k FROM @lookup)
SELECT id, translated_text FROM q LEFT JOIN (SELECT * FROM e WHERE source_language = 'en' AND target_language = 'th') e ON k = source_normalized""")
def glossary_exact_lookup(spark, sf):
    entries = glossary.directional_entries(_items(spark))
    return glossary.exact_lookup(frame(spark, "lookup"), entries, "en", "th").select("id", "translated_text")


@query(f"""WITH {ITEMS_SQL}, q AS (SELECT id, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS k FROM @lookup)
SELECT id FROM q WHERE NOT EXISTS (SELECT 1 FROM e WHERE source_language = 'en' AND target_language = 'th' AND k = source_normalized)""")
def glossary_exact_miss(spark, sf):
    entries = glossary.directional_entries(_items(spark))
    return glossary.exact_lookup(frame(spark, "lookup"), entries, "en", "th").where("translated_text is null").select("id")


@query(f"WITH {ITEMS_SQL} SELECT source_language, source_normalized, translated_text FROM e WHERE target_language = 'th' ORDER BY seq DESC, source_language, source_normalized LIMIT 5")
def glossary_direction_topn(spark, sf):
    out = glossary.for_direction(glossary.directional_entries(_items(spark)), "th", limit=5)
    return out.select("source_language", "source_normalized", "translated_text")


@query("SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def glossary_list_topn(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    top = glossary.newest(orders, "o_orderdate", "o_orderkey", limit=100)
    return top.crossJoin(orders.agg(F.count("*").alias("total"))).select("o_orderkey", "o_custkey", "total")  # one row


@query("""WITH m AS (SELECT seq, CASE WHEN source_language = 'th' THEN trim(source_text) ELSE trim(translated_text) END AS th,
  CASE WHEN source_language = 'zh' THEN source_text WHEN target_language = 'zh' THEN translated_text END AS zh,
  CASE WHEN source_language = 'en' THEN source_text WHEN target_language = 'en' THEN translated_text END AS en
  FROM @imports WHERE source_language = 'th' OR target_language = 'th')
SELECT th AS thai_text, arg_max(zh, seq) FILTER (zh <> '') AS chinese_text, arg_max(en, seq) FILTER (en <> '') AS english_text FROM m GROUP BY th""")
def legacy_pivot(spark, sf):
    return glossary.upsert(glossary.to_multilingual(frame(spark, "imports"))).select("thai_text", "chinese_text", "english_text")


# Text


@query(f"SELECT doc_id, md5({DOC_KEY}) AS key_md5, CAST(length({DOC_KEY}) AS INTEGER) AS n FROM documents d")
def text_normalize(spark, sf):
    key = tx.glossary_key("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(key).alias("key_md5"), F.char_length(key).alias("n"))


@query("SELECT id, translate(regexp_replace(source, '(?i)(?:&#x0*20;|&#0*32;|&nbsp;)', ' ', 'g'), '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS text FROM @pairs")
def thai_digits(spark, sf):
    return frame(spark, "pairs").select("id", tx.translation_text("source").alias("text"))


VOTE = """CASE WHEN greatest(th, zh, en) = 0 THEN '{1}' WHEN th = greatest(th, zh, en) THEN 'th' WHEN zh = greatest(th, zh, en) THEN 'zh' ELSE 'en' END"""
COUNTS = r"""len(regexp_extract_all({0}, '[\x{{0E00}}-\x{{0E7F}}]')) AS th, len(regexp_extract_all({0}, '[{1}]')) AS zh, len(regexp_extract_all({0}, '{2}')) AS en"""
WORD_COUNTS = COUNTS.format("text", r"\x{3400}-\x{9FFF}", r"[A-Za-z]+(?:[''-][A-Za-z]+)*")


@query(f"SELECT doc_id AS id, {VOTE.format('', 'en')} AS language FROM (SELECT doc_id, {WORD_COUNTS} FROM documents) UNION ALL SELECT -id, {VOTE.format('', 'en')} FROM (SELECT id, {WORD_COUNTS} FROM @texts)")
def language_vote(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    more = frame(spark, "texts").select((-F.col("id")).cast("bigint").alias("id"), "text")
    return docs.unionByName(more).select("id", lang.detect_language("text").alias("language"))


PAGE_COUNTS = COUNTS.format("text", r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}", "[A-Za-z]")


@query(f"SELECT page, {VOTE.format('', 'auto')} AS language FROM (SELECT page, sum(th) AS th, sum(zh) AS zh, sum(en) AS en FROM (SELECT page, {PAGE_COUNTS} FROM @page_lines) GROUP BY page)")
def page_language_vote(spark, sf):
    return lang.page_language(frame(spark, "page_lines"), ["page"])


NUMS = r"regexp_extract_all(translate({0}, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '\d+(?:[.,]\d+)*%?')"
NKEY = r"CASE WHEN regexp_full_match(regexp_replace(replace(v, ',', ''), '%$', ''), '\d+(\.\d+)?') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(v, ',', ''), '%$', ''), '^0+(\d)', '\1'), '(\.\d*?)0+$', '\1'), '\.$', '') ELSE regexp_replace(replace(v, ',', ''), '%$', '') END"


def _numbers_sql(rows: str) -> str:
    return f"""WITH r AS ({rows}), s AS (SELECT id, v, min(i) AS i FROM (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM (SELECT id, {NUMS.format('a')} AS x FROM r)) GROUP BY id, v),
t AS (SELECT DISTINCT id, {NKEY} AS k FROM (SELECT id, unnest({NUMS.format('b')}) AS v FROM r)), m AS (SELECT id, v, i, {NKEY} AS k FROM s)
SELECT r.id, CAST(coalesce(n, 0) AS INTEGER) AS n_missing, coalesce(said, '') AS shown FROM r LEFT JOIN
 (SELECT id, count(*) AS n, string_agg(v, ', ' ORDER BY i) FILTER (j <= 5) AS said FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS j FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = m.id AND t.k = m.k)) GROUP BY id) q ON q.id = r.id"""


@query(_numbers_sql("SELECT doc_id AS id, text AS a, substr(text, 1, CAST(length(text) / 2 AS INTEGER)) AS b FROM (SELECT * FROM documents) WHERE true").replace("CAST(length(text) / 2 AS INTEGER)", "length(text) // 2"))
def quality_numbers(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("a"), F.expr("substr(text, 1, char_length(text) div 2)").alias("b"))
    missing = tx.missing_numbers("a", "b")
    return docs.select("id", F.size(missing).alias("n_missing"), F.array_join(F.slice(missing, 1, 5), ", ").alias("shown"))


@query(_numbers_sql(r"SELECT id, regexp_replace(translate(source, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '【第\s*\d+\s*页】', '', 'g') AS a, regexp_replace(translated, '【第\s*\d+\s*页】', '', 'g') AS b FROM (SELECT id, regexp_replace(source, '&#x20;', ' ') AS source, translated FROM @pairs)"))
def quality_number_cases(spark, sf):
    missing = tx.missing_numbers("source", "translated")
    return frame(spark, "pairs").select("id", F.size(missing).alias("n_missing"), F.array_join(F.slice(missing, 1, 5), ", ").alias("shown"))


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS a, regexp_replace(substr(text, 1, 10 + doc_id % 50), '^\s+|\s+$', '', 'g') AS b FROM documents)
SELECT doc_id, length(a) > 80 AND length(b) < length(a) * 0.15 AS is_short FROM r""")
def quality_short(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.is_short(F.col("text"), F.expr("substr(text, 1, 10 + cast(doc_id % 50 as int))")).alias("is_short"))


@query("""SELECT id, CASE WHEN id = 4 THEN '请复核数字：译文中未找到 1, 2, 3, 4, 5' WHEN id = 5 THEN '译文长度明显偏短，可能存在漏译' ELSE '' END AS warnings FROM @pairs""")
def quality_warnings(spark, sf):
    return frame(spark, "pairs").select("id", F.array_join(tx.quality_warnings("source", "translated"), "|").alias("warnings"))


@query(r"""SELECT id, lower(regexp_replace(text, '[^A-Za-z0-9\x{0E00}-\x{0E7F}]+', '', 'g')) AS ocr_key, regexp_replace(lower(text), '[^0-9A-Za-z\x{3400}-\x{9FFF}\x{0E00}-\x{0E7F}]+', '', 'g') AS layout_key,
lower(regexp_replace(text, '\s+', '', 'g')) AS outline_key, lower(regexp_replace(text, '[\s　，。,:：;；()（）\[\]]+', '', 'g')) AS bilingual_key FROM @labels_text""")
def text_keys(spark, sf):
    return frame(spark, "labels_text").select("id", tx.ocr_match_key("text").alias("ocr_key"), tx.layout_key("text").alias("layout_key"), tx.outline_key("text").alias("outline_key"), tx.bilingual_key("text").alias("bilingual_key"))


@query(r"""SELECT id, regexp_extract(text, '^\s*([A-Za-z]{1,4}\d*\s*[-–—]\s*\d+(?:\s*[-–—]\s*\d+)?)(?:\s+|[\x{3400}-\x{9FFF}])', 1) AS code FROM @labels_text
WHERE regexp_matches(text, '^\s*([A-Za-z]{1,4}\d*\s*[-–—]\s*\d+(?:\s*[-–—]\s*\d+)?)(?:\s+|[\x{3400}-\x{9FFF}])(.*?)\s*$')""")
def drawing_codes(spark, sf):
    return frame(spark, "labels_text").withColumn("d", tx.drawing_code("text")).where("d is not null").select("id", F.col("d.code").alias("code"))


@query("""SELECT * FROM (VALUES (1, 'A - 12 Ground floor plan', 'A - 12 Ground floor plan'), (2, 'ST05-02 ดูแบบ', 'ST05-02 ดูแบบ'), (3, 'no code', 'no code'), (4, 'พ12 ผนัง', 'W12 ผนัง'), (5, 'WO ผนังL', 'W0 ผนังม'),
(6, 'กขค A 1', 'ก ข ค  A 1'), (7, 'Plan MECHANICAL ENGINEER', 'Plan'), (8, '建筑 图', '建筑 图'), (9, 'a', 'a'), (10, '12 34', '12 34'), (11, 'ST–1–2图纸', 'ST–1–2图纸')) AS t(id, joined, repaired)""")
def ocr_repairs(spark, sf):
    return frame(spark, "labels_text").select("id", tx.join_thai_gaps("text").alias("joined"), tx.repair_outline("text").alias("repaired"))


@query(r"""SELECT id, regexp_matches(v, '[A-Za-z\x{0E00}-\x{0E7F}\x{4E00}-\x{9FFF}]') AND (regexp_matches(v, '[\x{4E00}-\x{9FFF}]') OR len(regexp_extract_all(v, '[A-Za-z\x{0E00}-\x{0E7F}]')) >= 2) AS ok
FROM (SELECT id, regexp_replace(text, '\s+', '', 'g') AS v FROM @labels_text)""")
def translatable_text(spark, sf):
    return frame(spark, "labels_text").select("id", tx.is_translatable("text").alias("ok"))


@query(r"""SELECT id, a <> b AND b <> '' AS collapsed, regexp_replace(a, '\s', '', 'g') <> regexp_replace(b, '\s', '', 'g') AND b <> '' AS deleted FROM
(SELECT doc_id AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS a, trim(regexp_replace(CASE doc_id % 3 WHEN 0 THEN replace(text, ' ', '  ') WHEN 1 THEN replace(text, ' ', '') ELSE upper(text) END, '\s+', ' ', 'g')) AS b FROM documents)""")
def needs_replacement(spark, sf):
    other = F.expr("case doc_id % 3 when 0 then replace(text, ' ', '  ') when 1 then replace(text, ' ', '') else upper(text) end")
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), tx.needs_replacement("text", other).alias("collapsed"), tx.needs_replacement("text", other, False).alias("deleted"))


@query("""SELECT * FROM (VALUES (1, 'report.PDF', '.pdf', 'report', '.pdf'), (2, 'b', '', 'b', '.bin'), (3, '.env', '', '.env', '.bin'), (4, 'x.tar.g-z', '.g-z', 'x.tar', '.bin')) AS t(id, name, suffix, stem, archived)""")
def file_names(spark, sf):
    rows = spark.createDataFrame([(1, "/tmp/report.PDF"), (2, "a/b"), (3, ".env"), (4, "c:\\x.tar.g-z")], "id int, p string")
    return rows.select("id", tx.base_name("p").alias("name"), tx.suffix("p").alias("suffix"), tx.stem("p").alias("stem"), tx.archive_suffix("p").alias("archived"))


@query("""SELECT * FROM (VALUES (1, 4, true), (2, 2, false), (3, 0, false)) AS t(id, n, bullets)""")
def graphemes_and_bullets(spark, sf):
    rows = spark.createDataFrame([(1, "ก้ า b c", "• x", " • y"), (2, "e\u0301 f", "• x", "z"), (3, " ", "", "")], "id int, t string, a string, b string")
    return rows.select("id", tx.grapheme_count("t").alias("n"), tx.separate_list_items("a", "b").alias("bullets"))


@query("SELECT id, s IN ('auto', 'zh', 'th', 'en') AND t IN ('zh', 'th', 'en') AND s <> t AS ok FROM @directions")
def language_pairs(spark, sf):
    return frame(spark, "directions").select("id", lang.valid_direction("s", "t").alias("ok"))


@query()
def romanize_residual(spark, sf):
    return frame(spark, "texts").select("id", uni.romanize("text").alias("text"))


@query()
def sequence_similarity(spark, sf):
    items = table(spark, sf, "benchmark")
    return items.select("item_id", uni.similarity("text", F.reverse("text")).alias("ratio"), uni.thai_key("text").alias("thai"))


# Segments


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, 0 AS batch, 1 AS items, n AS chars FROM s WHERE i = 1 UNION ALL
 SELECT s.conv_id, s.turn, s.i, CASE WHEN items >= 4 OR chars + n > 900 THEN batch + 1 ELSE batch END, CASE WHEN items >= 4 OR chars + n > 900 THEN 1 ELSE items + 1 END,
 CASE WHEN items >= 4 OR chars + n > 900 THEN n ELSE chars + n END FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
SELECT conv_id, turn, batch FROM r""")
def batch_pack(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("page", F.lit(1))
    return segments.pack_batches(rows, "conv_id", "turn", "page", "text", items=4, characters=900)


@query("SELECT batch, CAST(CASE batch WHEN 3 THEN 160 ELSE 180 END AS BIGINT) AS n FROM (SELECT unnest(range(0, 4)) AS batch)".replace("range(0, 4)", "[0, 1, 2, 3]"))
def batch_pack_pages(spark, sf):
    rows = spark.range(700).selectExpr("1 as doc", "id as pos", "id div 100 + 1 as page", "'text' as text")
    return segments.pack_batches(rows, "doc", "pos", "page", "text").groupBy("batch").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS INTEGER) AS chunk FROM conversations")
def fixed_chunks(spark, sf):
    return segments.fixed_chunks(table(spark, sf, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "chunk")


@query(r"""WITH p AS (SELECT conv_id, turn // 2 + 1 AS page, regexp_replace(string_agg(text, chr(10) ORDER BY turn), '^\s+|\s+$', '', 'g') AS t FROM conversations GROUP BY 1, 2)
SELECT conv_id, md5(CASE WHEN max(page) > 1 THEN string_agg('【第 ' || page || ' 页】' || chr(10) || t, chr(10) || chr(10) ORDER BY page) ELSE min(t) END) AS md5 FROM p GROUP BY conv_id""")
def page_join(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("page", F.expr("turn div 2 + 1"))
    return segments.join_pages(rows, "conv_id", "page", "turn", "text").select("conv_id", F.md5("text").alias("md5"))


@query("SELECT * FROM (VALUES (1, 1, 'alpha beta'), (1, 2, 'gamma'), (2, 1, 'no markers here'), (3, 3, 'y'), (3, 10, 'z')) AS t(id, page_number, text)")
def page_split(spark, sf):
    return segments.split_pages(frame(spark, "marked"), "id", "text", 1)


@query(r"SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS key, count(*) AS n_rows FROM documents GROUP BY 1")
def work_dedup(spark, sf):
    return segments.distinct_work(table(spark, sf, "documents"), "text")


@query(r"""WITH k AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS key FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS done_by, count(*) OVER (PARTITION BY key) AS n_rows FROM k""")
def work_fan_out(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = docs.groupBy(tx.strip(tx.collapse("text")).alias("key")).agg(F.min("doc_id").alias("done_by"), F.count("*").alias("n_rows"))
    return segments.fan_out(docs, done, "text").select("doc_id", "done_by", "n_rows")


@query("SELECT * FROM (VALUES (1, 1, 'The first line goes on-here.', CAST(3 AS BIGINT), CAST(12 AS DOUBLE)), (1, 2, 'Heading', CAST(1 AS BIGINT), CAST(19.2 AS DOUBLE)), (1, 3, '• one', CAST(1 AS BIGINT), CAST(12 AS DOUBLE)), (1, 4, '• two', CAST(1 AS BIGINT), CAST(12 AS DOUBLE)), (2, 1, 'A1', CAST(1 AS BIGINT), CAST(12 AS DOUBLE)), (2, 2, 'B1', CAST(1 AS BIGINT), CAST(12 AS DOUBLE)), (2, 3, 'C1', CAST(1 AS BIGINT), CAST(12 AS DOUBLE)), (2, 4, 'far', CAST(1 AS BIGINT), CAST(12 AS DOUBLE))) AS t(page_number, paragraph, text, n_units, \"leading\")")
def paragraph_islands(spark, sf):
    return segments.merge_paragraphs(boxed(frame(spark, "units"))).select("page_number", "paragraph", "text", "n_units", F.round("leading", 6).alias("leading"))


@query("""WITH u AS (SELECT *, lag(x0) OVER w AS px, lag(y1) OVER w AS py, lag(font_size) OVER w AS pf, lag(color) OVER w AS pc FROM @units WINDOW w AS (PARTITION BY page_number ORDER BY pos)),
i AS (SELECT *, sum(CASE WHEN pc = color AND abs(pf - font_size) <= greatest(0.75, least(pf, font_size) * 0.12) AND abs(px - x0) <= greatest(pf, font_size) * 0.5 AND y1 - py > greatest(pf, font_size) * 1.7 AND y1 - py <= greatest(pf, font_size) * 3.5 THEN 0 ELSE 1 END) OVER (PARTITION BY page_number ORDER BY pos) AS g FROM u)
SELECT page_number, pos, CASE WHEN count(*) OVER (PARTITION BY page_number, g) >= 3 THEN max(x1 - x0) OVER (PARTITION BY page_number, g) END AS list_width FROM i""")
def vertical_lists(spark, sf):
    return segments.vertical_lists(boxed(frame(spark, "units"))).select("page_number", "pos", "list_width")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN l_shipdate >= p THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate ROWS UNBOUNDED PRECEDING) AS INTEGER) AS island FROM l""")
def lineitem_islands(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    order = [F.col("l_linenumber").asc_nulls_last(), F.col("l_shipdate").asc_nulls_last()]
    return segments.islands(rows, ["l_orderkey"], order, F.col("l_shipdate") >= F.col("_prev.l_shipdate")).select("l_orderkey", "l_linenumber", "island")


@query("SELECT conv_id, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY m) AS INTEGER) AS place FROM (SELECT conv_id, role, min(turn) AS m FROM conversations GROUP BY 1, 2)")
def first_seen_distinct(spark, sf):
    return segments.first_seen(table(spark, sf, "conversations"), ["conv_id"], "role", ["turn"])


@query("SELECT conv_id, turn, first_value(text) OVER (PARTITION BY conv_id, role ORDER BY turn) = text AS same, md5(first_value(text) OVER (PARTITION BY conv_id, role ORDER BY turn)) AS md5 FROM conversations")
def source_reuse(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("value", F.col("text"))
    out = segments.reuse_first(rows, F.concat_ws(":", "conv_id", "role"), ["turn"], "value")
    return out.select("conv_id", "turn", (F.col("value") == F.col("text")).alias("same"), F.md5("value").alias("md5"))


@query("SELECT conv_id, turn, 'cad:' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') AS ordinal FROM conversations")
def ordinal_ids(spark, sf):
    return segments.ordinals(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "cad:").select("conv_id", "turn", "ordinal")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def replacement_rows(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    new = rows.where("n_nationkey % 3 = 0").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"))
    return segments.replace_rows(rows, new, "n_nationkey")


@query(r"""SELECT id, list_filter(a, lambda c: NOT regexp_full_match(c, '\s*')) = list_filter(b, lambda c: NOT regexp_full_match(c, '\s*')) AS ok
FROM (VALUES (1, ['a', ' ', 'b'], ['a', 'b', ' ']), (2, ['a', 'b'], ['b', 'a']), (3, [' '], CAST([] AS VARCHAR[]))) AS t(id, a, b)""")
def character_mapping(spark, sf):
    rows = spark.createDataFrame([(1, list("a b"), list("ab ")), (2, list("ab"), list("ba")), (3, [" "], [])], "id int, a array<string>, b array<string>")
    return rows.select("id", segments.positions_agree(F.col("a"), F.col("b")).alias("ok"))


@query()
def fragment_merge(spark, sf):
    rows = spark.createDataFrame(
        [(1, 1, "Ground", 0.0, 0.0, 40.0, 10.0, 9.0, 10.0, "#000"), (1, 2, "floor", 44.0, 0.0, 80.0, 10.0, 9.2, 10.0, "#000"), (1, 3, "far", 200.0, 0.0, 220.0, 10.0, 9.0, 10.0, "#000")],
        "page int, pos int, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double, color string",
    )
    return segments.merge_fragments(rows)


# Boxes


@query(f"""SELECT a.id AS a, b.id AS b, round({INTER} / greatest(1, least({AREA.format('a')}, {AREA.format('b')})), 6) AS overlap, round({INTER} / greatest(1, {AREA.format('a')}), 6) AS coverage,
{INTER} > greatest(0.5, least({AREA.format('a')}, {AREA.format('b')}) * 0.08) AS collides FROM @boxes a JOIN @boxes b ON a.page = b.page AND a.id < b.id""")
def box_overlap(spark, sf):
    a, b = boxed(frame(spark, "boxes")).alias("a"), boxed(frame(spark, "boxes")).alias("b")
    x, y = F.col("a.bbox"), F.col("b.bbox")
    met = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.id") < F.col("b.id")))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(g.overlap(x, y), 6).alias("overlap"), F.round(g.coverage(x, y), 6).alias("coverage"), g.collides(x, y).alias("collides"))


@query(f"SELECT a.id FROM @boxes a WHERE NOT EXISTS (SELECT 1 FROM @covers b WHERE a.page = b.page AND {INTER} / greatest(1, {AREA.format('a')}) >= 0.55)")
def box_coverage_anti(spark, sf):
    return spatial.uncovered(boxed(frame(spark, "boxes")), boxed(frame(spark, "covers")), "page").select("id")


SAME = f"""({INTER} / greatest(1, least({AREA.format('a')}, {AREA.format('b')})) >= 0.45 OR ({INTER} > 0 AND
 CASE WHEN a.rotation IN (0, 180) THEN (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) ELSE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)) END >= 0.72 AND
 CASE WHEN a.rotation IN (0, 180) THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)) ELSE (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) END >= 0.12))"""


@query(f"""SELECT a.id, min(b.idx) AS existing_idx FROM @boxes a LEFT JOIN @covers b ON a.page = b.page AND {SAME} GROUP BY a.id""")
def same_line(spark, sf):
    out = spatial.first_on_line(boxed(frame(spark, "boxes")), boxed(frame(spark, "covers")), "page", "id", F.col("a.rotation"))
    return out.select("id", "existing_idx")


@query(f"""WITH c AS (SELECT a.id, arg_min(struct_pack(x0 := b.x0, y0 := b.y0, x1 := b.x1, y1 := b.y1), {AREA.format('b')}) AS cl, any_value(a.x0) AS x0, any_value(a.y0) AS y0, any_value(a.x1) AS x1, any_value(a.y1) AS y1
 FROM @boxes a JOIN @cells b ON a.page = b.page AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1 GROUP BY a.id)
SELECT id, cl.x0 AS cx0, cl.x1 AS cx1 FROM c WHERE x0 >= cl.x0 - 2 AND x1 <= cl.x1 + 2 AND y0 >= cl.y0 - 2 AND y1 <= cl.y1 + 2 AND cl.y1 - cl.y0 <= greatest((y1 - y0) * 8, 800 * 0.15) AND cl.x1 - cl.x0 <= 600 * 0.75""")
def cell_assign(spark, sf):
    out = spatial.smallest_cell(boxed(frame(spark, "boxes")), boxed(frame(spark, "cells")), "page", "id", 600.0, 800.0)
    return out.where("cell is not null").select("id", F.col("cell.x0").alias("cx0"), F.col("cell.x1").alias("cx1"))


@query("""WITH m AS (SELECT a.id, (a.x0 + a.x1) / 2 AS cx, (a.y0 + a.y1) / 2 AS cy, axis, pos, lo, hi FROM @boxes a JOIN @rules b ON a.page = b.page
 WHERE CASE axis WHEN 'h' THEN (a.x0 + a.x1) / 2 ELSE (a.y0 + a.y1) / 2 END BETWEEN lo - 2 AND hi + 2),
v AS (SELECT id, cx, pos FROM m WHERE axis = 'v' UNION ALL SELECT id, cx, lo FROM m WHERE axis = 'h' UNION ALL SELECT id, cx, hi FROM m WHERE axis = 'h'),
t AS (SELECT id, max(pos) FILTER (pos <= cy) AS top, min(pos) FILTER (pos >= cy) AS bottom FROM m WHERE axis = 'h' GROUP BY id),
l AS (SELECT id, max(pos) FILTER (pos <= cx) AS lft, min(pos) FILTER (pos >= cx) AS rgt FROM v GROUP BY id)
SELECT id, top, bottom, lft AS "left", rgt AS "right" FROM t JOIN l USING (id) WHERE bottom - top >= 4 AND rgt - lft >= 8""")
def grid_bounds(spark, sf):
    return spatial.grid_bounds(boxed(frame(spark, "boxes")), frame(spark, "rules"), "page", "id")


@query(f"""SELECT id, round(ratio, 6) AS ratio, CASE WHEN ratio < 0.08 THEN 1.0 ELSE least(1.0, greatest(CASE WHEN ratio < 0.2 THEN 0.85 WHEN ratio < 0.4 THEN 0.75 ELSE 0.65 END, least(1.0, 6.0 / 9.0))) END::DOUBLE AS scale
FROM (SELECT a.id, sum(coalesce({INTER}, 0)) / greatest(1, any_value({AREA.format('a')})) AS ratio FROM @boxes a LEFT JOIN @covers b ON a.page = b.page GROUP BY a.id)""")
def obstacle_scale(spark, sf):
    out = spatial.overlap_share(boxed(frame(spark, "boxes")), boxed(frame(spark, "covers")), "page", "id")
    return out.select("id", F.round("ratio", 6).alias("ratio"), g.ink_scale(F.col("ratio"), F.lit(9.0), F.lit(1.0)).alias("scale"))


@query(f"""SELECT a.id FROM @boxes a WHERE NOT EXISTS (SELECT 1 FROM @covers b WHERE a.page = b.page AND ({INTER} / greatest(1, least({AREA.format('a')}, {AREA.format('b')})) >= 0.18 OR
((a.x0 + a.x1) / 2 BETWEEN b.x0 - 4 AND b.x1 + 4 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 - 4 AND b.y1 + 4)))""")
def uncovered_seeds(spark, sf):
    return spatial.seed_is_covered(boxed(frame(spark, "boxes")), boxed(frame(spark, "covers")), "page").select("id")


@query(f"""SELECT DISTINCT a.id FROM @boxes a JOIN @boxes b ON a.page = b.page AND a.id <> b.id WHERE greatest(a.y0, b.y0) - least(a.y1, b.y1) BETWEEN -3 AND 48
AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) >= least(a.x1 - a.x0, b.x1 - b.x0) * 0.2""")
def band_neighbors(spark, sf):
    return spatial.next_to_neighbor(boxed(frame(spark, "boxes")), "page", "id").select("id")


@query(f"""SELECT DISTINCT a.id FROM @boxes a JOIN @covers b ON a.page = b.page WHERE {INTER} / greatest(1, {AREA.format('a')}) >= 0.90 OR (
{INTER} / greatest(1, {AREA.format('a')}) >= 0.30 AND greatest(1, {AREA.format('a')}) <= greatest(1, {AREA.format('b')}) * 0.65
AND (a.x0 + a.x1) / 2 BETWEEN b.x0 - greatest(2, (b.x1 - b.x0) * 0.04) AND b.x1 + greatest(2, (b.x1 - b.x0) * 0.04)
AND (a.y0 + a.y1) / 2 BETWEEN b.y0 - greatest(2, (b.y1 - b.y0) * 0.55) AND b.y1 + greatest(2, (b.y1 - b.y0) * 0.55))""")
def covered_fragments(spark, sf):
    return spatial.covered_by_translation(boxed(frame(spark, "boxes")), boxed(frame(spark, "covers")), "page", "id")


@query("WITH e AS (" + EMB.replace("embedding[", "CAST(embedding[").replace("])", "] AS DOUBLE))").replace("] AS DOUBLE))", "] AS DOUBLE))") + f""")
SELECT a.page, count(*) AS n FROM e a JOIN e b ON a.page = b.page AND a.id < b.id WHERE {INTER} / greatest(1, least({AREA.format('a')}, {AREA.format('b')})) >= 0.55 GROUP BY a.page""")
def vector_box_overlaps(spark, sf):
    a, b = boxed(vector_boxes(spark, sf)).alias("a"), boxed(vector_boxes(spark, sf)).alias("b")
    met = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.id") < F.col("b.id")) & (g.overlap(F.col("a.bbox"), F.col("b.bbox")) >= 0.55))
    return met.groupBy(F.col("a.page").alias("page")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE e AS ({BOXES}), s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS i FROM e),
f AS (SELECT page, i, true AS stays, id, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM s WHERE i = 1 UNION ALL
 SELECT page, i, stays, id, CASE WHEN stays THEN list_append(kept, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) ELSE kept END FROM
 (SELECT s.*, f.kept, len(list_filter(f.kept, lambda k: {HELD.format('s', 'k')} >= 0.70)) = 0 AS stays FROM f JOIN s ON s.page = f.page AND s.i = f.i + 1))
SELECT e.* FROM f JOIN e USING (page, id) WHERE stays""")
def nms_dedup(spark, sf):
    return spatial.suppress(vector_boxes(spark, sf), "page", ["-area", "id"], spatial.SEEDS)


@query(f"""WITH e AS (SELECT *, CAST(id * 37 % 180 AS DOUBLE) AS angle, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM ({BOXES})),
m AS (SELECT a.page, a.id AS seed, b.id, b.x0, b.y0, b.x1, b.y1, b.angle FROM e a JOIN e b ON a.page = b.page AND abs(a.cx - b.cx) <= 8 AND abs(a.cy - b.cy) <= 8),
k AS (SELECT seed FROM m GROUP BY page, seed HAVING count(*) >= 4 AND max(angle) - min(angle) >= 70 AND max(x1) - min(x0) <= least(180, 600 * 0.1) AND max(y1) - min(y0) <= least(180, 800 * 0.1))
SELECT DISTINCT m.id FROM m JOIN k USING (seed)""")
def ring_members(spark, sf):
    lines = boxed(vector_boxes(spark, sf)).withColumn("angle", (F.col("id") * 37 % 180).cast("double"))
    return spatial.ring_members(lines, "page", "id", 600.0, 800.0, reach=8, least=4)


STROKES = "SELECT l_orderkey // 16 AS page, l_quantity / 4 AS pos, CAST(l_partkey % 400 AS DOUBLE) AS lo, l_partkey % 400 + l_quantity AS hi FROM lineitem"


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos, lo, hi) AS i FROM (SELECT page, CAST(pos AS DOUBLE) AS pos, lo, CAST(hi AS DOUBLE) AS hi FROM ({STROKES}))),
f AS (SELECT page, i, [{{'head': pos, 'total': pos, 'n': 1, 'lo': lo, 'hi': hi}}] AS g FROM s WHERE i = 1 UNION ALL
 SELECT page, i, CASE WHEN k IS NULL THEN list_append(g, {{'head': pos, 'total': pos, 'n': 1, 'lo': lo, 'hi': hi}}) ELSE list_transform(g, lambda x, j:
  CASE WHEN j = k THEN {{'head': x.head, 'total': x.total + pos, 'n': x.n + 1, 'lo': least(x.lo, lo), 'hi': greatest(x.hi, hi)}} ELSE x END) END FROM
 (SELECT s.*, f.g, list_max(list_filter(list_transform(f.g, lambda x, j: CASE WHEN s.pos - x.head <= 1.2 AND s.lo <= x.hi + 4 AND s.hi >= x.lo - 4 THEN j END), lambda j: j IS NOT NULL)) AS k
  FROM f JOIN s ON s.page = f.page AND s.i = f.i + 1)),
l AS (SELECT page, unnest(g) AS x FROM f WHERE i = (SELECT max(i) FROM s WHERE s.page = f.page))
SELECT page, round(x.total / x.n, 6) AS pos, x.lo AS lo, x.hi AS hi FROM l WHERE x.hi - x.lo >= 16 OR x.n >= 2""")
def grid_rule_merge(spark, sf):
    rules = table(spark, sf, "lineitem").selectExpr("l_orderkey div 16 as page", "l_quantity / 4 as pos", "l_partkey % 400 as lo", "l_partkey % 400 + l_quantity as hi")
    return spatial.merge_rules(rules, "page", 600.0).withColumn("pos", F.round("pos", 6))


@query()
def phrase_fragments(spark, sf):
    return similar.fragments_of_phrases(frame(spark, "fragments"), "page", "id", 600.0)


@query("SELECT * FROM (VALUES (1, CAST(2 AS DOUBLE)), (2, NULL)) AS t(key, \"offset\")")
def robust_offsets(spark, sf):
    rows = [(1, float(i), float(i) + d) for i, d in enumerate((2, 2, 2.5, 1.5, 90))] + [(2, 0.0, 1.0)]
    return spatial.robust_offset(spark.createDataFrame(rows, "key int, s double, t double"), "key", "s", "t", 1000.0)


@query("""SELECT id, CAST(tile AS INTEGER) AS tile, greatest(0, w * c / 3 - CASE WHEN c > 0 THEN w * 0.012 ELSE 0 END) AS x0, least(h, h * (r + 1) / 2 + CASE WHEN r + 1 < 2 THEN h * 0.018 ELSE 0 END) AS y1
FROM (SELECT *, tile % 3 AS c, tile // 3 AS r FROM (VALUES (1, CAST(600 AS DOUBLE), CAST(800 AS DOUBLE))) AS p(id, w, h), (SELECT unnest(range(0, 6)) AS tile))""")
def tile_grid(spark, sf):
    pages = spark.createDataFrame([(1, 600.0, 800.0)], "id int, width double, height double")
    return spatial.tiles(pages, "grid").select("id", "tile", F.col("clip.x0").alias("x0"), F.col("clip.y1").alias("y1"))


@query("""SELECT id, CASE WHEN n <= side THEN '0' ELSE array_to_string(list_sort(list_distinct(list_append(range(0, n - side + 1, greatest(1, side - greatest(0, least(side - 1, o)))), n - side))), ',') END AS starts
FROM (VALUES (1, 900, 1000, 100), (2, 2700, 1000, 200), (3, 2000, 1000, 100)) AS t(id, n, side, o)""")
def tile_offsets(spark, sf):
    rows = spark.createDataFrame([(1, 900, 1000, 100), (2, 2700, 1000, 200), (3, 2000, 1000, 100)], "id int, n int, side int, o int")
    return rows.select("id", F.array_join(g.tile_offsets("n", "side", "o").cast("array<string>"), ",").alias("starts"))


@query(f"""SELECT id, CASE WHEN abs(a - t) <= 1.5 THEN CAST(t % 360 AS INTEGER) END AS rotation FROM (SELECT *, round(a / 90) * 90 AS t FROM
(SELECT vec_id AS id, (degrees(atan2(CASE vec_id % 4 WHEN 1 THEN x ELSE y END, CASE vec_id % 4 WHEN 0 THEN x WHEN 1 THEN y / 100 ELSE x END)) + 360) % 360 AS a FROM
(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) / CASE vec_id % 4 WHEN 0 THEN 100 ELSE 1 END AS y FROM embeddings)))""")
def rotations(spark, sf):
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4).alias("k"), e(0).alias("x"), e(1).alias("y"))
    y = F.when(F.col("k") == 0, F.col("y") / 100).otherwise(F.col("y"))
    dy, dx = F.when(F.col("k") == 1, F.col("x")).otherwise(y), F.when(F.col("k") == 1, y / 100).otherwise(F.col("x"))
    return rows.select("id", g.cardinal_rotation(dx, dy).alias("rotation"))


# Routing


@query("SELECT page, CASE WHEN drawings >= 20000 THEN 'vector' WHEN images > 0 AND units = 0 THEN 'image' WHEN units > 0 THEN 'native_text' ELSE 'no_native_text' END AS page_type FROM @counts")
def page_type(spark, sf):
    return frame(spark, "counts").select("page", routing.page_type("drawings", "images", "units").alias("page_type"))


@query("""SELECT page, route, route <> 'scanned_image' AND route <> 'preserve' AS translate_native, CASE WHEN route = 'scanned_image' THEN 'scan' WHEN route = 'dense_vector' AND NOT coalesce(native_text_complete, false) THEN 'cad' END AS visual_strategy FROM
(SELECT *, coalesce(nullif(processing_route, ''), CASE WHEN page_type IN ('vector', 'vector_mixed') THEN 'dense_vector' WHEN page_type IN ('image', 'mixed') THEN 'scanned_image' WHEN page_type IN ('native_text', 'text') THEN CASE WHEN table_like THEN 'native_table' ELSE 'native_text' END ELSE 'preserve' END) AS route FROM @profiles)""")
def page_route(spark, sf):
    return routing.plan_pages(frame(spark, "profiles")).select("page", "route", "translate_native", "visual_strategy")


@query("""SELECT id, CASE WHEN trim(text) = '' AND ocr_pages = 0 AND NOT has_visual THEN 'no_text'
 WHEN length(text) > CASE WHEN name LIKE '%.txt' OR name LIKE '%.md' THEN 50000 ELSE 1000000 END THEN 'too_long' WHEN ocr_pages > 50 THEN 'too_many_ocr_pages' END AS rejection FROM @uploads""")
def doc_admission(spark, sf):
    return frame(spark, "uploads").select("id", routing.rejection("name", "text", "ocr_pages", "has_visual").alias("rejection"))


HINT_SQL = r"""WITH h AS (SELECT *, trim(coalesce(source_hint, '')) AS v, coalesce(source_confidence, 0) AS c, trim(coalesce(read, '')) AS said FROM @hints),
o AS (SELECT *, regexp_replace(v, '\s', '', 'g') AS q, regexp_extract_all(v, '[\x{0E01}-\x{0E2E}]') AS own, len(regexp_extract_all(v, '[\x{0E00}-\x{0E7F}]')) AS thai FROM h),
r AS (SELECT *, c >= 60 AND len(own) >= 2 AND len(list_distinct(own)) >= 2 AND thai / greatest(1, length(q)) >= 0.30
 AND (regexp_matches(v, '[ะ-ฺเ-๎]') OR len(list_distinct(own)) / greatest(1, len(own)) >= 0.60) AS reliable FROM o)"""


@query(HINT_SQL + " SELECT id, reliable, NOT regexp_matches(said, '[\\x{0E00}-\\x{0E7F}]') AND (reliable OR (upper(said) = '[NO_TEXT]' AND c >= 80 AND thai >= 2)) AS review FROM r")
def hint_reliability(spark, sf):
    return frame(spark, "hints").select("id", routing.hint_is_reliable().alias("reliable"), routing.read_needs_review("read").alias("review"))


@query(HINT_SQL + " SELECT id, x1 > x0 AND y1 > y0 AND (greatest(x1 - x0, y1 - y0) <= 36 OR (x1 - x0 <= 28 AND y1 - y0 <= 80)) AND length(q) BETWEEN 1 AND 8 AND thai <= 3 AND regexp_matches(q, '[0-9๐-๙]') AS tiny FROM r")
def tiny_label(spark, sf):
    return boxed(frame(spark, "hints")).select("id", routing.is_tiny_label(F.col("bbox")).alias("tiny"))


@query("SELECT l_orderkey AS page, count(*) FILTER (l_extendedprice / 100 >= 20 AND l_quantity >= 4) >= 6 AS table_like FROM lineitem GROUP BY 1")
def table_pages(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit("re").alias("kind"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_extendedprice") / 100).alias("x1"), F.col("l_quantity").alias("y1"))
    return routing.looks_like_table(rows, "page", 600.0, 400.0)


# Layout


@query(f"""SELECT id, CASE WHEN id % 3 > 1 OR x1 - x0 >= 48 THEN 'left' WHEN abs((x0 + x1 - 60) / 2) <= 3.6 THEN 'center' WHEN abs(x1 - 60) <= 1.5 THEN 'right' ELSE 'left' END AS alignment FROM ({BOXES})""")
def alignments(spark, sf):
    rows, content = boxed(vector_boxes(spark, sf)), g.box(*map(F.lit, (0, 0, 60, 100)))
    return rows.select("id", layout.alignment(F.col("id") % 3, F.col("bbox"), content).alias("alignment"))


@query("""WITH d AS (SELECT l_orderkey AS grp, l_quantity AS b, abs(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey)) AS d FROM lineitem)
SELECT grp, CASE WHEN count(*) < 2 THEN greatest(10, max(b)) ELSE greatest(10, coalesce(median(d) FILTER (d > 0), 11.5)) END::DOUBLE AS leading FROM d GROUP BY grp""".replace("AS leading", 'AS "leading"'))
def line_leading(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("grp"), F.struct("l_linenumber", "l_quantity", "l_partkey").alias("o"), F.col("l_quantity").alias("baseline"), F.lit(10.0).alias("font_size"), F.col("l_quantity").alias("height")
    )
    return layout.leading(rows, "grp", "o")


@query("SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN greatest(1, o_totalprice) ELSE 0 END) * 2 >= sum(greatest(1, o_totalprice)) AS mostly FROM orders GROUP BY 1")
def majority_flags(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(layout.majority(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("mostly"))


@query("SELECT * FROM (VALUES (1, CAST(0 AS DOUBLE), CAST(10 AS DOUBLE)), (2, CAST(2 AS DOUBLE), CAST(8 AS DOUBLE))) AS t(id, x0, x1)")
def clipped_lines(spark, sf):
    rows = spark.createDataFrame([(1, -5.0, 5.0, 15.0, 5.0), (2, 2.0, 2.0, 8.0, 8.0), (3, -5.0, -5.0, 15.0, -5.0), (4, 10.2, 0.0, 9.9, 0.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    cut = layout.clip_line(g.box(*map(F.lit, (0, 0, 10, 10))), *map(F.col, ("x0", "y0", "x1", "y1")))
    return rows.withColumn("c", cut).where("c is not null").select("id", F.col("c.x0").alias("x0"), F.col("c.x1").alias("x1"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT round(l_quantity, 2), round(l_discount, 2), round(l_tax, 2), l_linenumber FROM lineitem)")
def line_dedup(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), F.col("l_tax").alias("x1"), F.col("l_linenumber").cast("double").alias("y1"), F.lit(1.0).alias("width"), "l_orderkey")
    return layout.distinct_lines(rows, [], "l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT conv_id, text, min(turn) AS m FROM conversations WHERE length(text) <= 120 GROUP BY 1, 2) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY m) AS INTEGER) AS place, md5(text) AS md5 FROM o""")
def context_lines(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("score", F.lit(0.9))
    return layout.context_lines(rows, "conv_id", "turn", "text", "score").select("conv_id", "place", F.md5("text").alias("md5"))


@query(r"""WITH r AS (SELECT *, regexp_extract_all(t, '[\x{0E01}-\x{0E2E}]') AS own, len(regexp_extract_all(t, '[\x{0E00}-\x{0E7F}]')) / greatest(1, length(regexp_replace(t, '\s', '', 'g'))) AS share
 FROM (VALUES (1, 'x', 10.0, true, 0.9), (2, 'กขค', 60.0, false, 0.55), (3, 'กขค ผนัง', 80.0, false, 0.9), (4, 'กกก', 90.0, false, 0.9)) AS v(id, t, c, m, s))
SELECT id, m OR (c >= 72 AND len(own) >= 3 AND len(list_distinct(own)) >= 2 AND len(list_distinct(own)) / greatest(1, len(own)) >= 0.30 AND share >= 0.35 AND length(t) <= 250) AS credible,
s >= 0.55 AND len(own) >= 3 AND len(list_distinct(own)) >= 2 AS confirmed FROM r""")
def gap_filters(spark, sf):
    rows = spark.createDataFrame([(1, "x", 10.0, True, 0.9), (2, "กขค", 60.0, False, 0.55), (3, "กขค ผนัง", 80.0, False, 0.9), (4, "กกก", 90.0, False, 0.9)], "id int, t string, c double, m boolean, s double")
    return rows.select("id", layout.gap_is_credible("t", "c", F.col("m")).alias("credible"), layout.reading_is_confirmed("t", "s").alias("confirmed"))


@query("SELECT id, greatest(x1 - x0, y1 - y0) / greatest(1, least(x1 - x0, y1 - y0)) >= 3 OR (greatest(x1 - x0, y1 - y0) / greatest(1, least(x1 - x0, y1 - y0)) >= 1.5 AND y1 <= 800 * 0.24) AS ok FROM @boxes")
def recall_shapes(spark, sf):
    return boxed(frame(spark, "boxes")).select("id", layout.recall_shape(F.col("bbox"), 800.0).alias("ok"))


@query("SELECT * FROM (VALUES (1, CAST(0 AS DOUBLE), CAST(70 AS DOUBLE)), (2, CAST(0 AS DOUBLE), CAST(100 AS DOUBLE))) AS t(id, x0, x1)")
def barrier_clip(spark, sf):
    boxes = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 100.0, 10.0), (2, 2, 0, 0.0, 0.0, 100.0, 10.0)], "page int, id int, rotation int, x0 double, y0 double, x1 double, y1 double")
    bars = spark.createDataFrame([(1, "v", 70.0, -5.0, 20.0), (1, "v", 97.0, -5.0, 20.0), (1, "h", 5.0, 0.0, 100.0), (2, "v", 50.0, 20.0, 40.0)], "page int, axis string, pos double, lo double, hi double")
    return layout.clip_at_barriers(boxed(boxes), bars, "page", "id").select("id", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"))


@query("SELECT * FROM (VALUES (3), (4)) AS t(pos)")
def recall_additions(spark, sf):
    kind = "page int, pos int, rotation int, exact boolean, x0 double, y0 double, x1 double, y1 double"
    new = [(1, 1, 0, False, 0.0, 0.0, 50.0, 10.0), (1, 2, 0, False, 40.0, 1.0, 90.0, 9.0), (1, 3, 90, False, 0.0, 0.0, 50.0, 10.0), (1, 4, 0, True, 40.0, 0.0, 90.0, 10.0), (1, 5, 0, False, 42.0, 0.0, 90.0, 10.0)]
    old = [(1, 1, 0, False, 0.0, 0.0, 48.0, 10.0)]
    return layout.recall_additions(spark.createDataFrame(new, kind), spark.createDataFrame(old, kind), "page").select("pos")


@query("SELECT * FROM (VALUES (1, 'อาคาร/building', CAST(30 AS DOUBLE)), (3, 'far', CAST(310 AS DOUBLE)), (4, 'x', CAST(10 AS DOUBLE))) AS t(pos, text, y1)")
def bilingual_merge(spark, sf):
    rows = [(1, 1, " อาคาร ", "建筑 ", 0.0, 0.0, 50.0, 10.0), (1, 2, "building", "建筑", 5.0, 20.0, 60.0, 30.0), (1, 3, "far", "建筑", 0.0, 300.0, 50.0, 310.0), (1, 4, "x", "", 0.0, 0.0, 50.0, 10.0)]
    df = spark.createDataFrame(rows, "page int, pos int, text string, translated_text string, x0 double, y0 double, x1 double, y1 double")
    return layout.merge_bilingual(df, "page", "pos").select("pos", F.replace("text", F.lit("\n"), F.lit("/")).alias("text"), "y1")


@query("SELECT * FROM (VALUES (1, 'The long/word-/breaking'), (2, '建筑图纸目录/一'), (3, '')) AS t(id, lines)")
def wrapped_text(spark, sf):
    rows = spark.createDataFrame([(1, "The long word-breaking"), (2, "建筑图纸目录一"), (3, " ")], "id int, t string")
    width = F.when(F.col("id") == 2, F.array_join(layout.wrap_lines(F.col("t"), 6), "/")).otherwise(F.array_join(layout.wrap_lines(F.col("t"), 8), "/"))
    return rows.select("id", width.alias("lines"))


@query("SELECT * FROM (VALUES (1, 1, 'a b', 'x'), (1, 2, 'c', 'y z'), (2, 1, 'a  b', 'x')) AS t(id, part, source, translated)")
def positioned_parts(spark, sf):
    return layout.positioned_parts(spark.createDataFrame([(1, "a b   c", "x  y z"), (2, "a  b", "x")], "id int, text string, translated_text string"), "id")


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, CAST(n // c AS INTEGER) AS sheet, CAST(n % c AS INTEGER) AS sheet_row FROM
(SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS n, CAST(max(l_linenumber) OVER (PARTITION BY l_returnflag) AS BIGINT) AS c FROM lineitem)""")
def repacked_rows(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("capacity"))
    out = layout.repack_rows(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "sheet", "sheet_row")


@query("""SELECT conv_id, md5('{"segments":[' || string_agg('{"id":"' || turn || '","text":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY turn) || ']}') AS payload_md5 FROM conversations GROUP BY conv_id""")
def request_payloads(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("id"), "text")
    return layout.request_payload(rows, ["conv_id"], "turn").select("conv_id", F.md5("payload").alias("payload_md5"))


@query("SELECT conv_id, CAST(count(*) FILTER (role <> 'user') AS BIGINT) AS completed FROM conversations GROUP BY 1")
def initial_completed(spark, sf):
    pages = table(spark, sf, "conversations").select("conv_id", F.lit(False).alias("visual"), F.when(F.col("role") == "user", F.lit("x")).alias("text"))
    return layout.initial_completed(pages, "conv_id")


@query(f"SELECT id, round(greatest(2, least(CASE WHEN id % 5 <= 2 THEN 7 ELSE 14 END, (x1 - x0) / greatest(1, id % 3) * 0.72)), 6)::DOUBLE AS size FROM ({BOXES})")
def label_sizes(spark, sf):
    size = layout.label_font_size(F.expr("x1 - x0"), F.expr("id % 3"), F.expr("id % 5"))
    return vector_boxes(spark, sf).select("id", F.round(size, 6).alias("size"))


# OCR tables and responses


@query("""WITH w AS (SELECT * FROM @tsv WHERE trim(text) <> '' AND conf >= 35 AND width > 1 AND height > 1), e AS (SELECT image, max("left" + width) AS w, max(top + height) AS h FROM w GROUP BY image)
SELECT image, string_agg(trim(text), ' ' ORDER BY "left") AS source_text, avg(conf) AS confidence, round(min("left") / any_value(e.w) * 1000, 6) AS x0, round(max(top + height) / any_value(e.h) * 1000, 6) AS y1
FROM w JOIN e USING (image) GROUP BY image, block_num, par_num, line_num HAVING max("left" + width) - min("left") >= 3 AND max(top + height) - min(top) >= 3""")
def tsv_lines(spark, sf):
    return files.ocr_lines(frame(spark, "tsv"), "image").select("image", "source_text", "confidence", F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"))


@query(r"""SELECT id, x.id AS item, coalesce(x.source_text, '') AS source_text, coalesce(x.translated_text, '') AS translated_text FROM
(SELECT id, unnest(from_json(json_extract(regexp_extract(body, '(?s)(\{.*\})', 1), '$.items'), '[{"id": "VARCHAR", "source_text": "VARCHAR", "translated_text": "VARCHAR"}]')) AS x FROM @bodies)""")
def json_items(spark, sf):
    rows = frame(spark, "bodies").withColumnRenamed("id", "k")
    return responses.items(rows, "k", "body").select(F.col("k").alias("id"), F.col("id").alias("item"), "source_text", "translated_text")


@query(r"""SELECT id, k AS segment, json_extract_string(j, '$.' || k) AS translated_text FROM
(SELECT id, j, unnest(json_keys(j)) AS k FROM (SELECT id, json_extract(regexp_extract(body, '(?s)(\{.*\})', 1), '$.translations') AS j FROM @bodies) WHERE j IS NOT NULL)""")
def json_translations(spark, sf):
    rows = frame(spark, "bodies").withColumnRenamed("id", "k")
    return responses.translations(rows, "k", "body").select(F.col("k").alias("id"), F.col("id").alias("segment"), "translated_text")


@query("SELECT event_id, event_type FROM events WHERE props IS NOT NULL AND json_valid(props) AND json_type(props) = 'OBJECT'")
def json_objects(spark, sf):
    return table(spark, sf, "events").where(F.from_json(responses.json_body("props"), "map<string,string>").isNotNull()).select("event_id", "event_type")


@query()
def json_strict(spark, sf):
    return table(spark, sf, "events").select("event_id", responses.strict_object("props").alias("body"))


@query("""SELECT req, id, 'missing' AS problem FROM (SELECT DISTINCT * FROM @asked) a WHERE NOT EXISTS (SELECT 1 FROM @returned r WHERE r.req = a.req AND r.id = a.id) UNION ALL
SELECT req, id, CASE WHEN trim(id) = '' THEN 'blank' ELSE 'unknown' END FROM (SELECT DISTINCT * FROM @returned) r WHERE NOT EXISTS (SELECT 1 FROM @asked a WHERE r.req = a.req AND r.id = a.id) UNION ALL
SELECT req, id, 'repeated' FROM @returned GROUP BY 1, 2 HAVING count(*) > 1""")
def id_check(spark, sf):
    return responses.compare_ids(frame(spark, "asked"), frame(spark, "returned"), ["req", "id"])


@query("""SELECT id, CASE WHEN TRY_CAST(retry_after AS DOUBLE) IS NOT NULL THEN greatest(0.1, least(30, TRY_CAST(retry_after AS DOUBLE))) ELSE least(30, 0.5 * pow(2, attempt)) END::DOUBLE AS delay,
CASE WHEN status IN (401, 403, 429) THEN 'retry' WHEN status IN (404, 405, 501) THEN 'fallback' WHEN regexp_matches(lower(message), 'timed out|timeout|context length|too large|maximum') THEN 'split' ELSE 'fail' END AS action FROM @retries""")
def retry_plan(spark, sf):
    return frame(spark, "retries").select("id", history.retry_delay(F.col("retry_after"), F.col("attempt"), 0.5).alias("delay"), responses.retry_action("status", "message").alias("action"))


@query("SELECT * FROM (VALUES (1, 'สวัสดี'), (2, 'Demo translation: x'), (3, '谢谢')) AS t(id, translated_text)")
def demo_translation(spark, sf):
    rows = spark.createDataFrame([(1, "en", "th", " Hello "), (2, "th", "en", "x"), (3, "en", "zh", "thank you")], "id int, source_language string, target_language string, text string")
    return provider.translate(rows).select("id", "translated_text")


@query()
def fuzzy_canonical(spark, sf):
    hints = spark.createDataFrame([(1, 1, "ST05 ดแบบขยาย A605"), (1, 2, "งจจงจ"), (1, 3, "ขึ้น")], "page int, id int, hint string")
    known = spark.createDataFrame([(1, 1, "ST-05 ดูแบบขยาย A6-05"), (1, 2, "ห้องไฟฟ้า")], "page int, idx int, source string")
    return similar.best_canonical(hints, known, "page", "id")


# Reports


@query("""SELECT event_type AS stage, count(*) AS call_count, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS sum_elapsed_ms, max(CAST(value AS BIGINT)) AS max_elapsed_ms, min(CAST(value AS BIGINT)) AS min_elapsed_ms FROM (SELECT event_type, floor(value) AS value FROM events) GROUP BY 1""")
def stage_timing(spark, sf):
    events = table(spark, sf, "events").select("event_type", F.floor("value").alias("ms"))
    return reports.stage_timing(events, "event_type", "ms")


@query("""SELECT coalesce(nullif(phase, ''), 'unattributed') AS phase, count(*) AS request_count, max(started_ms + elapsed_ms) - min(started_ms) AS wall_elapsed_ms, CAST(sum(elapsed_ms) AS BIGINT) AS sum_elapsed_ms,
count(*) FILTER (status = 'error') AS error_count, CAST(sum(coalesce(request_bytes, 0)) AS BIGINT) AS request_bytes FROM @requests GROUP BY 1""")
def phase_summary(spark, sf):
    return reports.phase_summary(frame(spark, "requests"))


@query("""WITH e AS (SELECT event_type AS k, epoch_ms(ts) // 1000 AS s, CAST(floor(value) AS BIGINT) * 60 AS n FROM events), b AS (SELECT k, s AS t0, 1 AS d FROM e UNION ALL SELECT k, s + n, -1 FROM e),
r AS (SELECT k, sum(d) OVER (PARTITION BY k ORDER BY t0, d DESC ROWS UNBOUNDED PRECEDING) AS now FROM b) SELECT k AS event_type, CAST(max(now) AS BIGINT) AS peak FROM r GROUP BY k""")
def peak_concurrency(spark, sf):
    events = table(spark, sf, "events").select("event_type", F.unix_timestamp("ts").alias("s"), (F.floor("value") * 60).alias("n"))
    return reports.peak_concurrency(events, ["event_type"], "s", "n")


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, event_type FROM e WHERE p IS NULL OR p <> event_type""")
def state_changes(spark, sf):
    return reports.state_changes(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("SELECT job, min(t) FILTER (completed_pages > 0) AS first_page_seconds, max(t) AS total_seconds, round(max(t) / greatest(1, max(total_pages)), 3) AS seconds_per_page FROM @snapshots GROUP BY job")
def run_summary(spark, sf):
    return reports.run_summary(frame(spark, "snapshots").withColumnRenamed("t", "elapsed_seconds"), "job")


@query("""SELECT d.lang AS page, count(*) AS n, count(*) FILTER (quality = 1) AS n_exact, median(CAST(n_chars AS DOUBLE)) AS median_score, min(CAST(n_chars AS DOUBLE)) AS min_score,
coalesce(string_agg(CAST(d.doc_id AS VARCHAR), ',' ORDER BY d.doc_id) FILTER (toxic = 1), '') AS failing FROM documents d JOIN labels USING (doc_id) GROUP BY 1""")
def audit_by_page(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    out = reports.audit(rows, "lang", "doc_id", F.col("n_chars").cast("double"), F.col("quality") == 1, F.col("toxic") == 1)
    return out.select(F.col("lang").alias("page"), "n", "n_exact", "median_score", "min_score", F.array_join(F.col("failing").cast("array<string>"), ",").alias("failing"))


@query("""WITH k AS (SELECT CAST(doc_id // 100 AS BIGINT) AS page, CASE WHEN length(text) > 20 THEN md5(text) END AS key FROM documents), e AS (SELECT page, key, count(*) AS n, min(page) OVER (PARTITION BY key) AS first FROM k GROUP BY 1, 2)
SELECT page, CAST(sum(n) AS BIGINT) AS candidates, CAST(coalesce(sum(n) FILTER (key IS NOT NULL), 0) AS BIGINT) AS fingerprinted, CAST(coalesce(sum(n - 1) FILTER (key IS NOT NULL), 0) AS BIGINT) AS within_page, count(*) FILTER (key IS NOT NULL AND first < page) AS cross_page,
CAST(sum(n) - coalesce(sum(n - 1) FILTER (key IS NOT NULL), 0) - count(*) FILTER (key IS NOT NULL AND first < page) AS BIGINT) AS left_to_do FROM e GROUP BY page""")
def cache_reuse(spark, sf):
    rows = table(spark, sf, "documents").select(F.expr("doc_id div 100").alias("page"), F.when(F.char_length("text") > 20, F.md5("text")).alias("key"))
    return reports.cache_reuse(rows, "page", "key")


@query("""WITH b AS (SELECT lang AS part, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CAST(n_chars AS DOUBLE), length(source), doc_id, doc_id) AS c, row_number() OVER (PARTITION BY lang ORDER BY length(source), doc_id, doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents),
r AS (SELECT *, CASE WHEN c <= 10 THEN 0 WHEN list_contains(list_transform(range(0, 10), lambda i: CAST(round_even(i * (n - 1) / 9.0, 0) AS BIGINT)), p) THEN 1 ELSE 2 END AS k FROM b)
SELECT part, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k, p) AS take FROM r) WHERE n <= 20 OR take <= 20""")
def sample_blocks(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("part"), "doc_id", F.col("n_chars").cast("double").alias("c"), F.char_length("source").alias("y"), F.col("doc_id").alias("x"))
    return reports.stratified_sample(rows, "part", "doc_id", "c", "x", "y", 20)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_histogram(spark, sf):
    return reports.histogram(table(spark, sf, "events"), "event_type")


@query("SELECT job, t, CAST(least(100, round_even(completed_pages / total_pages * 100, 0)) AS INTEGER) AS progress FROM @snapshots")
def progress_percent(spark, sf):
    return frame(spark, "snapshots").select("job", "t", history.progress("completed_pages", "total_pages").alias("progress"))


@query("SELECT lang, count(*) - count(DISTINCT text) AS n_repeated FROM documents GROUP BY 1")
def repeated_sources(spark, sf):
    return reports.repeated_sources(table(spark, sf, "documents"), "lang", "text")


@query("SELECT o_orderkey AS page, count(*) FILTER (l_linestatus <> 'F') AS left_to_do, count(*) FILTER (l_linestatus <> 'F') = 0 AS is_done FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def remaining_work(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linestatus")
    rows = rows.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("page")), "page", "left_semi")
    return reports.remaining_work(rows, "page", F.col("l_linestatus") == "F")


# History


@query("SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 30")
def history_owner_topn(spark, sf):
    mine = history.of_owner(table(spark, sf, "events"), 7, "user_id")
    return glossary.newest(mine, "ts", "event_id", limit=30).select("event_id", "ts")


@query("SELECT id, " + ", ".join(f"arg_max({c}, seq) FILTER ({c} IS NOT NULL) AS {c}" for c in ("status", "stage", "total_pages", "completed_pages")) + " FROM @attempts GROUP BY id")
def attempts_state(spark, sf):
    return history.fold_updates(frame(spark, "attempts"), "id", "seq", ["status", "stage", "total_pages", "completed_pages"])


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last_type, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id")
def user_state(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return history.fold_updates(events, "user_id", "at", ["event_type"], "ts").select("user_id", F.col("event_type").alias("last_type"), "created_at", "updated_at")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND ts < (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def expired_jobs(spark, sf):
    events = table(spark, sf, "events")
    last = events.agg(F.max("ts").alias("now"))
    jobs = events.select("event_id", F.when(F.col("event_type").isin("click", "purchase"), "completed").otherwise("processing").alias("status"), F.col("ts").alias("updated_at"))
    return jobs.crossJoin(F.broadcast(last)).where(history.expired(jobs, F.col("now"), 5 * 86400)).select("event_id")  # one row


@query("SELECT n_regionkey, list_aggregate(list(n_name ORDER BY n_nationkey), 'string_agg', ',') AS names, count(*) AS n FROM nation GROUP BY 1")
def grouped_segments(spark, sf):
    rows = table(spark, sf, "nation")
    own = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return rows.groupBy("n_regionkey").agg(F.array_join(own, ",").alias("names"), F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def work_left_over(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
