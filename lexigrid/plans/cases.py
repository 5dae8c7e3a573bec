"""Queries of operators over whole driver tables, and SQL that states each rule again.

Where a rule needs a second table or flags that no driver table has, both are made from the keys of all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import geometry as g
from lexigrid.functions import text as tx
from lexigrid.operators import history, responses, routing, segments, similar, spatial
from lexigrid.plans.base import BOXES, HELD, boxed, query, table, vector_boxes

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
ROW = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}"


def _kept(share: float) -> str:
    """Rows ``s`` (page, i, id and box) folded in order i: what no kept box of the page covers by this share stays."""
    return f"""f AS (SELECT page, i, true AS stays, id, [{ROW}] AS kept FROM s WHERE i = 1 UNION ALL
 SELECT page, i, stays, id, CASE WHEN stays THEN list_append(kept, {ROW}) ELSE kept END FROM
 (SELECT s.*, f.kept, len(list_filter(f.kept, lambda k: {HELD.format("s", "k")} >= {share})) = 0 AS stays FROM f JOIN s ON s.page = f.page AND s.i = f.i + 1))"""


# Boxes


@query(f"""WITH RECURSIVE v AS ({BOXES}), s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0) AS i FROM v a
 WHERE id % 3 > 0 AND id % 5 > 0 AND x1 - x0 >= 8 AND y1 - y0 >= 6 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.page = a.page AND b.id % 3 = 0 AND {HELD.format("a", "b")} >= 0.35)),
{_kept(0.55)} SELECT page, 'ผนัง ' || id AS source_text FROM f WHERE stays""")
def uncovered_ocr_blocks(spark, sf):
    boxes = boxed(vector_boxes(spark, sf))
    own = boxes.withColumn("source_text", F.concat(F.when(F.col("id") % 5 > 0, "ผนัง ").otherwise("wall "), F.col("id").cast("string")))
    return spatial.uncovered_ocr(own.where("id % 3 > 0"), boxes.where("id % 3 = 0"), "page").select("page", "source_text")


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id % 3, id) AS i FROM ({BOXES})),
{_kept(0.5)} SELECT page, id, CAST(id % 3 AS INTEGER) AS precedence FROM f WHERE stays""")
def candidate_union(spark, sf):
    boxes = vector_boxes(spark, sf)
    return spatial.candidate_union([boxes.where(f"id % 3 = {i}") for i in range(3)], "page", ["id"], 0.5).select("page", "id", "precedence")


@query("""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, a, b) AS i FROM
 (SELECT DISTINCT l_orderkey // 16 AS page, l_partkey % 12 AS a, l_suppkey % 9 AS b, l_quantity / 50 AS score FROM lineitem WHERE l_quantity / 50 >= 0.3)),
f AS (SELECT page, i, a, b, score, true AS ok, [a] AS ua, [b] AS ub FROM s WHERE i = 1 UNION ALL
 SELECT page, i, a, b, score, ok, CASE WHEN ok THEN list_append(ua, a) ELSE ua END, CASE WHEN ok THEN list_append(ub, b) ELSE ub END FROM
 (SELECT s.*, ua, ub, NOT list_contains(ua, s.a) AND NOT list_contains(ub, s.b) AS ok FROM f JOIN s ON s.page = f.page AND s.i = f.i + 1))
SELECT page, a, b, score FROM f WHERE ok""")
def greedy_matches(spark, sf):
    pairs = table(spark, sf, "lineitem").selectExpr("l_orderkey div 16 as page", "l_partkey % 12 as a", "l_suppkey % 9 as b", "l_quantity / 50 as score")
    return similar.match_one_to_one(pairs.distinct(), "page", "a", "b", "score", 0.3)


@query(f"""WITH u AS (SELECT *, 10 + id % 4 * 0.3 AS s, CASE WHEN id // 40 % 2 = 0 THEN 0 ELSE 90 END AS r FROM ({BOXES})),
p AS (SELECT *, lag(x0) OVER w AS a0, lag(y0) OVER w AS b0, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(s) OVER w AS ps, lag(r) OVER w AS pr FROM u WINDOW w AS (PARTITION BY page ORDER BY id)),
m AS (SELECT page, id, pr = r AND abs(ps - s) <= greatest(0.35, least(ps, s) * 0.08) AND
 CASE WHEN r = 0 THEN abs((b0 + b1 - y0 - y1) / 2) >= least(b1 - b0, y1 - y0) * 0.55 AND greatest(0, least(a1, x1) - greatest(a0, x0)) >= least(a1 - a0, x1 - x0) * 0.15 AND greatest(0, greatest(b0, y0) - least(b1, y1)) <= greatest(ps, s) * 1.25
 ELSE abs((a0 + a1 - x0 - x1) / 2) >= least(a1 - a0, x1 - x0) * 0.55 AND greatest(0, least(b1, y1) - greatest(b0, y0)) >= least(b1 - b0, y1 - y0) * 0.15 AND greatest(0, greatest(a0, x0) - least(a1, x1)) <= greatest(ps, s) * 1.25 END AS goes FROM p)
SELECT page, id, CAST(sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY id) AS INTEGER) AS island FROM m""")
def line_groups(spark, sf):
    lines = boxed(vector_boxes(spark, sf)).selectExpr(
        "page", "id", "bbox", "cast(10 + id % 4 * 0.3 as double) as font_size", "if(id div 40 % 2 = 0, 0, 90) as rotation", "false as bold", "false as italic"
    )
    return segments.islands(lines, ["page"], ["id"], segments.same_group()).select("page", "id", "island")


@query(f"""SELECT id, round(x0 * 0.6, 6) AS x0, round(y1 * 0.8, 6) AS y1, round(10 + x0 / 1000 * 200, 6) AS tx0, round(20 + y1 / 1000 * 300, 6) AS ty1,
round(2 * x0 + 0.5 * y0 + 3, 6) AS mx, round(0.25 * x0 - y0 + 1, 6) AS my, round(2 * (2 * x0 + 0.5 * y0 + 3) + 7, 6) AS cx, round(3 * (0.25 * x0 - y0 + 1) - 7, 6) AS cy FROM ({BOXES})""")
def moved_boxes(spark, sf):
    rows = boxed(vector_boxes(spark, sf))
    b, r = F.col("bbox"), lambda x: F.round(x, 6)
    m, n = (F.array(*(F.lit(float(v)) for v in x)) for x in ((2, 0.25, 0.5, -1, 3, 1), (2, 0, 0, 3, 7, -7)))
    page, tile = g.to_page(b, 600, 800), g.from_tile(b, g.box(*map(F.lit, (10, 20, 210, 320))))
    one, two = g.transform_point(m, b["x0"], b["y0"]), g.transform_point(g.multiply_matrices(m, n), b["x0"], b["y0"])
    return rows.select(
        "id", r(page["x0"]).alias("x0"), r(page["y1"]).alias("y1"), r(tile["x0"]).alias("tx0"), r(tile["y1"]).alias("ty1"),
        r(one["x"]).alias("mx"), r(one["y"]).alias("my"), r(two["x"]).alias("cx"), r(two["y"]).alias("cy"),
    )


@query(f"""SELECT id, x0 + 5 AS x0, y1 + 7 AS y1, x0 + 5 <= 18 OR x1 + 5 >= 52 OR y1 + 7 >= 52 AS touches FROM ({BOXES})""")
def tile_edges(spark, sf):
    rows = vector_boxes(spark, sf).withColumn("p", F.expr("array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y0), named_struct('x', x1, 'y', y1), named_struct('x', x0, 'y', y1))"))
    points = g.offset_points(F.col("p"), F.lit(5.0), F.lit(7.0))
    around, tile = g.union_of_points(points), g.box(*map(F.lit, (10, 0, 60, 60)))
    return rows.select("id", around["x0"].alias("x0"), around["y1"].alias("y1"), g.touches_inner_edge(points, tile, F.lit(100), F.lit(100)).alias("touches"))


@query(f"""SELECT page, round(max(greatest(x0 * 0.6, x1 * 0.6) + greatest(y0 * 0.8, y1 * 0.8)) - min(x0 * 0.6 + y0 * 0.8), 6) AS along,
round(max(y1 * 0.6 - x0 * 0.8) - min(y0 * 0.6 - x1 * 0.8), 6) AS across FROM ({BOXES}) GROUP BY page""")
def projected_extents(spark, sf):
    out = spatial.projected_extents(boxed(vector_boxes(spark, sf)), "page", 0.6, 0.8)
    return out.select("page", F.round("along", 6).alias("along"), F.round("across", 6).alias("across"))


@query("SELECT DISTINCT l_quantity AS width, greatest(1, least(4, 100 / greatest(l_quantity, 1))) AS scale FROM lineitem")
def raster_scales(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("width")).distinct()
    return rows.select("width", spatial.raster_scale(F.col("width"), 100.0).alias("scale"))


_LINE = "CASE id % 4 WHEN 0 THEN 'ผนัง' WHEN 1 THEN 'ก' WHEN 2 THEN 'ก ก' ELSE 'wall' END"


@query(rf"""WITH l AS (SELECT id, {_LINE} AS t, id % 50 / 50.0 AS s, x1 - x0 AS w, y1 - y0 AS h, id % 2 * 90 AS r FROM ({BOXES})),
c AS (SELECT *, len(regexp_extract_all(t, '[\x{{0E00}}-\x{{0E7F}}]')) AS n, len(list_distinct(regexp_extract_all(t, '[\x{{0E01}}-\x{{0E2E}}]'))) AS k, CASE WHEN r = 0 THEN h <= w * 1.5 ELSE w <= h * 1.5 END AS way FROM l)
SELECT id, s >= 0.65 AND n > 0 AND way AND (s >= 0.78 OR (n >= 2 AND k >= 2)) AS accepted, way AND s >= 0.40 AND n > 0 AND (s >= 0.78 OR n >= 2) AS covers FROM c""")
def acceptable_lines(spark, sf):
    rows = boxed(vector_boxes(spark, sf)).withColumns({"t": F.expr(_LINE), "s": F.expr("id % 50 / 50.0D")})
    turn = (F.col("id") % 2 * 90).cast("int")
    return rows.select(
        "id", routing.is_acceptable("t", "s", F.col("bbox"), turn).alias("accepted"), routing.covers_seed("t", "s", F.col("bbox"), turn).alias("covers")
    )


# Segments and pages


@query(rf"""WITH c AS (SELECT *, regexp_replace(lower(text), '[^0-9A-Za-z\x{{3400}}-\x{{9FFF}}\x{{0E00}}-\x{{0E7F}}]+', '', 'g') AS k FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id % 40, k ORDER BY conv_id, turn) AS i FROM c)
SELECT conv_id % 40 AS cell, md5(coalesce(string_agg({TRIM.format("text")}, chr(10) ORDER BY conv_id, turn) FILTER ({TRIM.format("text")} <> ''), '')) AS md5, min(turn)::DOUBLE AS x0, max(turn + 2)::DOUBLE AS x1,
min(greatest(1, turn / 2))::DOUBLE AS font_size, count(*) AS n_kept FROM n WHERE i = 1 OR k = '' GROUP BY 1""")
def cell_rows(spark, sf):
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") % 40).alias("cell"), "conv_id", "turn", "text", F.col("text").alias("translated_text"),
        g.box("turn", F.lit(0), F.col("turn") + 2, F.lit(1)).alias("bbox"), (F.col("turn") / 2).alias("font_size"),
    )
    return spatial.coalesce_cells(rows, ["cell"], ["conv_id", "turn"]).select("cell", F.md5("translated_text").alias("md5"), "x0", "x1", "font_size", "n_kept")


@query("""WITH p AS (SELECT conv_id AS document, turn AS page, turn % 3 = 0 AS v, turn % 2 = 0 AS c, turn % 4 AS b, greatest(0, length(text) % 5 - turn % 3) AS k, turn % 3 AS l FROM conversations),
w AS (SELECT document, page, 'visual' AS kind, CAST(page AS VARCHAR) AS said FROM p WHERE v AND NOT c UNION ALL SELECT document, page, 'no_text_layer', CAST(page AS VARCHAR) FROM p WHERE b = 0 AND NOT v UNION ALL
 SELECT document, page, 'preserved', page || ':' || k FROM p WHERE k > 0 UNION ALL SELECT document, page, 'logo', page || ':' || l FROM p WHERE l > 0)
SELECT document, kind, string_agg(said, ', ' ORDER BY page) AS pages FROM w GROUP BY 1, 2""")
def profile_warnings(spark, sf):
    pages = table(spark, sf, "conversations").selectExpr(
        "conv_id as document", "turn as page_number", "turn % 3 = 0 as visual_required", "turn % 2 = 0 as native_text_complete", "turn % 4 as text_blocks",
        "char_length(text) % 5 as preserved_source_chars", "turn % 3 as protected_logo_source_chars",
    )
    return routing.profile_warnings(pages)


@query("""SELECT conv_id, turn, CASE WHEN (coalesce(turn % 5 = 0, false) OR turn % 4 = 1) AND turn % 2 = 1 THEN 'outline' WHEN turn % 5 = 0 OR turn % 4 = 1 THEN 'layout' WHEN turn % 2 = 0 AND conv_id % 2 = 0 THEN 'text_layer' ELSE 'native' END AS writer FROM conversations""")
def writer_routes(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "if(turn % 5 = 0, true, null) as visual", "if(turn % 4 = 1, 'ocr', 'text') as source_kind",
        "case when turn % 2 = 1 then 'outline' when conv_id % 2 = 0 then 'text-layer' end as engine",
    )
    return rows.select("conv_id", "turn", routing.segment_route().alias("writer"))


@query(f"""SELECT conv_id, turn, md5({TRIM.format("t")}) AS md5, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM
(SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' ' || text || '!' WHEN 1 THEN '  ' END AS t FROM conversations) WHERE {TRIM.format("t")} <> ''""")
def translated_segments(spark, sf):
    rows = table(spark, sf, "conversations")
    done = rows.where("turn % 3 < 2").selectExpr("conv_id", "turn", "if(turn % 3 = 0, concat(' ', text, '!'), '  ') as translated_text")
    out = segments.translated(rows, done, ["conv_id"], ["turn"], "translated_text")
    return out.select("conv_id", "turn", F.md5("translated_text").alias("md5"), F.col("place").cast("bigint").alias("place"))


@query("""SELECT l_partkey AS part, CAST(l_linenumber AS BIGINT) AS paragraph, arg_max(l_orderkey, struct_pack(o := l_orderkey, s := l_suppkey)) AS translated FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def part_paragraphs(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("concat(l_returnflag, ':', l_partkey, ':', l_linenumber) as id", "l_orderkey as t", "struct(l_orderkey, l_suppkey) as seq")
    out = segments.last_by_part(rows, "R:", "id", "t", "seq")
    return out.select(F.col("part").cast("bigint").alias("part"), "paragraph", F.col("t").alias("translated"))


@query("""WITH a AS (SELECT conv_id, turn AS expected, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
b AS (SELECT conv_id, turn AS baseline, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations WHERE turn % 3 > 0)
SELECT a.conv_id, CAST(place AS INTEGER) AS place, expected, baseline FROM a LEFT JOIN b USING (conv_id, place)""")
def positional_pairs(spark, sf):
    rows = table(spark, sf, "conversations")
    asked = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("expected"))
    had = rows.where("turn % 3 > 0").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn"), asc=False).alias("baseline"))
    return segments.side_by_side(asked.join(had, "conv_id", "left"), ["conv_id"], "expected", "baseline")


@query("SELECT l_orderkey AS page FROM lineitem EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity < 10")
def exact_only_pages(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), "l_quantity")
    return segments.pages_apart(rows, rows.where("l_quantity < 10"), "page")


@query(f"SELECT conv_id, turn FROM conversations WHERE turn % 4 <> 1 AND turn % 5 > 0 AND {TRIM.format('text')} <> ''")
def text_pages(spark, sf):
    rows = table(spark, sf, "conversations").withColumns({"route": F.expr("if(turn % 4 = 1, 'scanned_image', 'native_text')"), "body": F.expr("if(turn % 5 = 0, ' ', text)")})
    return routing.pages_with_text(rows, "route", "body").select("conv_id", "turn")


# Responses


@query(f"""SELECT user_id, arg_min(event_type, struct_pack(e := event_id, t := event_type)) AS reading FROM
(SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 2 GROUP BY 1""")
def reading_votes(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("reading"))
    return responses.reading_votes(rows, "user_id", "event_id", "reading")


@query("SELECT conv_id, turn, md5(text) AS source_md5, role AS translated_text, CASE WHEN turn % 2 = 0 THEN 'th' END AS source_language FROM conversations")
def image_results(spark, sf):
    said = F.to_json(F.expr("named_struct('source_language', if(turn % 2 = 0, 'th', null), 'source_text', text, 'translated_text', role)"))
    rows = table(spark, sf, "conversations").withColumn("body", F.concat(F.lit("```json\nHere: "), said, F.lit(" done\n```")))
    got = rows.withColumn("r", responses.image_result("body"))
    return got.select("conv_id", "turn", F.md5("r.source_text").alias("source_md5"), "r.translated_text", "r.source_language")


@query("""SELECT conv_id, md5(CASE WHEN conv_id % 3 = 0 THEN 'plain ' || conv_id ELSE string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user' AND text <> '') END) AS responses_md5,
md5(string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '')) AS chat_md5 FROM conversations GROUP BY conv_id""")
def response_texts(spark, sf):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(F.when(x["role"] == "user", "output_text").otherwise("reasoning").alias("type"), x["text"].alias("text")))
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(parts.alias("content"))
    plain = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("plain "), F.col("conv_id").cast("string")))
    body = F.to_json(F.struct(plain.alias("output_text"), F.array(F.struct("content")).alias("output")))
    chat = F.to_json(F.struct(F.array(F.struct(F.struct("content").alias("message"))).alias("choices")))
    return own.select("conv_id", F.md5(responses.responses_text(body)).alias("responses_md5"), F.md5(responses.chat_text(chat)).alias("chat_md5"))


@query(f"""SELECT page, 's' || id AS source_text, round(least(1000, 12 * x0), 6) AS x0, round(least(1000, 12 * x1), 6) AS x1 FROM ({BOXES})
WHERE id % 7 > 0 AND least(1000, 12 * x1) > least(1000, 12 * x0) AND least(1000, 12 * y1) > least(1000, 12 * y0)""")
def response_blocks(spark, sf):
    block = F.expr("named_struct('source_text', concat(' s', id), 'translated_text', if(id % 7 = 0, ' ', 't'), 'bbox', array(12 * x0, 12 * y0, 12 * x1, 12 * y1))")
    rows = vector_boxes(spark, sf).groupBy("page").agg(F.to_json(F.struct(F.collect_list(block).alias("blocks"))).alias("body"))
    return responses.layout_blocks(rows, "page", "body").select("page", "source_text", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query("SELECT conv_id, md5(list_aggregate(arg_max(string_split(text, ' '), struct_pack(n := len(string_split(text, ' ')), s := -turn)), 'string_agg', ' ')) AS md5 FROM conversations GROUP BY conv_id")
def longest_partials(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("items"))
    return responses.longest_partial(rows, "conv_id", "items", "turn").select("conv_id", F.md5(F.array_join("items", " ")).alias("md5"))


@query("SELECT conv_id, turn, turn <= length(text) % 5 AS complete FROM conversations")
def complete_ids(spark, sf):
    asked, got = F.sequence(F.lit(0).cast("bigint"), F.col("turn")), F.sequence(F.lit(0).cast("bigint"), (F.char_length("text") % 5).cast("bigint"))
    return table(spark, sf, "conversations").select("conv_id", "turn", responses.is_complete(asked, got).alias("complete"))


# Text and history


@query(r"SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 3 = 0 THEN ' ผนัง' ELSE '' END, '[\x{0E00}-\x{0E7F}]') AS residual FROM documents")
def residual_thai(spark, sf):
    out = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " ผนัง").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", tx.has_thai(out).alias("residual"))


@query(r"""SELECT doc_id, regexp_full_match(lower(u), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS ok FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN h
 WHEN 1 THEN upper(h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]) ELSE h[1:8] || '-' || h[9:32] END AS u FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents))""")
def client_ids(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    cut = F.regexp_replace("h", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    one = F.when(F.col("doc_id") % 3 == 0, F.col("h")).when(F.col("doc_id") % 3 == 1, F.upper(cut)).otherwise(F.regexp_replace("h", "^(.{8})", "$1-"))
    return rows.select("doc_id", tx.is_client_id(one).alias("ok"))


@query(f"""SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 THEN upper(role) ELSE {TRIM.format("text")} END) AS chosen, md5(chr(65279) || {TRIM.format("text")} || chr(10)) AS download FROM conversations""")
def preferred_texts(spark, sf):
    revised = F.expr("case turn % 3 when 0 then concat(' ', upper(role)) when 1 then '  ' end")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(tx.preferred(revised, F.col("text"))).alias("chosen"), F.md5(tx.txt_download("text")).alias("download"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 > 0 AND doc_id % 80 >= 40 AND doc_id % 3 > 0 THEN sha256(text) || ':ผนัง ' || doc_id END AS key FROM documents")
def visual_keys(spark, sf):
    mark = F.when(F.col("doc_id") % 4 > 0, F.upper(F.sha2("text", 256))).otherwise("none")
    hint = F.concat(F.when(F.col("doc_id") % 3 > 0, " ผนัง  ").otherwise("wall "), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", tx.visual_cache_key(mark, hint, F.col("doc_id") % 80).alias("key"))


@query("SELECT DISTINCT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS n, CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END AS b, CASE WHEN l_quantity > 10 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5' ELSE '' END AS f FROM lineitem")
def cell_texts(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(tx.cell_text(q).alias("n"), tx.cell_text(q > 25).alias("b"), tx.cell_text(F.when(q > 10, q + 0.5)).alias("f")).distinct()


@query("""SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN n_name WHEN 1 THEN 'x,' || n_name ELSE n_name END AS warnings FROM nation""")
def added_warnings(spark, sf):
    before = F.when(F.col("n_regionkey") == 1, F.array(F.lit("x"))).when(F.col("n_regionkey") == 2, F.array("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(history.add_warning(before, F.col("n_name")), ",").alias("warnings"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def exports_due(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as id", "o_orderdate as created_at", "if(o_orderstatus = 'F', 'zh', 'en') as target_language",
        "case o_orderkey % 3 when 0 then concat(o_orderkey, '.pdf') when 1 then 'a.pdf.txt' end as export_filename",
    )
    return history.to_export(rows).select("id")


@query("""SELECT n_nationkey, 'lang=' || CASE WHEN n_nationkey % 2 = 0 THEN 'th' ELSE 'en' END || ',name=' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ',page=' || n_regionkey ELSE '' END AS metadata FROM nation""")
def merged_metadata(spark, sf):
    old, new = F.expr("map('name', n_name, 'lang', 'en')"), F.expr("if(n_nationkey % 2 = 0, map('lang', 'th', 'page', cast(n_regionkey as string)), null)")
    said = F.transform(F.array_sort(F.map_entries(history.merge_metadata(old, new))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(said, ",").alias("metadata"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at, CAST(round_even(value, 0) AS BIGINT) AS elapsed_ms FROM events""")
def event_times(spark, sf):
    return table(spark, sf, "events").select("event_id", history.utc_text("ts").alias("at"), history.elapsed_ms(F.lit(0.0), F.col("value") / 1000).alias("elapsed_ms"))
