import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexigrid.functions import geometry as g
from lexigrid.operators import glossary, history, provider, reports, responses, routing, segments, similar, spatial


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_blank_never_clears_and_items_are_kept(spark):
    first = glossary.upsert(spark.createDataFrame([(1, "ท่อ", "管", "Pipe", "a")], "seq int, th string, zh string, en string, source_filename string"))
    then = glossary.upsert(spark.createDataFrame([(2, " ท่อ ", " ", "Tube", "b")], "seq int, th string, zh string, en string, source_filename string"), first)
    r = then.first()
    assert (r.chinese_text, r.english_text, r.created_seq, r.updated_seq, r.source_filename) == ("管", "Tube", 1, 2, "b")
    assert rows(glossary.import_counts(spark.createDataFrame([(1, "th", "zh", "ท่อ", "管", "f")], "seq int, source_language string, target_language string, source_text string, translated_text string, source_filename string"), first)) == [(1, 0, 0, 1)]


def test_containment_is_not_word_bounded_and_covers_short_terms(spark):
    texts = spark.createDataFrame([(1, "the contractor shall use pipe treatment here."), (2, "xabcy"), (3, "")], "id int, text_key string")
    terms = spark.createDataFrame([(1, "contractor shall use pipe"), (2, "ipe treat"), (3, "bc"), (4, ""), (5, "shall not use")], "t int, term_key string")
    assert rows(glossary.containment_join(texts, terms).select("id", "t"), "id", "t") == [(1, 1), (1, 2), (2, 3)]


def test_context_block(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b" * 50), (1, 3, "c")], "id int, rank int, line string")
    kept = glossary.within_budget(ranked, "id", F.col("line"), 10)
    assert glossary.context_block(kept, "id").first()["context"].endswith("：\na")


def test_partial_updates(spark):
    state = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    patch = spark.createDataFrame([(1, None, 9), (3, "x", 1)], "id int, s string, n int")
    assert rows(history.apply_update(state, patch, "id", ["s", "n"]), "id") == [(1, "a", 9), (2, "b", 2)]
    w = spark.range(1).select(history.add_warning(F.array(F.lit("x")), F.lit("x")), history.add_warning(F.lit(None).cast("array<string>"), F.lit("y")))
    assert tuple(w.first()) == (["x"], ["y"])
    h = spark.createDataFrame([(1, "zh", "b.pdf", 2), (2, "zh", "a.pdf", 1), (3, "en", "c.pdf", 0), (4, "zh", "d.txt", 0)], "id int, target_language string, export_filename string, created_at int")
    assert [r.id for r in history.to_export(h).collect()] == [2, 1]


def test_unknown_stored_route_is_an_error(spark):
    pages = spark.createDataFrame([(1, "image", False, "nowhere", False)], "page int, page_type string, table_like boolean, processing_route string, native_text_complete boolean")
    with pytest.raises(PySparkException):
        routing.plan_pages(pages).collect()


def test_profile_warnings_and_writers(spark):
    pages = spark.createDataFrame([("d", 1, True, False, 0, 0, 0), ("d", 2, False, True, 3, 7, 2), ("d", 3, False, True, 0, 0, 0)], "document string, page_number int, visual_required boolean, native_text_complete boolean, text_blocks int, preserved_source_chars int, protected_logo_source_chars int")
    got = {r.kind: r.pages for r in routing.profile_warnings(pages).collect()}
    assert got == {"visual": "1", "preserved": "2:5", "logo": "2:2", "no_text_layer": "3"}
    segs = spark.createDataFrame([(1, True, "x", "outline"), (2, True, "x", None), (3, False, "native", "text-layer"), (4, None, "native", None)], "id int, visual boolean, source_kind string, engine string")
    assert [r[0] for r in segs.orderBy("id").select(routing.segment_route()).collect()] == ["outline", "layout", "text_layer", "native"]


def test_acceptance_gates(spark):
    df = spark.createDataFrame([(1, "ผนัง", 0.7), (2, "ก", 0.7), (3, "ก", 0.8), (4, "wall", 0.9)], "id int, t string, s double")
    box = g.box(*map(F.lit, (0, 0, 50, 10)))
    got = df.orderBy("id").select(routing.is_acceptable("t", "s", box, F.lit(0)), routing.covers_seed("t", "s", box, F.lit(0)), routing.is_acceptable("t", "s", box, F.lit(90)))
    assert [tuple(r) for r in got.collect()] == [(True, True, False), (False, False, False), (True, True, False), (False, False, False)]


def test_greedy_folds(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, "a"), (1, 1.0, 0.0, 11.0, 10.0, "a"), (1, 1.0, 0.0, 11.0, 10.0, "b"), (2, 0.0, 0.0, 5.0, 5.0, "a")], "page int, x0 double, y0 double, x1 double, y1 double, t string")
    assert spatial.suppress(b, "page", ["y0", "x0"], 0.5).count() == 2
    assert spatial.suppress(b, "page", ["y0", "x0"], 0.5, ["t"]).count() == 3
    ocr = spark.createDataFrame([(1, "ผนัง", (0.0, 0.0, 50.0, 10.0)), (1, "wall", (0.0, 50.0, 50.0, 60.0)), (1, "ประตู", (0.0, 90.0, 50.0, 100.0))], "page int, source_text string, bbox struct<x0: double, y0: double, x1: double, y1: double>")
    seen = spark.createDataFrame([(1, (0.0, 0.0, 60.0, 12.0))], "page int, bbox struct<x0: double, y0: double, x1: double, y1: double>")
    assert [r.source_text for r in spatial.uncovered_ocr(ocr, seen, "page").collect()] == ["ประตู"]
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.3)], "page int, l int, r int, s double")
    assert rows(similar.match_one_to_one(pairs, "page", "l", "r", "s", 0.5).select("l", "r")) == [(1, 1)]
    lines = [(1, 0.0, 10.0 * i, 300.0, 10.0 * i) for i in range(12)] + [(1, x, 0.0, x, 110.0) for x in (0.0, 100.0, 300.0)]
    found = spatial.dense_table_regions(spark.createDataFrame(lines, "page int, x0 double, y0 double, x1 double, y1 double"), "page", 400.0, 300.0)
    assert rows(found) == [(1, 0.0, 0.0, 302.0, 122.0)]


def test_ring_and_cells(spark):
    import math

    ring = [(1, i, 45.0 * i, (10 * math.cos(i), 10 * math.sin(i), 10 * math.cos(i) + 2, 10 * math.sin(i) + 2)) for i in range(8)] + [(1, 99, 0.0, (500.0, 500.0, 502.0, 502.0))]
    df = spark.createDataFrame(ring, "page int, id int, angle double, bbox struct<x0: double, y0: double, x1: double, y1: double>")
    assert sorted(r.id for r in spatial.ring_members(df, "page", "id", 2000.0, 2000.0).collect()) == list(range(8))
    cells = spark.createDataFrame([(1, 1, "b", "B", 9.0, (0.0, 5.0, 4.0, 9.0)), (1, 1, "a", "A", 8.0, (0.0, 0.0, 5.0, 4.0)), (1, 1, "a2", "a", 7.0, (0.0, 9.0, 5.0, 12.0))], "page int, cell int, text string, translated_text string, font_size double, bbox struct<x0: double, y0: double, x1: double, y1: double>").withColumn("y", F.col("bbox.y0"))
    r = spatial.coalesce_cells(cells, ["page", "cell"], ["y"]).first()
    assert (r.translated_text, r.text, r.n_kept, r.font_size) == ("A\nB", "a\nb", 2, 8.0)
    recall = spatial.covered_by_translation(df.where("id = 99"), df.where("id = 99").select("page", "bbox"), "page", "id")
    assert recall.count() == 1


def test_responses(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c.alias("v")).first()["v"]
    assert one(responses.strict_object("b"), b='{"a": 1, "a": 2}') is None
    assert one(responses.strict_object("b"), b='x ```json {"a": [1]} ```') == '{"a": [1]}'
    assert one(responses.responses_text("b"), b='{"output":[{"content":[{"type":"output_text","text":"x"},{"type":"other","text":"n"}]},{"content":[{"type":"output_text","text":"y"}]}]}') == "x\ny"
    assert one(responses.responses_text("b"), b='{"output_text":"z","output":[]}') == "z"
    assert one(responses.chat_text("b"), b='{"choices":[{"message":{"content":[{"text":"p"},{"text":"q"}]}}]}') == "p\nq"
    assert one(responses.chat_text("b"), b='{"choices":[{"message":{"content":"s"}}]}') == "s"
    body = '{"blocks":[{"source_text":"a","translated_text":"b","bbox":[-5,0,1200,10]},{"source_text":"a","translated_text":"b","bbox":[5,0,1,10]},{"source_text":"","translated_text":"b","bbox":[0,0,1,1]},{"source_text":"a","translated_text":"b","bbox":["x",0,1,1]}]}'
    assert rows(responses.layout_blocks(spark.createDataFrame([(1, body)], "k int, body string"), "k", "body")) == [(1, "a", "b", 0.0, 0.0, 1000.0, 10.0)]
    votes = spark.createDataFrame([("R1", 1, "WALL"), ("R1", 2, "DOOR"), ("R1", 3, "WALL"), ("R2", 1, "ผนัง"), ("R2", 2, "ผนัง")], "id string, n int, t string")
    assert rows(responses.reading_votes(votes, "id", "n", "t")) == [("R1", "WALL")]
    parts = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["a", "b"]), (1, 3, ["c", "d"])], "k int, seq int, items array<string>")
    assert rows(responses.longest_partial(parts, "k", "items", "seq")) == [(1, ["a", "b"])]


def test_provider_contract(spark):
    provider.register("upper", lambda df: df.withColumn("translated_text", F.upper("text")))
    df = spark.createDataFrame([("en", "zh", "room 12"), ("en", "zh", "room 12")], "source_language string, target_language string, text string")
    assert {r.translated_text for r in provider.translate(df, "upper").collect()} == {"ROOM 12"}
    assert provider.translate(df, "upper").count() == 2


def test_reading_scores_and_groups(spark):
    a = spark.createDataFrame([(1, ["x", "y"])], "k int, ids array<string>")
    b = spark.createDataFrame([(1, ["x"])], "k int, ids array<string>")
    assert [r.ok for r in reports.reading_scores(a, b, "k").orderBy("pos").collect()] == [True, False]
    lines = spark.createDataFrame([(1, i, 0, False, False, 10.0, (0.0, 12.0 * i, 50.0, 12.0 * i + 10)) for i in range(3)] + [(1, 3, 0, True, False, 10.0, (0.0, 40.0, 50.0, 50.0))], "page int, pos int, rotation int, bold boolean, italic boolean, font_size double, bbox struct<x0: double, y0: double, x1: double, y1: double>")
    got = segments.islands(lines, ["page"], ["pos"], segments.same_group())
    assert [r.island for r in got.orderBy("pos").collect()] == [1, 1, 1, 2]


def test_fragments_of_phrases(spark):
    df = spark.createDataFrame([(1, 1, "กขคงจฉชซฌ", 0.9, 0.0, 0.0, 400.0, 20.0), (1, 2, "กขค", 0.5, 10.0, 5.0, 60.0, 30.0), (1, 3, "ฮฮฮ", 0.5, 10.0, 5.0, 60.0, 30.0)], "page int, id int, text string, score double, x0 double, y0 double, x1 double, y1 double")
    assert rows(similar.fragments_of_phrases(df, "page", "id", 600.0)) == [(2,)]


def test_fragments_against_a_plain_version(spark):
    """All pairs of a page, the phrase only in the outer 15 % of it."""
    from difflib import SequenceMatcher

    import re

    from lexigrid.plans.inline import TABLES
    from lexigrid.plans.registry import QUERIES

    want = set()
    own = [dict(zip(("page", "id", "text", "score", "x0", "y0", "x1", "y1"), r, strict=True)) for r in TABLES["fragments"][1]]
    thai, cons = (lambda t: re.findall("[\u0e00-\u0e7f]", t)), (lambda t: "".join(re.findall("[\u0e01-\u0e2e]", t)))
    for f in own:
        for q in own:
            w, h, qw, qh = f["x1"] - f["x0"], f["y1"] - f["y0"], q["x1"] - q["x0"], q["y1"] - q["y0"]
            phrase = len(thai(q["text"])) >= 8 and q["score"] >= 0.85 and qw >= 3 * qh and (q["x0"] <= 90 or q["x1"] >= 510)
            if not phrase or f is q or f["page"] != q["page"] or not 0 < len(thai(f["text"])) < len(thai(q["text"])):
                continue
            if min(f["x1"], q["x1"]) - max(f["x0"], q["x0"]) < w * 0.6 or w > qw * 0.45 or f["y0"] < q["y0"] - qh * 0.5 or f["y1"] > q["y1"] + qh * 3.5:
                continue
            a, b = cons(f["text"]), cons(q["text"])
            met = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            known = sum(c in thai(q["text"]) for c in thai(f["text"])) / len(thai(f["text"]))
            arc = w <= qw * 0.25 and h <= qh * 1.75 and f["x0"] >= q["x0"] + qw * 0.18 and f["x1"] <= q["x1"] - qw * 0.18
            arc = arc and q["y1"] + qh * 0.45 <= f["y0"] and f["y1"] <= q["y1"] + qh * 3.75
            if known >= 0.7 and met / max(1, len(a)) >= 0.65 or arc:
                want.add(f["id"])
    assert {r.id for r in QUERIES["phrase_fragments"](spark, "").collect()} == want == {2, 4}


def test_glossary_key_is_normalized_and_folded(spark):
    import unicodedata

    from lexigrid.functions import text as tx

    texts = ["ＰＩＰＥ　ｔｒｅａｔｍｅｎｔ", "ﬁre Straße", "ÀÉ ö x\t y ", "น้ำ ทำ", "①½ ²", "ΑΣ İI", "建筑 图纸", "", None, "a\x1cb", "\u00a0x\u3000", "µ", "가", "x" * 5000 + "Ǆ"]
    got = {r.text: r.k for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.glossary_key("text").alias("k")).collect()}
    assert got == {t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).strip().casefold().split()) for t in texts}
    every = [chr(c) for c in range(0x20, 0x3000) if chr(c).isprintable()]
    df = spark.createDataFrame([(i, "a" + c + "b") for i, c in enumerate(every)], "i int, text string")
    for r in df.select("text", tx.glossary_key("text").alias("k")).collect():
        assert r.k == " ".join(unicodedata.normalize("NFKC", r.text).strip().casefold().split()), repr(r.text)
