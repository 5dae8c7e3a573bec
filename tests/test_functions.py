from pyspark.sql import functions as F

from lexigrid.functions import geometry as g
from lexigrid.functions import text as tx
from lexigrid.functions import unicode_udf as uni


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_numbers_and_digits(spark):
    assert one(spark, tx.translation_text(F.lit("总面积为๓,๓๖๔平方米&#x20;至佛历๒๕๖๗年"))) == "总面积为3,364平方米 至佛历2567年"
    for a, b in (("3.30%", "3.3%"), ("3.30", "3.30%"), ("【第 ๒๑ 页】总面积为๓,๓๖๔平方米", "【第 21 页】总面积为3,364平方米")):
        assert one(spark, tx.quality_warnings(F.lit(a), F.lit(b))) == []
    keys = {"1,000.50": "1000.5", "007": "7", "0": "0", "1.2.3": "1.2.3", "10": "10", "100%": "100"}
    assert {k: one(spark, tx.numeric_key(F.lit(k))) for k in keys} == keys


def test_exact_key_and_romanization():
    assert uni.exact_key(" Ｓtraße　 Ａ ") == "strasse a"
    assert uni.roman("ก") == "K" and uni.roman("a่b") == "aTHb" and uni.roman("กา") == "ka"
    assert uni.reading_similarity("กขค", "กขคงจ") == 3 / 5 and uni.reading_similarity("", "ก") == 0
    assert uni.decoded("中文".encode("gb18030")) == "中文" and uni.decoded(b"\xef\xbb\xbfa") == "a"
    assert uni.thai_key_of("ก่ A", True) == "ก"


def test_cells_and_downloads(spark):
    assert [one(spark, tx.cell_text(F.lit(x))) for x in (None, True, 3.0, " a ")] == ["", "true", "3", "a"]
    assert one(spark, tx.preferred(F.lit(" "), F.lit("t"))) == "t"
    assert one(spark, tx.txt_download(F.lit(" a "))) == "﻿a\n"
    assert one(spark, tx.visual_cache_key(F.lit("A" * 64), F.lit(" ผนัง  1"), F.lit(40.0))) == "a" * 64 + ":ผนัง 1"
    assert one(spark, tx.visual_cache_key(F.lit("xyz"), F.lit("ผนัง"), F.lit(90.0))) is None


def test_matrices_and_points(spark):
    m = F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 5.0, 7.0)))
    assert one(spark, g.multiply_matrices(m, m)) == [1, 0, 0, 1, 10, 14]
    p = one(spark, g.transform_point(m, F.lit(1.0), F.lit(2.0)))
    assert (p.x, p.y) == (6, 9)
    b = one(spark, g.from_tile(g.box(*map(F.lit, (0, 0, 500, 1000))), g.box(*map(F.lit, (100, 0, 300, 50)))))
    assert tuple(b) == (100, 0, 200, 50)
    poly = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((5, 50), (90, 60))))
    tile = g.box(*map(F.lit, (0, 0, 100, 100)))
    assert one(spark, g.touches_inner_edge(poly, tile, F.lit(1000), F.lit(1000))) is False
    assert one(spark, g.touches_inner_edge(g.offset_points(poly, F.lit(5), F.lit(0)), tile, F.lit(1000), F.lit(1000))) is True
