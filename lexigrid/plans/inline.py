"""Small inline tables, the same rows for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

A = "a" * 64
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "pairs": (
        "id int, source string, translated string",
        [
            (1, "总面积为๓,๓๖๔平方米&#x20;至佛历๒๕๖๗年", "Total area 3,364 square metres, year 2567"),
            (2, "【第 ๒๑ 页】总面积为๓,๓๖๔平方米", "【第 21 页】总面积为3,364平方米"),
            (3, "Load 3.30% of 12", "3.3 of 12"),
            (4, "Rooms 1, 2, 3, 4, 5, 6 and 7", "Rooms only"),
            (5, "word " * 30, "short"),
            (6, "No digits at all", "ไม่มีตัวเลข"),
            (7, "Total 1,000.50 and 007", "1000.5 and 7"),
        ],
    ),
    "texts": (
        "id int, text string",
        [
            (1, "中文项目使用 Python FastAPI 和 OpenAI Responses API。" * 5),
            (2, "This is an English sentence about buildings."),
            (3, "อาคารสำนักงาน ชั้น ๒"),
            (4, ""),
            (5, "12345"),
            (6, "  PIPE   Treatment  "),
            (7, "อาคาร building 建筑"),
            (8, "don't stop-me now"),
        ],
    ),
    "page_lines": (
        "page int, pos int, text string",
        [(1, 1, "อาคาร A"), (1, 2, "bc"), (2, 1, "建筑物 level"), (2, 2, "图纸目录一览"), (3, 1, "123"), (4, 1, "Plan"), (4, 2, "ก")],
    ),
    "imports": (
        "seq int, source_language string, target_language string, source_text string, translated_text string, source_filename string",
        [
            (1, "th", "zh", "อาคาร", "建筑", "a.csv"),
            (2, "th", "zh", " อาคาร ", "建筑", "a.csv"),
            (3, "zh", "th", "另一译法", "อาคาร", "b.csv"),
            (4, "zh", "zh", "甲", "乙", "b.csv"),
            (5, "en", "th", "Roof", "หลังคา", "b.csv"),
            (6, "th", "en", "หลังคา", "Roof Deck", "c.csv"),
            (7, "th", "zh", "ผนัง", "", "c.csv"),
            (8, "en", "th", "Wall", "ผนัง", "c.csv"),
        ],
    ),
    "writes": (
        "seq int, th string, zh string, en string, source_filename string",
        [
            (1, "ท่อ", "管道", "", "m1"),
            (2, "ท่อ", "", "PIPE TREATMENT", "m2"),
            (3, " เสา ", "柱", "Column", "m3"),
            (4, "เสา", None, "Pillar", "m4"),
            (5, "คาน", "梁", "Beam", "m5"),
            (6, "คานคอดิน", None, "Beam", "m6"),
        ],
    ),
    "lookup": (
        "id int, text string",
        [(1, "pipe  treatment"), (2, "Column"), (3, "The contractor shall use PIPE TREATMENT."), (4, "Beam"), (5, "pillar"), (6, None)],
    ),
    "marked": (
        "id int, text string",
        [
            (1, "【第 1 页】\nalpha beta\n\n【第 2 页】\ngamma"),
            (2, "no markers here"),
            (3, "【第3页】 x 【第 3 页】 y 【第 10 页】 z"),
        ],
    ),
    "units": (
        "page_number int, pos int, text string, color string, font_size double, x0 double, y0 double, x1 double, y1 double",
        [
            (1, 1, "The first line", "#000", 10.0, 10.0, 10.0, 110.0, 20.0),
            (1, 2, "goes on-", "#000", 10.0, 10.0, 22.0, 100.0, 32.0),
            (1, 3, "here.", "#000", 10.5, 11.0, 34.0, 60.0, 44.0),
            (1, 4, "Heading", "#f00", 16.0, 10.0, 60.0, 90.0, 76.0),
            (1, 5, "• one", "#000", 10.0, 10.0, 90.0, 60.0, 100.0),
            (1, 6, "• two", "#000", 10.0, 10.0, 102.0, 64.0, 112.0),
            (2, 1, "A1", "#000", 10.0, 10.0, 10.0, 40.0, 20.0),
            (2, 2, "B1", "#000", 10.0, 10.0, 35.0, 60.0, 45.0),
            (2, 3, "C1", "#000", 10.0, 11.0, 60.0, 50.0, 70.0),
            (2, 4, "far", "#000", 10.0, 200.0, 85.0, 230.0, 95.0),
        ],
    ),
    "boxes": (
        "page int, id int, rotation int, x0 double, y0 double, x1 double, y1 double",
        [
            (1, 1, 0, 0.0, 0.0, 100.0, 20.0), (1, 2, 0, 50.0, 0.0, 150.0, 20.0), (1, 3, 0, 5.0, 2.0, 60.0, 18.0),
            (1, 4, 90, 300.0, 10.0, 320.0, 90.0), (1, 5, 90, 302.0, 60.0, 318.0, 140.0), (2, 6, 0, 10.0, 10.0, 60.0, 30.0),
            (2, 7, 0, 500.0, 500.0, 500.0, 540.0), (2, 8, 0, 200.0, 200.0, 260.0, 220.0), (2, 9, 0, 255.0, 201.0, 330.0, 219.0),
        ],
    ),
    "covers": (
        "page int, idx int, x0 double, y0 double, x1 double, y1 double",
        [(1, 1, 0.0, 0.0, 90.0, 22.0), (1, 2, 296.0, 0.0, 330.0, 95.0), (2, 3, 195.0, 195.0, 240.0, 225.0), (2, 4, 0.0, 0.0, 30.0, 20.0)],
    ),
    "cells": (
        "page int, x0 double, y0 double, x1 double, y1 double",
        [(1, 0.0, 0.0, 160.0, 30.0), (1, 0.0, 0.0, 110.0, 25.0), (2, 0.0, 0.0, 80.0, 40.0), (2, 190.0, 190.0, 400.0, 230.0)],
    ),
    "fragments": (
        "page int, id int, text string, score double, x0 double, y0 double, x1 double, y1 double",
        [
            (1, 1, "อาคารสำนักงานใหญ่", 0.95, 10.0, 10.0, 210.0, 30.0), (1, 2, "อาคาร", 0.5, 40.0, 32.0, 100.0, 45.0), (1, 3, "ผนง", 0.5, 40.0, 32.0, 100.0, 45.0),
            (1, 4, "ผ", 0.5, 90.0, 42.0, 120.0, 60.0), (1, 5, "plan", 0.9, 40.0, 32.0, 100.0, 45.0), (1, 6, "อาคาร", 0.5, 400.0, 32.0, 460.0, 45.0),
            (2, 7, "อาคารสำนักงานใหญ่", 0.95, 200.0, 10.0, 400.0, 30.0), (2, 8, "อาคาร", 0.5, 240.0, 32.0, 300.0, 45.0),
            (3, 9, "อาคารสำนักงานใหญ่", 0.80, 10.0, 10.0, 210.0, 30.0), (3, 10, "อาคาร", 0.5, 40.0, 32.0, 100.0, 45.0),
        ],
    ),
    "rules": (
        "page int, axis string, pos double, lo double, hi double",
        [
            (1, "h", 0.0, 0.0, 200.0), (1, "h", 30.0, 0.0, 200.0), (1, "v", 0.0, 0.0, 60.0), (1, "v", 120.0, 0.0, 60.0),
            (2, "h", 5.0, 0.0, 400.0), (2, "h", 40.0, 0.0, 400.0), (2, "h", 190.0, 0.0, 300.0), (2, "h", 240.0, 0.0, 300.0),
        ],
    ),
    "profiles": (
        "page int, page_type string, table_like boolean, processing_route string, native_text_complete boolean",
        [
            (1, "vector", False, None, False), (2, "vector_mixed", False, None, True), (3, "image", False, None, False),
            (4, "mixed", False, None, False), (5, "native_text", True, None, True), (6, "text", False, None, True),
            (7, "no_native_text", False, None, False), (8, "image", False, "native_table", False), (9, None, None, "", None),
        ],
    ),
    "counts": (
        "page int, drawings int, images int, units int",
        [(1, 25000, 2, 10), (2, 10, 1, 0), (3, 10, 1, 4), (4, 0, 0, 0), (5, 20000, 0, 0)],
    ),
    "uploads": (
        "id int, name string, text string, ocr_pages int, has_visual boolean",
        [
            (1, "a.txt", "x" * 50001, 0, False), (2, "b.docx", "x" * 50001, 0, False), (3, "c.pdf", "  ", 0, False),
            (4, "d.pdf", "", 51, True), (5, "e.pdf", "", 0, True), (6, "f.md", "fine", 0, False),
        ],
    ),
    "hints": (
        "id int, source_hint string, source_confidence double, read string, x0 double, y0 double, x1 double, y1 double",
        [
            (1, "W6 ผนัง 123", 82.0, "WALL", 0.0, 0.0, 50.0, 10.0), (2, "งจจงจ", 64.0, "[NO_TEXT]", 0.0, 0.0, 50.0, 10.0),
            (3, "ผนัง", 48.0, "", 0.0, 0.0, 30.0, 30.0), (4, "ก๑", 90.0, "[no_text]", 0.0, 0.0, 20.0, 70.0),
            (5, "A1 ๒", 10.0, "ผนัง", 0.0, 0.0, 36.0, 36.0), (6, None, None, None, 0.0, 0.0, 0.0, 5.0),
        ],
    ),
    "labels_text": (
        "id int, text string",
        [
            (1, "A - 12 Ground floor plan"), (2, "ST05-02 ดูแบบ"), (3, "no code"), (4, "พ12 ผนัง"), (5, "WO ผนังL"),
            (6, "ก ข ค  A 1"), (7, "Plan MECHANICAL ENGINEER"), (8, "建筑 图"), (9, "a"), (10, "12 34"), (11, "ST–1–2图纸"),
        ],
    ),
    "tsv": (
        "image int, text string, conf double, left int, top int, width int, height int, block_num string, par_num string, line_num string",
        [
            (1, "world", 90.0, 60, 10, 40, 12, "1", "1", "1"), (1, "hello", 80.0, 10, 11, 40, 12, "1", "1", "1"),
            (1, "x", 20.0, 1, 1, 5, 5, "1", "1", "1"), (1, "next", 70.0, 10, 40, 30, 10, "1", "1", "2"),
            (1, " ", 99.0, 10, 60, 30, 10, "1", "1", "3"), (1, "dot", 99.0, 10, 60, 2, 10, "1", "1", "4"), (2, "only", 50.0, 0, 0, 200, 100, "1", "1", "1"),
        ],
    ),
    "asked": ("req int, id string", [(1, "R001"), (1, "R002"), (1, "R003"), (2, "R001"), (3, "R009")]),
    "returned": ("req int, id string", [(1, "R001"), (1, "R003"), (1, "R003"), (1, "R777"), (2, "R001"), (3, "")]),
    "requests": (
        "run int, phase string, started_ms int, elapsed_ms int, status string, request_bytes int",
        [
            (1, "read", 0, 100, "ok", 10), (1, "read", 50, 100, "error", None), (1, None, 100, 50, "ok", 5), (1, "text", 150, 10, "ok", 7),
            (2, "", 5, 5, "ok", 1), (2, "read", 10, 5, "ok", 1),
        ],
    ),
    "snapshots": (
        "job int, t double, status string, stage string, completed_pages int, total_pages int",
        [
            (1, 0.5, "processing", "parse", 0, 4), (1, 1.0, "processing", "parse", 0, 4), (1, 2.5, "processing", "text", 1, 4),
            (1, 4.0, "processing", "text", 3, 4), (1, 5.0, "completed", "done", 4, 4), (2, 1.0, "processing", "parse", 0, 3), (2, 9.0, "failed", "parse", 0, 3),
        ],
    ),
    "bodies": (
        "id int, body string",
        [
            (1, '```json {"items":[{"id":"R1","source_text":"a","translated_text":"b"},{"id":"R2","source_text":"c"}]} ```'),
            (2, 'Sure: {"translations":{"s1":"one","s2":"2"}} done'),
            (3, '{"items":[]}'),
        ],
    ),
    "attempts": (
        "id int, seq int, status string, stage string, total_pages int, completed_pages int",
        [
            (1, 1, "processing", "uploaded", None, 0), (1, 2, None, "parsed", 10, None), (1, 3, None, None, None, 4), (1, 4, "completed", "done", None, 10),
            (2, 1, "processing", "uploaded", None, 0), (2, 2, "failed", None, None, None),
        ],
    ),
    "retries": (
        "id int, retry_after string, attempt int, status int, message string",
        [(1, "5", 0, 429, "queue"), (2, "x", 3, 500, "request timed out"), (3, None, 9, 404, ""), (4, "99", 1, 500, "bad"), (5, "0", 1, 401, None)],
    ),
    "directions": ("id int, s string, t string", [(1, "auto", "zh"), (2, "th", "th"), (3, "en", "fr"), (4, "zh", "en"), (5, "xx", "th")]),
    "days": ("id int, kind string, n int", [(1, "a", 1), (2, "b", 2), (3, "a", 3)]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values(name: str) -> str:
    """The table as a SQL subquery."""
    schema, rows = TABLES[name]
    names = ", ".join(f'"{c.split()[0]}"' for c in schema.split(", "))
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


def fill(sql: str) -> str:
    """SQL with every @name replaced by the inline table."""
    for name in sorted(TABLES, key=len, reverse=True):
        sql = sql.replace(f"@{name}", values(name))
    return sql
