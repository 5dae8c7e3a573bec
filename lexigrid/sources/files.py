"""File sources: admitted uploads, text, office documents, glossaries, OCR tables.

Files are read by Spark's binary reader from any store; parsing is a vectorized map over whole files, so a file that
can't be read becomes a row with an error and never ends the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.text import base_name, strip, suffix
from lexigrid.functions.unicode_udf import decoded, exact_key

# Limits of uploads and of spreadsheet archives, name spaces, header names.
MAX_BYTES, SHEET_BYTES, SHEET_UNPACKED, SHEET_PARTS, HEADER_ROWS, SHEET_ROWS = 200 << 20, 10 << 20, 100 << 20, 5000, 20, 10_000
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
HEADERS = {
    "thai": ("originaltextthai", "originalthai", "thaitext", "thai", "ภาษาไทย"),
    "english_translated": ("translatedtextenglish", "translatedenglish", "englishtext", "english"),
    "english_revised": ("revisedtextenglish", "revisedenglish"),
    "chinese_translated": ("translatedtextchinese", "translatedchinese", "chinesetext", "chinese", "中文"),
    "chinese_revised": ("revisedtextchinese", "revisedchinese", "修订中文"),
}
SEGMENT = "path string, segment_id string, page_number int, text string, part_name string, paragraph_index int, error string"


def uploads(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """The admitted and rejected files of a folder.  Spark's scan itself leaves out files of no bytes."""
    return admit(spark.read.format("binaryFile").load(path), limit)


def admit(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """(path, name, suffix, length, content, sha256, rejection): rejection is ``empty``, ``too_large`` or null."""
    bad = F.when(F.col("length") == 0, "empty").when(F.col("length") > limit, "too_large")
    return files.select(
        "path", base_name("path").alias("name"), suffix("path").alias("suffix"), "length",
        "content", F.sha2("content", 256).alias("sha256"), bad.alias("rejection"),
    )


def reader_for() -> Column:
    """Which reader a suffix calls for; null for none."""
    return F.when(F.col("suffix").isin(".txt", ".md"), "text").when(F.col("suffix").isin(".docx", ".pptx", ".pdf"), F.substring("suffix", 2, 9))


def _paragraphs(root, name_space: str, field: str) -> Iterator[tuple[int, str]]:
    """Number and text of the paragraphs with text; those with field codes count but are left out."""
    for i, p in enumerate(root.iter(f"{name_space}p")):
        if any(x.tag in field.split() for x in p.iter()):
            continue
        text = "".join(t.text or "" for t in p.iter(f"{name_space}t")).strip()
        if text:
            yield i, text


_FIELDS = f"{WORD}fldChar {WORD}fldSimple {WORD}instrText"


def docx_segments(content: bytes) -> Iterator[tuple[str, int, str, str, int]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "word/document.xml" not in names:
            raise ValueError("no document part")
        more = sorted(n for n in names if re.match(r"^word/(?:header\d+|footer\d+|footnotes|endnotes)\.xml$", n))
        for part in ["word/document.xml", *more]:
            for i, text in _paragraphs(ElementTree.fromstring(z.read(part)), WORD, _FIELDS):
                yield f"docx:{part}:{i}", 1, text, part, i


def pptx_segments(content: bytes) -> Iterator[tuple[str, int, str, str, int]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.match(r"^ppt/slides/slide(\d+)\.xml$", n)))
        if not slides:
            raise ValueError("no slides")
        for page, part in slides:
            for i, text in _paragraphs(ElementTree.fromstring(z.read(part)), DRAWING, f"{DRAWING}fld"):
                yield f"pptx:{part}:{i}", page, text, part, i


def text_segments(content: bytes) -> Iterator[tuple[str, int, str, None, int]]:
    text = decoded(content)
    if text is None:
        raise ValueError("unknown encoding")
    if text.strip():
        yield "text:0", 1, text, None, 0


READERS = {"text": text_segments, "docx": docx_segments, "pptx": pptx_segments}


def segments(files: DataFrame) -> DataFrame:
    """Segments of uploads (path, suffix, content); a file that can't be read gives one row with its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind, content in zip(b.path, b.kind, b.content, strict=True):
                try:
                    rows += [(path, *s, None) for s in READERS[kind](bytes(content))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "segment_id", "page_number", "text", "part_name", "paragraph_index", "error"]).astype(
                {"page_number": "Int32", "paragraph_index": "Int32"}
            )

    known = files.withColumn("kind", reader_for()).where(F.col("kind").isin(*READERS))
    return known.select("path", "kind", "content").mapInPandas(parse, SEGMENT)


def _cells(content: bytes) -> Iterator[tuple[str, list[list]]]:
    """(sheet name, rows of cell values) of a workbook, read from its parts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if len(z.infolist()) > SHEET_PARTS or sum(i.file_size for i in z.infolist()) > SHEET_UNPACKED:
            raise ValueError("workbook too complex")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            target = targets[s.get(f"{RELATION}id")].lstrip("/")
            rows: list[list] = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{SHEET}row"):
                at = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(at - 1 - len(rows))]
                out: list = []
                for c in row.iter(f"{SHEET}c"):
                    col = 0
                    for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                        col = col * 26 + ord(ch) - 64
                    out += [None] * (col - 1 - len(out)) if col else []
                    v, kind = c.find(f"{SHEET}v"), c.get("t")
                    value = v.text if v is not None else None
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                    elif kind == "b":
                        value = "true" if value == "1" else "false"
                    elif kind in (None, "n") and value and re.fullmatch(r"-?\d+\.0*", value):
                        value = value.split(".")[0]
                    out.append(value)
                rows.append(out)
            yield s.get("name"), rows


def _header(rows: list[list]) -> tuple[int, dict[str, int]] | None:
    for n, row in enumerate(rows[:HEADER_ROWS]):
        found: dict[str, int] = {}
        for i, v in enumerate(row):
            name = "".join(c for c in exact_key(str(v or "")) if c.isalnum())
            for f, known in HEADERS.items():
                if name and name in known:
                    found.setdefault(f, i)
        if "thai" in found and len(found) > 1:
            return n, found
    return None


def xlsx_glossary(content: bytes) -> list[dict]:
    """Rows (th, zh, en) of the sheets whose header is known; a revised text goes before a translated one."""
    if len(content) > SHEET_BYTES:
        raise ValueError("workbook too large")
    out, known = [], False
    for _, rows in _cells(content):
        head = _header(rows)
        if not head:
            continue
        known = True
        n, cols = head
        get = lambda row, f: str(row[cols[f]] or "").strip() if f in cols and cols[f] < len(row) else ""  # noqa: B023, E731
        for row in rows[n + 1 :]:
            if any(str(v or "").strip() for v in row):
                out.append({"th": get(row, "thai"), "zh": get(row, "chinese_revised") or get(row, "chinese_translated"), "en": get(row, "english_revised") or get(row, "english_translated")})
    if not known:
        raise ValueError("no known header")
    if len(out) > SHEET_ROWS:
        raise ValueError("too many rows")
    return out


def glossary_workbooks(files: DataFrame) -> DataFrame:
    """(path, seq, th, zh, en, error) of workbooks (path, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    rows += [(path, i, r["th"], r["zh"], r["en"], None) for i, r in enumerate(xlsx_glossary(bytes(content)))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "seq", "th", "zh", "en", "error"])

    return files.select("path", "content").mapInPandas(parse, "path string, seq long, th string, zh string, en string, error string")


def glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a UTF-8 CSV glossary, header names trimmed, with a seq in file order; blank rows don't count."""
    raw = spark.read.csv(path, header=True, multiLine=True, mode="PERMISSIVE", encoding="UTF-8")
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    need = ["source_language", "target_language", "source_text", "translated_text"]
    lacking = [c for c in need if c not in names]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    rows = raw.select(*(strip(F.coalesce(F.col(f"`{names[c]}`"), F.lit(""))).alias(c) for c in need))
    rows = rows.where(F.concat(*need) != "").withColumn("seq", F.monotonically_increasing_id())
    return rows.select(F.lower("source_language").alias("source_language"), F.lower("target_language").alias("target_language"), "source_text", "translated_text", "seq")


def ocr_lines(words: DataFrame, image: str, least: float = 35.0) -> DataFrame:
    """Lines from OCR words (image, text, conf, left, top, width, height, block_num, par_num, line_num).

    Words too unsure or too thin go; a line joins its words from left to right; boxes are in thousandths of the extent of
    the image's words.
    """
    ok = words.where((strip("text") != "") & (F.col("conf") >= least) & (F.col("width") > 1) & (F.col("height") > 1))
    ok = ok.select("*", (F.col("left") + F.col("width")).alias("right"), (F.col("top") + F.col("height")).alias("bottom"))
    line = ok.groupBy(image, "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", F.col("top").alias("t"), strip("text").alias("text")))), lambda x: x["text"]), " ").alias("source_text"),
        F.avg("conf").alias("confidence"), F.min("left").alias("l"), F.min("top").alias("t"), F.max("right").alias("r"), F.max("bottom").alias("b"),
    )
    extent = ok.groupBy(image).agg(F.max("right").alias("w"), F.max("bottom").alias("h"))
    scaled = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.col(v) / F.col(n) * 1000.0))
    out = line.join(extent, image).where("r - l >= 3 and b - t >= 3")
    return out.select(image, "source_text", "confidence", scaled("l", "w").alias("x0"), scaled("t", "h").alias("y0"), scaled("r", "w").alias("x1"), scaled("b", "h").alias("y1"))
