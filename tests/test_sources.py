import io
import zipfile

from lexigrid.operators import glossary
from lexigrid.sources import files, store


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("one") + "<w:p><w:fldSimple/><w:r><w:t>no</w:t></w:r></w:p>" + p(" ") + p("two")
    return _zip({"word/document.xml": f"<w:document {W}>{body}</w:document>", "word/header1.xml": f"<w:hdr {W}>{p('head')}</w:hdr>", "word/other.xml": "<x/>"})


def _pptx():
    slide = lambda t: f"<a:sld {A}><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:sld>"
    return _zip({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two")})


def _xlsx(rows):
    cell = lambda c, r, v: f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{n}">' + "".join(cell(c, n, v) for c, v in zip("ABCDEF", row) if v is not None) + "</row>" for n, row in rows)
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    return _zip({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="s" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rel, "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{body}</sheetData></worksheet>"})


def test_files_become_segments(spark, tmp_path):
    for name, content in {"a.txt": "中文".encode("gb18030"), "b.docx": _docx(), "c.pptx": _pptx(), "d.docx": b"broken", "e.txt": b"", "f.xyz": b"1"}.items():
        (tmp_path / name).write_bytes(content)
    up = files.uploads(spark, str(tmp_path), limit=10_000)
    assert {r.name for r in up.collect()} == {"a.txt", "b.docx", "c.pptx", "d.docx", "f.xyz"}
    made = spark.createDataFrame([("x/e.txt", 0, bytearray()), ("y.txt", 11_000, bytearray(b"y"))], "path string, length long, content binary")
    assert {r.name: r.rejection for r in files.admit(made, 10_000).collect()} == {"e.txt": "empty", "y.txt": "too_large"}
    got = files.segments(up.where("rejection is null")).collect()
    said = {(r.path.rsplit("/", 1)[-1], r.segment_id): (r.page_number, r.text) for r in got if not r.error}
    assert said == {
        ("a.txt", "text:0"): (1, "中文"),
        ("b.docx", "docx:word/document.xml:0"): (1, "one"), ("b.docx", "docx:word/document.xml:3"): (1, "two"), ("b.docx", "docx:word/header1.xml:0"): (1, "head"),
        ("c.pptx", "pptx:ppt/slides/slide2.xml:0"): (2, "two"), ("c.pptx", "pptx:ppt/slides/slide10.xml:0"): (10, "ten"),
    }
    assert [r.path.rsplit("/", 1)[-1] for r in got if r.error] == ["d.docx"]


def test_workbook_header_and_revised_columns(spark):
    head = ["NO", "Original Text（Thai）", "Translated Text（English）", "Revised Text（English）", "Translated Text（Chinese）", "Revised Text（Chinese）"]
    book = _xlsx([(3, head), (4, ["1", "ท่อ", "Old", "", "旧", "最终中文术语"]), (5, ["2", "ท่อ", "Final English Term", None, None, None]), (6, ["3", None, "x", None, None, None])])
    df = files.glossary_workbooks(spark.createDataFrame([("p", bytearray(book)), ("q", bytearray(b"no"))], "path string, content binary"))
    rows = df.where("error is null").withColumn("source_filename", df.path)
    assert rows.count() == 3 and df.where("error is not null").count() == 1
    ok = rows.where(glossary.multilingual_row_is_valid())
    r = glossary.upsert(ok).first()
    assert ok.count() == 2 and (r.english_text, r.chinese_text) == ("Final English Term", "最终中文术语")


def test_csv_glossary(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("﻿ source_language ,target_language,source_text,translated_text\nTH,zh,อาคาร,建筑\n,,,\nzh,zh,甲,乙\nen,th,\"two\nlines\",สอง\n", encoding="utf-8")
    rows = files.glossary_csv(spark, str(p))
    assert [(r.source_language, r.source_text) for r in rows.orderBy("seq").collect()] == [("th", "อาคาร"), ("zh", "甲"), ("en", "two\nlines")]
    assert rows.where(glossary.directional_row_is_valid()).count() == 2


def test_store_takes_up_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    store.append(spark.createDataFrame([(1,)], "id int"), path)
    store.append(spark.createDataFrame([(2, "x")], "id int, note string"), path)
    assert [(r.id, r.note) for r in store.read(spark, path).orderBy("id").collect()] == [(1, None), (2, "x")]
    e = spark.createDataFrame([("job_started", 2, "a")], "name string, n int, k string")
    assert store.event_lines(e, "name", ["n", "k"]).first()["line"] == 'document_event=job_started fields={"k":"a","n":2}'
    assert store.missing_exports(spark.range(3), spark.range(2)).count() == 1
    assert {"id", "created_at"} <= set(store.with_identity(spark.range(1).toDF("n")).columns)
