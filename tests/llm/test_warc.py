import hashlib
import io
import random

import pytest
from oracle import both
from pyspark.sql import functions as F

from lexigrid.llm import queries, warc

PAGES = "page_id long, url string, html string"


def records(n=30, seed=1):
    r = random.Random(seed)
    return [warc.make_record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>"}, bytes(r.choices(b"abcdefgh", k=r.randint(100, 4000)))) for i in range(n)]


def read(raw):
    return list(warc.salvage(io.BytesIO(raw)))


def names(found):
    return [x.headers["WARC-Record-ID"] for x in found if isinstance(x, warc.Record)]


def covers(found, size):
    """Records and gaps lie end to end over the whole file."""
    at = 0
    for x in found:
        assert x.offset == at and x.length > 0
        at += x.length
    assert at == size


def test_whole_archive():
    parts = records()
    found = read(b"".join(parts))
    assert names(found) == [f"<urn:page:{i}>" for i in range(30)]
    covers(found, sum(map(len, parts)))


@pytest.mark.parametrize("seed", range(8))
def test_damage_costs_only_the_records_it_hits(seed):
    r = random.Random(seed)
    parts = records(seed=seed)
    raw = bytearray(b"".join(parts))
    ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    hit = set(r.sample(range(30), 4))
    for k in hit:
        start = ends[k] - len(parts[k])
        for j in range(start, min(start + 12, ends[k])):  # the member's head
            raw[j] ^= 0xA5
    found = read(bytes(raw))
    assert names(found) == [f"<urn:page:{i}>" for i in range(30) if i not in hit]
    assert sum(isinstance(x, warc.Gap) for x in found) >= 1
    covers(found, len(raw))


def test_cut_file_junk_and_plain_records():
    parts = records(5)
    whole = b"".join(parts)
    found = read(whole[:-7])
    assert names(found) == [f"<urn:page:{i}>" for i in range(4)] and isinstance(found[-1], warc.Gap)
    covers(found, len(whole) - 7)
    found = read(b"junk\x1f\x8b\x08" + whole + b"\x00" * 10)
    assert len(names(found)) == 5 and isinstance(found[0], warc.Gap) and isinstance(found[-1], warc.Gap)
    import gzip

    plain = b"".join(gzip.decompress(p) for p in parts)
    assert len(names(read(plain))) == 5
    broken = plain.replace(b"Content-Length: ", b"Content-Length: x", 1)
    found = read(broken)
    assert len(names(found)) == 4
    covers(found, len(broken))
    assert read(b"") == []
    wrong = gzip.compress(gzip.decompress(parts[0]).replace(b"sha256:", b"sha256:0", 1))
    assert [x.reason for x in read(wrong)] == ["block digest differs"]


def test_query_and_sql(spark):
    a, b = both(spark, queries.QUERIES["op10_warc"], queries.ORACLES["op10_warc"])
    assert a == b


def test_archives_by_rows(spark, tmp_path):
    long = "x" * 300_000
    made = [(1, "u", long), (2, "u\r\nInjected: 1", long), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", long), (2, "u", long), (7, "u", "é" * 50)]
    df = spark.createDataFrame(made, PAGES)
    folder = f"file://{tmp_path}/arc"
    manifest = warc.write_archives(warc.with_revisits(df), folder, file_bytes=1000)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(made)
    back = warc.read_archives(manifest, folder).collect()
    assert {r.kind for r in back} == {"record"}
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in back)
    assert ("<urn:page:2>", "revisit", "<urn:page:1>") in kinds and ("<urn:page:1>", "response", None) in kinds
    assert sum(k[1] == "revisit" for k in kinds) == 2
    assert {r.payload_digest for r in back if r.record_id == "<urn:page:7>"} == {hashlib.sha256(("é" * 50).encode()).hexdigest()}
    path = next(tmp_path.rglob("*.warc.gz"))
    path.write_bytes(path.read_bytes()[5:])
    again = warc.read_archives(manifest, folder).collect()
    assert sum(r.kind == "gap" for r in again) == 1


def test_lost_records_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * (200 + i)) for i in range(5)], PAGES)
    folder = f"file://{tmp_path}/arc"
    manifest = warc.write_archives(warc.with_revisits(df.coalesce(1)), folder)
    path = next(tmp_path.rglob("*.warc.gz"))
    raw = path.read_bytes()
    path.write_bytes(raw[:-9])
    assert {r.kind for r in warc.read_archives(manifest, folder).collect()} == {"record", "gap"}
    with pytest.raises(Exception, match="has 4 records of 5"):
        warc.read_archives(manifest, folder, whole=True).collect()
    path.unlink()
    with pytest.raises(Exception, match="arc"):
        warc.read_archives(manifest, folder).collect()


def test_odd_ids_and_clashing_columns(spark, tmp_path, monkeypatch):
    body = "long enough a page to be revisited, " * 5
    ids = ["None", None, "a b+c", " x ", "%41", "\r\n", "é>", "None"]
    df = spark.createDataFrame([(i, "u v\n w", body) for i in ids], "page_id string, url string, html string")
    df = df.select("*", *(F.lit(1).alias(c) for c in ("payload", "payload_digest", "first", "copies", "kind", "n")))
    monkeypatch.setattr(warc, "table", lambda spark, d, name: df)
    got = warc.op10_warc(spark, "").collect()
    assert sorted(map(repr, (r.page_id for r in got))) == sorted(map(repr, ids))
    assert {r.refers_to for r in got if r.page_id not in (None, " x ", "\r\n")} == {"\r\n"}
    assert {r.record_type for r in got if r.page_id in (None, "\r\n")} == {"response"}


def test_records_that_end_at_the_edge_of_a_block(monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "BLOCK", 1000)
    for left in range(1, 8):
        head = gzip.decompress(warc.make_record({"WARC-Record-ID": "<a>"}, b""))
        first = gzip.decompress(warc.make_record({"WARC-Record-ID": "<a>"}, b"x" * (3000 - left - len(head) - 3)))
        raw = first + gzip.decompress(warc.make_record({"WARC-Record-ID": "<b>"}, b"y" * 50))
        found = read(raw)
        assert names(found) == ["<a>", "<b>"], left
        covers(found, len(raw))


def test_long_plain_records_take_one_pass():
    import gzip
    import time

    raw = gzip.decompress(warc.make_record({"WARC-Record-ID": "<a>"}, b"x" * (200 << 20)))
    began = time.perf_counter()
    assert names(read(raw)) == ["<a>"]
    assert time.perf_counter() - began < 10


def test_empty_pages(spark, tmp_path):
    folder = f"file://{tmp_path}/arc"
    assert warc.read_archives(warc.write_archives(warc.with_revisits(spark.createDataFrame([], PAGES)), folder), folder).count() == 0
