"""WARC archives: a writer with content-addressed revisits, and a reader that salvages damaged files.

Writing.  Each task streams its records, one gzip member each, into files of about ``FILE_BYTES``, under names of the
attempt's own, so no attempt writes over another's files.  Files go to a folder that executors share, through a file
system found by the path's scheme.  The result is the manifest: it names the files of the attempts that were committed,
with their numbers of records, and readers hold the files against it.

Reading.  A file is read in blocks.  A record must have a version line, a header block, a Content-Length that fits, the
closing blank lines and, where it states one, a matching block digest.  After a failed check the reader looks for the
next gzip member that opens (or version line, in a plain file) and goes on from there; the bytes in between become a
row of kind ``gap`` with their offset, length and reason, so nothing is skipped silently.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import bounded_batches, fresh_path, parallelism, slices, stage, table

FILE_BYTES = 32 << 20
BLOCK = 1 << 20
#: Smaller payloads are always written in full.
REVISIT_BYTES = 100
#: Digests that may be broadcast: half a million take some 64 MB.
BROADCAST_DIGESTS = 500_000
#: A header block is looked for so far.
HEADER_BYTES = 64 << 20
#: No block may be longer: Spark has no longer value, so the writer can't be handed one.
RECORD_BYTES = 1 << 31
# The markers of the two formats.
VERSION, MEMBER, END = b"WARC/", b"\x1f\x8b\x08", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0
    length: int = 0


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


#: What can't stand in a header line, or not at either end of its value.
_LINE = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]|^\s|\s$").sub


def _percent(m: re.Match) -> str:
    return quote(m[0], safe="")


def page_name(page) -> str:
    """The record id of a page; that of a null page_id has no id in it."""
    return "<urn:page>" if page is None else f"<urn:page:{quote(str(page), safe='')}>"


def make_record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own; Content-Length and the block digest are added.

    White space that a header line can't hold is percent-encoded.
    """
    own = headers | {"WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_LINE(_percent, str(v))}\r\n" for k, v in own.items()) + "\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + block + END) + gz.flush()


class Damaged(Exception):
    pass


def parse_record(raw: bytes) -> tuple[Record, int]:
    """The record at the start of ``raw``, and the bytes that it takes."""
    if not raw.startswith(VERSION):
        raise Damaged("no version line")
    end = raw.find(END)
    if end < 0:
        raise Damaged("header block without an end")
    headers = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        headers[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    size = headers.get("Content-Length", "")
    if not size.isdigit() or int(size) > RECORD_BYTES:
        raise Damaged("no valid Content-Length")
    at = end + 4
    block = raw[at : at + int(size)]
    if len(block) < int(size):
        raise Damaged("block cut short")
    if raw[at + len(block) : at + len(block) + 4] != END:
        raise Damaged("block not closed")
    digest = headers.get("WARC-Block-Digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest differs")
    return Record(headers, block), at + len(block) + 4


@dataclass
class _Window:
    """A stream of which the bytes from ``base`` on are at hand."""

    stream: object
    base: int = 0
    data: bytearray = field(default_factory=bytearray)
    ended: bool = False

    def more(self) -> bool:
        block = b"" if self.ended else self.stream.read(BLOCK)
        self.ended |= not block
        self.data += block
        return bool(block)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.base += n


def _member(w: _Window) -> tuple[bytes, int]:
    """The content and size of the gzip member at the start of the window."""
    while len(w.data) < 18 and w.more():
        pass
    gz, out, fed, total = zlib.decompressobj(31), [], 0, 0
    while not gz.eof:
        if fed == len(w.data) and not w.more():
            raise Damaged("member cut short")
        try:
            out.append(gz.decompress(bytes(w.data[fed:])))
        except zlib.error as e:
            raise Damaged("member does not unpack") from e
        fed = len(w.data)
        total += len(out[-1])
        if total > RECORD_BYTES + BLOCK:
            raise Damaged("member too long")
    return b"".join(out), fed - len(gz.unused_data)


def _opens(data: bytes) -> bool:
    """Whether a gzip member that begins like a record stands at the start of ``data``."""
    try:
        return zlib.decompressobj(31).decompress(data[:4096], 16).startswith(VERSION)
    except zlib.error:
        return False


def _next_start(w: _Window) -> int:
    """Bytes to the next place, after the first, where a record may begin; all that is left if there is none.

    Bytes that are passed are dropped, and counted by the caller through ``base``.
    """
    at = 1
    while True:
        spots = [x for x in (w.data.find(MEMBER, at), w.data.find(VERSION, at)) if x >= 0]
        if spots:
            at = min(spots)
            while len(w.data) < at + 4096 and w.more():
                pass
            if w.data[at : at + 5] == VERSION or _opens(bytes(w.data[at : at + 4096])):
                return at
            at += 1
        elif w.ended or not w.more():
            return len(w.data)
        else:
            at = max(1, len(w.data) - BLOCK - 8)


def salvage(stream) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, packed or plain, in order.  Their offsets and lengths cover every byte."""
    w = _Window(stream)
    gap: Gap | None = None
    while w.data or w.more():
        try:
            while len(w.data) < len(VERSION) and w.more():
                pass
            if w.data[:3] == MEMBER or len(w.data) < 3:
                content, size = _member(w)
                record, used = parse_record(content)
                if used != len(content):
                    raise Damaged("more than a record in a member")
            else:
                record, size = _plain(w)
        except Damaged as e:
            size = _next_start(w)
            gap = gap or Gap(w.base, 0, str(e))
            gap.length += size
            w.drop(size)
            continue
        if gap:
            yield gap
            gap = None
        record.offset, record.length = w.base, size
        yield record
        w.drop(size)
    if gap:
        yield gap


def _plain(w: _Window) -> tuple[Record, int]:
    """The record at the start of the window, read on until its header block says that it is whole."""
    seen = 0
    while (end := w.data.find(END, max(0, seen - 4))) < 0:
        seen = len(w.data)
        if not w.data.startswith(VERSION) or seen > HEADER_BYTES or not w.more():
            break
    size = re.search(rb"\r\nContent-Length:[ \t]*(\d{1,19})[ \t]*\r\n", w.data[: end + 2]) if end >= 0 else None
    if size and int(size[1]) <= RECORD_BYTES:
        while len(w.data) < end + 8 + int(size[1]) and w.more():
            pass
        return parse_record(bytes(w.data[: end + 8 + int(size[1])]))
    return parse_record(bytes(w.data[: max(0, end) + 4]))


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, digest, record_type, refers_to) rows; returns the manifest (path, n_records, n_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, n, out, done = f"part-{task.partitionId():06d}", 0, None, []

        def close():
            nonlocal out
            out[0].close()
            done.append((out[1], out[2], out[3]))
            out = None

        for b in slices(batches, "payload"):
            for page, url, payload, digest, kind, refers in zip(*(b.column(c).to_pylist() for c in _WRITTEN), strict=True):
                if out is None:
                    name = f"{root}/{stem}-{n:05d}-{uuid.uuid4().hex}.warc.gz"
                    out = [files.open_output_stream(name, compression=None), name, 0, 0]
                headers = {
                    "WARC-Type": kind,
                    "WARC-Record-ID": page_name(page),
                    "WARC-Date": "1970-01-01T00:00:00Z",
                    "WARC-Target-URI": url or "",
                    "WARC-Payload-Digest": f"sha256:{digest}",
                    "Content-Type": "text/html; charset=utf-8",
                }
                if kind == "revisit":
                    headers |= {
                        "WARC-Profile": REVISIT_PROFILE,
                        "WARC-Refers-To": page_name(refers),
                        "X-Payload-Length": str(len(payload)),
                    }
                raw = make_record(headers, b"" if kind == "revisit" else payload)
                out[0].write(raw)
                out[2] += 1
                out[3] += len(raw)
                if out[3] >= file_bytes:
                    close()
                    n += 1
        if out:
            close()
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
            ["path", "n_records", "n_bytes"],
        )

    written = records.select(*_WRITTEN).mapInArrow(run, "path string, n_records long, n_bytes long")
    return stage(written, "manifest")


_WRITTEN = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
_READ = (
    "path string, offset long, length long, kind string, record_type string, record_id string, uri string, "
    "refers_to string, payload binary, payload_bytes long, payload_digest string, reason string"
)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True, whole: bool = False) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` from the files of a manifest (path, n_records), read as streams.

    Damaged bytes give gap rows; a file that can't be opened or read fails its task, which Spark tries again.  If
    ``whole``, so does a file with other than n_records records.  An empty manifest gives an empty result.  For responses,
    payload_bytes and payload_digest are those of the bytes read; for revisits, those the record states.
    """
    n = max(1, min(parallelism(manifest.sparkSession), manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.int64(), pa.string(), pa.string()]

        def rows(path: str, expected: int):
            met = 0
            with files.open_input_stream(path, compression=None) as stream:
                for x in salvage(stream):
                    if isinstance(x, Gap):
                        yield (path, x.offset, x.length, "gap", *[None] * 7, x.reason)
                        continue
                    met += 1
                    h = x.headers
                    kind = h.get("WARC-Type")
                    if kind == "revisit":
                        size, digest = int(h.get("X-Payload-Length", -1)), h.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                    else:
                        size, digest = len(x.block), hashlib.sha256(x.block).hexdigest()
                    names = (h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Refers-To"))
                    yield (path, x.offset, x.length, "record", kind, *names, x.block if payloads else None, size, digest, None)
            if whole and met != expected:
                raise OSError(f"{path} has {met} records of {expected}")

        for b in batches:
            for path, expected in zip(b.column("path").to_pylist(), b.column("n_records").to_pylist(), strict=True):
                held, weight = [], 0
                for row in rows(path, expected):
                    held.append(row)
                    weight += 200 + len(row[8] or b"")
                    if weight > 8 * BLOCK:
                        yield _batch(held, names, kinds)
                        held, weight = [], 0
                if held:
                    yield _batch(held, names, kinds)

    return manifest.select("path", "n_records").repartition(n).mapInArrow(run, _READ)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and what kind of record each becomes.

    Null html is an empty payload; a page of null id is always a response.  Of rows with equal payloads of REVISIT_BYTES
    or more that with the smallest page_id is the response; rows that repeat that page_id are responses too.  Pages of any
    length that Spark can hold are whole; an empty table gives an empty result; columns but page_id, url and html are
    ignored.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("payload"))
    own = own.withColumn("payload_digest", F.sha2("payload", 256))
    small = pages.select("page_id", F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).alias("n"))
    first = small.where(f"n >= {REVISIT_BYTES} and page_id is not null").groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("copies")
    )
    # only digests met twice can change anything; few of them need no shuffle of the payloads
    again = stage(first.where("copies > 1").select("payload_digest", "first"), "digests")
    out = own.join(F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again, "payload_digest", "left")
    later = F.col("first") < F.col("page_id")
    return out.withColumn("record_type", F.when(later, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(later, F.col("first"))
    )


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Every row of pages, written and read back; a record that is lost on the way is an error.  Odd rows as in with_revisits."""
    bounded_batches(spark)
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    folder = fresh_path(spark, "warc")
    back = read_archives(write_archives(with_revisits(pages), folder), folder, payloads=False, whole=True)
    ident = "cast(if({0} = '<urn:page>', null, url_decode(regexp_extract({0}, '^<urn:page:(.*)>$', 1))) as {1})"
    return back.where("kind = 'record'").selectExpr(
        f"{ident.format('record_id', kind)} as page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        f"{ident.format('refers_to', kind)} as refers_to",
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)
"""
