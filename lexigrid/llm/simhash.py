"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves.  Two fingerprints that differ in at most three bits differ in at most one
bit in one half, so they share that half with one bit wildcarded: 64 variants a fingerprint, an equality match, and a
popcount to verify.  Only distinct fingerprints take part; copies are folded first by a combining aggregate.

A bucket of two is verified from its least and greatest member.  A larger one is gathered, up to ``BUCKET`` members,
and gives a spanning forest instead of its pairs.  A still larger one is cut again: the half that the key leaves open
differs in at most three bits too, so it is halved and wildcarded in turn, to 16 and then 8 bits.  At the third level
11 bits are open, so a bucket cannot hold more than 2,048 different fingerprints: nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import bounded_batches, keyed_text, parallelism, slices, stage, table, without
from lexigrid.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Members of a bucket that one task compares with each other.
BUCKET = 4096


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text; 0 without a word."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, split at \x20 and \x09-\x0D only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        marks = np.array([fingerprint(x) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(marks)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, a row for each input row."""
    docs = keyed_text(docs)
    return docs.mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for members in b.column("fps").to_pylist():
            rest = np.array(members, np.int64).view(np.uint64)
            while len(rest) > 1:
                front, rest = [rest[0]], rest[1:]
                while front and len(rest):
                    x = front.pop()
                    near = np.bitwise_count(rest ^ x) <= DISTANCE
                    if near.any():
                        got, rest = rest[near], rest[~near]
                        a.append(np.full(len(got), x))
                        z.append(got)
                        front.extend(got)
        arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, z)]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])


def _variants(points: DataFrame, level: int, width: int) -> DataFrame:
    """A row for each bit of ``rest``: the half with that bit cleared joins the key, the other half is the new rest."""
    half, mask = width // 2, (1 << width // 2) - 1
    low, high = f"(rest & {mask}L)", f"(shiftrightunsigned(rest, {half}) & {mask}L)"
    cut = points.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    key = f"shiftleft(cast(i as bigint), 32) | (if(i < {half}, {low}, {high}) & ~shiftleft(1L, i % {half}))"
    return cut.selectExpr(
        *[f"k{n}" for n in range(level)], "fp", f"{key} as k{level}", f"if(i < {half}, {high}, {low}) as rest"
    )


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) over the column ``fp`` that connect what a chain of links of 3 bits or fewer connects."""
    # few bytes, but 64 rows each later on: dealt out before they grow
    distinct = distinct.repartition(parallelism(distinct.sparkSession))
    edges, points = None, distinct.select("fp", F.col("fp").alias("rest"))
    for level, width in enumerate((64, 32, 16)):
        keys = [f"k{n}" for n in range(level + 1)]
        varied = _variants(points, level, width)
        sizes = varied.groupBy(*keys).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        sizes = stage(sizes.where("n > 1"), "buckets")
        pairs = sizes.where("n = 2").select("a", "b").where(f"bit_count(a ^ b) <= {DISTANCE}")
        last = level == 2
        inside = sizes.where("n > 2" if last else f"n > 2 and n <= {bucket}").select(*keys)
        lists = varied.join(inside, keys).groupBy(*keys).agg(F.collect_list("fp").alias("fps"))
        found = pairs.unionByName(lists.select("fps").mapInArrow(_forest, "a long, b long"))
        edges = found if edges is None else edges.unionByName(found)
        over = sizes.where(f"n > {bucket}")
        if last or over.isEmpty():
            return edges.distinct()
        points = varied.join(over.select(*keys), keys).select(*keys, "fp", "rest")
    return edges


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    A null or empty text has fingerprint zero and links like any other; texts of any length are read whole, a row at a
    time; a bit that is set in exactly half the shingles is 0; repeated rows stay repeated; an empty table gives an empty
    result; columns but doc_id and text are ignored.  component_id is the smallest non-null doc_id.
    """
    marks = stage(fingerprints(docs), "fingerprints")
    first = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(first, bucket)).withColumnsRenamed({"node": "fp"})
    rooted = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its fingerprint and component.  Odd rows as in near_duplicates."""
    bounded_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id, with all its columns.

    Rows of a null doc_id stay; rows that share the smallest doc_id all stay; null and empty texts are one group; an empty
    table gives an empty result.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, stage(gone, "gone"), ["doc_id"]).select(*docs.columns)
