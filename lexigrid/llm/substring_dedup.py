"""Exact substring dedup by prefix-partitioned suffix trees.

Candidates.  Only suffixes that can lie under a node WINDOW words deep with two documents below it go into a tree.  Each
window of WINDOW words has one least hashed gram of GRAM words, the same in every document, so a window whose gram is
met in one document only is out.  Neighbouring windows mostly share their gram and are held as one span; equal spans
are folded by a combining aggregate, with their smallest document, so copies reach the trees once.

Partition.  Each suffix of the folded spans is a row: the hashes of its words 1-8, 9-22, 23-36 and 37-50, its span and
that span's smallest document.  Suffixes are dealt to trees by their prefix.  A prefix of 8 words with more than
a task's share of suffixes grows to 22 words, then 36, then 50; a share is ``GROUP_SUFFIXES`` at most, and what is dealt
to one task are whole prefixes, so a task's trees fit in its memory at any size of the corpus.  Below a prefix of 50
words that is still too common there is only one node, and its smallest document is an aggregate.

Tree.  A task orders its suffixes (suffix array), takes the depth that each shares with the one before it (LCP array),
and makes the internal nodes from the intervals of suffixes that share a depth.  The nodes WINDOW words deep are the
repeats; a suffix starts one if the smallest document below its node is smaller than its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import bounded_batches, keyed_text, parallelism, sized, slices, stage, table, unstage

WINDOW, GRAM = 50, 8
#: Words of a prefix, as it grows; the last is the depth of the nodes that are sought.
DEPTHS = (8, 22, 36, WINDOW)
#: Window starts of a span; suffixes that one task orders; a prefix of fewer suffixes never grows.
SPAN, GROUP_SUFFIXES, PREFIX_SUFFIXES = 64, 500_000, 4096
#: Rows that a Python worker hands back at a time.
OUT_ROWS = 100_000
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1 for i in range(WINDOW + 1)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    span, n = 1, len(x) - width + 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys, cut to SPAN."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    pieces = -(-sizes // SPAN)
    at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(starts, pieces) + at * SPAN, np.minimum(np.repeat(sizes, pieces) - at * SPAN, SPAN)


class _Blocks:
    """Hashes of any run of words of one document, from running sums."""

    def __init__(self, hashes: np.ndarray):
        odd, n = 0x5851F42D4C957F2D, len(hashes)
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(odd))], dtype=np.uint64)
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(odd, -1, 1 << 64)))], dtype=np.uint64)
        self.total = np.r_[np.uint64(0), np.cumsum(hashes * power[:-1], dtype=np.uint64)]

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.total[start + size] - self.total[start]) * self.inverse[start])


def _spans_of(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram key, start, length, two content hashes) of the spans of one document of WINDOW words or more."""
    n = len(hashes) - GRAM + 1
    grams = np.zeros(n, np.uint64)
    for i in range(GRAM):
        grams += hashes[i : i + n] * _ODD[i]
    key = _least(_mix(grams), WINDOW - GRAM + 1)
    start, size = _runs(key)
    contents = [_Blocks(h).hashes(start, size + WINDOW - 1) for h in (hashes, _mix(hashes))]
    return key[start], start, size, *contents


_SPAN_SCHEMA = "doc_id {0}, tid long, k long, at int, size int, h1 long, h2 long"


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, k, at, size, h1, h2): the spans of every whole text; tid tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            which, cols = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = _words(text)
                if len(words) >= WINDOW:
                    cols.append(_spans_of(_hashes(words)))
                    which.append(np.full(len(cols[-1][0]), i, np.int64))
            if not cols:
                continue
            which = pa.array(np.concatenate(which))
            k, at, size, h1, h2 = (np.concatenate(x) for x in zip(*cols, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(which), b.column("tid").take(which), pa.array(k.view(np.int64))]
                + [pa.array(x.astype(np.int32)) for x in (at, size)]
                + [pa.array(x.view(np.int64)) for x in (h1, h2)],
                ["doc_id", "tid", "k", "at", "size", "h1", "h2"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id is not null").mapInArrow(run, _SPAN_SCHEMA.format(kind))


_LEVELS = [f"p{i}" for i in range(len(DEPTHS))]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each suffix of the spans asked for, from the texts that hold them first."""

    def made(b: pa.RecordBatch, rows: list[int], cols: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        which = pa.array(np.repeat(rows, [len(c[0]) for c in cols]))
        sid, at, *parts = (np.concatenate(x) for x in zip(*cols, strict=True))
        arrays = [pa.array(sid, pa.int64()), pa.array(at, pa.int32()), b.column("doc_id").take(which)]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(x.view(np.int64)) for x in parts], ["sid", "i", "first", *_LEVELS])

    for b in slices(batches):
        rows, cols, n = [], [], 0
        for r, (text, asked) in enumerate(zip(b.column("text").to_pylist(), b.column("asked").to_pylist(), strict=True)):
            blocks = _Blocks(_hashes(_words(text)))
            size = np.array([x["size"] for x in asked])
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            start = at + np.repeat([x["at"] for x in asked], size)
            parts = [blocks.hashes(start + a, z - a) for a, z in zip((0, *DEPTHS), DEPTHS, strict=False)]
            rows.append(r)
            cols.append((np.repeat([x["sid"] for x in asked], size), at, *parts))
            n += len(at)
            if n >= OUT_ROWS:
                yield made(b, rows, cols)
                rows, cols, n = [], [], 0
        if n:
            yield made(b, rows, cols)


def suffix_array(prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes given as rows of block hashes, and how many words each shares with the one before it."""
    order = np.lexsort(prefixes.T[::-1])
    rows = prefixes[order]
    same = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    return order, np.r_[0, np.array([0, *DEPTHS])[same]]


def internal_nodes(shared: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, starts, ends) of the intervals of two suffixes or more that share a prefix, for each depth, from the root.

    An interval of one depth lies inside one of the depth before: that is the node above it.
    """
    out = []
    for depth in DEPTHS:
        starts = np.flatnonzero(shared < depth)
        ends = np.r_[starts[1:], len(shared)]
        many = ends - starts > 1
        out.append((depth, starts[many], ends[many]))
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, a, z): the suffixes [a, z) of a span that start a repeat which a smaller document has too."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    group = pa.Table.from_batches(held)
    del held
    order, shared = suffix_array(np.stack([group[c].to_numpy() for c in _LEVELS], axis=1))
    rank = pc.rank(group["first"].combine_chunks(), sort_keys="ascending", tiebreaker="dense").to_numpy()[order]
    _, starts, ends = internal_nodes(shared)[-1]
    later = np.zeros(len(order), bool)
    for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
        own = rank[a:z]
        later[a:z] = own > own.min()
    hit = order[later]
    yield _joined(group["sid"].to_numpy()[hit], group["i"].to_numpy()[hit])


def _joined(sid: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring suffixes of a span."""
    order = np.lexsort((i, sid))
    sid, i = sid[order], i[order]
    starts = np.flatnonzero(np.r_[True, (sid[1:] != sid[:-1]) | (i[1:] != i[:-1] + 1)]) if len(sid) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(sid)] if len(sid) else starts
    arrays = [pa.array(sid[starts], pa.int64()), pa.array(i[starts], pa.int32()), pa.array(i[ends - 1] + 1, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, ["sid", "a", "z"])


def repeat_starts(suffixes: DataFrame, prefix_suffixes: int | None = None, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """(sid, a, z) from staged suffix rows: grows prefixes until their suffixes fit, deals them out, builds the trees."""
    left, dealt, total = suffixes, None, suffixes.count()
    groups = max(parallelism(suffixes.sparkSession), total // group_suffixes + 1)
    if prefix_suffixes is None:
        prefix_suffixes = max(PREFIX_SUFFIXES, total // groups)
    for level in range(len(DEPTHS)):
        prefix = _LEVELS[: level + 1]
        sizes = left.groupBy(*prefix).agg(F.count("*").alias("n"))
        wide = stage(sizes.where(f"n > {prefix_suffixes}").select(*prefix), "wide")
        none = wide.isEmpty()
        fit = left if none else left.join(sized(wide, 8 * len(prefix)), prefix, "left_anti")
        fit = fit.select("sid", "i", "first", *_LEVELS, F.xxhash64(*prefix).alias("prefix"))
        dealt = fit if dealt is None else dealt.unionByName(fit)
        left = None if none else left.join(sized(wide, 8 * len(prefix)), prefix, "left_semi")
        if none:
            break
    found = dealt.repartition(groups, "prefix").drop("prefix").mapInArrow(_trees, "sid long, a int, z int")
    if left is None:
        return found
    left = stage(left, "common")  # its nodes are one prefix each: a plain join that can be split where one is very common
    nodes = stage(left.groupBy(*_LEVELS).agg(F.min("first").alias("least")), "nodes")
    below = left.join(nodes, _LEVELS).where("least < first").select("sid", F.col("i").alias("a"), F.expr("i + 1 as z"))
    return found.unionByName(below)


_RUNS = "array<struct<a:int,z:int>>"


def repeats(docs: DataFrame, prefix_suffixes: int | None = None, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """(doc_id, tid, at, runs): runs [a, z) of the windows from word ``at`` on that a smaller document has too."""
    every = stage(spans(docs), "spans")
    shared = every.groupBy("k").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    # both written: a join of plain scans can be split where one passage is very common, and its spans then combine
    # before they are dealt out
    met = stage(every.join(stage(shared.select("k"), "shared"), "k"), "met")
    unstage(every)
    path = ["k", "h1", "h2", "size"]
    folded = met.groupBy(*path).agg(F.min(F.struct("doc_id", "tid", "at")).alias("rep"))
    folded = stage(folded.withColumn("sid", F.monotonically_increasing_id()), "paths")
    # a gram with a single different span has no other suffix to meet
    several = stage(folded.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "several")
    asked = folded.join(several, "k").select("rep.doc_id", "rep.tid", F.expr("struct(sid, rep.at as at, size) as x"))
    asked = stage(asked.groupBy("doc_id", "tid").agg(F.collect_list("x").alias("asked")), "asked")  # no more than the text
    small = asked.agg(F.sum(64 + 16 * F.size("asked"))).first()[0] or 0
    texts = docs.join(sized(asked, total=small), ["doc_id", "tid"]).select("doc_id", "text", "asked")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"sid long, i int, first {kind}, " + ", ".join(f"{c} long" for c in _LEVELS)
    suffixes = stage(texts.mapInArrow(_suffixes, schema), "suffixes")
    later = repeat_starts(suffixes, prefix_suffixes, group_suffixes)
    later = stage(later.groupBy("sid").agg(F.collect_list(F.struct("a", "z")).cast(_RUNS).alias("later")), "repeats")
    unstage(suffixes)
    nodes = folded.join(later, "sid", "left").select(*path, F.col("rep.doc_id").alias("first"), "later")
    nodes = stage(nodes, "nodes")  # as above: a path that very many documents share is split
    # an equal span starts in a smaller document; else only where a tree says so
    whole = f"cast(array(struct(0 as a, size as z)) as {_RUNS})"
    runs = F.expr(f"if(first < doc_id, {whole}, coalesce(later, cast(array() as {_RUNS})))")
    return met.join(nodes, path).select("doc_id", "tid", "at", runs.alias("runs")).where("size(runs) > 0")


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        total, removed, kept = [], [], []
        for text, cover in zip(b.column("text").to_pylist(), b.column("cover").to_pylist(), strict=True):
            words = _words(text)
            total.append(len(words))
            if cover:
                stay = np.zeros(len(words) + 1, np.int32)
                pairs = np.array([(x["a"], x["z"]) for x in cover])
                np.add.at(stay, pairs[:, 0], 1)
                np.add.at(stay, pairs[:, 1], -1)
                words = [w for w, c in zip(words, stay.cumsum().tolist(), strict=False) if not c]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeats(
    docs: DataFrame, prefix_suffixes: int | None = None, group_suffixes: int = GROUP_SUFFIXES
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text without words under a window that an earlier document has.

    doc_id may be of any type that Spark orders.  Rows with a null doc_id are neither earlier nor trimmed; null and empty
    texts have no words; rows of one doc_id never remove each other's words, and rows alike in both id and text give one
    row each; texts of any length are read whole, a row at a time; an empty table gives an empty result; columns but
    doc_id and text are ignored.
    """
    docs = keyed_text(docs).withColumn("tid", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    covers = repeats(docs, prefix_suffixes, group_suffixes)
    covers = covers.withColumn("runs", F.expr(f"transform(runs, r -> struct(at + r.a as a, at + r.z + {WINDOW - 1} as z))"))
    covers = covers.groupBy("doc_id", "tid").agg(F.flatten(F.collect_list("runs")).alias("cover"))
    covers = stage(covers, "covers")
    small = covers.agg(F.sum(64 + 8 * F.size("cover"))).first()[0] or 0
    marked = docs.join(sized(covers, total=small), ["doc_id", "tid"], "left").select("doc_id", "text", "cover")
    return marked.mapInArrow(_trim, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: words, words removed, and the digest of those kept.  Odd rows as in remove_repeats."""
    bounded_batches(spark)
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
