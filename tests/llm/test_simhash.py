import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lexigrid.llm import simhash
from lexigrid.llm.components import connected_components


def plain_fingerprint(text):
    """Bit by bit, as the rule says it."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(marks):
    """marks: {key: fingerprint}; the group of each key by comparing all pairs."""
    left, out = dict(marks), {}
    while left:
        first = next(iter(left))
        group, front = {first}, [first]
        del left[first]
        while front:
            x = front.pop()
            near = [k for k, f in left.items() if bin(f ^ marks[x]).count("1") <= 3]
            for k in near:
                del left[k]
            group |= set(near)
            front += near
        out |= {k: min(group) for k in group}
    return out


def test_against_all_pairs(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = plain_components(marks)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{marks[k]:016x}", want[k]) for k in texts}


def test_every_level_of_cutting_finds_the_links(spark):
    r = random.Random(4)
    points = set()
    for _ in range(6):
        seed = r.getrandbits(64)
        for _ in range(40):  # near each other: all share buckets
            points.add(seed ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    points |= {r.getrandbits(64) for _ in range(50)}
    order = sorted(points)
    want = plain_components(dict(zip(order, order, strict=True)))
    signed = [(int(np.uint64(p).view(np.int64)),) for p in order]
    df = spark.createDataFrame(signed, "fp long")
    for bucket in (4096, 3, 2):
        edges = simhash.links(df, bucket)
        unsigned = lambda v: int(np.int64(v).view(np.uint64))
        roots = {unsigned(x.node): unsigned(x.root) for x in connected_components(edges).collect()}
        groups = {}
        for p in order:
            groups.setdefault(roots.get(p, p), set()).add(p)
        wanted = {}
        for p in order:
            wanted.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)}


def test_odd_rows(clashing, empty, odd):
    got = simhash.near_duplicates(clashing).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[4].fingerprint == by[5].fingerprint == by[6].fingerprint == "0" * 16
    assert by[4].component_id == by[5].component_id == by[6].component_id == 4
    assert by[2].component_id == 1 and by[None].component_id == 1
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 5 not in ids and ids.count(9) == 2 and None in ids
    assert simhash.keep_first(empty).count() == 0


def test_fingerprint_of_long_text_is_whole():
    from oddrows import LONG

    assert simhash.fingerprint(LONG) == plain_fingerprint(LONG) != simhash.fingerprint(LONG[:1000])


def test_links_do_not_grow_with_the_square(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same text in every row of it").alias("text"))
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {0}
