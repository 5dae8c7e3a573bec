import random

import pytest
from oddrows import rows
from pyspark.sql import functions as F

from lexigrid.llm import substring_dedup as sd


def plain(docs):
    """Every window of every document, looked up in a dictionary of the smallest document that has it."""
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - 49):
            g = b" ".join(w[i : i + 50])
            if d is not None and d < first.get(g, d + 1):
                first[g] = d
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[b" ".join(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        out.append((d, len(w), sum(gone), b" ".join(x for x, y in zip(w, gone, strict=True) if not y).decode()))
    return sorted(map(repr, out))


def ours(df, **k):
    return sorted(repr(tuple(r)) for r in sd.remove_repeats(df, **k).collect())


#: As in production; every prefix grown to its end; many small groups of trees.
SHAPES = [{}, {"prefix_suffixes": 0}, {"prefix_suffixes": 3, "group_suffixes": 50}]


@pytest.mark.parametrize("shape", SHAPES)
def test_against_a_dictionary_of_windows(spark, docs, shape):
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert ours(docs, **shape) == want


@pytest.mark.parametrize("seed", range(3))
def test_planted_repeats(spark, seed, monkeypatch):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 70, 130)] + [["x"] * 90, (["a", "b"] * 60)]
    made = []
    for d in range(25):
        text = []
        for _ in range(r.randint(0, 4)):
            text += [word() for _ in range(r.randint(0, 40))] + r.choice(passages)
        made.append((d, " ".join(text)))
    r.shuffle(made)
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert ours(df, **SHAPES[seed]) == plain(made)


def test_shuffled_joins(spark, docs, monkeypatch):
    monkeypatch.setattr("lexigrid.llm.common.BROADCAST_BYTES", -1)
    assert ours(docs, prefix_suffixes=20) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_string_ids(spark, docs):
    named = docs.where("doc_id is not null").withColumn("doc_id", F.format_string("d%09d", "doc_id"))
    got = {r.doc_id: (r.n_removed, r.kept) for r in sd.remove_repeats(named).collect()}
    plain_rows = {f"d{r.doc_id:09d}": r for r in sd.remove_repeats(docs.where("doc_id is not null")).collect()}
    assert got == {k: (r.n_removed, r.kept) for k, r in plain_rows.items()}


def test_odd_rows(clashing, empty):
    want = plain([(d, t) for d, t, *_ in rows()])
    assert ours(clashing) == want
    assert sd.remove_repeats(empty).count() == 0


def test_internal_nodes_are_shared_prefixes():
    import numpy as np

    r = np.random.default_rng(1)
    rows = r.integers(0, 3, (400, len(sd.DEPTHS))).astype(np.uint64)
    order, shared = sd.suffix_array(rows)
    ordered = [tuple(x) for x in rows[order].tolist()]
    assert ordered == sorted(map(tuple, rows.tolist()))
    for level, (depth, starts, ends) in enumerate(sd.internal_nodes(shared), 1):
        assert depth == sd.DEPTHS[level - 1]
        want = {}
        for x in ordered:
            want[x[:level]] = want.get(x[:level], 0) + 1
        assert {ordered[a][:level]: int(z - a) for a, z in zip(starts, ends)} == {k: n for k, n in want.items() if n > 1}


def test_one_passage_in_every_document(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string"), F.lit(" " + text)).alias("text"))
    got = {r.doc_id: r.n_removed for r in sd.remove_repeats(df).collect()}
    assert got[0] == 0 and {got[i] for i in range(1, 200)} == {60}
