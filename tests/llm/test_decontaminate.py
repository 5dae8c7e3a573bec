import hashlib
import re
from collections import Counter

from oddrows import rows
from oracle import both

from lexigrid.llm import decontaminate as dc
from lexigrid.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12)) if w and item is not None else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(repr, out))


def ours(df, items):
    got = dc.contamination(df, items).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    return sorted(repr(tuple(r)) for r in got.collect())


def test_query_and_sql(spark):
    a, b = both(spark, queries.QUERIES["op5_decontamination"], queries.ORACLES["op5_decontamination"])
    assert a == b


def test_planted_items(spark):
    items = [(1, "Alpha beta gamma"), (2, " ".join(f"w{i}" for i in range(20))), (3, "the"), (4, None), (5, "..."), (None, "zeta eta"), (10, "alpha BETA gamma"), (6, "a a a a a a a a a a a a a a a")]
    texts = [
        (1, "say ALPHA, beta; gamma twice: alpha-beta-gamma"), (2, " ".join(f"W{i}" for i in range(3, 18))), (3, " ".join(f"w{i}" for i in range(12))),
        (4, "The end of the the"), (5, "alphabeta gamma"), (6, "zeta eta"), (7, "a " * 14), (8, "É beta alpha beta gamma é"), (9, None), (10, "--- "),
    ]
    df, it = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ours(df, it) == plain(texts, items)


def test_odd_rows(spark, clashing, empty):
    items = [(1, rows()[0][1][20:200]), (2, "one two"), (3, "")]
    it = spark.createDataFrame(items, "item_id int, text string")
    assert ours(clashing, it) == plain([(d, t) for d, t, *_ in rows()], items)
    assert ours(empty, it) == []
    none = spark.createDataFrame([], "item_id int, text string")
    assert ours(clashing, none) == plain([(d, t) for d, t, *_ in rows()], [])
    kept = dc.keep_clean(clashing, it)
    assert kept.columns == clashing.columns
    want = {d for d, t, *_ in rows()} - {1, 2, 3, 9, None}
    assert {r.doc_id for r in kept.collect()} == want


def near(docs, items, slop=3, misses=3):
    """Item ids for which, from a start to which two of the three rarest terms lead, nearly all words are met."""
    split = [(d, words(t)) for d, t in docs]
    counts = Counter(x for _, w in split for x in w)
    out = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12)) if w and item is not None else ():
            p = w[i : i + 13]
            rare = sorted(set(p), key=lambda x: counts[x])[:3]
            for d, text in split:
                at = {x: [j for j, y in enumerate(text) if y == x] for x in set(p)}
                starts = {j - p.index(x) for x in rare for j in at[x]}
                for s in starts:
                    led = sum(any(abs(j - p.index(x) - s) <= slop for j in at[x]) for x in rare)
                    met = sum(any(abs(j - o - s) <= slop for j in at[x]) for o, x in enumerate(p))
                    if led >= min(2, len(rare)) and met >= len(p) - misses and 2 * met > len(p):
                        out.setdefault(d, set()).add(str(item))
    return out


def test_near_items(spark):
    base = [f"w{i}" for i in range(13)]
    swap = lambda *at: " ".join("zz" if i in at else x for i, x in enumerate(base))
    texts = [
        (1, " ".join(base)), (2, swap(4)), (3, swap(1, 5, 9)), (4, swap(1, 5, 9, 11)), (5, " ".join(base[:6] + ["in", "side"] + base[6:])),
        (6, " ".join(base[:6] + ["a"] * 9 + base[6:])), (7, " ".join(reversed(base))), (8, "x " + swap(0, 12)), (9, None), (10, "w1 w2"),
    ]
    # three terms are rarer than the rest, and in one document one of them is missing
    texts += [(20 + i, " ".join(base[3:])) for i in range(3)]
    items = [(1, " ".join(base)), (2, "w1 w2"), (3, "none of these")]
    df, it = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: set(r.near_items) for r in dc.contamination(df, it).collect() if r.near_items}
    assert got == near(texts, items)
    assert {"1"} <= got[1] and {"1"} <= got[2] and {"1"} <= got[5] and "1" not in got.get(6, ())


def test_shuffled_joins(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    a, b = both(spark, queries.QUERIES["op5_decontamination"], queries.ORACLES["op5_decontamination"])
    assert a == b


def test_digest_is_of_sorted_strings():
    assert hashlib.sha256(b"1,10,2").hexdigest() == hashlib.sha256(",".join(sorted(["2", "10", "1"])).encode()).hexdigest()
