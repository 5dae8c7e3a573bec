from oddrows import rows
from oracle import both

from lexigrid.llm import quality as q
from lexigrid.llm import queries


def plain(text):
    """The counts, one character and one window at a time."""
    t, words, word = text or "", [], ""
    for c in t + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen, dup = set(), 0
    for line in t.split("\n"):
        if any(c not in " \t\n\r\x0b\x0c" for c in line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {g: 0 for g in grams}
    for g in grams:
        count[g] += 1
    marked = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(marked)


def check(df, texts):
    got = {}
    for r in q.judge(df, stats=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts:
        for r in got[doc_id]:
            want = plain(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r.base_failed and r.kept) and r.kept == (r.rejected_by is None)


def test_counts(spark, docs):
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(clashing, empty):
    check(clashing, [(d, t) for d, t, *_ in rows()])
    assert q.judge(empty, stats=True).count() == 0 and q.keep_good(empty).count() == 0
    kept = q.keep_good(clashing)
    assert kept.columns == clashing.columns and {4, 5, 6}.isdisjoint(r.doc_id for r in kept.collect())


def test_order_does_not_change_the_verdict(docs):
    texts = [q.Text(r.text) for r in docs.collect()]
    one = [q.first_rejection(t, q.RULES) is None for t in texts]
    assert one == [q.first_rejection(t, q.RULES[::-1]) is None for t in texts]
    assert set(q.order_rules([t.text for t in texts])) == set(q.RULES)


def test_labelled_quality(spark, docs, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = [(r.kept, labels[r.doc_id], r.base_failed) for r in q.judge(docs, stats=True).collect() if r.doc_id in labels]
    good = [k for k, y, base in got if y == 1 and not base]
    bad = [k for k, y, base in got if y == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_query_and_sql(spark):
    a, b = both(spark, queries.QUERIES["op4_quality_rules"], queries.ORACLES["op4_quality_rules"])
    assert a == b
