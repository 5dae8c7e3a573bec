import pytest
from oracle import SF, both

from lexigrid.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    ours, theirs = both(spark, registry.QUERIES[name], registry.ORACLES[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_engine_does_not_import_the_training_data_package():
    import os
    import re

    import lexigrid

    top = os.path.dirname(lexigrid.__file__)
    for d, _, files in os.walk(top):
        if os.path.basename(d) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"lexigrid\.llm|from \.llm", open(os.path.join(d, f)).read()), f


def test_sequence_similarity_compares_whole_texts(spark, tmp_path):
    from difflib import SequenceMatcher

    texts = ["ab" * 40 + "กาข", "x" * 60 + "ผนัง ก่", "short", "", None, "palindromes " * 7 + " อาคาร"]
    spark.createDataFrame(list(enumerate(texts)), "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.ratio, r.thai) for r in registry.QUERIES["sequence_similarity"](spark, str(tmp_path)).collect()}
    whole = [t or "" for t in texts]
    want = {i: (SequenceMatcher(None, t, t[::-1], autojunk=False).ratio(), "".join(c for c in t if "฀" <= c <= "๿")) for i, t in enumerate(whole)}
    assert got == want


def test_lineitem_islands_orders_nulls_as_its_sql_does(spark, tmp_path):
    import datetime as dt

    import duckdb

    day = lambda n: n and dt.datetime(1998, 1, n)
    lines = [(1, 1, 5), (1, 2, None), (1, 2, 4), (1, 2, 6), (1, None, 7), (1, None, 3), (2, 1, None), (2, 1, 2), (2, 2, 9), (None, 1, 3), (None, None, 4), (None, 2, 2)]
    # equal lines that start no island; where they start one, the SQL leaves open which of them comes first
    lines += [(3, 1, 4), (3, 2, 8), (3, 2, 8)]
    spark.createDataFrame([(k, n, day(d)) for k, n, d in lines], "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(map(repr, c.execute(registry.ORACLES["lineitem_islands"]).fetchall()))
    got = sorted(repr(tuple(r)) for r in registry.QUERIES["lineitem_islands"](spark, str(tmp_path)).collect())
    assert got == want
