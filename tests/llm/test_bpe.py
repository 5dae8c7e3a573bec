import hashlib
import random

import numpy as np
from oddrows import LONG, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexigrid.llm import bpe

PATH = bpe.vocabulary_path()
REFERENCE = Tokenizer.from_file(PATH)
REFERENCE.no_padding()
REFERENCE.no_truncation()
ENCODER = bpe.Encoder(bpe.Vocabulary.load(PATH), cache=50)


def check(texts):
    ours = ENCODER.encode_batch(texts)
    theirs = [REFERENCE.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours] == theirs
    assert [ENCODER.decode(x) for x in ours] == [REFERENCE.decode(x, skip_special_tokens=False) for x in theirs]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeth '\n\r\t12<|>")), max_size=60), max_size=5))
def test_any_text(texts):
    check(texts)


def test_long_words_specials_and_runs():
    r = random.Random(2)
    check(["<|endoftext|>", "a<|endoftext|> b<|endof", "", None, "x" * 5000, "ab" * 300, "!" * 3000, " \n\n  \t x  ", "thisisaverylongword" * 40, LONG[:5000]])
    check(["".join(r.choice("abcdeth") for _ in range(n)) for n in range(30, 70)])


def test_all_code_points_split_alike():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::97]
    check([f"a{chr(c)}b {chr(c)} {chr(c)}1{chr(c)}{chr(c)}  {chr(c)}\n" for c in points])


def test_query_against_the_library(spark, clashing, empty):
    got = bpe.round_trip_digests(clashing, PATH).collect()
    want = []
    for doc_id, text, *_ in rows():
        ids = REFERENCE.encode(text or "", add_special_tokens=False).ids
        back = REFERENCE.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert bpe.round_trip_digests(empty, PATH).count() == 0


def test_encode_then_decode(odd):
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd, PATH), PATH).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows())
