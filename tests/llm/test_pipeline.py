import hashlib

import corpus_pipeline
import numpy as np
from lexigrid.llm import bpe, quality, secrets
from test_decontaminate import words
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer


def test_run_against_plain_stages(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t in docs if quality.first_rejection(quality.Text(t), quality.RULES) is None]
    groups = plain_components({d: plain_fingerprint(t) for d, t in kept})
    kept = [(d, t) for d, t in kept if groups[d] == d]
    windows = {tuple(w[i : i + 13]) for w in items if w for i in range(max(1, len(w) - 12))}
    clean = []
    for d, t in kept:
        w = words(t)
        hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((d, t))
    found = {r.doc_id: r.secrets for r in secrets.scan(spark.createDataFrame(clean, "doc_id long, text string")).collect()}
    tk = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for d, t in clean:
        for s in found[d]:
            t = t.replace(s, secrets.MASK)
        ids = tk.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, small).collect()) == sorted(want)


def test_stages_keep_the_columns_of_documents(spark, small, odd, empty):
    for name, work in corpus_pipeline.STAGES[:-1]:
        assert work(spark, odd, small).columns == odd.columns, name
        assert work(spark, empty, small).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, small).count() == odd.count()
