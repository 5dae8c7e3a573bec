"""Toxicity by a subsequence string kernel, a Nyström map and a linear support vector machine.

Kernel.  A word is the bag of its letter subsequences of length ``P`` whose letters stand at most ``GAP`` apart from
each other, each weighing ``DECAY`` to the power of the letters left out; a bag is divided by its length as a vector.  Two words'
kernel value is the dot product of their bags: words with a letter put into them or left out still share much of it.  A
mark stands before the first letter.  Punctuation and digits inside a word are dropped, and letters spelled out one by
one are joined, before that.  Words of fewer than ``P`` - 1 letters have an empty bag.

Landmarks.  Words and word beginnings that stand out in toxic training documents, common clean words, and the clean
words that are most like each of the former.  The Nyström map is K(landmarks)^-1/2 times the kernel values with them.

Training.  Sentences carry the label of their document.  A sentence scores as its highest word.  Starting from all
words that stand out, the machine is fitted on the highest word of each toxic sentence that has one, and on the same
word with a letter put in, doubled or left out, against the words of clean sentences, and the highest words are chosen
anew, ``ROUNDS`` times.  A document scores as its highest sentence; a logistic curve on that margin, fitted to documents
and misspelt insults, gives the probability.

Since the map is linear in the bag, the fitted machine folds into one weight a subsequence: scoring a word is a sum of
a few table lookups.  Workers keep the margins of words they met, up to ``CACHE``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import bounded_batches, keyed_text, least_hashed, slices, table

P, GAP, DECAY = 5, 1, 0.6
LANDMARKS, CLEAN_LANDMARKS, ROUNDS = 72, 24, 3
#: Costs of margin errors, on toxic and on clean words together.
C_TOXIC, C_CLEAN = 2e4, 1e6
#: Weight of the examples with a letter put in, doubled or left out against those without; the letters put in, at each place.
STRETCHED, LETTERS, PUT_IN = 1.0, "xeqaziknvojtwuyrlshdcmpgbf", 4
#: For each landmark, the most like it of the words that only clean documents have become landmarks too.
NEAR = 2
#: Weight of misspelt insults against documents where the score is fitted to margins.
MISSPELT = 0.05
#: Labelled documents of each class that are fitted on.
SAMPLE_DOCS = 1000
CACHE = 400_000
_DROP = re.compile(r"[^\w\s]+|[\d_]+").sub
_SPELLED = re.compile(r"(?<!\S)[^\W\d_](?:\s[^\W\d_])+(?!\S)").sub
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)").split


def words_of(text: str | None) -> list[str]:
    """The words of a text, lower-cased, letters only; runs of single letters are one word."""
    return _SPELLED(lambda m: "".join(m[0].split()), _DROP("", text.lower())).split() if text else []


def _hops() -> list[tuple[tuple[int, ...], float]]:
    """The ways to pick P letters from one on, and what each weighs."""
    out = [((0,), 1.0)]
    for _ in range(P - 1):
        out = [((*at, at[-1] + 1 + g), w * DECAY**g) for at, w in out for g in range(GAP + 1)]
    return out


HOPS = _hops()


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence hash, weight) of all subsequences of all words."""
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    codes = np.frombuffer(("\x02" + "\x02".join(words)).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[of] - np.arange(len(of))  # letters from here to the word's end
    which, keys, weights = [], [], []
    for at, w in HOPS:
        start = np.flatnonzero(left > at[-1])
        h = np.full(len(start), 7, np.uint64)
        for a in at:
            h = (h ^ codes[start + a]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        which.append(of[start])
        keys.append(h)
        weights.append(np.full(len(start), w))
    which, keys, weights = (np.concatenate(x) for x in (which, keys, weights))
    norm = np.sqrt(1 + np.bincount(which, weights * weights, len(words)))  # 1: short words don't weigh more
    return which, keys, weights / norm[which]


def gram(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel values of all words of ``a`` with all of ``b``."""
    (ia, ka, wa), (ib, kb, wb) = bag(a), bag(b)
    keys = np.unique(kb)
    table_ = np.zeros((len(keys), len(b)))
    np.add.at(table_, (np.searchsorted(keys, kb), ib), wb)
    at = np.minimum(np.searchsorted(keys, ka), len(keys) - 1)
    hit = keys[at] == ka
    out = np.zeros((len(a), len(b)))
    np.add.at(out, ia[hit], wa[hit, None] * table_[at[hit]])
    return out


@dataclass
class Machine:
    """Weights of subsequences, the bias, and the logistic curve of a document's margin."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, words: list[str]) -> np.ndarray:
        which, keys, weights = bag(words)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.bincount(which[hit], weights[hit] * self.weights[at[hit]], len(words)) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


#: What training gives where nothing toxic can be learned.
NEVER = Machine(np.zeros(1, np.uint64), np.zeros(1), 0.0, 0.0, -10.0)


def pick_landmarks(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """Words and beginnings of words that stand out in toxic documents, and the commonest clean words."""

    def beginnings(d: set[str]) -> set[str]:
        return {w[:n] for w in d for n in (4, 5, 6, 8, len(w)) if 4 <= n <= len(w)}

    a: Counter = Counter()
    for d in toxic:
        a.update(beginnings(d))
    a = Counter({w: n for w, n in a.items() if n >= 3})
    b: Counter = Counter()
    for d in clean:
        b.update(w for w in beginnings(d) if w in a)
    worth = {}
    for w, n in a.items():
        p, q = n / len(toxic), (b[w] + 0.5) / (len(clean) + 1)
        worth[w] = (p - q) / np.sqrt(q + p)
    picked: list[str] = []
    for w in sorted(worth, key=lambda w: (-worth[w], w)):
        if len(picked) == LANDMARKS or worth[w] <= 0.02:
            break
        if sum(w.startswith(x) or x.startswith(w) for x in picked) < 3:
            picked.append(w)
    common = Counter(w for d in clean for w in d if len(w) >= P)
    return picked + [w for w, _ in common.most_common(CLEAN_LANDMARKS) if w not in picked]


def _svm(parts: list[tuple[np.ndarray, float, np.ndarray]], steps: int = 100) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the violators.

    parts: (features, label, weight of each row); features are taken up a few thousand rows at a time.
    """
    n = parts[0][0].shape[1] + 1
    w, ridge = np.zeros(n), np.eye(n)
    ridge[-1, -1] = 1e-6
    for step in range(steps):
        left, right = ridge.copy(), np.zeros(n)
        for x, y, c in parts:
            for i in range(0, len(x), 10_000):
                rows = np.c_[x[i : i + 10_000], np.ones(len(x[i : i + 10_000]))]
                out = y * (rows @ w) < 1
                rows, weight = rows[out], c[i : i + 10_000][out]
                left += (rows * weight[:, None]).T @ rows
                right += y * (rows.T @ weight)
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = w + (new - w) * (1.0 if step < 20 else 0.5)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability that y is 1, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-2 * a, (weight * (p - y)).sum()])
        r = weight * p * (1 - p) + 1e-9
        h = np.array([[(r * x * x).sum() + 1e-2, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


def _stretched(words: list[str], counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Each word with a letter put in, doubled or left out after its first, as further examples that share its weight."""
    out, weight = [], []
    for w, n in zip(words, counts, strict=True):
        made = [w[:i] + LETTERS[(i * 7 + k * 11 + len(w)) % len(LETTERS)] + w[i:] for i in range(1, len(w)) for k in range(PUT_IN)]
        made += [w[:i] + w[i] + w[i:] for i in range(1, len(w))]
        made += [w[:i] + w[i + 1 :] for i in range(1, len(w))] if len(w) >= P else []
        out += made
        weight += [STRETCHED * n / len(made)] * len(made)
    return out, np.array(weight)


def train(texts: list[str | None], labels: list[int]) -> Machine:
    """A machine from documents and their labels; without a label of either kind, one that says 0 throughout."""
    y = np.array(labels)
    # sentences matter in toxic documents; of clean ones every word is clean
    sentences = [[set(words_of(s)) for s in _SENTENCE(t or "")] if v else [] for t, v in zip(texts, labels, strict=True)]
    whole = [set().union(*s) if v else set(words_of(t)) for t, s, v in zip(texts, sentences, labels, strict=True)]
    toxic, clean = [w for w, v in zip(whole, y, strict=True) if v], [w for w, v in zip(whole, y, strict=True) if not v]
    marks = pick_landmarks(toxic, clean) if toxic and clean else []
    if not marks:
        return NEVER
    seen = Counter(w for d in clean for w in d)
    every = sorted(set().union(*whole))
    words, near = [], [np.zeros((2, 0))] * len(marks)  # only words that share a subsequence with a landmark
    only_clean = set(seen).difference(*toxic, marks)
    for i in range(0, len(every), 2_000):
        part = gram(every[i : i + 2_000], marks)
        live = np.flatnonzero(part.any(axis=1))
        own = np.array([j for j in live if every[i + j] in only_clean], np.int64)
        for k in range(len(marks)):
            held = np.c_[near[k], np.stack([part[own, k], i + own])]
            near[k] = held[:, np.argsort(-held[0], kind="stable")[:NEAR]]
        words += [every[i + j] for j in live]
    marks += sorted({every[int(j)] for x in near for value, j in x.T if value > 0.2})
    values, vectors = np.linalg.eigh(gram(marks, marks))
    keep = values > values.max() * 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström: kernel values with the landmarks times this
    rows_ = [(gram(words[i : i + 2_000], marks) @ root).astype(np.float32) for i in range(0, len(words), 2_000)]
    x = np.concatenate([np.zeros((0, root.shape[1]), np.float32), *rows_])
    del rows_, every
    number = {w: i for i, w in enumerate(words)}
    negative = np.array([seen[w] for w in words], float)

    def members(groups: list[set[str]]) -> list[np.ndarray]:
        found = [np.array([number[w] for w in g if w in number], np.int64) for g in groups]
        return [f for f in found if len(f)]

    bags = members([s for doc, v in zip(sentences, y, strict=True) if v for s in doc])
    hot = np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(f) for f in members(toxic))]), minlength=len(words))
    lift = (hot + 0.1) / len(toxic) / ((negative + 0.5) / len(clean))
    chosen = [f[lift[f].argmax()] for f in bags]
    chosen = [i for i in chosen if lift[i] > 3]
    if not chosen:
        return NEVER
    w, bias = np.zeros(x.shape[1]), 0.0
    for turn in range(ROUNDS):
        positive = np.bincount(np.array(chosen, np.int64), minlength=len(words)).astype(float)
        rows = np.flatnonzero(positive)
        others = np.flatnonzero(negative)
        spread, weight = _stretched([words[i] for i in rows], positive[rows])
        more = np.concatenate([np.zeros((0, x.shape[1])), *(gram(spread[i : i + 2_000], marks) @ root for i in range(0, len(spread), 2_000))])
        share = C_CLEAN / max(1, len(others))
        w, bias = _svm([
            (x[rows], 1.0, C_TOXIC * positive[rows] / positive.sum()),
            (more, 1.0, C_TOXIC * weight / positive.sum()),
            (x[others], -1.0, share * np.sqrt(negative[others])),
            (np.zeros((1, x.shape[1])), -1.0, share * np.sqrt([float(len(clean))])),
        ])
        if turn < ROUNDS - 1:
            f = x @ w + bias
            best = [g[f[g].argmax()] for g in bags]
            chosen = [i for i in best if f[i] > 0] or chosen

    alpha = root @ w
    which, keys, weights = bag(marks)
    table_ = np.unique(keys)
    folded = np.bincount(np.searchsorted(table_, keys), weights * alpha[which], len(table_))
    machine = Machine(table_, folded, bias, 1.0, 0.0)
    f = x @ w + bias
    margin = np.array(
        [max([bias, *f[[number[q] for q in d if q in number]]]) for d in whole]
    )
    # each toxic document counts again with its insult misspelt
    spread, weight = _stretched([words[i] for i in rows], positive[rows])
    margin, truth = np.r_[margin, machine.margins(spread)], np.r_[y, np.ones(len(spread))]
    machine.slope, machine.shift = _logistic(margin, truth, np.r_[np.ones(len(y)), weight * MISSPELT])
    return machine


class Scorer:
    """The highest margin of each text; margins of the words met so far are kept."""

    def __init__(self, machine: Machine, cache: int = CACHE):
        self.m, self.limit = machine, cache
        self.known: dict[str, float] = {}

    def margins(self, texts: list[str | None]) -> np.ndarray:
        words = [set(words_of(t)) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        new = list(set().union(*words) - self.known.keys())
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.known.update(zip(part, self.m.margins(part).tolist(), strict=True))
        get = self.known.__getitem__
        return np.array([max(map(get, w), default=self.m.bias) for w in words])


_workers: dict[str, Scorer] = {}


def _scorer(shared, token: str) -> Scorer:
    if token not in _workers:
        _workers.clear()
        _workers[token] = Scorer(shared.value)
    return _workers[token]


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    """Train on (doc_id, text) and (doc_id, toxic): for each label the ``sample_docs`` documents of the least hash."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # at most twice sample_docs ids: bounded by the parameter
    ids = least_hashed(marked, "toxic", sample_docs).drop("rank")
    rows = keyed_text(docs).join(F.broadcast(ids), "doc_id").select("text", "toxic").collect()
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``.

    Null, empty and wordless texts get the score of a text without a suspicious word; texts of any length are read whole;
    of equal words it does not matter which scores; repeated rows stay repeated; an empty table gives an empty result;
    columns but doc_id and text are ignored.
    """
    docs = keyed_text(docs)
    shared, token = docs.sparkSession.sparkContext.broadcast(machine), uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared, token)
        for b in slices(batches):
            p = scorer.m.probability(scorer.margins(b.column("text").to_pylist()))
            arrays = [b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, scored by a machine trained on labels outside the held-out fold.  Odd rows as in score."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    fold = "crc32(cast(doc_id as string)) % 5"
    machine = fit(docs, table(spark, sf_dir, "labels").where(f"{fold} <> 0"))
    return score(docs, machine).selectExpr("doc_id", f"{fold} = 0 as held_out", "score", "predicted")
