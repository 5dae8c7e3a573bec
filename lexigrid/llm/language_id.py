"""Language identification by interpolated Kneser-Ney character models.

A word is spelled with a mark at either end; its characters are predicted from up to ``ORDER`` - 1 before them.  The
highest order uses counts, the lower ones continuation counts, each with its own discount, mixed down to a uniform
start.  All languages share one sorted array of gram hashes an order, with a row of probabilities beside each hash, so
one binary search serves every language; back-off weights stand in another such array.  Scores of words are kept by
each worker, for up to ``CACHE`` words.

The language with the lowest bits a character wins.  On documents that the models were not fitted on, a temperature is
calibrated for the score, and for each language the ``REJECT`` quantile of its own bits a character: a text above it is
flagged as rejected.
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

ORDER = 4
#: Documents of each language that are sampled; every CALIBRATION_PART-th is calibrated on, the rest fitted on.
SAMPLE_DOCS, CALIBRATION_PART = 300, 4
CACHE, REJECT, UNKNOWN = 400_000, 0.999, "und"
#: Words of the pieces that the score is calibrated on besides whole texts.
PIECE = 12
_WORD = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, lower-cased; numerals such as \u00bd or \u2167 are no letters."""
    found = _WORD(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def _grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every predicted character: the hash of its n-gram, that of its context, and the word it is in.

    Contexts shorter than n - 1 at a word's start are filled with the mark.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    pad = ORDER
    text = "\x02" * pad + ("\x03" + "\x02" * pad).join(words) + "\x03"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes + 1)
    at = np.arange(len(of)) + pad * (of + 1)
    context = np.full(len(of), n, np.uint64)
    for i in range(n - 1, 0, -1):
        context = _step(context, codes[at - i])
    return _step(context, codes[at]), context, of


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in a sorted array; -1 where absent."""
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


@dataclass
class Models:
    """langs; for each order the gram hashes with bits (keys x langs), the context hashes with back-off weights."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    uniform: float
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def probabilities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters x langs) probabilities, and the word of each character."""
        top, _, of = _grams(words, ORDER)
        out = np.empty((len(top), len(self.langs)), np.float32)
        todo, held = np.arange(len(top)), []
        for n in range(ORDER, 0, -1):
            gram, context, _ = _grams(words, n)
            keys, rows = self.grams[n - 1]
            at = _find(keys, gram[todo])
            out[todo[at >= 0]] = rows[at[at >= 0]]
            todo = todo[at < 0]
            held.append((todo, context[todo]))
            if not len(todo):
                break
        out[todo] = self.uniform
        for n, (rows, context) in zip(range(ORDER - len(held) + 1, ORDER + 1), reversed(held), strict=True):
            keys, weights = self.contexts[n - 1]
            at = _find(keys, context)
            out[rows] *= np.where((at >= 0)[:, None], weights[at], np.float32(1))
        return out, of

    def word_bits(self, words: list[str]) -> np.ndarray:
        """(words x langs): the bits that each language's model spends on each word."""
        p, of = self.probabilities(words)
        bits = -np.log2(p).astype(np.float64)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        return np.add.reduceat(bits, starts, axis=0)


def fit(samples: dict[str, list[str]]) -> Models:
    """Models of the languages from their texts."""
    langs = sorted(samples)
    if not langs:
        return Models([], [], [], 0.0)
    counted = {x: Counter(w for t in samples[x] for w in words_of(t)) or Counter(["\x03"]) for x in langs}
    words = {x: list(c) for x, c in counted.items()}
    times = {x: np.fromiter(c.values(), np.int64, len(c)) for x, c in counted.items()}
    alphabet = len({c for ws in words.values() for w in ws for c in w}) + 2
    uniform = 1 / alphabet
    grams, contexts = [], []
    below: dict[str, np.ndarray] = {}
    own_grams = {x: _grams(words[x], 1) for x in langs}
    shorter_grams = own_grams
    for n in range(1, ORDER + 1):
        longer_grams = {x: _grams(words[x], n + 1) for x in langs} if n < ORDER else {}
        gram_all = np.concatenate([own_grams[x][0] for x in langs])
        context_all = np.concatenate([own_grams[x][1] for x in langs])
        all_keys, all_contexts = np.unique(gram_all), np.unique(context_all)
        probs = np.zeros((len(all_keys), len(langs)))
        weights = np.ones((len(all_contexts), len(langs)))
        # a gram of the union, seen in whichever language: its context and the gram one shorter
        first = np.unique(gram_all, return_index=True)[1]
        context_of = np.searchsorted(all_contexts, context_all[first])
        if n > 1:
            shorter = np.searchsorted(grams[-1][0], np.concatenate([shorter_grams[x][0] for x in langs])[first])
        for j, x in enumerate(langs):
            gram, _, of = own_grams[x]
            if n == ORDER:
                kinds, inverse = np.unique(gram, return_inverse=True)
                counts = np.bincount(inverse, times[x][of]).astype(np.int64)
            else:  # how many different characters stand before the gram
                longer = np.unique(longer_grams[x][0], return_index=True)[1]
                kinds, counts = np.unique(gram[longer], return_counts=True)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            row = np.searchsorted(all_keys, kinds)
            total = np.bincount(context_of[row], counts, len(all_contexts))
            types = np.bincount(context_of[row], minlength=len(all_contexts))
            has = total > 0
            weights[has, j] = np.maximum(discount * types[has] / total[has], 1e-9)
            own = np.zeros(len(all_keys))
            own[row] = np.maximum(counts - discount, 0) / total[context_of[row]]
            lower = below[x][shorter] if n > 1 else np.full(len(all_keys), uniform)
            probs[:, j] = own + weights[context_of, j] * lower
        below = {x: probs[:, j] for j, x in enumerate(langs)}
        grams.append((all_keys, np.maximum(probs, 1e-12).astype(np.float32)))
        contexts.append((all_contexts, weights.astype(np.float32)))
        shorter_grams, own_grams = own_grams, longer_grams
    return Models(langs, grams, contexts, uniform)


class Scorer:
    """Bits a character of texts, with the bits of the words met so far kept."""

    def __init__(self, models: Models, cache: int = CACHE):
        self.m, self.limit = models, cache
        self.known: dict[str, int] = {}
        self.bits = np.empty((0, len(models.langs)))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x langs) bits a character, and the number of characters; 0 where there is no letter."""
        words = [words_of(t) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
            self.bits = self.bits[:0]
        new = sorted({w for ws in words for w in ws} - self.known.keys())
        if new:
            self.known.update(zip(new, range(len(self.bits), len(self.bits) + len(new)), strict=True))
            parts = [self.m.word_bits(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            self.bits = np.concatenate([self.bits, *parts])
        out, n, get = np.zeros((len(texts), len(self.m.langs))), np.zeros(len(texts)), self.known.__getitem__
        for i, ws in enumerate(words):
            if ws:
                n[i] = sum(map(len, ws)) + len(ws)
                out[i] = self.bits[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0) / n[i]
        return out, n


def confidence(bits: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    """(texts x langs), each row adding to 1: less sure for short texts and small gaps."""
    z = -(bits - bits.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None] * temperature
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def calibrate(models: Models, texts: list[str], langs: list[str]) -> Models:
    """Set the temperature with the least log loss, and each language's rejection limit."""
    if not models.langs:
        return models
    # short texts too: all of each text again in pieces
    pieces = [(" ".join(w[i : i + PIECE]), x) for t, x in zip(texts, langs, strict=True) for w in [words_of(t)] for i in range(0, len(w), PIECE)]
    texts = [*texts, *(t for t, _ in pieces)]
    langs = [*langs, *(x for _, x in pieces)]
    bits, n = Scorer(models).score(texts)
    has = n > 0
    truth = np.array([models.langs.index(x) for x in langs], np.int64)
    loss = {}
    for t in 2.0 ** np.arange(-4, 5, 0.5):
        p = confidence(bits[has], n[has], t)
        loss[t] = -np.log(np.maximum(p[np.arange(has.sum()), truth[has]], 1e-6)).mean()
    models.temperature = min(loss, key=loss.get) if loss else 1.0
    models.limits = np.full(len(models.langs), np.inf)
    for j in range(len(models.langs)):
        own = bits[(truth == j) & (n >= 20), j]
        if len(own):
            models.limits[j] = np.quantile(own, REJECT) * 1.05
    return models


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Models from (doc_id, text, lang): ``sample_docs`` documents of each language, those of the least hash of doc_id."""
    known = labelled.where("lang is not null and doc_id is not null")
    # sample_docs ids a language: bounded by the parameter
    ids = F.broadcast(least_hashed(known, "lang", sample_docs))
    rows = known.join(ids, ["doc_id", "lang"]).select("text", "lang", "rank").collect()
    rows = [r for r in rows if r["text"] and r["lang"]]
    samples: dict[str, list[str]] = {}
    for r in rows:
        if r["rank"] % CALIBRATION_PART:
            samples.setdefault(r["lang"], []).append(r["text"])
    rest = [r for r in rows if r["rank"] % CALIBRATION_PART == 0 and r["lang"] in samples]
    return calibrate(fit(samples), [r["text"] for r in rest], [r["lang"] for r in rest])


_workers: dict[str, Scorer] = {}


def _scorer(shared, token: str) -> Scorer:
    """One scorer a worker and model, so that later tasks find the words of earlier ones."""
    if token not in _workers:
        _workers.clear()
        _workers[token] = Scorer(shared.value)
    return _workers[token]


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, bits_per_char) for each row of ``docs``.

    Models of no language (nothing labelled) give ``und`` throughout.  Texts that are null or have no letter are ``und``
    with score 0; texts of any length are read whole; ties go to the language first by name; repeated rows stay repeated;
    an empty table gives an empty result; columns but doc_id and text are ignored.
    """
    docs = keyed_text(docs)
    if not models.langs:
        return docs.selectExpr(
            "doc_id", f"'{UNKNOWN}' as lang_pred", "0D as score", "true as rejected", "cast(null as double) as bits_per_char"
        )
    shared, token = docs.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared, token)
        langs, limits = np.array(scorer.m.langs, object), scorer.m.limits
        for b in slices(batches):
            bits, n = scorer.score(b.column("text").to_pylist())
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            p = confidence(bits, n, scorer.m.temperature)[np.arange(len(bits)), best]
            has = n > 0
            arrays = [
                b.column("doc_id"),
                pa.array(np.where(has, langs[best], UNKNOWN), pa.string()),
                pa.array(np.where(has, p, 0.0)),
                pa.array(~has | (least > limits[best])),
                pa.array(least, mask=~has),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "rejected", "bits_per_char"])

    return docs.mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, bits_per_char double"
    )


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, by models of the languages outside the held-out fold.  Odd rows as in identify."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    fold = "crc32(cast(doc_id as string)) % 3"
    models = train(docs.where(f"{fold} <> 1").select("doc_id", "text", "lang"))
    out = identify(docs, models)
    return out.selectExpr("doc_id", f"{fold} = 1 as held_out", "lang_pred", "score", "rejected")
