"""Byte-level BPE by contiguous rank arrays.

A word is held as a row of parts and a row of the ranks of adjacent parts.  The least rank (the leftmost on ties) is
found by a scan, the boundary is deleted, and the two neighbouring ranks are looked up again.  Words of one length are
rows of one matrix, so a scan is one vector operation over thousands of words.  Words of over ``SHORT`` bytes go
through a linked list and a heap, whose cost stays n log n.  Each worker keeps the encoded form of the words it met,
up to ``CACHE`` of them.  Vocabulary and merges are broadcast; their size is that of the vocabulary file.
"""

from __future__ import annotations

import hashlib
import uuid
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexigrid.llm.common import bounded_batches, keyed_text, slices, table

SHORT = 48
CACHE = 400_000
NONE = np.iinfo(np.int32).max
# The published split pattern of byte-level BPE, white space spelled out as the Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """What a tokenizer file says, as arrays that can be broadcast."""

    tokens: list[bytes]
    special: dict[str, int]
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_chars()
        ids = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            known = all(c in of for c in token)
            tokens[i] = bytes(of[c] for c in token) if known else token.encode()
        for token, i in special.items():
            tokens[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        made = np.array([ids[a + b] for a, b in merges], np.int32)
        bytes_ = np.zeros(256, np.int32)
        for c, b in of.items():
            bytes_[b] = ids[c]
        return cls(tokens, special, bytes_, keys[order], order.astype(np.int32), made[order])


class Encoder:
    """Encodes and decodes texts; keeps the words it met."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.v, self.limit = vocabulary, cache
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall
        inside = sorted(vocabulary.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, inside)) + ")") if inside else None
        self.pairs = {
            int(k): (int(r), int(i))
            for k, r, i in zip(vocabulary.pair_keys, vocabulary.pair_ranks, vocabulary.pair_ids, strict=True)
        }

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NONE where the pair does not merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.v.pair_keys, keys), len(self.v.pair_keys) - 1)
        there = self.v.pair_keys[at] == keys
        return np.where(there, self.v.pair_ranks[at], NONE), self.v.pair_ids[at]

    def _short(self, words: list[bytes]) -> list[bytes]:
        """Words of one length."""
        n = len(words[0])
        parts = self.v.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)]
        out: list[bytes] = [b""] * len(words)
        if n == 1:
            return [p.astype("<u4").tobytes() for p in parts]
        ranks, ids = self._ranks(parts[:, :-1], parts[:, 1:])
        rows = np.arange(len(words))
        while len(rows):
            at = ranks.argmin(axis=1)  # the first of equals
            every = np.arange(len(rows))
            go = ranks[every, at] < NONE
            for r, p in zip(rows[~go], parts[~go].astype("<u4"), strict=True):
                out[r] = p.tobytes()
            if not go.any():
                break
            rows, parts, ranks, ids, at = rows[go], parts[go], ranks[go], ids[go], at[go]
            every = np.arange(len(rows))
            parts[every, at] = ids[every, at]
            width = parts.shape[1] - 1
            if width == 1:
                for r, p in zip(rows, parts[:, :1].astype("<u4"), strict=True):
                    out[r] = p.tobytes()
                break
            span = np.arange(width)
            parts = np.take_along_axis(parts, span + (span > at[:, None]), axis=1)
            keep = span[:-1] + (span[:-1] >= at[:, None])
            ranks, ids = np.take_along_axis(ranks, keep, axis=1), np.take_along_axis(ids, keep, axis=1)
            for shift in (-1, 0):
                x = at + shift
                e = every[(x >= 0) & (x < width - 1)]
                x = x[e]
                ranks[e, x], ids[e, x] = self._ranks(parts[e, x], parts[e, x + 1])
        return out

    def _long(self, word: bytes) -> bytes:
        part = [int(self.v.byte_ids[b]) for b in word]
        n = len(part)
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.pairs.get
        heap = [(m[0], i, part[i], part[i + 1], m[1]) for i in range(n - 1) if (m := get(part[i] << 32 | part[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := get(part[x] << 32 | part[y])):
                    heapq.heappush(heap, (m[0], x, part[x], part[y], m[1]))
        return np.array([p for p in part if p >= 0], "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        by: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            by.setdefault(len(b := w.encode()), []).append((w, b))
        for n, group in by.items():
            if n > SHORT:
                self.known.update((w, self._long(b)) for w, b in group)
            else:
                for at in range(0, len(group), 8192):
                    part = group[at : at + 8192]
                    self.known.update(zip((w for w, _ in part), self._short([b for _, b in part]), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; none for null and empty texts."""
        split: list[list[str | int]] = []
        for t in texts:
            pieces: list = []
            for piece in self.specials.split(t) if t and self.specials else [t] if t else []:
                pieces += [self.v.special[piece]] if piece in self.v.special else self.split(piece)
            split.append(pieces)
        if len(self.known) > self.limit:
            self.known.clear()
        new = {w for pieces in split for w in pieces if w.__class__ is str} - self.known.keys()
        if new:
            self._learn(new)
        known = self.known
        ids = {i: np.array([i], "<u4").tobytes() for i in self.v.special.values()}
        return [b"".join([known[w] if w.__class__ is str else ids[w] for w in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> str:
        tokens = self.v.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_workers: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder a worker and broadcast, so that later tasks find the words of earlier ones."""
    if shared.id not in _workers:
        _workers.clear()
        _workers[shared.id] = Encoder(shared.value)
    return _workers[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex  # no later broadcast can have it

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>): the tokens of every whole text.  Null texts have none."""
    docs = keyed_text(docs)
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for b in slices(batches):
            ids = [np.frombuffer(x, "<i4") for x in e.encode_batch(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    shared = _Shared(encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for b in batches:
            texts = [e.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text and decodes its ids, in one pass.

    Null and empty texts have no token; texts of any length are read whole; of pairs of equal rank the first is joined;
    repeated rows stay repeated; an empty table gives an empty result; columns but doc_id and text are ignored.
    """
    docs = keyed_text(docs)
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, sha = _encoder(shared), hashlib.sha256
        for b in slices(batches):
            ids = e.encode_batch(b.column("text").to_pylist())
            back = [e.decode(x).encode() for x in ids]
            arrays = [
                b.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([sha(x).hexdigest() for x in ids], pa.string()),
                pa.array([sha(x).hexdigest() for x in back], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, encoded and decoded.  Odd rows as in round_trip_digests."""
    bounded_batches(spark)
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path())
