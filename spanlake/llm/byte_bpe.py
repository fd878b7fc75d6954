"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash (hash and displace, no empty slot) resolves a
pre-token that is a vocabulary entry as a whole; the slot's key is compared, so
a stranger is never taken for an entry.  Tier two: a heap over a linked list of
bytes applies the merges in rank order.  Vocabulary and hash are built once on
the driver (a fixed public file of some 50,000 entries) and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import id_text, parts_of, table

_M = (1 << 64) - 1
CACHE_BYTES = 80 << 20  # of pre-tokens a worker remembers in each of two generations
CACHED = 64  # bytes; longer pre-tokens are rare and are not remembered
PART = 50_000  # pre-tokens of a text that are held at once
BATCH_TEXT, BATCH_ROWS = 4 << 20, 1_000  # characters and rows of one batch of results


def load_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by id, from a file of base64 entry and rank per line."""
    with open(path, "rb") as f:
        pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]
    out = [b""] * len(pairs)
    for rank, entry in pairs:
        out[rank] = entry
    return out


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n, self.m = len(keys), max(1, len(keys) // per_bucket)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for i, h in enumerate(hashes):
            buckets[(h >> 40) % self.m].append(i)
        self.shift = [0] * self.m
        self.slots = [-1] * self.n
        taken, tries = np.zeros(self.n, bool), np.arange(256, dtype=np.uint64)
        order = sorted((b for b in range(self.m) if buckets[b]), key=lambda b: -len(buckets[b]))
        for b in (b for b in order if len(buckets[b]) > 1):
            own, base = np.array([hashes[i] for i in buckets[b]], np.uint64), 0
            while True:  # 256 displacements at a time; the first without a clash
                at = self._slots(own[None, :], (tries + np.uint64(base))[:, None])
                flat = np.sort(at, axis=1)
                good = ~taken[at].any(axis=1) & (flat[:, 1:] != flat[:, :-1]).all(axis=1)
                if good.any():
                    break
                base += len(tries)
            d = int(good.argmax())
            self.shift[b] = base + d
            taken[at[d]] = True
            for i, s in zip(buckets[b], at[d].tolist()):
                self.slots[s] = i
        free = iter(np.flatnonzero(~taken).tolist())
        for b in (b for b in order if len(buckets[b]) == 1):  # the remaining slots; negative: the slot itself
            s = next(free)
            self.shift[b] = -1 - s
            self.slots[s] = buckets[b][0]

    def _slots(self, h, d):
        with np.errstate(over="ignore"):
            return ((h + d * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) % np.uint64(self.n)).astype(np.int64)

    def _slot(self, h: int, d: int) -> int:
        return (((h + d * 0x9E3779B97F4A7C15) & _M) * 0xD6E8FEB86659FD93 & _M) % self.n if self.n else 0

    def get(self, key: bytes, h: int) -> int:
        """The key's candidate index; the caller compares the key."""
        d = self.shift[(h >> 40) % self.m]
        return self.slots[-1 - d if d < 0 else self._slot(h, d)]


class Codec:
    def __init__(self, entries: list[bytes], pattern: str):
        self.entries, self.pattern = entries, pattern
        self.hash = PerfectHash(entries)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.ready = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pair", "byte_id")} | {"cache": {}, "older": {}, "held": 0, "ready": None}

    def start(self) -> None:
        if self.ready is None:
            import regex

            self.ready = regex.compile(self.pattern)
            ranks = {e: i for i, e in enumerate(self.entries)}
            self.byte_id = [ranks[bytes([b])] for b in range(256)]
            self.pair = {  # every split of an entry in two entries -> its rank
                ranks[e[:k]] << 20 | ranks[e[k:]]: i
                for i, e in enumerate(self.entries) for k in range(1, len(e)) if e[:k] in ranks and e[k:] in ranks
            }

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token by a heap over linked bytes: lowest rank first, leftmost of equals."""
        pair, n = self.pair.get, len(token)
        ids = [self.byte_id[b] for b in token]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := pair(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r = pop(heap)
            i, r = r & 0xFFFFFFFF, r >> 32
            if ids[i] < 0 or (j := right[i]) >= n or pair(ids[i] << 20 | ids[j]) != r:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = r, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (x := pair(r << 20 | ids[k])) is not None:
                    push(heap, x << 32 | i)
            if (k := left[i]) >= 0 and (x := pair(ids[k] << 20 | r)) is not None:
                push(heap, x << 32 | k)
        return [x for x in ids if x >= 0]

    def pretoken(self, token: str) -> bytes:
        raw = token.encode()
        i = self.hash.get(raw, xxhash.xxh3_64_intdigest(raw)) if self.hash.n else -1
        ids = (i,) if i >= 0 and self.entries[i] == raw else self.merge(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, tokens: list[str]) -> bytes:
        cache, strange = self.cache, {}
        try:
            return b"".join(map(cache.__getitem__, tokens))
        except KeyError:
            pass
        if self.held > CACHE_BYTES:  # bounds a worker's memory; what is used again stays
            self.older, self.cache, self.held = cache, {}, 0
            cache = self.cache
        older = self.older.get
        for t in set(tokens):
            if t not in cache:
                ids = older(t) or self.pretoken(t)
                if len(t) > CACHED:
                    strange[t] = ids
                else:
                    cache[t] = ids
                    self.held += 150 + 2 * len(t) + len(ids)  # two objects and their place in the table
        if not strange:
            return b"".join(map(cache.__getitem__, tokens))
        return b"".join(strange[t] if t in strange else cache[t] for t in tokens)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; PART pre-tokens of a long text are held at a time."""
        if self.ready is None:
            self.start()
        if len(text) <= 4 * PART:
            return self._ids(self.ready.findall(text))
        found, out = (m[0] for m in self.ready.finditer(text)), []
        while part := list(islice(found, PART)):
            out.append(self._ids(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        parts = (b"".join(map(self.entries.__getitem__, at[i:i + PART].tolist())) for i in range(0, len(at), PART))
        return b"".join(parts)


_worker: dict = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """From a ranks file; by default the public 50k byte-level vocabulary and its pattern."""
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return Codec(load_ranks(path), pattern)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (array of int).

    Null counts as empty (no ids).  No special tokens; their strings are ordinary
    text.  Ids are decoded again and decoded_sha256 is of the decoded bytes.
    Repeated rows give repeated rows; further columns of docs are ignored.
    """
    narrow = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def run(batches):
        c = shared.value
        c = _worker.setdefault((len(c.entries), c.pattern, hash(tuple(c.entries[-50:]))), c)  # keeps its cache between tasks
        for batch in batches:
            for part in parts_of(batch, "text", BATCH_TEXT, BATCH_ROWS):
                n, sha, back, ids = [], [], [], []
                for text in part.column("text"):
                    data = c.encode(text.as_py() or "")
                    n.append(len(data) // 4)
                    sha.append(hashlib.sha256(data).hexdigest())
                    back.append(hashlib.sha256(c.decode(data)).hexdigest())
                    if with_ids:
                        ids.append(data)
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype("<i4")
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return narrow.mapInArrow(run, out)


def bpe_decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None, to_col: str = "text") -> DataFrame:
    """Adds column to_col: the decoded UTF-8 text, in place of a column of that name (null ids: null; ids
    outside the vocabulary: error; no ids: the empty text).  Other columns, repeated rows and their number stay."""
    import pandas as pd

    shared = encoded.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def back(ids):
        c = shared.value
        return ids.map(lambda x: None if x is None else c.decode(np.asarray(x, "<u4").tobytes()).decode("utf-8", "replace"))

    back.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    return encoded.withColumn(to_col, F.pandas_udf(back, "string")(F.col(ids_col)))


def op6_byte_bpe(spark, sf_dir):
    return bpe_encode(table(spark, sf_dir, "documents"), with_ids=False)
