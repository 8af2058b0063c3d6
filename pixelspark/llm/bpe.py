"""Byte-level BPE with a hierarchical-bitmap rank queue.

For every merge rank there is a bucket of the linked-list positions where a pair of that rank
starts.  Two levels of bitmaps, of 256 bits a word, mark the ranks that have entries, so the next rank is found
by two find-first-set steps; entries whose pair has changed since are skipped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import kept, trim


class RankQueue:
    """The next merge of a pre-token: a bucket of linked-list positions for every rank.

    Bit ``r & 255`` of ``low[r >> 8]`` marks a non-empty bucket and bit a of ``top`` a word of ``low`` that is not
    zero, so two find-first-set steps give the lowest rank.  A bucket is a heap, for the leftmost of equal
    ranks.  All are empty again after each pre-token and serve the next.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=0) + 1
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.low = [0] * ((size >> 8) + 1)
        self.bit = [1 << i for i in range(256)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest-ranked adjacent pair, the leftmost of equals.

        ``after`` and ``before`` link the starts of the parts; the pair that starts at ``i`` is
        ``piece[i : after[after[i]]]`` and ``now[i]`` its rank.  Entries whose pair has changed
        since they were queued are skipped.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        buckets, low, bit = self.buckets, self.low, self.bit
        n, top = len(piece), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [get(piece[i : i + 2]) for i in range(n - 1)]
        now.append(None)
        for i, r in enumerate(now):
            if r is not None:
                bucket = buckets[r]
                if not bucket:
                    a = r >> 8
                    low[a] |= bit[r & 255]
                    top |= 1 << a
                bucket.append(i)  # ascending, so a heap
        while top:
            a = (top & -top).bit_length() - 1
            word = low[a]
            first = word & -word
            rank = (a << 8) + first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                low[a] = word = word ^ first
                if not word:
                    top &= top - 1
            if now[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            now[j] = None
            new = []
            if k < n:
                before[k] = i
                now[i] = r = get(piece[i : after[k]])
                if r is not None:
                    new.append((r, i))
            else:
                now[i] = None
            h = before[i]
            if h >= 0:
                r = get(piece[h:k])
                if r != now[h]:  # an equal rank still has its entry
                    now[h] = r
                    if r is not None:
                        new.append((r, h))
            for r, i in new:
                bucket = buckets[r]
                if bucket:
                    heappush(bucket, i)
                else:
                    bucket.append(i)
                    a = r >> 8
                    low[a] |= bit[r & 255]
                    top |= 1 << a
        out, i = [], 0
        while i < n:
            k = after[i]
            out.append(get(piece[i:k]))
            i = k
        return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class _Known(dict):
    """What recent pre-tokens became: two generations, so frequent ones stay when the older goes.

    An entry holds the decimal ids joined by commas and the bytes its ids decode to.
    """

    def __init__(self, codec: Codec, each: int, longest: int):
        self.codec, self.each, self.longest, self.older = codec, each, longest, {}

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        entry = self.older.get(piece)
        if entry is None:
            ids = self.codec.merge(piece.encode())
            entry = (",".join(map(str, ids)), self.codec.decode(ids))
        if len(piece) <= self.longest:
            if len(self) >= self.each:
                self.older = dict(self)
                self.clear()
            self[piece] = entry
        return entry


class Codec:
    """Encodes and decodes with one vocabulary; recent pre-tokens are remembered, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 450_000, longest: int = 64):
        self.find = regex.compile(pattern).findall
        self.merge = RankQueue(ranks).merge
        self.tokens = {r: t for t, r in ranks.items()}
        self.known = _Known(self, remember // 2, longest)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return numbers(self.coded(text)[0]).tolist()

    def coded(self, text: str) -> tuple[str, bytes]:
        """Decimal ids joined by commas and the bytes they decode to, of a whole text."""
        names, decoded = zip(*map(self.known.__getitem__, self.find(text)), strict=True) if text else ((), ())
        return ",".join(names), b"".join(decoded)


def numbers(joined: str) -> np.ndarray:
    return np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32)


def _encoder(vocabulary, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a worker has learned serves its later tasks too
        name = hashlib.sha256(vocabulary.value + pattern.encode()).hexdigest()
        codec = kept(name, lambda: Codec(read_ranks(vocabulary.value), pattern))
        for batch in batches:
            counts, digests, sources, all_ids = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                names, decoded = codec.coded(text.as_py() or "")
                counts.append(names.count(",") + 1 if names else 0)
                digests.append(hashlib.sha256(names.encode()).hexdigest())
                sources.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(numbers(names))
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(sources, pa.string())]
            names_out = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *all_ids]))))
                names_out.append("ids")
            yield pa.record_batch(columns, names=names_out)
            del columns, batch, all_ids
            trim()

    return run


def encode_documents(rows: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns the id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256`` (the bytes decoded from the ids); with ``with_ids`` also ``ids``.
    A null or empty text has no tokens and the digests of the empty string.  Rows are
    independent: repeated rows and null ids stay, an empty table gives an empty result, other
    columns are ignored.  The driver reads the vocabulary (under a megabyte, fixed) and
    broadcasts its bytes.  Memory of a task: the vocabulary, a bounded cache and one Arrow batch.
    """
    spark = rows.sparkSession
    with open(vocabulary_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    kind = dict(rows.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.select(F.col(id_col), F.col(text_col)).mapInArrow(_encoder(vocabulary, pattern, with_ids), schema)
