"""Suffix-array dedup: bytes covered by a window that also starts earlier in the collection.

Equal windows are found in three steps.

1. Anchors.  Every window of ``window`` bytes holds a k-gram of least hash (the leftmost of equals).  The
   windows of a text fall into *runs* that share an anchor; equal windows have equal anchors, so
   only runs whose anchor's hash occurs more than once in the corpus can hold a repeat.
2. Sorting.  The bytes of such a run, cut out with its windows, are the documents of a small
   collection, aligned at the anchor.  Their order is built column-wise from the right: each round
   inserts one symbol of every document, updates the transform (the documents in the order of what
   follows the column) and the common prefixes of neighbours, and reads and writes both as
   sequential files.  Windows of one column whose common prefix reaches the window are equal.
3. The earliest of equal windows stays; the bytes of all others are removed.

Runs with equal bytes are one document of the collection (their earliest owner stands for them), and
an anchor with one such document needs no sorting.  Runs of an anchor that is hot (a share of all runs) are cut into
single windows, which meet by their own hash.  Texts travel twice, in compressed blocks.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import _powers, mix
from .jaccard import TOKEN_BITS, pack, unpack
from .scratch import Scratch
from .workers import release

_BLOB = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"
_FIELDS = ["bucket", "kind", "a", "b", "c", "d", "e"]
_TYPES = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
TEXT, RUNS, CUTS, KNOWN = 0, 1, 2, 3
PIECE = 1 << 19
AT_ONCE = 1 << 12


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_FIELDS)


def runs_of(data: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first start, number of starts, anchor's place after it, anchor's hash.

    Long texts are taken in pieces; a run cut at a piece's end is two runs, which changes nothing.
    """
    span = window - k + 1
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(len(data) - window + 1, 0), PIECE):
        part = data[a : a + PIECE + window - 1]
        n = len(part) - k + 1  # k-grams
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        grams = mix((total[k:] - total[:-k]) * down[:n])
        least = _sliding_min(grams >> np.uint64(1), span)
        starts = len(least)
        where = _leftmost(grams >> np.uint64(1), least)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        length = np.diff(np.append(first, starts))
        anchor = where[first]
        # least hashes crowd at the low end, so they are spread again
        out.append((first + a, length, anchor - first, mix(grams[anchor] + np.uint64(1)) >> np.uint64(64 - TOKEN_BITS)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values."""
    n = len(v)
    pad = -n % w
    full = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).reshape(-1)
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _leftmost(v: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Place of the leftmost value equal to the least of each stretch that starts at or after it."""
    starts = np.arange(len(least))
    change = np.flatnonzero(np.diff(least, prepend=least[:1] ^ np.uint64(1)))
    # within stretches of one value, search that value's places
    order = np.argsort(v, kind="stable")
    sorted_v = v[order]
    lo = np.searchsorted(sorted_v, least[change])
    count = np.searchsorted(sorted_v, least[change], side="right") - lo
    out = np.empty(len(least), np.int64)
    end = np.append(change[1:], len(least))
    single = count == 1
    reps = end - change
    out[:] = np.repeat(order[lo], reps)
    for i in np.flatnonzero(~single):
        places = np.sort(order[lo[i] : lo[i] + count[i]])
        s = starts[change[i] : end[i]]
        out[change[i] : end[i]] = places[np.searchsorted(places, s)]
    return out


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""


def _part_of(token: np.ndarray, parts: int) -> np.ndarray:
    """The part of the range of anchor hashes."""
    return np.minimum((token.astype(np.float64) * (parts / 2.0**TOKEN_BITS)).astype(np.int64), parts - 1)


def _stretches(to: np.ndarray, kind: int, key: np.ndarray, first: np.ndarray, shape: np.ndarray, token: np.ndarray) -> Iterator[tuple]:
    """Rows of runs by where they go; ``to`` ascends."""
    start = np.flatnonzero(np.diff(to, prepend=-1))
    for a, b in zip(start.tolist(), np.append(start, len(to))[1:].tolist(), strict=True):
        ids, at = np.unique(key[a:b], return_inverse=True)
        yield int(to[a]), kind, pack(ids, step=True), pack(at), pack(first[a:b]), pack(shape[a:b]), pack(token[a:b])


def _anchors(batches: Iterator[pa.RecordBatch], window: int, k: int, parts: int, step: int, flush: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Runs by part of the range of anchor hashes: owner keys, owner, start, shape (length, anchor, known), hash.

    An anchor that occurs again among the runs at hand is known to repeat: its runs go to the buckets of
    their texts at once, and one of them, marked so, to the part.  However frequent an anchor is, its
    part gets it once from each lot of runs.  ``step`` parts or buckets share a row.
    """
    release()
    keys, sizes, cols, held = [], [], [], 0

    def blocks() -> Iterator[pa.RecordBatch]:
        first, length, place, token = (np.concatenate(c) for c in zip(*cols, strict=True))
        key = np.repeat(np.array(keys, np.int64).view(np.uint64), sizes)
        order = np.argsort(token, kind="stable")
        first, shape, token, key = first[order], (length * 512 + place * 2)[order], token[order], key[order]
        lead = np.flatnonzero(np.diff(token, prepend=token[:1] ^ np.uint64(1)))
        count = np.diff(np.append(lead, len(token)))
        for row in _stretches(_part_of(token[lead], parts) // step, RUNS, key[lead], first[lead], shape[lead] + (count > 1), token[lead]):
            yield _batch([row])
        again = np.flatnonzero(np.repeat(count > 1, count))
        bucket = _bucket_of(key[again], parts) // step
        order = np.argsort(bucket, kind="stable")
        again = again[order]
        for row in _stretches(bucket[order], KNOWN, key[again], first[again], shape[again], token[again]):
            yield _batch([row])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
            found = runs_of(np.frombuffer(text, np.uint8), window, k)
            if not len(found[0]):
                continue
            keys.append(key)
            sizes.append(len(found[0]))
            cols.append(found)
            held += len(found[0])
            if held >= flush:
                yield from blocks()
                keys, sizes, cols, held = [], [], [], 0
    if keys:
        yield from blocks()
    release()


def _respread(batches: Iterator[pa.RecordBatch], parts: int, flush: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows for several parts or buckets at once, dealt out to each: the second half of an exchange to very many."""
    lots: dict[int, list[list[np.ndarray]]] = {kind: [[], [], [], []] for kind in (RUNS, KNOWN)}
    held = 0

    def blocks() -> Iterator[pa.RecordBatch]:
        for kind, lot in lots.items():
            key, first, shape, token = (np.concatenate([np.zeros(0, np.uint64), *c]) for c in lot)
            to = _part_of(token, parts) if kind == RUNS else _bucket_of(key, parts)
            order = np.argsort(to, kind="stable")
            for row in _stretches(to[order], kind, key[order], first[order], shape[order], token[order]):
                yield _batch([row])
            for c in lot:
                c.clear()

    for batch in batches:
        for kind, *row in zip(*(batch.column(c) for c in _FIELDS[1:]), strict=True):
            ids, at, *values = (unpack(x.as_py()) for x in row)
            for column, v in zip(lots[kind.as_py()], (ids[at.astype(np.int64)], *values), strict=True):
                column.append(v)
            held += len(at)
        if held >= flush:
            yield from blocks()
            held = 0
    yield from blocks()
    release()


def _frequent(batches: Iterator[pa.RecordBatch], least: int = 8, flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Anchors that many runs of a lot share, and how many; and the number of runs, as anchor -1."""
    held: list[np.ndarray] = []
    n = 0

    def counted() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        often = count >= least
        return pa.record_batch([pa.array(np.append(token[often].astype(np.int64), -1)), pa.array(np.append(count[often], n))], names=["token", "n"])

    for batch in batches:
        for e in batch.column("e"):
            held.append(unpack(e.as_py()))
            n += len(held[-1])
            if n >= flush:
                yield counted()
                held, n = [], 0
    yield counted()


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _repeated_runs(table: pa.Table, parts: int, step: int) -> pa.Table:
    """Runs of a part whose anchor occurs more than once, by bucket of their text; known ones pass through."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    rows = []
    for bucket, kind, *row in zip(*(table.column(c) for c in _FIELDS), strict=True):
        row = [x.as_py() for x in row]
        if kind.as_py() == KNOWN:
            rows.append((bucket.as_py() // step, KNOWN, *row))
            continue
        ids, at, first, shape, token = map(unpack, row)
        for col, v in zip(cols, (ids[at.astype(np.int64)], first, shape, token), strict=True):
            col.append(v)
    if cols[0]:
        key, first, shape, token = (np.concatenate(c) for c in cols)
        order = np.argsort(token, kind="stable")
        t = token[order]
        same = np.diff(t) == 0
        order = order[np.append(same, False) | np.insert(same, 0, False)]
        order = order[(shape[order] & np.uint64(1)) == 0]  # the others have been sent
        bucket = _bucket_of(key[order], parts) // step
        order = order[np.lexsort((first[order], key[order], bucket))]
        rows += _stretches(_bucket_of(key[order], parts) // step, KNOWN, key[order], first[order], shape[order], token[order])
    out = pa.Table.from_batches([_batch(rows)])
    release()
    return out


def _texts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of texts by bucket: keys, lengths, bytes."""
    for batch in batches:
        keys = np.array(batch.column(0).to_pylist(), np.int64)
        texts = list(_bytes(batch.column(1)))
        bucket = _bucket_of(keys, buckets) if len(keys) else keys
        for b in np.unique(bucket):
            at = np.flatnonzero(bucket == b)
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts[i] for i in at))
            size = np.array([len(texts[i]) for i in at], np.uint64)
            yield _batch([(int(b), TEXT, pack(keys[at].view(np.uint64)), pack(size), body, b"", b"")])


def _open_bucket(table: pa.Table) -> tuple[dict[int, bytes], tuple[np.ndarray, ...], list[tuple]]:
    """Texts by key; runs sorted by (key, start): key, start, length, place, token; cut ranges."""
    texts: dict[int, bytes] = {}
    cols: list[list[np.ndarray]] = [[], [], [], []]
    cuts = []
    for kind, *row in zip(*(table.column(c) for c in _FIELDS[1:]), strict=True):
        kind, (a, b, c, d, e) = kind.as_py(), (x.as_py() for x in row)
        if kind == TEXT:
            size = unpack(b).astype(np.int64)
            body = zstandard.ZstdDecompressor().decompress(c, max_output_size=int(size.sum()) + 1)
            at = 0
            for key, n in zip(unpack(a).view(np.int64).tolist(), size.tolist(), strict=True):
                texts[key] = body[at : at + n]
                at += n
        elif kind in (RUNS, KNOWN):
            for col, v in zip(cols, (unpack(a)[unpack(b).astype(np.int64)].view(np.int64), unpack(c).astype(np.int64), unpack(d).astype(np.int64), unpack(e)), strict=True):
                col.append(v)
        else:
            cuts.append((unpack(a).view(np.int64)[unpack(b).astype(np.int64)], unpack(c).astype(np.int64), unpack(d).astype(np.int64)))
    if not cols[0]:
        z = np.zeros(0, np.int64)
        return texts, (z, z, z, z, z.view(np.uint64)), cuts
    key, first, shape, token = (np.concatenate(c) for c in cols)
    order = np.lexsort((first, key))
    return texts, (key[order], first[order], shape[order] >> 9, shape[order] >> 1 & 255, token[order]), cuts


def _earliest(texts: dict[int, bytes], runs: tuple[np.ndarray, ...], window: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct (anchor, bytes) of a bucket: the bytes, the index of the earliest run, and which runs are not it."""
    seen: dict[tuple, int] = {}
    strings, firsts = [], []
    later = np.zeros(len(runs[0]), bool)
    text, last = b"", None
    for i, (key, first, length, place, token) in enumerate(zip(*(c.tolist() for c in runs), strict=True)):
        if key != last:
            text, last = texts[key], key
        x = text[first : first + length + window - 1]
        name = (token, place, x)
        if name in seen:
            later[i] = True
        else:
            seen[name] = i
            strings.append(x)
            firsts.append(i)
    return strings, np.array(firsts, np.int64), later


def _single_windows(strings: list[bytes], runs: list[np.ndarray], hot: np.ndarray, window: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Runs of hot anchors, cut into their windows; each goes by its own hash, so no part gets all of an anchor.

    Equal windows have one hash, one place of the anchor and one part, as equal runs have.
    """
    key, first, length, place, token = runs
    if not len(hot):
        return strings, runs
    is_hot = np.isin(token, hot)
    rest = np.flatnonzero(~is_hot)
    out, kept = [c[rest].tolist() for c in runs], [strings[i] for i in rest.tolist()]
    for i in np.flatnonzero(is_hot).tolist():
        for o in range(int(length[i])):
            w = strings[i][o : o + window]
            kept.append(w)
            for column, v in zip(out, (int(key[i]), int(first[i]) + o, 1, int(place[i]) - o, int.from_bytes(hashlib.blake2b(w, digest_size=TOKEN_BITS // 8).digest())), strict=True):
                column.append(v)
    return kept, [np.array(c, old.dtype) for c, old in zip(out, runs, strict=True)]


def _collect(table: pa.Table, window: int, parts: int, hot) -> pa.Table:
    """The distinct runs of a bucket with their earliest owners, by part of the range of anchor hashes."""
    texts, runs, _ = _open_bucket(table)
    strings, at, _ = _earliest(texts, runs, window)
    strings, (key, first, length, place, token) = _single_windows(strings, [c[at] for c in runs], hot.value, window)
    part = _part_of(token, parts)
    rows = []
    for p in np.unique(part):
        o = np.flatnonzero(part == p)
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(strings[i] for i in o))
        rows.append((int(p), RUNS, pack(key[o].view(np.uint64)), body, pack(first[o]), pack(length[o] * 256 + place[o]), pack(token[o])))
    release()
    return pa.Table.from_batches([_batch(rows)])


class Columns:
    """The documents of a collection as columns of symbols, in a file of its own: ``places`` rows of ``m`` symbols.

    The file is private to a task and unlinked when it is made, as Spark's own spill files are read by nobody else.
    """

    def __init__(self, places: int, m: int):
        self.places, self.m, self.file = places, m, tempfile.TemporaryFile()
        self.file.truncate(places * m)

    def write(self, block: np.ndarray, at: int) -> None:
        """A block of documents, from document ``at`` on."""
        for place, row in enumerate(block):
            self.file.seek(place * self.m + at)
            self.file.write(row.tobytes())

    def row(self, place: int) -> np.ndarray:
        self.file.seek(place * self.m)
        return np.fromfile(self.file, np.uint8, self.m)

    def block(self, at: int, n: int) -> np.ndarray:
        out = np.empty((self.places, min(n, self.m - at)), np.uint8)
        for place in range(self.places):
            self.file.seek(place * self.m + at)
            out[place] = np.fromfile(self.file, np.uint8, out.shape[1])
        return out

    def close(self) -> None:
        self.file.close()


def sort_columns(symbols: Columns, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Column-wise construction over documents of equal length.

    From the last place to the first: one symbol of each document is inserted in front of what is there.  Yields
    the place, the documents in the order of their text from there on, and whether each differs from its
    predecessor within ``window`` symbols.  Order and common prefixes live in files that each round reads
    and writes from start to end; a round holds one row of each.
    """
    m, kind = symbols.m, np.min_scalar_type(window)
    with tempfile.TemporaryFile() as old, tempfile.TemporaryFile() as new:
        np.arange(m, dtype=np.int32).tofile(old)
        np.zeros(m, dtype=kind).tofile(old)
        for c in range(symbols.places - 1, -1, -1):
            old.seek(0)
            order, prefix = np.fromfile(old, np.int32, m), np.fromfile(old, kind, m)
            s = symbols.row(c)[order]
            to = np.argsort(s, kind="stable")
            fresh = np.zeros(m, kind)
            ends = np.flatnonzero(np.diff(s[to], prepend=-1, append=-1))
            # the common prefix with the document before of the same symbol: the least in between, plus one
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if b - a > 1:
                    at = to[a:b]
                    fresh[a + 1 : b] = np.minimum.reduceat(prefix[: at[-1] + 1], at[:-1] + 1)
                    fresh[a + 1 : b] = np.minimum(fresh[a + 1 : b], window - 1) + 1
            order = order[to]
            new.seek(0)
            order.tofile(new)
            fresh.tofile(new)
            old, new = new, old
            yield c, order, fresh < window


def _resolve(table: pa.Table, window: int, k: int, buckets: int) -> pa.Table:
    """Ranges of windows that start earlier elsewhere: by bucket of the text: key, first byte, end."""
    reach = window - k  # the largest distance of a window's start before its anchor
    cols: list[list] = [[], [], [], []]
    strings: list[bytes] = []
    for key, body, first, shape, token in zip(*(table.column(c) for c in "abcde"), strict=True):
        key, first, shape, token = unpack(key.as_py()).view(np.int64), unpack(first.as_py()).astype(np.int64), unpack(shape.as_py()).astype(np.int64), unpack(token.as_py())
        size = (shape >> 8) + window - 1
        data = zstandard.ZstdDecompressor().decompress(body.as_py(), max_output_size=int(size.sum()) + 1)
        end = np.cumsum(size)
        strings += [data[b - n : b] for b, n in zip(end.tolist(), size.tolist(), strict=True)]
        for col, v in zip(cols, (key, first, shape, token), strict=True):
            col.append(v)
    key, first, shape, token = (np.concatenate(c) for c in cols)
    length, place = shape >> 8, shape & 255
    order = np.lexsort((first + place, key))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # equal documents of several buckets: the earliest owner stands for them, the rest goes
    best: dict[tuple, int] = {}
    removed: list[tuple[int, int, int]] = []  # run, from, to (starts)
    for i in order.tolist():
        name = (int(token[i]), int(place[i]), strings[i])
        if name in best:
            removed.append((i, 0, int(length[i])))
        else:
            best[name] = i
    docs = np.array(sorted(best.values()), np.int64)
    _, group, n = np.unique(token[docs], return_inverse=True, return_counts=True)
    docs = docs[n[group] > 1]
    if len(docs):
        # bring documents of one anchor together, so that ties before the first round are harmless
        docs = docs[np.argsort(token[docs], kind="stable")]
        places, m = reach + window, len(docs)
        symbols, gone = Columns(places, m), Columns(reach + 1, m)
        begin, size = reach - place[docs], length[docs] + window - 1
        for x in range(0, m, AT_ONCE):  # the places of all symbols at once would take 32 bytes each
            part = slice(x, min(x + AT_ONCE, m))
            joined = np.frombuffer(b"".join(strings[i] for i in docs[part].tolist()), np.uint8)
            n = size[part]
            row = np.arange(len(joined)) + np.repeat(begin[part] - np.cumsum(n) + n, n)
            matrix = np.zeros((places, part.stop - part.start), np.uint8)
            matrix[row, np.repeat(np.arange(part.stop - part.start), n)] = joined
            symbols.write(matrix, x)
        del best, strings, joined, row, matrix
        mine, past = rank[docs], begin + length[docs]
        for c, by, differs in sort_columns(symbols, window):
            if c > reach:
                continue
            later = np.zeros(m, np.uint8)
            live = (begin[by] <= c) & (c < past[by])
            group = np.cumsum(differs)[live]
            at = by[live]
            if len(at):
                start = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
                least = np.repeat(np.minimum.reduceat(mine[at], start), np.diff(np.append(start, len(at))))
                later[at] = mine[at] != least
            gone.write(later[None, :], c * m)
        symbols.close()
        for x in range(0, m, AT_ONCE):
            edge = np.diff(gone.block(x, AT_ONCE).astype(np.int8), axis=0, prepend=0, append=0)
            up, down = np.nonzero(edge.T == 1), np.nonzero(edge.T == -1)
            for j, a, b in zip((up[0] + x).tolist(), up[1].tolist(), down[1].tolist(), strict=True):
                removed.append((int(docs[j]), a - int(begin[j]), b - int(begin[j])))
        gone.close()
    if not removed:
        return pa.Table.from_batches([_batch([])])
    run, a, b = (np.array(c, np.int64) for c in zip(*removed, strict=True))
    owner, from_, to = key[run], first[run] + a, first[run] + b - 1 + window
    bucket = _bucket_of(owner, buckets)
    rows = []
    for x in np.unique(bucket):
        o = np.flatnonzero(bucket == x)
        ids, at = np.unique(owner[o], return_inverse=True)
        rows.append((int(x), CUTS, pack(ids.view(np.uint64), step=True), pack(at), pack(from_[o]), pack(to[o]), b""))
    release()
    return pa.Table.from_batches([_batch(rows)])


def merged(ranges: np.ndarray) -> np.ndarray:
    """Disjoint, non-touching ranges (from, end) that cover the same bytes."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    ends = np.maximum.accumulate(ranges[:, 1])
    new = np.append(True, ranges[1:, 0] > ends[:-1])
    at = np.flatnonzero(new)
    return np.column_stack([ranges[at, 0], ends[np.append(at[1:], len(ranges)) - 1]])


def _finish(table: pa.Table, window: int, with_text: bool) -> pa.Table:
    texts, runs, cuts = _open_bucket(table)
    _, _, later = _earliest(texts, runs, window)
    key = [runs[0][later], *(c[0] for c in cuts)]
    from_ = [runs[1][later], *(c[1] for c in cuts)]
    to = [(runs[1] + runs[2] + window - 1)[later], *(c[2] for c in cuts)]
    key, from_, to = (np.concatenate(c) for c in (key, from_, to))
    order = np.argsort(key, kind="stable")
    key, spans = key[order], np.column_stack([from_, to])[order]
    rows: list[list] = [[], [], [], [], [], []]
    for name, text in texts.items():
        mine = merged(spans[np.searchsorted(key, name) : np.searchsorted(key, name, side="right")])
        kept, at = [], 0
        for a, b in mine.tolist():
            kept.append(text[at:a])
            at = b
        kept = b"".join([*kept, text[at:]])
        values = (name, len(text), len(text) - len(kept), len(mine), hashlib.sha256(kept).hexdigest(), kept if with_text else None)
        for col, v in zip(rows, values, strict=True):
            col.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    out = pa.table([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return out if with_text else out.drop_columns(["kept"])


def remove_repeats(rows: DataFrame, window: int = 100, k: int = 36, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, part_bytes: int = 8_000_000, often: int = 4096, fan: int = 4096) -> DataFrame:
    """Removes every byte covered by a ``window``-byte string that also starts earlier.

    Earlier means in a text of smaller id or at a smaller place of the same text; overlaps count, and
    all is judged on the input.  Matches never cross texts.  Null ids come last.  Rows of one id
    are separate texts, in the order of their bytes.

    Returns id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``, and with
    ``with_text`` the kept bytes.  Null and empty texts have no bytes; texts shorter than the window
    lose nothing; an empty table gives an empty result; other columns are ignored.  Ids are integers.
    """
    if not 0 <= window - k <= 255:
        raise ValueError("the window must be longer than the anchor by at most 255 bytes")
    spark = rows.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    odd = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    named = None
    if not odd.isEmpty():
        # ids that do not name one row: number the rows in order; ranges are numbered one after the other
        ordered = docs.select("id", "text").orderBy(F.asc_nulls_last("id"), F.col("text").cast("binary"))
        docs = scratch.keep(ordered.withColumn("key", F.monotonically_increasing_id()))
        named = docs.select("key", "id")
        docs = docs.select("key", "text")
    else:
        docs = docs.select(F.col("id").alias("key"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    step = 1 if parts <= fan else -(-parts // math.isqrt(parts))

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows by part; to many parts in two exchanges, as one lot would leave next to nothing for each."""
        if step == 1:
            return rows
        return rows.repartition(-(-parts // step), "bucket").mapInArrow(lambda it: _respread(it, parts), _BLOB)

    anchors = docs.where(F.octet_length("text") >= window).mapInArrow(lambda it: _anchors(it, window, k, parts, step), _BLOB)
    repeated = scratch.keep(dealt(dealt(anchors).groupBy("bucket").applyInArrow(lambda t: _repeated_runs(t, parts, step), _BLOB)))
    scratch.forget()
    counts = repeated.mapInArrow(_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    runs = counts.where("token = -1").first()
    # each hot anchor has at least 1 / 65536 of all runs, so there are at most 65536
    many = counts.where((F.col("token") >= 0) & (F.col("n") >= max(often, (runs["n"] if runs else 0) >> 16))).toArrow().column("token").to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(many).astype(np.uint64))
    texts = docs.mapInArrow(lambda it: _texts(it, parts), _BLOB)
    collected = texts.unionByName(repeated).groupBy("bucket").applyInArrow(lambda t: _collect(t, window, parts, hot), _BLOB)
    cuts = scratch.keep(collected.groupBy("bucket").applyInArrow(lambda t: _resolve(t, window, k, parts), _BLOB))
    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out = texts.unionByName(repeated).unionByName(cuts).groupBy("bucket").applyInArrow(lambda t: _finish(t, window, with_text), schema)
    out = out.withColumnRenamed("key", id_col) if named is None else out.join(named, "key").withColumnRenamed("id", id_col)
    columns = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    return out.select(*columns)
