"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles.  Under one order of all shingles (rarest first) two sets
with similarity ``t`` share at least ``l`` tokens of their ``l``-prefixes, where the ``l``-prefix
of a set of n tokens has ``n - ceil(t * n) + l`` tokens.  Each document picks the ``l`` with the
least estimated cost of its candidates; a pair must share the smaller ``l`` of the two inside
those prefixes before it is verified.

The rarity of a shingle is counted over all documents without moving a row for each of them:
tokens travel as sorted, packed blocks to the part of the token range they belong to, and only
tokens that occur more than once travel back to their documents, under short dense ids.  A document's
tokens that do not come back are its own; they lead its prefix and can match nothing, and shared tokens
are all among those that came back, so verification needs no other.  Tokens that a first pass finds hot
(a line in a share of all documents) are known to be repeated: they never meet in a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import SPACES, joined_bytes, mix, pieces, runs, word_hashes
from .scratch import Scratch
from .workers import release

TOKEN_BITS = 48
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def pack(values: np.ndarray, step: bool = False) -> bytes:
    """Non-negative integers as compressed byte planes; with ``step`` the ascending ones as differences."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    if step and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    head = bytes([width, step]) + len(values).to_bytes(6, "little")
    return head + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width, step, n = data[0], data[1], int.from_bytes(data[2:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=width * n + 1), dtype=np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.T
    values = out.view(np.uint64).reshape(-1)
    return np.cumsum(values, dtype=np.uint64) if step else values


def shingle_sets(texts: pa.Array, words: int, at_once: int = 4 << 20) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted; one for all words of a shorter text.

    Texts are taken in runs of about ``at_once`` bytes, so memory follows the longest text.
    """
    for part in runs(texts, at_once):
        yield from _run_sets(part, words)


def _run_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    data, firsts = joined_bytes(texts)
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in pieces(data, SPACES):
        starts, h = word_hashes(data[a:b], SPACES)
        hashes.append(h)
        owners.append(np.searchsorted(firsts, starts + a, side="right") - 1)
    h, ends = np.concatenate(hashes), np.searchsorted(np.concatenate(owners), np.arange(len(texts) + 1))
    if len(h) >= words:
        rolled = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            rolled += h[k : len(h) - words + 1 + k] * _ODD[k]
        rolled = mix(rolled)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            short = h[a:b] * np.array(_ODD[: b - a])
            yield mix(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_digest(tokens: np.ndarray) -> int:
    """64 bits of a set, as a signed integer; the set is sorted."""
    spread = mix(tokens + np.uint64(len(tokens)))
    total = np.array([spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(spread)], dtype=np.uint64)
    return int((mix(total[:1]) * _ODD[1] + mix(total[1:] + _ODD[2])).view(np.int64)[0])


def _often(tokens: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that occur ``least`` times or more, and how often."""
    t = np.concatenate([np.zeros(0, np.uint64), *tokens]) >> np.uint64(64 - TOKEN_BITS)
    cell = (t >> np.uint64(TOKEN_BITS - 22)).astype(np.int64)
    t = t[np.bincount(cell, minlength=1 << 22)[cell] >= least]
    token, count = np.unique(t, return_counts=True)
    return token[count >= least], count[count >= least]


def _describe(batches: Iterator[pa.RecordBatch], words: int, least: int = 8, flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Id, digest and size of each set; and, marked ``often``, tokens frequent in a lot of distinct sets."""
    seen: set[int] = set()
    held, n, names = [], 0, ["id", "node", "n", "often"]

    def frequent(kind: pa.DataType) -> pa.RecordBatch:
        token, count = _often(held, least)
        return pa.record_batch([pa.nulls(len(token), kind), pa.array(token.astype(np.int64)), pa.array(count), pa.array(np.ones(len(token), bool))], names=names)

    kind = None
    for batch in batches:
        kind, node, size = batch.schema.field(0).type, [], []
        for s in shingle_sets(batch.column(1), words):
            digest = set_digest(s) if len(s) else None
            node.append(digest)
            size.append(len(s))
            if digest is not None and digest not in seen:
                seen.add(digest)
                held.append(s)
                n += len(s)
                if n >= flush:
                    yield frequent(kind)
                    held, n = [], 0
        yield pa.record_batch([batch.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(np.zeros(len(node), bool))], names=names)
    if kind is not None:
        yield frequent(kind)
    release()


_BLOCK = "part int, kind int, node binary, a binary, b binary, c binary"
_NAMES, _KINDS = ["part", "kind", "node", "a", "b", "c"], (pa.int32(), pa.int32(), *[pa.binary()] * 4)
# what a row carries: documents (numbers, digests, sizes), tokens on the way to their part (numbers, the place of
# each token's number, tokens), or repeated tokens on the way to their documents (numbers, tokens of each, ids, rarities)
DOCS, TOKENS, READY = 0, 1, 2
# a document's number on the way: its bucket, the task that read it, and a count; 63 bits
_BUCKET_SHIFT, _TASK_SHIFT = 41, 20
MOST_PARTS, MOST_TASKS, MOST_SETS = 1 << 22, 1 << 21, 1 << 20


def _row(*values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)], names=_NAMES)


def _bounds(parts: int, step: int) -> np.ndarray:
    """Where every ``step``-th part of the token range begins, and its end."""
    starts = (np.arange(0, parts, step, dtype=np.float64) * (2.0**TOKEN_BITS / parts)).astype(np.uint64)
    return np.append(starts, np.uint64(1 << TOKEN_BITS))


def _buckets(number: np.ndarray, step: int) -> Iterator[tuple[int, slice]]:
    """Stretches of ascending document numbers by bucket, ``step`` buckets at once."""
    bucket = (number >> np.uint64(_BUCKET_SHIFT)).astype(np.int64) // step
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(first.tolist(), np.append(first, len(bucket))[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, b)


def _doc_rows(number: np.ndarray, digest: np.ndarray, size: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
    """Documents by bucket; numbers ascend."""
    for b, x in _buckets(number, step):
        yield _row(b, DOCS, pack(number[x], step=True), pack(digest[x]), pack(size[x]), b"")


def _token_rows(number: np.ndarray, owner: np.ndarray, token: np.ndarray, parts: int, step: int) -> Iterator[pa.RecordBatch]:
    """Tokens by part; tokens ascend, ``owner`` is the place of each one's document in ``number``, which ascends."""
    cuts = np.searchsorted(token, _bounds(parts, step))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        o = owner[cuts[p] : cuts[p + 1]]
        have = np.zeros(len(number), bool)
        have[o] = True
        yield _row(p, TOKENS, pack(number[have], step=True), pack((np.cumsum(have) - 1)[o]), pack(token[cuts[p] : cuts[p + 1]], step=True), b"")


def _ready_rows(number: np.ndarray, token: np.ndarray, rarity: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
    """Repeated tokens by bucket of their document; one number for each token, in any order."""
    order = np.argsort(number, kind="stable")
    number, token, rarity = number[order], token[order], rarity[order]
    for b, x in _buckets(number, step):
        o = number[x]
        start = np.flatnonzero(np.diff(o, prepend=o[:1] ^ np.uint64(1)))
        yield _row(b, READY, pack(o[start], step=True), pack(np.diff(np.append(start, len(o)))), pack(token[x]), pack(rarity[x]))


def _rarity(df: np.ndarray) -> np.ndarray:
    """Classes of document frequency; equal classes are ordered by token."""
    return np.minimum(255, (8 * np.log2(np.maximum(df, 1))).astype(np.int64))


def _post(batches: Iterator[pa.RecordBatch], words: int, parts: int, step: int, hot, flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Packed (token, document) blocks by part of the token range; a set once a task.

    A document gets a short number for the way: its bucket (by the set's digest), the task, and a count,
    so the numbers in a block are nearly consecutive and cost next to nothing.  A repeated task
    gives the same numbers, as it reads the same rows.  Hot tokens need no part: they are known to be
    repeated and have their rarity, so they go to the buckets of their documents at once.
    """
    task = TaskContext.get().partitionId()
    if task >= MOST_TASKS:
        raise ValueError(f"more than {MOST_TASKS} input partitions: read the table in larger ones")
    hot_token, hot_rarity = hot.value
    seen: set[int] = set()
    counts: dict[int, int] = {}
    nodes, digests, sizes, tokens, held = [], [], [], [], 0

    def blocks() -> Iterator[pa.RecordBatch]:
        node, digest, size = np.array(nodes, np.uint64), np.array(digests, np.int64).view(np.uint64), np.array(sizes, np.int64)
        rank = np.argsort(node)
        place = np.empty(len(node), np.uint32)
        place[rank] = np.arange(len(node), dtype=np.uint32)
        node = node[rank]
        yield from _doc_rows(node, digest[rank], size[rank], step)
        token, owner = np.concatenate(tokens), np.repeat(place, size)
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        del order
        if len(hot_token):
            a, b = np.searchsorted(token, hot_token), np.searchsorted(token, hot_token, side="right")
            which = np.repeat(np.arange(len(hot_token)), b - a)
            at = np.arange(len(which)) + np.repeat(a - np.cumsum(b - a) + (b - a), b - a)
            yield from _ready_rows(node[owner[at]], which, hot_rarity[which], step)
            rest = np.ones(len(token), bool)
            rest[at] = False
            token, owner = token[rest], owner[rest]
        yield from _token_rows(node, owner, token, parts, step)

    release()
    try:
        for batch in batches:
            for s in shingle_sets(batch.column(0), words):
                if not len(s):
                    continue
                digest = set_digest(s)
                if digest in seen:
                    continue
                seen.add(digest)
                bucket = ((digest ^ digest >> 29) & 0xFFFFFFFF) % parts
                count = counts[bucket] = counts.get(bucket, -1) + 1
                if count >= MOST_SETS:
                    raise ValueError(f"more than {MOST_SETS} sets of one bucket in a task: read the table in smaller partitions")
                nodes.append(bucket << _BUCKET_SHIFT | task << _TASK_SHIFT | count)
                digests.append(digest)
                sizes.append(len(s))
                tokens.append(s >> np.uint64(64 - TOKEN_BITS))
                held += len(s)
                if held >= flush:
                    yield from blocks()
                    nodes, digests, sizes, tokens, held = [], [], [], [], 0
        if nodes:
            yield from blocks()
    finally:
        release()


def _spread(batches: Iterator[pa.RecordBatch], parts: int, flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Blocks for several parts at once, dealt out to each part: the second half of an exchange to very many."""
    lots: dict[int, list[list[np.ndarray]]] = {kind: [[], [], []] for kind in (DOCS, TOKENS, READY)}
    held = 0

    def blocks() -> Iterator[pa.RecordBatch]:
        columns = {kind: [np.concatenate([np.zeros(0, np.uint64), *c]) for c in lot] for kind, lot in lots.items()}
        number, digest, size = columns[DOCS]
        order = np.argsort(number)
        yield from _doc_rows(number[order], digest[order], size[order], 1)
        number, token, _ = columns[TOKENS]
        number, owner = np.unique(number, return_inverse=True)
        order = np.argsort(token)
        yield from _token_rows(number, owner[order], token[order], parts, 1)
        yield from _ready_rows(*columns[READY], 1)
        for lot in lots.values():
            for c in lot:
                c.clear()

    for batch in batches:
        for row in batch.to_pylist():
            number, kind = unpack(row["node"]), row["kind"]
            if kind == DOCS:
                values = number, unpack(row["a"]), unpack(row["b"])
            elif kind == TOKENS:
                token = unpack(row["b"])
                values = number[unpack(row["a"]).astype(np.int64)], token, token[:0]
            else:
                values = np.repeat(number, unpack(row["a"]).astype(np.int64)), unpack(row["b"]), unpack(row["c"])
            for column, v in zip(lots[kind], values, strict=True):
                column.append(v)
            held += len(values[0])
            if held >= flush:
                yield from blocks()
                held = 0
    yield from blocks()
    release()


def _repeated(table: pa.Table, parts: int, step: int, hot: int) -> pa.Table:
    """Tokens of a part that more than one document holds, by bucket of the document; and what is on its way there.

    Repeated tokens get short ids, dense over all parts: the ``i``-th of part p is ``hot + i * parts + p``.
    """
    out: list[pa.RecordBatch] = []
    cols: list[list[np.ndarray]] = [[], []]
    p = table.column("part")[0].as_py() if table.num_rows else 0
    for row in table.to_pylist():
        if row["kind"] == TOKENS:
            cols[0].append(unpack(row["node"])[unpack(row["a"]).astype(np.int64)])
            cols[1].append(unpack(row["b"]))
        else:
            out.append(_row(row["part"] // step, *(row[name] for name in _NAMES[1:])))
    if cols[0]:
        node, token = np.concatenate(cols[0]), np.concatenate(cols[1])
        del cols
        order = np.argsort(token, kind="stable")
        token, node = token[order], node[order]
        first = np.flatnonzero(np.diff(token, prepend=token[:1] + np.uint64(1)))
        count = np.diff(np.append(first, len(token)))
        keep = np.repeat(count > 1, count)
        count = count[count > 1]
        name = np.repeat(np.arange(len(count), dtype=np.uint64) * np.uint64(parts) + np.uint64(hot + p), count)
        out += _ready_rows(node[keep], name, np.repeat(_rarity(count), count), step)
    release()
    return pa.Table.from_batches(out, pa.schema(list(zip(_NAMES, _KINDS, strict=True))))


_PREFIX = "node long, n long, repeated long, l int, tokens binary, prefix array<long>, layer array<int>"


def narrow(values: np.ndarray) -> bytes:
    """Ascending non-negative integers in as few bytes as the largest needs."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = max(1, (int(values[-1]).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    return out.view(np.uint64).reshape(-1)


def _prefixes(table: pa.Table, percent: int, longest: int, verify_cost: float) -> pa.Table:
    """Documents whose prefix holds repeated tokens: those tokens, and the prefix of least cost.

    Of equal sets from several tasks one stays.
    """
    docs: list[list[np.ndarray]] = [[], [], []]
    cols: list[list[np.ndarray]] = [[], [], []]
    for row in table.to_pylist():
        if row["kind"] == DOCS:
            for column, name in zip(docs, ("node", "a", "b"), strict=True):
                column.append(unpack(row[name]))
        else:
            k = unpack(row["a"]).astype(np.int64)
            for column, values in zip(cols, (np.repeat(unpack(row["node"]), k), unpack(row["b"]), unpack(row["c"])), strict=True):
                column.append(values)
    number, digest, size = (np.concatenate([np.zeros(0, np.uint64), *c]) for c in docs)
    number_of, token, df = (np.concatenate([np.zeros(0, np.uint64), *c]) for c in cols)
    del cols, docs
    order = np.lexsort((number, digest))
    leads = order[np.diff(digest[order], prepend=digest[order][:1] ^ np.uint64(1)) != 0]
    leads = leads[np.argsort(number[leads])]
    number, digest, size = number[leads], digest[leads].view(np.int64), size[leads].astype(np.int64)
    at = np.minimum(np.searchsorted(number, number_of), max(len(number) - 1, 0))
    keep = number[at] == number_of if len(number) else np.zeros(len(number_of), bool)
    at, token, df = at[keep], token[keep], df[keep]
    order = np.lexsort((token, df, at))
    at, token, df = at[order], token[order], df[order].astype(np.float64)
    node, n = digest[at], size[at]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first, len(at))[1:]
    out: list[list] = [[], [], [], [], [], [], []]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        size, held = int(n[a]), b - a
        own = size - held
        one = size - (percent * size + 99) // 100 + 1 - own  # repeated tokens in the 1-prefix
        if one <= 0:
            continue
        others = np.cumsum(2.0 ** (df[a:b] / 8) - 1)
        lengths = np.minimum(one + np.arange(longest), held)
        cost = others[lengths - 1] * (1 + verify_cost / np.arange(1, longest + 1))
        best = int(cost[: held - one + 1].argmin()) + 1
        length = min(one + best - 1, held)
        row = (node[a], size, held, best, narrow(np.sort(token[a:b])), token[a : a + length].astype(np.int64), np.maximum(1, np.arange(length) - one + 2).astype(np.int32))
        for column, x in zip(out, row, strict=True):
            column.append(x)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    made = pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["node", "n", "repeated", "l", "tokens", "prefix", "layer"])
    release()
    return made


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the intersections of the sets ``ta`` and ``tb``."""
    for batch in batches:
        a, b = batch.column("ta"), batch.column("tb")
        both, last, v = np.zeros(batch.num_rows, np.int64), None, None
        for i in range(batch.num_rows):
            u, packed = widen(a[i].as_py()), b[i].as_py()
            if packed != last:
                last, v = packed, widen(packed)
            at = np.searchsorted(u, v)
            both[i] = np.count_nonzero(u[np.minimum(at, len(u) - 1)] == v)
        yield pa.record_batch([*batch.select(["a", "b", "na", "nb"]).columns, pa.array(both)], names=["a", "b", "na", "nb", "both"])


def _with_overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``both``, the size of the intersection, and the sizes ``na`` and ``nb``."""
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}")) for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_overlaps, "a long, b long, na long, nb long, both long")


def _meeting(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that share at least the smaller ``l`` tokens of their prefixes."""
    a, b = (sets.select(F.col("node").alias(x), F.col("l").alias(f"l{x}"), F.col("prefix").alias(f"p{x}"), F.col("layer").alias(f"y{x}")) for x in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b").withColumn("l", F.least("la", "lb"))
    # layers ascend along a prefix, so the tokens of up to layer l lead it
    part = lambda x: F.slice(f"p{x}", F.lit(1), F.size(F.filter(f"y{x}", lambda y: y <= F.col("l"))))
    return both.where(F.size(F.array_intersect(part("a"), part("b"))) >= F.col("l")).select("a", "b")


def jaccard_components(
    rows: DataFrame,
    words: int = 5,
    percent: int = 75,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 8,
    verify_cost: float = 8.0,
    short_list: int = 16,
    part_tokens: int = 1_000_000,
    often: int = 4096,
    fan: int = 4096,
) -> DataFrame:
    """Components of documents that link at a shingle similarity of ``percent`` or more.

    Words are runs of characters that are not white space (ASCII), A-Z in lower case.  A set
    has the distinct runs of ``words`` words; a text of fewer words has one, all of them; a text
    without words (null, empty) has none and links with nothing.

    Equal sets form one class (64 bits of the set's digest name it).  Prefix tokens form lists.
    In a list of up to ``short_list`` classes all pairs are candidates.  In a longer one every
    class is compared with one of them, the list's pivot; classes that link with it need no
    comparison with each other.  Of the other pairs (u, v) those remain for which
    ``min(|u & p|, |v & p|)`` and the repeated tokens both have outside the pivot p could still make
    up the needed overlap: an exact bound, so no link between components is lost.

    Returns one row for each row: id, ``n_shingles`` and ``component_id``, the smallest id
    reachable.  Repeated rows stay and share a class; null ids get the smallest id of their
    component or null; an empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "jaccard")
    kind = dict(rows.dtypes)[id_col]
    slim = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    described = scratch.keep(slim.mapInArrow(partial(_describe, words=words), f"id {kind}, node long, n long, often boolean"))
    base = described.where("not often").drop("often")
    total = base.agg(F.sum("n")).first()[0] or 0
    if not total:
        return base.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    # each hot token has at least 1 / 65536 of all occurrences, so there are at most 65536
    frequent = described.where("often").groupBy("node").agg(F.sum("n").alias("df")).where(F.col("df") >= max(often, total >> 16)).toArrow()
    token, df = (frequent.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(token)
    hot = spark.sparkContext.broadcast((token[order].astype(np.uint64), _rarity(df[order])))
    n_hot = len(token)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-total // part_tokens)))
    step = 1 if parts <= fan else -(-parts // math.isqrt(parts))

    def dealt(blocks: DataFrame):
        """The blocks by part; to many parts in two exchanges, as one lot would leave next to nothing for each."""
        if step > 1:
            blocks = blocks.repartition(-(-parts // step), "part").mapInArrow(lambda it: _spread(it, parts), _BLOCK)
        return blocks.groupBy("part")

    blocks = slim.select("text").mapInArrow(lambda it: _post(it, words, parts, step, hot), _BLOCK)
    back = dealt(blocks).applyInArrow(lambda t: _repeated(t, parts, step, n_hot), _BLOCK)
    sets = scratch.keep(dealt(back).applyInArrow(lambda t: _prefixes(t, percent, longest, verify_cost), _PREFIX))
    scratch.forget()
    n = sets.count()  # documents that may have partners

    posts = sets.select("node", "n", "repeated", "l", F.explode(F.arrays_zip("prefix", "layer")).alias("z")).select("node", "n", "repeated", "l", F.col("z.prefix").alias("token"), F.col("z.layer").alias("layer"))
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct((F.col("n") - F.col("repeated")).alias("own"), "node")).alias("p")).where("c > 1")
    posts = scratch.keep(posts.join(lists.select("token", "c", F.col("p.node").alias("pivot")), "token"))
    linked = F.expr(f"100 * both >= {percent} * (na + nb - both)")
    fit = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"

    # short lists: every pair that meets in them often enough
    a, b = (posts.where(F.col("c") <= short_list).select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "l", "layer"))) for x in ("a", "b"))
    met = a.join(b, "token").where(F.expr(f"node_a < node_b and {fit} and greatest(layer_a, layer_b) <= least(l_a, l_b)"))
    short = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("l_a", "l_b")).alias("l")).where("shared >= l").select("a", "b")

    # long lists: everything against the pivots first, then what the bound leaves of each pivot's members
    star = posts.where(F.col("c") > short_list).where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    star = scratch.keep(_with_overlap(star, sets).withColumn("linked", linked))
    size = sets.select("node", F.col("n").alias("size"), "repeated")
    member = scratch.keep(star.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "both", "linked").join(size, "node"), 4 * n)
    left = member.where(~F.col("linked"))
    u, v = (df.select("pivot", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "both", "linked", "repeated")), F.col("size").alias(f"n_{x}")) for df, x in ((left, "a"), (member, "b")))
    bound = "least(both_a, both_b) + least(repeated_a - both_a, repeated_b - both_b)"
    rest = u.join(v, "pivot").where(F.expr(f"(node_a < node_b or linked_b and node_a <> node_b) and {fit} and (100 + {percent}) * ({bound}) >= {percent} * (n_a + n_b)"))
    rest = rest.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    rest = _meeting(rest, sets)

    pairs = short.unionByName(rest).distinct()
    found = _with_overlap(pairs, sets).where(linked).select("a", "b").unionByName(star.where("linked").select("a", "b"))
    comps = connected_components(found, scratch)
    scratch.drop(posts, star, member, sets)
    scratch.forget()

    least = base.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    joined = comps.join(least, "node")
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(joined.select("node", "component"), "node", "left").join(smallest, "component", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return base.join(named, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
