"""Sharding: the smallest feasible shard capacity over ordered atomic groups, cut there.

Groups (rows of equal key) are ordered by key.  The driver never sees all of them: it works on
*blocks*, runs of consecutive groups that share a key prefix.  A block has its total and its
largest group.  Two greedy checks bracket the answer: one that may cut anywhere inside a block
and one that cuts between blocks only.  Blocks in which a cut may fall are split further, with a
job over just those, until both checks agree or no such block is left.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Repeated rows that get their slots at once.
COPIES_A_PIECE = 65_536


def cuts_within(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Greedy check: ends of at most ``shards`` runs that each fit ``capacity``, or None."""
    total = [0, *accumulate(sizes)]
    ends, at = [], 0
    while at < len(sizes):
        to = bisect_right(total, total[at] + capacity) - 1
        if to == at or len(ends) == shards:
            return None
        ends.append(to)
        at = to
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the smallest capacity that passes the greedy check."""
    if not sizes:
        return 0
    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if cuts_within(sizes, shards, mid) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def level_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Cuts for a feasible capacity, each as near its even share as feasibility allows.

    The greedy check from the left gives the latest place of each cut, the one from the right
    the earliest; every cut between them that its predecessor reaches is feasible.
    """
    n, total = len(sizes), [0, *accumulate(sizes)]
    right = cuts_within(sizes[::-1], shards, capacity) or []
    early = [n - x for x in right][::-1]
    early = [0] * (shards - len(early)) + early  # earliest start of shard k
    early = [*early[1:], n]  # earliest end of shard k
    out, at = [], 0
    for k in range(shards):
        reach = bisect_right(total, total[at] + capacity) - 1
        ideal = total[n] * (k + 1) / shards
        to = bisect_right(total, ideal) - 1
        if to < n and total[to + 1] - ideal < ideal - total[to]:
            to += 1
        at = min(max(to, early[k], at), reach)
        out.append(at)
    return out


def _reaches(total: list[int], coarse: list[bool], shards: int, capacity: int) -> tuple[list[int], bool]:
    """Ends of a greedy run, in size units, that may cut anywhere inside a coarse block; whether it fits."""
    at, ends = 0, []
    for _ in range(shards):
        want = at + capacity
        if want >= total[-1]:
            return [*ends, total[-1]], True
        i = bisect_right(total, want) - 1
        to = want if coarse[i] else total[i]
        if to <= at:
            return ends, False
        ends.append(to)
        at = to
    return ends, False


def _least_fluid(sizes: list[int], coarse: list[bool], most: int, shards: int, hi: int) -> int:
    """A lower bound: the smallest capacity if coarse blocks could be cut anywhere."""
    total = [0, *accumulate(sizes)]
    lo = max(most, -(-total[-1] // shards))
    while lo < hi:
        mid = (lo + hi) // 2
        if _reaches(total, coarse, shards, mid)[1]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _blocks(groups: DataFrame, depth: int, inside: list[str] | None) -> dict:
    if inside is not None:
        groups = groups.where(F.substring("key", 1, len(inside[0])).isin(inside))
    found = groups.groupBy(F.substring("key", 1, depth).alias("block")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most")
    )
    return {r[0]: {"size": r[1], "n": r[2], "most": r[3]} for r in zip(*found.toArrow().to_pydict().values(), strict=True)}


def plan_cuts(groups: DataFrame, shards: int, first_depth: int = 4, step: int = 1) -> tuple[int, list[str]]:
    """Smallest capacity, and a prefix that starts each shard but the first, over ``groups(key, size)``.

    ``key`` is unique lower-case hex of one length, evenly spread (a digest), so a level sends at
    most ``16 ** first_depth`` blocks, or ``16 ** step`` for each block that a cut may fall into,
    to the driver, however many groups there are.
    """
    blocks = _blocks(groups, first_depth, None)
    depth = first_depth
    while blocks:
        order = sorted(blocks)
        sizes, coarse = [blocks[b]["size"] for b in order], [blocks[b]["n"] > 1 for b in order]
        hi = smallest_capacity(sizes, shards)
        lo = _least_fluid(sizes, coarse, max(r["most"] for r in blocks.values()), shards, hi)
        split: set[str] = set()
        if lo < hi:
            total, at = [0, *accumulate(sizes)], 0
            furthest = _reaches(total, coarse, shards, hi)[0]
            for far in furthest:
                i = min(bisect_right(total, far), len(order)) - 1
                split.update(order[j] for j in range(max(at, 0), i + 1) if coarse[j])
                # the least that a shard of capacity lo takes when blocks stay whole
                at = bisect_right(total, total[at] + lo) - 1 if at < len(order) else at
            split.update(b for b, s, c in zip(order, sizes, coarse, strict=True) if c and s > lo)
            split = {b for b in split if len(b) == depth} or split
        if not split:
            cuts = level_cuts(sizes, shards, hi)
            return hi, [order[c] for c in cuts[:-1] if c < len(order)]
        width = min(map(len, split))
        split = {b for b in split if len(b) == width}
        depth = width + step
        for b in split:
            del blocks[b]
        blocks |= _blocks(groups, depth, sorted(split))
    return 0, []


def shard_by_bytes(rows: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Every row into a shard of near equal bytes; rows of equal text stay together.

    A row's size is the UTF-8 length of its text plus ``overhead``; a null text has length 0 and
    equals the empty text.  Groups larger than an even share of what is left come first, largest
    first, each alone in a shard (no partition into whole groups can do better); the other groups
    follow in the order of their digests and are cut at the smallest feasible capacity.  A row
    finds its shard by comparing its digest with at most ``shards - 1`` cut keys, so no row moves
    for that.  Slots number a shard's rows without gaps: rows are dealt into buckets inside
    each shard and numbered there, starting at the bucket's offset, so no task holds a whole shard.
    Rows of equal id and text are counted before they are dealt and take a run of slots, so
    however many there are, also without an id, they are one row of a bucket.

    Returns id, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot``, ``grown_shard``
    (null) and ``text_md5``.  Repeated rows each get a slot; null ids are kept; an empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = scratch.keep(
        rows.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    )
    groups = scratch.keep(slim.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    whole = groups.agg(F.sum("size"), F.sum("rows")).first()
    left, n_rows = whole[0] or 0, whole[1] or 0
    alone: list[str] = []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if r["size"] * (shards - len(alone)) <= left or len(alone) == shards - 1:
            break
        alone.append(r["key"])
        left -= r["size"]
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    _, firsts = plan_cuts(rest, shards - len(alone))
    shard = F.lit(len(alone))
    for first in firsts:
        shard = shard + (F.col("key") >= F.lit(first)).cast("int")
    for i, key in reversed(list(enumerate(alone))):
        shard = F.when(F.col("key") == F.lit(key), F.lit(i)).otherwise(shard)
    buckets = max(64, n_rows // 100_000)
    dealt = slim.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("id", "key"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("offset"))
    same = dealt.groupBy("shard", "bucket", "id", "key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    so_far = Window.partitionBy("shard", "bucket").orderBy("id", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = same.withColumn("before", F.sum("copies").over(so_far) - F.col("copies")).join(offsets, ["shard", "bucket"])
    pieces = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_A_PIECE).cast("long"))))
    numbered = pieces.withColumn("nth", F.explode(F.sequence("from", F.least(F.col("from") + COPIES_A_PIECE, "copies") - 1)))
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("before") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("key").alias("text_md5"),
    )
