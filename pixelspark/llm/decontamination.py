"""Benchmark decontamination: a prefix-filtered set join with exact check of item windows.

All of it is DataFrame expressions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import placed_words, word_array

SHINGLE = 3
#: What one broadcast may hold: shingles to count, windows, bytes of their words.
TOKENS_A_LOT = 1_000_000
WINDOWS_A_BLOCK = 200_000
BYTES_A_BLOCK = 32_000_000
#: Windows of more bytes are compared by SHA-256.
LONG_WINDOW = 4096


def _shingle(words: Column | str, at: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(n)))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows ``win`` (arrays of words) with the sorted ids of the items they are in."""
    words = items.select(F.col(id_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - F.lit(window), F.lit(0)))
    each = words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, F.lit(window)).alias("win"))
    return each.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _tokens(placed: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``token``: the shingles of each wanted length that start at a word."""
    if len(lengths) == 1:
        return placed.withColumn("token", _shingle("words", F.col("pos"), lengths[0]))
    return placed.withColumn("token", F.explode(F.array(*(_shingle("words", F.col("pos"), n) for n in lengths))))


def _rarity(scratch: Scratch, placed: DataFrame, tokens: DataFrame, lot: int) -> DataFrame:
    """``token`` and ``df``: in how many places of the documents each of the asked shingles is; those in none are left out."""
    lots = max(1, -(-tokens.count() // lot))
    counted = []
    for i in range(lots):
        asked = F.broadcast(tokens.where(F.pmod("token", F.lit(lots)) == i))
        seen = placed.select("token").join(asked, "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        counted.append(scratch.keep(seen))
    return functools.reduce(DataFrame.unionByName, counted)


def _covered(spans: str) -> Column:
    """Number of places inside at least one of the spans."""

    def add(so_far: Column, span: Column) -> Column:
        end = F.greatest(so_far["end"], span["start"] + span["len"])
        return F.struct(end.alias("end"), (so_far["n"] + end - F.greatest(so_far["end"], span["start"])).alias("n"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda done: done["n"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block: int = WINDOWS_A_BLOCK,
    lot: int = TOKENS_A_LOT,
) -> DataFrame:
    """Words of documents inside occurrences of item windows (``window`` consecutive words).

    An item shorter than the window, but not empty, is one window.  Shingles of three words (of
    all words of a shorter window) are ordered by how often the documents hold them, rarest
    first.  A document that holds a window holds all its shingles, so the prefix that must be
    joined is the rarest one.  A match is a candidate only where the window fits between the
    document's ends at the shingle's offset, and counts when the words are equal one by one.
    Rarity is counted once, for at most ``lot`` shingles in a pass over the documents.  Windows with a
    shingle that no document holds are given up before the join.  The index of the others is broadcast in
    blocks of about ``block`` windows and ``BYTES_A_BLOCK`` bytes of words; more windows take more passes,
    each written when it is done.  Which items a window is in is joined to the hits by the window's
    number, so lists of items are not broadcast by this operator.  Words of a window above
    ``LONG_WINDOW`` bytes are compared by SHA-256.  Only ids, lengths and hits are shuffled.

    Returns one row for each document row: id, ``n_words``, ``n_hit``, ``n_items``, ``items``
    (sorted ids), ``items_sha256``, ``contaminated``.  A null or empty text has no words.  Items
    with null ids mark words but are not counted.  Repeated rows stay; null document ids are
    kept; empty tables on either side give no hits; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    numbered = item_windows(items, window, item_col, item_text_col).withColumn("win_id", F.monotonically_increasing_id())
    windows = scratch.keep(numbered)
    # at most SHINGLE lengths can occur
    lengths = sorted(r[0] for r in windows.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    placed = _tokens(placed_words(docs, id_col, text_col), lengths)

    def shingle_at(j: Column) -> Column:
        chosen = [F.when(F.size("win") < n + 1, _shingle("win", j, n)) for n in range(1, SHINGLE)]
        return F.coalesce(*chosen, _shingle("win", j, SHINGLE))

    offsets = F.sequence(F.lit(0), F.size("win") - F.least(F.size("win"), F.lit(SHINGLE)))
    parts = windows.select("win_id", F.posexplode(F.transform(offsets, shingle_at)).alias("offset", "token"))
    df = _rarity(scratch, placed, scratch.keep(parts.select("token").distinct()), lot)
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")).alias("r")
    prefixes = parts.join(df, "token", "left").groupBy("win_id").agg(rarest).where("r.df > 0")
    spaced = F.array_join("win", " ")
    long = F.octet_length(spaced) > LONG_WINDOW
    index = scratch.keep(
        windows.join(prefixes, "win_id").select(
            "win_id",
            "items",
            F.size("win").alias("size"),
            F.when(~long, F.col("win")).alias("win"),
            F.when(long, F.sha2(spaced.cast("binary"), 256)).alias("digest"),
            F.least(F.octet_length(spaced), F.lit(LONG_WINDOW)).alias("bytes"),
            "r.token",
            "r.offset",
        )
    )
    n_windows, n_bytes = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    passes = max(1, -(-n_windows // block), -(-n_bytes // BYTES_A_BLOCK))
    hits = []
    for i in range(passes):
        mine = index.where(F.pmod("win_id", F.lit(passes)) == i).select("win_id", "size", "win", "digest", "token", "offset")
        found = placed.join(F.broadcast(mine), "token", "left")
        size, start = F.col("size"), F.col("pos") - F.col("offset")
        fits = F.col("win_id").isNotNull() & (start >= 0) & (start + size <= F.col("n"))
        there = F.slice("words", start + 1, size)
        equal = F.when(F.col("digest").isNull(), there == F.col("win")).otherwise(F.sha2(F.array_join(there, " ").cast("binary"), 256) == F.col("digest"))
        same = F.when(fits, equal).otherwise(False)
        here = F.lit(False)
        if i == 0:  # the row of the text itself
            here = F.col("pos") == F.col("n")
        if i == 0 and len(lengths) > 1:  # was multiplied too
            here = here & (F.col("token") == _shingle("words", F.col("pos"), lengths[0]))
        found = found.where(same | here).select("id", "key", "n", F.when(same, start).alias("start"), F.when(same, size).alias("len"), F.when(same, F.col("win_id")).alias("win_id"), here.alias("itself"))
        hits.append(scratch.keep(found) if passes > 1 else found)
    # rows without a window go to many places in the join, not all to that of null
    spread = F.coalesce("win_id", F.lit(-1) - F.pmod(F.xxhash64("id", "key"), F.lit(1 << 40)))
    hits = functools.reduce(DataFrame.unionByName, hits).withColumn("win_id", spread).join(index.select("win_id", "items"), "win_id", "left")
    copies = F.sum(F.col("itself").cast("int"))
    if len(lengths) > 1:
        copies = F.ceil(copies / len(lengths))
    per_doc = hits.groupBy("id", "key", "n").agg(
        copies.alias("copies"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    n_hit = _covered("spans").cast("long")
    one_each = per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return one_each.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
