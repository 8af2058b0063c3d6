"""Operators on label maps: dilation, adjacency, components, merging, comparing (SEG-*)."""

from __future__ import annotations

from math import ceil, log10

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, drop
from ..model import keys_of, shared_keys, with_summary
from .kernels import Kernel
from .stats import neighbours

CROSS = ((1, 0), (-1, 0), (0, 1), (0, -1))
AROUND = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))


def _offsets(places: tuple[tuple[int, int], ...]) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in places))


def dilate(segmap: DataFrame, kernel: Kernel, nx: int, ny: int, expand: DataFrame | None = None) -> DataFrame:
    """SEG-7, JN-6: labels grow into empty pixels under the kernel; of several the smallest wins.

    ``segmap`` holds labelled pixels (segID > 0).  With ``expand(segID)`` only those labels grow.
    Pixels deep inside a label are not sent out: only those with a neighbour of another label or
    none.  One aggregation, in which owners beat claims, replaces the anti-join.
    """
    keys = keys_of(segmap)
    labels = segmap.where("segID > 0").select(*keys, "x", "y", "segID")
    growing = labels if expand is None else labels.join(expand.select(*[k for k in keys if k in expand.columns], "segID").distinct(), [*[k for k in keys if k in expand.columns], "segID"], "left_semi")
    sent = growing.select(*keys, "segID", "x", "y", F.explode(_offsets(tuple((i, j) for i, j, w in kernel if w > 0 and (i, j) != (0, 0)))).alias("k"))
    claims = sent.select(*keys, (F.col("x") + F.col("k.dx")).alias("x"), (F.col("y") + F.col("k.dy")).alias("y"), "segID", F.lit(None).cast("int").alias("own")).where(F.col("x").between(1, nx) & F.col("y").between(1, ny))
    owned = labels.select(*keys, "x", "y", F.lit(None).cast("int").alias("segID"), F.col("segID").alias("own"))
    return claims.unionByName(owned).groupBy(*keys, "x", "y").agg(F.coalesce(F.max("own"), F.min("segID")).alias("segID"))


def dilate_edges(segmap: DataFrame, kernel: Kernel, nx: int, ny: int) -> DataFrame:
    """SEG-7 for convex brushes and all labels: only pixels on an edge are sent out."""
    keys = keys_of(segmap)
    labels = segmap.where("segID > 0").select(*keys, "x", "y", "segID")
    around = labels.select(*keys, "x", "y", "segID", F.explode(_offsets(((0, 0), *CROSS))).alias("k")).select(*keys, (F.col("x") + F.col("k.dx")).alias("x"), (F.col("y") + F.col("k.dy")).alias("y"), "segID", (F.expr("k.dx = 0 and k.dy = 0")).alias("own"))
    # only numbers and the least and the largest label, so one table of sums holds a pixel, not one of its labels
    found = around.groupBy(*keys, "x", "y").agg(F.max(F.when(F.col("own"), F.col("segID"))).alias("segID"), F.count(F.lit(1)).alias("n"), F.min("segID").alias("low"), F.max("segID").alias("high"))
    edges = found.where("segID is not null and (n < 5 or low < high)").select(*keys, "x", "y", "segID")
    # squares of pixels, in as many parts as the image needs: what a task holds does not grow with the image
    edges = edges.repartition(nx * ny // PART + 1, *keys, F.floor(F.col("x") / 64), F.floor(F.col("y") / 64))
    sent = edges.select(*keys, "segID", "x", "y", F.explode(_offsets(tuple((i, j) for i, j, w in kernel if w > 0 and (i, j) != (0, 0)))).alias("k"))
    claims = sent.select(*keys, (F.col("x") + F.col("k.dx")).alias("x"), (F.col("y") + F.col("k.dy")).alias("y"), "segID", F.lit(None).cast("int").alias("own")).where(F.col("x").between(1, nx) & F.col("y").between(1, ny))
    owned = labels.select(*keys, "x", "y", F.lit(None).cast("int").alias("segID"), F.col("segID").alias("own"))
    return claims.unionByName(owned).groupBy(*keys, "x", "y").agg(F.coalesce(F.max("own"), F.min("segID")).alias("segID"))


def expand_by_blur(pixels: DataFrame, kernel: Kernel, skycut: float = 1.0, least: float = 0.01) -> DataFrame:
    """SEG-5: a sky pixel takes the label with the largest blurred presence times its S/N.

    ``pixels`` holds x, y, sn and segID (0 sky).  Presence must exceed ``least`` and S/N ``skycut``; labelled
    pixels keep theirs.  ``kernel`` is normalised.
    """
    keys = keys_of(pixels)
    ks = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(w).alias("w")) for i, j, w in kernel))
    sent = pixels.where("segID > 0").select(*keys, "x", "y", "segID", F.explode(ks).alias("k")).select(*keys, (F.col("x") + F.col("k.dx")).alias("x"), (F.col("y") + F.col("k.dy")).alias("y"), F.col("segID").alias("claim"), F.col("k.w").alias("w"))
    best = sent.groupBy(*keys, "x", "y", "claim").agg(F.sum("w").alias("w")).where(F.col("w") > least).groupBy(*keys, "x", "y").agg(F.max(F.struct("w", (-F.col("claim")).alias("c"))).alias("b"))
    out = pixels.join(best, [*keys, "x", "y"], "left")
    take = (F.col("segID") == 0) & (F.col("sn") > skycut) & F.col("b").isNotNull()
    return out.withColumn("segID", F.when(take, -F.col("b.c")).otherwise(F.col("segID"))).drop("b")


def near(segmap: DataFrame, offset: int = 1) -> DataFrame:
    """SEG-9, D9, AGG-15, SET-2: labels next to each label (interior pixels' four neighbours)."""
    keys = keys_of(segmap)
    n = neighbours(segmap, offset).where("segID > 0 and left is not null and right is not null and up is not null and down is not null")
    pairs = n.select(*keys, "segID", F.explode(F.array("left", "right", "up", "down")).alias("o")).where("o > 0 and o <> segID")
    found = pairs.groupBy(*keys, "segID").agg(F.array_sort(F.collect_set("o")).alias("nearID"))
    every = segmap.where("segID > 0").select(*keys, "segID").distinct()
    out = every.join(found, [*keys, "segID"], "left").withColumn("nearID", F.coalesce("nearID", F.array().cast("array<int>")))
    return out.withColumn("Nnear", F.size("nearID"))


def edge_pixels(segmap: DataFrame) -> DataFrame:
    """SEG-13: labelled pixels that have a neighbour of another label (or lie at the border)."""
    n = neighbours(segmap)
    inside = F.expr("coalesce(left = segID and right = segID and up = segID and down = segID, false)")
    return n.where((F.col("segID") > 0) & ~inside).select(*keys_of(segmap), "x", "y", "segID")


def compare(map1: DataFrame, map2: DataFrame, ignore_sky: bool = True, least: float = 0.0) -> DataFrame:
    """SEG-12, JN-4: shares of common pixels of each pair of labels, both ways, and their product, image by image."""
    ids = shared_keys(map1, map2)
    keys = [*ids, "x", "y"]
    both = map1.select(*keys, F.col("segID").alias("s1")).join(map2.select(*keys, F.col("segID").alias("s2")), keys)
    one = map1.groupBy(*ids, F.col("segID").alias("s1")).agg(F.count(F.lit(1)).alias("n1"))
    two = map2.groupBy(*ids, F.col("segID").alias("s2")).agg(F.count(F.lit(1)).alias("n2"))
    if ignore_sky:
        both = both.where("s1 > 0 and s2 > 0")
    out = both.groupBy(*ids, "s1", "s2").agg(F.count(F.lit(1)).alias("common")).join(one, [*ids, "s1"]).join(two, [*ids, "s2"])
    out = out.withColumns({"frac1": F.col("common") / F.col("n1"), "frac2": F.col("common") / F.col("n2")}).withColumn("product", F.col("frac1") * F.col("frac2"))
    return out.where(F.col("product") > least)


def relabel(segmap: DataFrame, mapping: DataFrame) -> DataFrame:
    """SEG-15, JN-2: labels replaced by ``mapping(segID, newID)``, which may have image keys; others stay."""
    on = [*shared_keys(segmap, mapping), "segID"]
    return segmap.join(mapping.select(*on, "newID"), on, "left").withColumn("segID", F.coalesce("newID", "segID")).select(*segmap.columns)


def merge_lists_mapping(merges: DataFrame) -> DataFrame:
    """SEG-15: from ``segIDs`` arrays to (segID, newID): each list becomes its least label."""
    ids = keys_of(merges)
    return merges.select(*ids, F.array_min("segIDs").alias("newID"), F.explode("segIDs").alias("segID")).groupBy(*ids, "segID").agg(F.min("newID").alias("newID"))


def zap_lists(merges: DataFrame, gone: list[int]) -> DataFrame:
    """SEG-17: drops every list that holds any of the labels."""
    return merges.where(~F.arrays_overlap("segIDs", F.array(*map(F.lit, gone)))) if gone else merges


def paste_groups(segmap: DataFrame, groupim: DataFrame, groups: list[int], clean: DataFrame | None = None) -> DataFrame:
    """SEG-15: pixels of the chosen groups take the group's label; with ``clean`` its members vanish first."""
    keys = [*keys_of(segmap), "x", "y"]
    if clean is not None:
        on = [*shared_keys(segmap, clean), "segID"]
    base = segmap if clean is None else segmap.join(clean.select(*on), on, "left_anti").select(*segmap.columns)
    over = groupim.where(F.col("groupID").isin(groups)).select(*keys, "groupID")
    return base.join(over, keys, "full").select(*keys, F.coalesce("groupID", "segID").alias("segID"))


def merge_maps(base: DataFrame, add: DataFrame, base_stats: DataFrame, add_stats: DataFrame) -> DataFrame:
    """SEG-11, SET-4: two maps; of segments with one uniqueID the brighter survives, ``add`` overrides.

    Stats have segID, uniqueID, flux.  Labels of ``add`` move above those of ``base`` in the same image.
    """
    ids = shared_keys(base, add, base_stats, add_stats)
    keys = [*ids, "x", "y"]
    shift = base.groupBy(*ids).agg(F.max("segID").alias("shift"))
    pairs = base_stats.select(*ids, "uniqueID", F.col("segID").alias("s1"), F.col("flux").alias("f1")).join(add_stats.select(*ids, "uniqueID", F.col("segID").alias("s2"), F.col("flux").alias("f2")), [*ids, "uniqueID"])
    lose1, lose2 = pairs.where("f2 > f1").select(*ids, F.col("s1").alias("segID")), pairs.where("f2 <= f1").select(*ids, F.col("s2").alias("segID"))
    one = base.where("segID > 0").join(lose1, [*ids, "segID"], "left_anti").select(*keys, F.col("segID").alias("a"))
    two = with_summary(add.where("segID > 0").join(lose2, [*ids, "segID"], "left_anti"), shift, ids).select(*keys, (F.col("segID") + F.coalesce("shift", F.lit(0))).alias("b"))
    return one.join(two, keys, "full").select(*keys, F.coalesce("b", "a").alias("segID"))


TILE = 256
#: Pixels of a part in :func:`dilate_edges`.
PART = 1 << 17


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For the nodes 0 to n - 1 and their links a-b: the least node that each can reach."""
    label = np.arange(n)
    while True:  # labels only fall, so this ends
        least = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, label[a], least)
        np.minimum.at(nxt, label[b], least)
        while not np.array_equal(further := nxt[nxt], nxt):
            nxt = further
        if np.array_equal(nxt, label):
            return label
        label = nxt


def components(pixels: DataFrame, connectivity: int = 4, reach: int = 1, carry: tuple[str, ...] = (), in_one: int = 1_000_000) -> DataFrame:
    """SEG-10: labels connected pixels; ``comp`` is the least y * 2^32 + x of the component.

    Tiles of ``TILE`` pixels a side are labelled apart; only pixels at their borders then link what belongs
    together.  Up to ``in_one`` such links are solved in one task, more of them by rounds of joins.  ``carry`` names
    columns that stay beside each pixel.
    """
    keys = keys_of(pixels)
    places = tuple((i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)) if connectivity == 8 else CROSS
    later = [(i, j) for i, j in places if (j, i) > (0, 0)]
    schema = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in [*keys, "x", "y", *carry]) + ", comp long"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        if not carry:
            pdf = pdf.drop_duplicates(["x", "y"])
        number = pdf["y"].to_numpy(np.int64) * (1 << 32) + pdf["x"].to_numpy(np.int64)
        ids, back = np.unique(number, return_inverse=True)
        x, y = ids & 0xFFFFFFFF, ids >> 32
        x, y = x - x.min(), y - y.min()
        at = np.full((y.max() + 2 * reach + 1, x.max() + 2 * reach + 1), -1, np.int64)
        at[y + reach, x + reach] = np.arange(len(ids))
        ends = [(np.flatnonzero(o >= 0), o[o >= 0]) for i, j in later for o in [at[y + reach + j, x + reach + i]]]
        found = least_labels(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]), len(ids))
        return pdf[[*keys, "x", "y", *carry]].assign(comp=ids[found][back])

    tile = lambda c: F.floor(F.col(c) / TILE)
    local = pixels.select(*keys, "x", "y", *carry, tile("x").alias("__tx"), tile("y").alias("__ty")).groupBy(*keys, "__tx", "__ty").applyInPandas(label, schema)
    local = cut(local)
    inner = lambda c: F.pmod(F.col(c), F.lit(TILE)).between(reach, TILE - 1 - reach)
    border = local.where(~(inner("x") & inner("y"))).select(*keys, "x", "y", "comp").distinct()
    sent = border.select(*keys, "x", "y", F.col("comp").alias("a"), F.explode(_offsets(tuple(later))).alias("k")).select(*keys, "a", "x", "y", (F.col("x") + F.col("k.dx")).alias("ox"), (F.col("y") + F.col("k.dy")).alias("oy"))
    sent = sent.where((tile("x") != tile("ox")) | (tile("y") != tile("oy"))).select(*keys, "a", F.col("ox").alias("x"), F.col("oy").alias("y"))
    links = cut(sent.join(border.withColumnRenamed("comp", "b"), [*keys, "x", "y"]).where("a <> b").select(*keys, "a", "b").distinct())
    roots = _roots(links, keys, in_one)
    return local.join(roots, [*keys, "comp"], "left").select(*keys, "x", "y", *carry, F.coalesce("root", "comp").alias("comp"))


def _roots(links: DataFrame, keys: list[str], in_one: int) -> DataFrame:
    """(comp, root) of each end of ``links(a, b)`` that can reach a lesser one: the least."""
    if links.count() <= in_one:
        schema = ", ".join(f"{k} {links.schema[k].dataType.simpleString()}" for k in keys) + (", " if keys else "") + "comp long, root long"

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes, ends = np.unique(pdf[["a", "b"]].to_numpy(np.int64), return_inverse=True)
            ends = ends.reshape(-1, 2)
            out = pd.DataFrame({"comp": nodes, "root": nodes[least_labels(ends[:, 0], ends[:, 1], len(nodes))]})
            for k in reversed(keys):
                out.insert(0, k, pdf[k].iloc[0])
            return out[out["comp"] != out["root"]]

        return links.withColumn("__one", F.lit(1)).groupBy(*(keys or ["__one"])).applyInPandas(solve, schema)
    # links are turned towards the least end, first over all that lie above a node, then below it, until they are stars
    now, before = links, None
    while True:
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [*keys, "a"]).select(*keys, F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select(*keys, "e.a", "e.b").where("a <> b").distinct()
        nxt = cut(small)
        drop(now)
        # stars stay as they are: the number of links and the sum of their ends tell
        state = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if state == before:
            return nxt.select(*keys, F.col("a").alias("comp"), F.col("b").alias("root"))
        now, before = nxt, state


def group_segments(segmap: DataFrame, connectivity: int = 4) -> tuple[DataFrame, DataFrame]:
    """SEG-10, D8: groups of touching segments: (groupID, segID list, Ngroup, Npix) and the group map.

    A segment belongs to the component most of its pixels are in; a group is named by its least
    label; pixels carry the group of their segment.
    """
    from .stats import majority

    labels = segmap.where("segID > 0")
    both = components(labels, connectivity, carry=("segID",))
    ids = keys_of(segmap)
    home = majority(both, "segID", "comp")
    named = home.join(home.groupBy(*ids, "comp").agg(F.min("segID").alias("groupID")), [*ids, "comp"]).select(*ids, "segID", "groupID")
    sizes = both.groupBy(*ids, "segID").agg(F.count(F.lit(1)).alias("n"))
    groups = named.join(sizes, [*ids, "segID"]).groupBy(*ids, "groupID").agg(F.array_sort(F.collect_set("segID")).alias("segIDs"), F.count(F.lit(1)).cast("int").alias("Ngroup"), F.sum("n").alias("Npix"))
    return groups, labels.join(named, [*ids, "segID"]).select(*ids, "x", "y", "groupID")


def merge_closure(merges: DataFrame) -> DataFrame:
    """SEG-16: lists of an image that share a label become one (the full closure)."""
    ids = keys_of(merges)
    lists = merges.select(*ids, F.array_min("segIDs").alias("least"), "segIDs")
    now = lists.select(*ids, F.explode("segIDs").alias("segID"), "least").withColumn("comp", F.col("least"))
    while True:  # labels only fall, so this ends
        by_label = now.groupBy(*ids, "segID").agg(F.min("comp").alias("m"))
        by_list = now.join(by_label, [*ids, "segID"]).groupBy(*ids, "least").agg(F.min("m").alias("n"))
        nxt = cut(now.join(by_list, [*ids, "least"]).select(*ids, "segID", "least", F.least("comp", "n").alias("comp"), F.col("comp").alias("before")))
        drop(now)
        if nxt.where("comp <> before").isEmpty():
            return nxt.groupBy(*ids, "comp").agg(F.array_sort(F.collect_set("segID")).alias("segIDs")).select(*ids, "segIDs")
        now = nxt


def auto_merge(segmap: DataFrame, stats: DataFrame, spur_lim: float, ncut: int = 2, connectivity: int = 4) -> DataFrame:
    """SEG-18: groups of touching segments with cenfrac / (1 + sep) below ``spur_lim``, of at least ``ncut``."""
    on = [*shared_keys(segmap, stats), "segID"]
    spur = stats.where(F.try_divide("cenfrac", 1 + F.col("sep")) < spur_lim).select(*on)
    groups, _ = group_segments(segmap.join(spur, on, "left_semi").select(*segmap.columns), connectivity)
    return groups.where(F.col("Ngroup") >= ncut)


def extend_map(segmap: DataFrame, found: DataFrame) -> DataFrame:
    """SEG-14: labels found on the rest of the image, moved above the present ones, added."""
    ids = shared_keys(segmap, found)
    shift = segmap.groupBy(*ids).agg(F.max("segID").alias("shift"))
    cols = [*ids, "x", "y"]
    new = with_summary(found.where("segID > 0").join(segmap.where("segID > 0").select(*cols), cols, "left_anti"), shift, ids)
    return segmap.where("segID > 0").select(*cols, "segID").unionByName(new.select(*cols, (F.col("segID") + F.coalesce("shift", F.lit(0))).alias("segID")))


def unique_id(xmax: Column, ymax: Column, ny: int) -> Column:
    """D: x * pad + y with a pad above the image's height."""
    return F.ceil(xmax) * 10.0 ** ceil(log10(ny + 1)) + F.ceil(ymax)
