"""SEG-1, SEG-2, SEG-4: watershed labels.

Pixels above the threshold that lie within ``ext`` of each other form components, which are
independent.  Bins of whole components are flooded in order of brightness; the seeds of all
components, ranked by (value, place), give the global labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import keys_of, with_summary
from .segments import components

#: Pixels that one call floods, unless a component has more.
BIN = 50_000


def flood(x: np.ndarray, y: np.ndarray, v: np.ndarray, ext: int = 2, abstol: float = 4.0, reltol: float = 0.0, cliptol: float = np.inf, old: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Labels of one component's pixels: for each pixel its seed, as an index into the pixels; and all seeds.

    Pixels are visited from bright to faint, ties by (y, x).  A pixel takes the label of its brightest
    strictly brighter labelled neighbour.  A neighbouring label whose peak rises too little above
    the pixel (or any, above ``cliptol``) merges into the brightest label there.
    """
    order = np.lexsort((x, y, -v))
    place = {(int(x[i]), int(y[i])): int(i) for i in order}
    label: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    rank, seeds = {}, []
    steps = [(i, j) for j in range(-ext, ext + 1) for i in range(-ext, ext + 1) if (i, j) != (0, 0)]
    if old:
        steps = [(i, j) for i in range(-ext, ext + 1) for j in range(-ext, ext + 1) if (i, j) != (0, 0)]
    for i in map(int, order):
        c, best, best_label, touching = v[i], -np.inf, None, []
        for dx, dy in steps:
            j = place.get((int(x[i]) + dx, int(y[i]) + dy))
            if j is None or j not in label:
                continue
            s = label[j]
            if s not in touching:
                touching.append(s)
            if v[j] > c and v[j] > best:
                best, best_label = v[j], s
        if best_label is None:
            label[i] = i
            members[i] = [i]
            rank[i] = len(seeds)
            seeds.append(i)
            mine = i
        else:
            mine = best_label
            label[i] = mine
            members[mine].append(i)
        if abstol > 0 and len(touching) > 1:
            touching.sort(key=rank.__getitem__)
            weak = [s for s in touching if c > cliptol or v[s] - c < abstol * (v[s] / c) ** reltol]
            for s in weak:
                if s != touching[0]:
                    for m in members[s]:
                        label[m] = touching[0]
                    members[touching[0]] += members.pop(s)
    return np.array([label[i] for i in range(len(x))]), np.array(seeds)


def watershed(pixels: DataFrame, skycut: float = 1.0, pixcut: int = 3, ext: int = 2, abstol: float = 4.0, reltol: float = 0.0, cliptol: float = float("inf"), variant: str = "new") -> DataFrame:
    """Labelled pixels of ``pixels(x, y, sn)``: strictly above ``skycut`` ('old': or equal to it).

    Labels with fewer than ``pixcut`` pixels go; the others keep their numbers, which are the ranks of
    seeds from bright to faint over the whole image, from 1.
    """
    keys = keys_of(pixels)
    # few of all pixels, used twice
    cand = cut(pixels.where(F.col("sn") >= skycut if variant == "old" else F.col("sn") > skycut).select(*keys, "x", "y", "sn"))
    dealt = components(cand, connectivity=8, reach=max(ext, 1), carry=("sn",))
    schema = "".join(f"{k} {cand.schema[k].dataType.simpleString()}, " for k in keys) + "x int, y int, v double, seed_x int, seed_y int, is_seed boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["sn"].to_numpy()
        label, seeds = flood(x, y, v, ext, abstol, reltol, cliptol, variant == "old")
        out = pd.DataFrame({"x": x, "y": y, "v": v, "seed_x": x[label], "seed_y": y[label], "is_seed": np.isin(np.arange(len(x)), seeds)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    # components never touch, so those of a bin are flooded in one call as if they were alone
    bins = F.pmod(F.xxhash64("comp"), F.lit(cand.count() // BIN + 1))
    flooded = cut(dealt.withColumn("__bin", bins).groupBy(*keys, "__bin").applyInPandas(run, schema))
    # every seed counts for the numbers, also those merged away; ranks are made by ranges of value
    seeds = flooded.where("is_seed").select(*keys, F.col("x").alias("seed_x"), F.col("y").alias("seed_y"), "v")
    ranked = rank_globally(seeds, keys)
    out = flooded.join(ranked, [*keys, "seed_x", "seed_y"]).select(*keys, "x", "y", "segID")
    size = out.groupBy(*keys, "segID").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= pixcut)
    return out.join(size.select(*keys, "segID"), [*keys, "segID"], "left_semi").select(*keys, "x", "y", "segID")


def rank_globally(seeds: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """WIN-5: ranks by (v desc, y, x) in each image; windows over bands of equal numbers, offset by the bands before."""
    cuts = seeds.groupBy(*keys).agg(F.percentile_approx("v", [i / parts for i in range(1, parts)]).alias("cuts"))
    both = with_summary(seeds, cuts, keys).withColumn("__band", F.size(F.filter("cuts", lambda c: c > F.col("v"))))
    counts = both.groupBy(*keys, "__band").agg(F.count(F.lit(1)).alias("__n"))
    start = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__band")) - F.col("__n")).drop("__n")
    rn = F.row_number().over(Window.partitionBy(*keys, "__band").orderBy(F.desc("v"), "seed_y", "seed_x"))
    return both.withColumn("__rn", rn).join(start, [*keys, "__band"]).select(*keys, "seed_x", "seed_y", (F.col("__before") + F.col("__rn")).cast("int").alias("segID"))
