"""Image filters: kernel joins without joins, renderers, correlations (FLT-*).

A kernel is a fixed list on the driver.  Every pixel sends its value to the places it touches
(``explode`` of constant offsets) and one aggregation collects them, so a filter is one shuffle with
map-side combine, at any image size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import keys_of, with_summary
from .kernels import Kernel, gaussian_1d


def offsets(kernel: Kernel) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(w).alias("w")) for i, j, w in kernel))


def spread(pixels: DataFrame, kernel: Kernel, column: str = "flux") -> DataFrame:
    """Weighted mean of ``column`` under the kernel at every pixel that exists; NULLs have no weight."""
    keys = keys_of(pixels)
    sent = pixels.select(*keys, "x", "y", column, F.explode(offsets(kernel)).alias("k")).select(
        *keys, (F.col("x") + F.col("k.dx")).alias("x"), (F.col("y") + F.col("k.dy")).alias("y"), F.col(column).alias("v"), F.col("k.w").alias("w"), ((F.col("k.dx") == 0) & (F.col("k.dy") == 0)).alias("own")
    )
    out = sent.groupBy(*keys, "x", "y").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("n"), F.max("own").alias("own"))
    return out.where("own").select(*keys, "x", "y", F.try_divide("s", "n").alias(column))


def blur(pixels: DataFrame, sigma: float, column: str = "flux") -> DataFrame:
    """FLT-1: Gaussian blur to four sigma, two one-dimensional passes, renormalised over NULLs and edges.

    The two passes carry numerator and weight, so the result equals the two-dimensional kernel.
    """
    keys, line = keys_of(pixels), gaussian_1d(sigma)
    start = pixels.select(*keys, "x", "y", F.col(column).alias("s"), F.when(F.col(column).isNotNull(), 1.0).otherwise(0.0).alias("n"), F.lit(True).alias("own"))
    start = start.withColumn("s", F.coalesce("s", F.lit(0.0)))

    def once(df: DataFrame, axis: str, other: str) -> DataFrame:
        k = F.array(*(F.struct(F.lit(i).alias("d"), F.lit(w).alias("w")) for i, w in line))
        sent = df.select(*keys, "x", "y", "s", "n", "own", F.explode(k).alias("k"))
        moved = sent.select(*keys, (F.col(axis) + F.col("k.d")).alias(axis), other, (F.col("s") * F.col("k.w")).alias("s"), (F.col("n") * F.col("k.w")).alias("n"), (F.col("own") & (F.col("k.d") == 0)).alias("own"))
        return moved.groupBy(*keys, "x", "y").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("own").alias("own"))

    # the first pass may make rows at places that do not exist, which feed the second
    out = once(once(start, "x", "y"), "y", "x")
    return out.where("own").select(*keys, "x", "y", F.try_divide("s", "n").alias(column))


def difference(pixels: DataFrame, sigma: float) -> DataFrame:
    """FLT-3: image minus its blur."""
    keys = [*keys_of(pixels), "x", "y"]
    return pixels.select(*keys, "flux").join(blur(pixels, sigma).withColumnRenamed("flux", "smooth"), keys).select(*keys, (F.col("flux") - F.col("smooth")).alias("flux"))


def gradient(pixels: DataFrame, sigma: float | None = None) -> DataFrame:
    """FLT-2: norm of the central differences (one-sided at an edge), after an optional blur."""
    px = blur(pixels, sigma) if sigma else pixels
    keys = keys_of(px)
    sent = px.select(*keys, "x", "y", "flux", F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))).alias("k"))
    got = sent.groupBy(*keys, (F.col("x") + F.col("k.dx")).alias("x"), (F.col("y") + F.col("k.dy")).alias("y")).agg(
        *(F.max(F.when((F.col("k.dx") == i) & (F.col("k.dy") == j), F.col("flux"))).alias(n) for n, i, j in (("c", 0, 0), ("l", 1, 0), ("r", -1, 0), ("d", 0, 1), ("u", 0, -1))), F.max((F.col("k.dx") == 0) & (F.col("k.dy") == 0)).alias("own")
    )

    def slope(a: str, b: str) -> Column:
        return F.coalesce((F.col(b) - F.col(a)) / 2, F.col(b) - F.col("c"), F.col("c") - F.col(a), F.lit(0.0))

    return got.where("own").select(*keys, "x", "y", F.sqrt(F.pow(slope("l", "r"), 2) + F.pow(slope("d", "u"), 2)).alias("flux"))


def add_images(base: DataFrame, extra: DataFrame) -> DataFrame:
    """FLT-8: sums of two images, pixel by pixel, over the pixels of the first."""
    keys = [*keys_of(base), "x", "y"]
    both = base.select(*keys, "flux", F.lit(True).alias("own")).unionByName(extra.select(*keys, "flux", F.lit(False).alias("own")))
    return both.groupBy(*keys).agg(F.sum("flux").alias("flux"), F.max("own").alias("own")).where("own").drop("own")


def cutout(pixels: DataFrame, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """FLT-7: a rectangle, ends included."""
    return pixels.where(F.col("x").between(*x) & F.col("y").between(*y))


def box_flux(pixels: DataFrame, cx: int, cy: int, size: int) -> DataFrame:
    """FLT-12: flux in a square about a pixel."""
    h = size // 2
    return cutout(pixels, (cx - h, cx + h), (cy - h, cy + h)).groupBy(*keys_of(pixels)).agg(F.sum("flux").alias("flux"))


def render_points(sources: DataFrame, psf: Kernel, nx: int, ny: int) -> DataFrame:
    """FLT-9: image of point sources (xcen, ycen, flux): the PSF shared bilinearly by four pixels, clipped."""
    ids = keys_of(sources)
    x0, y0 = F.floor(F.col("xcen") + 0.5), F.floor(F.col("ycen") + 0.5)
    fx, fy = F.col("xcen") + 0.5 - x0, F.col("ycen") + 0.5 - y0
    four = F.array(*(F.struct((x0 + i).alias("x"), (y0 + j).alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)))
    corners = sources.select(*ids, "flux", F.explode(four).alias("c")).where("c.w > 0")
    sent = corners.select(*ids, (F.col("flux") * F.col("c.w")).alias("f"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.explode(offsets(psf)).alias("k"))
    placed = sent.select(*ids, (F.col("cx") + F.col("k.dx")).cast("int").alias("x"), (F.col("cy") + F.col("k.dy")).cast("int").alias("y"), (F.col("f") * F.col("k.w")).alias("f"))
    return placed.where(F.col("x").between(1, nx) & F.col("y").between(1, ny)).groupBy(*ids, "x", "y").agg(F.sum("f").alias("flux"))


def pixel_correlation(pixels: DataFrame, lags: list[int]) -> DataFrame:
    """FLT-10, AGG-21: correlation with the pixel ``lag`` away along x and y, and relative deviations.

    ``pixels`` holds (flux - sky) / skyRMS with objects and masked pixels NULL.  All lags go through
    one join: a pixel is sent to itself and to its lagged places.
    """
    keys = keys_of(pixels)
    good = pixels.where("flux is not null")
    to = F.array(*(F.struct(F.lit(n).alias("lag"), F.lit(a).alias("axis")) for n in lags for a in ("x", "y")))
    here = good.select(*keys, "x", "y", "flux", F.explode(to).alias("k")).select(*keys, F.col("k.lag").alias("lag"), F.col("k.axis").alias("axis"), "x", "y", "flux")
    there = here.select(*keys, "lag", "axis", F.when(F.col("axis") == "x", F.col("x") - F.col("lag")).otherwise(F.col("x")).alias("x"), F.when(F.col("axis") == "y", F.col("y") - F.col("lag")).otherwise(F.col("y")).alias("y"), F.col("flux").alias("v"))
    pair = here.join(there, [*keys, "lag", "axis", "x", "y"])
    on = lambda axis, sign: F.when((F.col("axis") == axis) & (F.lit(True) if sign == 0 else (F.signum("flux") == sign) & (F.signum("v") == sign)), F.col("flux"))
    cors = [F.corr(on(a, s), F.when(on(a, s).isNotNull(), F.col("v"))).alias(f"cor{a}{n}") for n, s in (("", 0), ("_neg", -1), ("_pos", 1)) for a in ("x", "y")]
    devs = [(F.stddev_samp(F.when(F.col("axis") == a, F.col("flux") - F.col("v"))) / F.sqrt(F.lit(2.0))).alias(f"relsd{a}") for a in ("x", "y")]
    out = pair.groupBy(*keys, "lag").agg(*cors, *devs)
    return out.withColumns({f"cor{a}_diff": F.col(f"cor{a}_pos") - F.col(f"cor{a}_neg") for a in ("x", "y")})


def covariance_matrix(pixels: DataFrame, axis: str = "x", lines: int = 256) -> DataFrame:
    """FLT-11: sample covariance of each pair of columns (``axis`` x) or rows, over the other axis.

    A pair is covered where both have a value.  Blocks of ``lines`` lines give partial sums of products by one matrix
    product each; these are added up, so no row is made for a pair of pixels.
    """
    other = "y" if axis == "x" else "x"
    keys = keys_of(pixels)
    middle = F.avg("flux").over(Window.partitionBy(*keys, axis))  # sums about the mean do not cancel
    px = pixels.where("flux is not null").select(*keys, F.col(axis).alias("i"), F.col(other).alias("line"), (F.col("flux") - middle).alias("flux"))
    names = ["n", "sij", "si", "sj"]
    schema = "".join(f"{k} {px.schema[k].dataType.simpleString()}, " for k in keys) + "i int, j int, " + ", ".join(f"{c} double" for c in names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="line", columns="i", values="flux")
        have = table.notna().to_numpy().astype(float)
        v = table.fillna(0.0).to_numpy()
        i, j = np.triu_indices(v.shape[1])
        at = table.columns.to_numpy()
        out = pd.DataFrame({"i": at[i], "j": at[j], "n": (have.T @ have)[i, j], "sij": (v.T @ v)[i, j], "si": (v.T @ have)[i, j], "sj": (have.T @ v)[i, j]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    block = px.withColumn("block", F.floor((F.col("line") - 1) / lines))
    sums = block.groupBy(*keys, "block").applyInPandas(run, schema).groupBy(*keys, "i", "j").agg(*(F.sum(c).alias(c) for c in names))
    return sums.select(*keys, "i", "j", F.when(F.col("n") > 1, (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def resample(pixels: DataFrame, nx: int, ny: int, ratio: float, fluxscale: str = "image", kind: str = "bilinear", recentre: bool = False) -> DataFrame:
    """FLT-6: a new grid whose pixels are ``ratio`` old pixels wide, by bilinear or bicubic (Akima) interpolation.

    fluxscale: image (keep the total), pixscale (scale by the area), norm (sum to one).  With ``recentre`` each
    image is sampled again so that its brightest new pixel comes to the middle.  A bicubic image is one group.
    """
    ids = keys_of(pixels)
    mx, my = int(nx / ratio), int(ny / ratio)
    grid = pixels.sparkSession.range(1, mx + 1).select(F.col("id").cast("int").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(my))).alias("y"))
    if ids:  # the new pixels of every image
        grid = pixels.select(*ids).distinct().crossJoin(F.broadcast(grid))

    def sampled(points: DataFrame) -> DataFrame:
        """Flux at the new pixels, moved by (sx, sy)."""
        at = lambda c, n: F.greatest(F.lit(1.0), F.least((F.col(c) - 0.5 + F.col(f"s{c}")) * ratio + 0.5, F.lit(float(n))))  # noqa: E731  old index of a new centre
        points = points.withColumns({"gx": at("x", nx), "gy": at("y", ny)})
        if kind == "bicubic":
            from .sky import bicubic_at

            old = pixels.select(*ids, (F.col("x") - 1).alias("gx"), (F.col("y") - 1).alias("gy"), "flux")
            return bicubic_at(points.select(*ids, "x", "y", (F.col("gx") - 1).alias("px"), (F.col("gy") - 1).alias("py")), old, "flux").select(*ids, "x", "y", "flux")
        points = points.withColumns({"ix": F.least(F.floor("gx"), F.lit(nx - 1)), "iy": F.least(F.floor("gy"), F.lit(ny - 1))})
        four = F.array(*(F.struct((F.col("ix") + i).alias("px"), (F.col("iy") + j).alias("py"), ((F.col("gx") - F.col("ix") if i else 1 - F.col("gx") + F.col("ix")) * (F.col("gy") - F.col("iy") if j else 1 - F.col("gy") + F.col("iy"))).alias("w")) for i in (0, 1) for j in (0, 1)))
        want = points.select(*ids, "x", "y", F.explode(four).alias("c")).select(*ids, "x", "y", F.col("c.px").cast("int").alias("px"), F.col("c.py").cast("int").alias("py"), F.col("c.w").alias("w"))
        old = pixels.select(*ids, F.col("x").alias("px"), F.col("y").alias("py"), "flux")
        return want.join(old, [*ids, "px", "py"]).groupBy(*ids, "x", "y").agg(F.sum(F.col("w") * F.col("flux")).alias("flux"))

    if kind not in ("bilinear", "bicubic"):
        raise ValueError("kind is bilinear or bicubic")
    still = {"sx": F.lit(0.0), "sy": F.lit(0.0)}
    out = sampled(grid.withColumns(still))
    if recentre:
        top = out.groupBy(*ids).agg(F.max(F.struct("flux", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("t"))
        top = top.select(*ids, (-F.col("t.x") - 0.5 - mx / 2).alias("sx"), (-F.col("t.y") - 0.5 - my / 2).alias("sy"))
        out = sampled(with_summary(grid, top, ids))
    if fluxscale == "pixscale":
        return out.withColumn("flux", F.col("flux") * ratio * ratio)
    total = out.groupBy(*ids).agg(F.sum("flux").alias("new"))
    whole = pixels.groupBy(*ids).agg(F.sum("flux").alias("old")) if fluxscale == "image" else total.select(*ids, F.lit(1.0).alias("old"))
    return with_summary(with_summary(out, total, ids), whole, ids).select(*ids, "x", "y", F.try_divide(F.col("flux") * F.col("old"), "new").alias("flux"))
