"""Sky estimation: tile aggregates, sigma clipping, interpolation, scans, polynomials (SKY-*)."""

from __future__ import annotations

from math import erf, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import normal_quantile_log
from ..model import keys_of
from . import filters


def _phi(s: float) -> float:
    return 0.5 * (1 + erf(s / sqrt(2)))


def sky_values(pixels: DataFrame) -> DataFrame:
    """Pixels that are neither masked nor in an object nor missing."""
    out = pixels.where("flux is not null")
    for c in ("objects", "mask"):
        if c in pixels.columns:
            out = out.where(F.coalesce(F.col(c), F.lit(0)) == 0)
    return out


def tile_windows(pixels: DataFrame, grid: int, box: int, nx: int, ny: int) -> DataFrame:
    """SKY-2, SKY-7: each sky pixel once for every window it lies in.

    Window centres step by ``grid`` from ``grid / 2`` over the image; a window reaches int(box / 2) to either side
    of its rounded centre.  Adds gx, gy (tile numbers), xc, yc (centres).  A pixel is in at most
    ceil((box + 1) / grid) squared windows.
    """
    h = box // 2
    mx, my = -(-nx // grid), -(-ny // grid)

    def tiles(c: str, most: int) -> Column:
        # floor(centre + 0.5) = g * grid + floor(grid / 2 + 0.5), g from 0
        first = F.ceil((F.col(c) - h - int(grid / 2 + 0.5)) / grid)
        last = F.floor((F.col(c) + h - int(grid / 2 + 0.5)) / grid)
        a, b = F.greatest(first, F.lit(0)), F.least(last, F.lit(most - 1))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    out = sky_values(pixels).withColumn("gx", F.explode(tiles("x", mx))).withColumn("gy", F.explode(tiles("y", my)))
    return out.withColumns({"xc": F.col("gx") * grid + grid / 2, "yc": F.col("gy") * grid + grid / 2})


def _tile_keys(df: DataFrame) -> list[str]:
    return [*keys_of(df), *[c for c in ("region", "gx", "gy", "xc", "yc") if c in df.columns]]


def clip(tiles: DataFrame, sigma: float | None = None, rounds: int = 5, sigmasel: float = 1.0) -> DataFrame:
    """SKY-1: iterative sigma clip in every tile.

    Per round: the lower median; the deviation from the quantile at 1 - Phi(sigmasel) below it;
    values within the limit stay.  The automatic clip is Phi^-1(1 - 2 / max(n, 2)) of the count.
    Each round is an aggregation of the tile (exact order statistics) and a filter; rounds after
    a tile has settled change nothing.
    """
    keys = _tile_keys(tiles)
    out = tiles
    for _ in range(rounds):
        order = Window.partitionBy(*keys).orderBy("flux", "y", "x")
        ranked = out.withColumns({"__rn": F.row_number().over(order), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
        whole = Window.partitionBy(*keys)
        med = F.max(F.when(F.col("__rn") == F.greatest(F.floor(F.col("__n") / 2), F.lit(1)), F.col("flux"))).over(whole)
        low = F.max(F.when(F.col("__rn") == F.floor((1 - _phi(sigmasel)) * F.col("__n") - 1).cast("long") + 1, F.col("flux"))).over(whole)
        ranked = ranked.withColumns({"__m": med, "__l": F.coalesce(low, F.min("flux").over(whole))})
        limit = F.lit(sigma) if sigma is not None else auto_clip(F.col("__n"))
        reach = limit * (F.col("__m") - F.col("__l")) / sigmasel
        out = ranked.where(F.abs(F.col("flux") - F.col("__m")) <= reach).drop("__rn", "__n", "__m", "__l")
    return out


def auto_clip(n: Column) -> Column:
    """Normal quantile of 1 - 2 / max(n, 2) by a rational approximation (error below 4.5e-4)."""
    p = 2 / F.greatest(n, F.lit(4)).cast("double")
    t = F.sqrt(-2 * F.ln(p))
    # Coefficients of the approximation of Abramowitz and Stegun, 26.2.23.
    return t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)


def clip_exact(values: np.ndarray, sigma: float | None = None, rounds: int = 5, sigmasel: float = 1.0) -> np.ndarray:
    """SKY-1 on one array, with the exact normal quantile."""
    x = np.sort(values[np.isfinite(values)])
    for _ in range(rounds):
        n = len(x)
        if n < 2:
            break
        limit = sigma if sigma is not None else -normal_quantile_log(log(min(0.5, 2 / max(n, 2))))
        med = x[max(n // 2 - 1, 0)]
        reach = limit * (med - x[max(int((1 - _phi(sigmasel)) * n - 1), 0)]) / sigmasel
        keep = x[np.abs(x - med) <= reach]
        if len(keep) == n:
            break
        x = keep
    return x


def tile_stats(tiles: DataFrame, skytype: str = "median", rmstype: str = "quanlo", sigmasel: float = 1.0) -> DataFrame:
    """SKY-3, SKY-4, SKY-5: sky and skyRMS of each tile from its values."""
    keys = _tile_keys(tiles)
    if skytype == "converge" or rmstype == "converge":
        spread = converged(tiles)
    if skytype == "mode":
        centre = density_mode(tiles)
    elif skytype == "converge":
        centre = spread.drop("sd_sky")
    else:
        centre = None  # a window of the tiles: no second computation of them, and no shuffle beside theirs
        agg = {"median": F.percentile("flux", 0.5), "mean": F.avg("flux")}[skytype]
        tiles = tiles.withColumn("sky", agg.over(Window.partitionBy(*keys)))
    d = F.col("flux") - F.col("sky")
    p = 2 * _phi(-sigmasel)
    lo = F.abs(F.percentile(F.when(d < 0, d), p)) / sigmasel
    hi = F.abs(F.percentile(F.when(d > 0, d), 1 - p)) / sigmasel
    rms = {"quanlo": lo, "quanhi": hi, "quanboth": (lo + hi) / 2, "sd": F.sqrt(F.avg(d * d)), "converge": F.first("sd_sky")}[rmstype]
    if centre is not None:
        tiles = tiles.join(centre, keys)
    if rmstype == "converge":
        tiles = tiles.join(spread.drop("sky"), keys)
    return tiles.groupBy(*keys, "sky").agg(rms.alias("skyRMS"), F.count(F.lit(1)).alias("n"), F.avg(F.when(d < 0, d * d)).alias("below"))


def density_mode(tiles: DataFrame, points: int = 512) -> DataFrame:
    """SKY-4: the place of the greatest Gaussian kernel density, per tile."""
    keys = _tile_keys(tiles)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.select(*keys).schema) + ", sky double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["flux"].to_numpy()
        spread = min(np.std(v, ddof=1), np.subtract(*np.percentile(v, [75, 25])) / 1.34) if len(v) > 1 else 0.0
        if not spread > 0:
            mode = float(np.median(v))
        else:
            bw = 0.9 * spread * len(v) ** -0.2
            at = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, points)
            # each value is shared between the two points beside it, then one convolution
            place = (v - at[0]) / (at[1] - at[0])
            left = np.minimum(place.astype(int), points - 2)
            weight = np.bincount(left, left + 1 - place, points) + np.bincount(left + 1, place - left, points)
            kernel = np.exp(-0.5 * (np.arange(1 - points, points) * (at[1] - at[0]) / bw) ** 2)
            mode = float(at[np.argmax(np.convolve(weight, kernel)[points - 1 : 2 * points - 1])])
        return pd.DataFrame([[*pdf[keys].iloc[0], mode]], columns=[*keys, "sky"])

    return tiles.groupBy(*keys).applyInPandas(run, schema)


def grown_windows(pixels: DataFrame, grid: int, box: int, nx: int, ny: int, skypixmin: int, boxadd: int, boxiters: int) -> DataFrame:
    """SKY-2: like :func:`tile_windows`, each tile with the first box of enough sky pixels.

    Boxes grow by ``boxadd`` at most ``boxiters`` times; counts of all candidate boxes come from one
    aggregation over the largest.
    """
    largest = tile_windows(pixels, grid, box + boxiters * 2 * (boxadd // 2), nx, ny)
    far = F.greatest(F.abs(F.col("x") - F.floor(F.col("xc") + 0.5)), F.abs(F.col("y") - F.floor(F.col("yc") + 0.5)))
    ring = F.greatest(F.lit(0), F.ceil((far - box // 2) / max(1, boxadd // 2))).cast("int")
    dealt = largest.withColumn("ring", ring)
    keys = _tile_keys(largest)
    counts = dealt.groupBy(*keys).agg(*(F.count_if(F.col("ring") <= i).alias(f"n{i}") for i in range(boxiters + 1)))
    first = F.coalesce(*(F.when(F.col(f"n{i}") >= skypixmin, F.lit(i)) for i in range(boxiters + 1)), F.lit(boxiters))
    return dealt.join(counts.select(*keys, first.alias("use")), keys).where("ring <= use").drop("ring", "use")


def pad_grid(grid: DataFrame, gx: int, gy: int, columns: tuple[str, ...] = ("sky", "skyRMS")) -> DataFrame:
    """SKY-9: missing tiles get the median of the tiles; a border of one tile by linear extrapolation.

    ``grid`` has gx, gy from 0; the result has them from -1 to the given counts.
    """
    keys = keys_of(grid)
    spark = grid.sparkSession
    full = spark.range(gx).select(F.col("id").cast("long").alias("gx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(gy - 1).cast("long"))).alias("gy"))
    if keys:
        full = grid.select(*keys).distinct().crossJoin(F.broadcast(full))  # a grid of tiles for each image
    med = grid.groupBy(*keys).agg(*(F.percentile(c, 0.5).alias(f"m_{c}") for c in columns))
    got = full.join(grid.select(*keys, "gx", "gy", *columns), [*keys, "gx", "gy"], "left")
    got = got.join(med, keys) if keys else got.crossJoin(F.broadcast(med))
    got = got.select(*keys, "gx", "gy", *(F.coalesce(c, f"m_{c}").alias(c) for c in columns))

    def extend(df: DataFrame, axis: str, n: int) -> DataFrame:
        sides = [(0, 1, -1), (n - 1, n - 2, n)] if n > 1 else [(0, 0, -1), (0, 0, n)]
        to = F.array(*(F.struct(F.lit(new).cast("long").alias("at"), F.when(F.col(axis) == a, F.lit(2.0 if a != b else 1.0)).when(F.col(axis) == b, F.lit(-1.0)).alias("w")) for a, b, new in sides))
        moved = df.withColumn("k", F.explode(to)).where("k.w is not null")
        other = [c for c in ("gx", "gy") if c != axis]
        edge = moved.groupBy(*keys, *other, F.col("k.at").alias(axis)).agg(*(F.sum(F.col(c) * F.col("k.w")).alias(c) for c in columns))
        return df.unionByName(edge)

    return extend(extend(got, "gx", gx), "gy", gy)


def bilinear(pixels: DataFrame, padded: DataFrame, grid: int, columns: tuple[str, ...] = ("sky", "skyRMS")) -> DataFrame:
    """SKY-10: tile values at pixel centres.

    The four corners of a cell are gathered on the grid (it is small), so pixels need one equi-join.
    """
    keys = keys_of(pixels)
    corner = F.array(*(F.struct((F.col("gx") - i).alias("ix"), (F.col("gy") - j).alias("iy"), F.lit(f"{i}{j}").alias("c")) for i in (0, 1) for j in (0, 1)))
    cells = padded.withColumn("k", F.explode(corner)).groupBy(*keys_of(padded), F.col("k.ix").alias("ix"), F.col("k.iy").alias("iy")).agg(*(F.max(F.when(F.col("k.c") == n, F.col(c))).alias(f"{c}{n}") for c in columns for n in ("00", "01", "10", "11")))
    at = lambda c: (F.col(c) - 0.5 - grid / 2) / grid
    px = pixels.withColumns({"ix": F.floor(at("x")), "iy": F.floor(at("y")), "fx": at("x") - F.floor(at("x")), "fy": at("y") - F.floor(at("y"))})
    out = px.join(cells, [*keys, "ix", "iy"], "left")
    value = lambda c: F.expr(f"{c}00 * (1 - fx) * (1 - fy) + {c}10 * fx * (1 - fy) + {c}01 * (1 - fx) * fy + {c}11 * fx * fy")
    return out.select(*pixels.columns, *(F.coalesce(value(c), F.lit(0.0)).alias(c) for c in columns))


def akima_slopes(z: np.ndarray) -> np.ndarray:
    """Akima derivatives on a uniform grid (unit step), along the last axis."""
    n = z.shape[-1]
    d = np.empty((*z.shape[:-1], n + 3))
    d[..., 2:-2] = np.diff(z, axis=-1)
    d[..., 1] = 2 * d[..., 2] - d[..., 3] if n > 2 else d[..., 2]
    d[..., 0] = 2 * d[..., 1] - d[..., 2]
    d[..., -2] = 2 * d[..., -3] - d[..., -4] if n > 2 else d[..., -3]
    d[..., -1] = 2 * d[..., -2] - d[..., -3]
    a, b = np.abs(d[..., 3:] - d[..., 2:-1]), np.abs(d[..., 1:-2] - d[..., :-3])
    even = (a + b) == 0
    return np.where(even, (d[..., 1:-2] + d[..., 2:-1]) / 2, (a * d[..., 1:-2] + b * d[..., 2:-1]) / np.where(even, 1, a + b))


_HERMITE = np.array([[1, 0, 0, 0], [0, 0, 1, 0], [-3, 3, -2, -1], [2, -2, 1, 1]], dtype=float)


def bicubic_coefficients(z: np.ndarray) -> np.ndarray:
    """SKY-11: 4 x 4 polynomial coefficients of each cell from Akima slopes and their cross terms."""
    zx, zy = akima_slopes(z.T).T, akima_slopes(z)
    zxy = (akima_slopes(zy.T).T + akima_slopes(zx)) / 2
    nx, ny = z.shape
    c = lambda f: np.array([[f[:-1, :-1], f[:-1, 1:]], [f[1:, :-1], f[1:, 1:]]])
    m = np.zeros((4, 4, nx - 1, ny - 1))
    m[:2, :2], m[2:, :2], m[:2, 2:], m[2:, 2:] = c(z), c(zx), c(zy), c(zxy)
    return np.einsum("ai,ijxy,bj->xyab", _HERMITE, m, _HERMITE)


def bicubic(pixels: DataFrame, padded: DataFrame, grid: int, column: str = "sky") -> DataFrame:
    """SKY-11: bicubic Akima interpolation at pixel centres, clamped to the grid's ends."""
    at = lambda c: (F.col(c) - 0.5 - grid / 2) / grid
    out = bicubic_at(pixels.withColumns({"px": at("x"), "py": at("y")}), padded, column)
    return out.select(*pixels.columns, column)


def bicubic_at(points: DataFrame, padded: DataFrame, column: str) -> DataFrame:
    """SKY-11 at the points (px, py) in units of the grid; adds ``column``.

    Coefficients are computed for each image's grid, which is one group; points join their cell and evaluate
    the polynomial as columns.
    """
    keys = keys_of(padded)
    names = [f"c{a}{b}" for a in range(4) for b in range(4)]
    schema = "".join(f"{k} string, " for k in keys) + "ix long, iy long, " + ", ".join(f"{n} double" for n in names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf.pivot(index="gx", columns="gy", values=column)
        c = bicubic_coefficients(z.to_numpy())
        nx, ny = c.shape[:2]
        out = pd.DataFrame(c.reshape(nx * ny, 16), columns=names)
        out.insert(0, "iy", np.tile(z.columns[:-1], nx))
        out.insert(0, "ix", np.repeat(z.index[:-1], ny))
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    cells = padded.withColumn("one", F.lit(1)).groupBy(*(keys or ["one"])).applyInPandas(run, schema)
    ends = padded.groupBy(*keys).agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"))
    px = points.join(ends, keys) if keys else points.crossJoin(F.broadcast(ends))
    within = lambda c: F.greatest(F.col(f"{c}0").cast("double"), F.least(F.col(f"{c}1").cast("double"), F.col(f"p{c}")))
    px = px.withColumns({"px": within("x"), "py": within("y")})
    px = px.withColumns({"ix": F.least(F.floor("px"), F.col("x1") - 1), "iy": F.least(F.floor("py"), F.col("y1") - 1)})
    px = px.withColumns({"tx": F.col("px") - F.col("ix"), "ty": F.col("py") - F.col("iy")})
    row = lambda a: F.expr(f"c{a}0 + ty * (c{a}1 + ty * (c{a}2 + ty * c{a}3))")
    value = row(0) + F.col("tx") * (row(1) + F.col("tx") * (row(2) + F.col("tx") * row(3)))
    return px.join(cells, [*keys, "ix", "iy"]).select(*points.columns, value.alias(column))


def sky_map(pixels: DataFrame, nx: int, ny: int, grid: int = 100, box: int = 100, skytype: str = "median", rmstype: str = "quanlo", kind: str = "bilinear", doclip: bool = True, skypixmin: int | None = None, boxadd: int = 50, boxiters: int = 0) -> DataFrame:
    """SKY-8: pixels with ``sky`` and ``skyRMS`` from clipped tiles and interpolation."""
    gx, gy = -(-nx // grid), -(-ny // grid)
    tiles = grown_windows(pixels, grid, box, nx, ny, skypixmin or box * box // 2, boxadd, boxiters) if boxiters else tile_windows(pixels, grid, box, nx, ny)
    stats = tile_stats(clip(tiles) if doclip else tiles, skytype, rmstype)
    padded = pad_grid(stats.select(*keys_of(pixels), "gx", "gy", "sky", "skyRMS"), gx, gy)
    px = pixels.drop("sky", "skyRMS")
    if kind == "bilinear":
        return bilinear(px, padded, grid)
    return bicubic(bicubic(px, padded, grid, "sky"), padded, grid, "skyRMS")


def by_region(pixels: DataFrame, region: str = "region", pedestal: bool = False, arguments: DataFrame | None = None) -> DataFrame:
    """SKY-19, SKY-21: sky of each region (median), or the median of the regions' sky as one pedestal.

    UDF-4: ``arguments(region, quantile, limit)`` gives each region a quantile of its own and a largest
    flux that counts; a region without a row, or with NULLs there, has the median of all its pixels.  A region
    all of whose pixels are above its limit stays, with NULL sky and n 0.
    """
    keys = keys_of(pixels)
    px = sky_values(pixels)
    if arguments is None:
        middle = F.percentile("flux", 0.5)
    else:
        px = px.join(arguments.select(region, "quantile", "limit"), region, "left").withColumn("flux", F.expr("if(limit is null or flux <= limit, flux, null)"))
        q, values = F.coalesce(F.first("quantile"), F.lit(0.5)), F.array_sort(F.collect_list("flux"))
        at = q * (F.size(values) - 1)
        low = F.floor(at).cast("int")
        middle = F.get(values, low) + (at - low) * (F.coalesce(F.get(values, low + 1), F.get(values, low)) - F.get(values, low))
    got = px.groupBy(*keys, region).agg(middle.alias("sky"), F.count("flux").alias("n"))
    return got.groupBy(*keys).agg(F.percentile("sky", 0.5).alias("sky")) if pedestal else got


def line_scan(pixels: DataFrame, axis: str, quantile: float = 0.4, block: int | None = None, good_frac: float = 0.0, trend: int | None = 21) -> DataFrame:
    """SKY-16, WIN-4: quantile of each line across ``axis``, less the median of them and their running trend.

    ``axis`` y corrects rows (lines of equal y), x columns.  The running median shrinks its window at the ends
    symmetrically.  Returns the line, its block and ``shift`` (0 where too few pixels are good).
    """
    keys, other = keys_of(pixels), "x" if axis == "y" else "y"
    part = F.floor((F.col(other) - 1) / block) if block else F.lit(0)
    lines = pixels.withColumn("part", part).groupBy(*keys, "part", axis).agg(F.percentile("flux", quantile).alias("q"), (F.count("flux") / F.count(F.lit(1))).alias("good"))
    lines = lines.withColumn("q", F.when(F.col("good") >= good_frac, F.col("q")))
    middle = lines.groupBy(*keys).agg(F.percentile("q", 0.5).alias("mid"))
    shifted = (lines.join(middle, keys) if keys else lines.crossJoin(F.broadcast(middle))).withColumn("shift", F.col("q") - F.col("mid"))
    if trend:
        h = trend // 2
        per = Window.partitionBy(*keys, "part")
        ranked = shifted.withColumns({"rn": F.row_number().over(per.orderBy(axis)), "n": F.count(F.lit(1)).over(per)})
        reach = F.least(F.lit(h), F.col("rn") - 1, F.col("n") - F.col("rn"))
        near = F.collect_list(F.struct("rn", "shift")).over(per.orderBy(axis).rowsBetween(-h, h))
        vals = F.sort_array(F.transform(F.filter(near, lambda s: (F.abs(s["rn"] - F.col("rn")) <= F.col("reach")) & s["shift"].isNotNull()), lambda s: s["shift"]))
        ranked = ranked.withColumn("reach", reach).withColumn("v", vals)
        k = F.size("v")
        med = F.when(k > 0, (F.get("v", F.floor((k - 1) / 2).cast("int")) + F.get("v", F.floor(k / 2).cast("int"))) / 2)
        shifted = ranked.withColumn("shift", F.col("shift") - med)
    return shifted.select(*keys, "part", axis, F.coalesce("shift", F.lit(0.0)).alias("shift"))


def scan_correct(pixels: DataFrame, rows: DataFrame, block: int | None = None) -> DataFrame:
    """SKY-16: image less the shift of each row."""
    part = F.floor((F.col("x") - 1) / block) if block else F.lit(0)
    return pixels.withColumn("part", part).join(rows, [*keys_of(pixels), "part", "y"], "left").withColumn("flux", F.col("flux") - F.coalesce("shift", F.lit(0.0))).drop("part", "shift")


def poly_sky(pixels: DataFrame, degree: int = 1, nx: int = 1, ny: int = 1) -> tuple[DataFrame, list[float]]:
    """SKY-17, SKY-18: additive polynomials in x and y by least squares, over sky pixels.

    One aggregation makes the normal equations of scaled coordinates; the driver solves the system
    of 2 * degree + 1 unknowns.  Degree -1 is zero, 0 the mean.  Returns pixels with ``sky`` and the
    coefficients (constant, powers of x, powers of y).
    """
    if degree < 0:
        return pixels.withColumn("sky", F.lit(0.0)), []
    u, v = (F.col("x") - 0.5) / nx, (F.col("y") - 0.5) / ny
    terms = [F.lit(1.0), *(F.pow(u, i) for i in range(1, degree + 1)), *(F.pow(v, i) for i in range(1, degree + 1))]
    n = len(terms)
    sums = [F.sum(terms[i] * terms[j]) for i in range(n) for j in range(i, n)] + [F.sum(t * F.col("flux")) for t in terms]
    row = [s or 0.0 for s in sky_values(pixels).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
    a, k = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = row[k]
            k += 1
    b = np.array(row[k:])
    c = np.linalg.lstsq(a, b, rcond=None)[0]
    return pixels.withColumn("sky", sum((float(x) * t for x, t in zip(c, terms, strict=True)), F.lit(0.0))), [float(x) for x in c]


def annulus_sky(pixels: DataFrame, xcen: float, ycen: float, lo: float, hi: float, bins: int = 10, radweight: float = 0.0) -> DataFrame:
    """SKY-13: sky in an annulus, from medians of ``bins`` rings with equal numbers of pixels.

    Pixels are clipped, then dealt by radius.  A ring's error is its deviation over the root of its number; the
    sky is the mean of the medians weighted by the inverse square of error and of radius to the power of
    minus ``radweight``, over the rings whose error reaches the sky, until their number settles.  ``skyerr`` is
    the deviation of all medians, ``skyRMS`` the mean error times the root of the mean number.
    """
    keys = keys_of(pixels)
    rad = F.sqrt(F.pow(F.col("x") - 0.5 - xcen, 2) + F.pow(F.col("y") - 0.5 - ycen, 2))
    inside = clip(sky_values(pixels).withColumn("rad", rad).where(F.col("rad").between(lo, hi)).withColumn("gx", F.lit(0)))
    ring = F.ntile(bins).over(Window.partitionBy(*keys, "gx").orderBy("rad", "y", "x"))
    rings = inside.withColumn("ring", ring).groupBy(*keys, "ring").agg(F.percentile("rad", 0.5).alias("r"), F.percentile("flux", 0.5).alias("m"), F.stddev_samp("flux").alias("s"), F.count(F.lit(1)).alias("n"))
    names = ["sky", "skyerr", "skyRMS", "Nnear"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = pdf["m"].to_numpy(), pdf["n"].to_numpy(float)
        err = pdf["s"].to_numpy() / np.sqrt(n)
        w = (pdf["r"].to_numpy() ** radweight / err) ** 2
        near, before = np.ones(len(m), bool), -1
        while True:
            sky = float(np.average(m[near], weights=w[near])) if near.any() else float("nan")
            near = np.abs(m - sky) <= err
            if near.sum() == before:
                break
            before = near.sum()
        use = near if near.any() else np.ones(len(m), bool)
        row = [sky, float(np.std(m, ddof=1)), float(err[use].mean() * np.sqrt(n[use].mean())), int(near.sum())]
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *row]], columns=[*keys, *names])

    schema = "".join(f"{k} {rings.schema[k].dataType.simpleString()}, " for k in keys) + "sky double, skyerr double, skyRMS double, Nnear long"
    # a ring without spread has no error to weigh by
    return rings.where("s > 0").withColumn("one", F.lit(1)).groupBy(*(keys or ["one"])).applyInPandas(run, schema)


def untruncated(mean: np.ndarray, sd: np.ndarray, low_mean: np.ndarray, low_sd: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """SKY-6: mean and deviation of the normals whose parts below mean + sd have the moments ``low_mean``, ``low_sd``.

    From the first guess (mean, sd), each round compares the moments that such a truncated normal would have
    with the observed ones: the mean moves by twice the difference, the deviation by the ratio.
    """
    upper, mu, sigma = mean + sd, mean.copy(), sd.copy()
    erfs = np.frompyfunc(erf, 1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            z = (upper - mu) / sigma
            share = 0.5 * (1 + erfs(z / sqrt(2)).astype(float))
            ratio = np.exp(-0.5 * z * z) / sqrt(2 * np.pi) / share
            mu, sigma = mu + 2 * (low_mean - (mu - sigma * ratio)), sigma * low_sd / (sigma * np.sqrt(1 - z * ratio - ratio * ratio))
    return mu, sigma


def converged(tiles: DataFrame, rounds: int = 100) -> DataFrame:
    """SKY-4 (converge), SKY-6: sky and deviation of each tile from the lower part of its values.

    Values above the median plus five rough deviations (twice that of the values below the median) go; of the rest
    the part below mean plus deviation is taken for a truncated normal.
    """
    keys = _tile_keys(tiles)
    whole = Window.partitionBy(*keys)
    v = tiles.withColumn("mid", F.percentile("flux", 0.5).over(whole))
    v = v.withColumn("rough", 2 * F.stddev_samp(F.when(F.col("flux") < F.col("mid"), F.col("flux"))).over(whole))
    v = v.where(F.col("flux") < F.col("mid") + 5 * F.col("rough"))
    v = v.withColumns({"mean": F.avg("flux").over(whole), "sd": F.stddev_samp("flux").over(whole)})
    low = v.where(F.col("flux") < F.col("mean") + F.col("sd")).groupBy(*keys, "mean", "sd").agg(F.avg("flux").alias("low_mean"), F.stddev_samp("flux").alias("low_sd"))
    names = ["mean", "sd", "low_mean", "low_sd"]
    schema = ", ".join(f"{k} {low.schema[k].dataType.simpleString()}" for k in keys) + ", sky double, sd_sky double"

    def run(batches):
        for pdf in batches:
            mu, sigma = untruncated(*(pdf[n].to_numpy(float) for n in names), rounds)
            yield pdf[keys].assign(sky=mu, sd_sky=sigma)

    return low.mapInPandas(run, schema)


def blur_sky(pixels: DataFrame, sigma: float) -> DataFrame:
    """SKY-14: blur of the sky pixels; objects have no weight."""
    return filters.blur(pixels.withColumn("flux", F.when(F.coalesce(F.col("objects"), F.lit(0)) == 0, F.col("flux"))), sigma).withColumnRenamed("flux", "sky")


def chisel(pixels: DataFrame, quantile: float = 0.95, sigma: float = 2.0, rounds: int = 5, tolerance: float = 0.01) -> DataFrame:
    """SKY-15: objects by alternating a quantile threshold of the blurred image and a new sky from the rest.

    Stops when the share of changed pixels is below ``tolerance``.  Returns pixels with ``objects``.
    """
    keys = [*keys_of(pixels), "x", "y"]
    smooth = filters.blur(pixels, sigma).withColumnRenamed("flux", "smooth")
    now = pixels.join(smooth, keys).withColumn("objects", F.lit(0)).persist()
    for _ in range(rounds):
        cut = now.where("objects = 0").agg(F.percentile("smooth", quantile).alias("cut"), F.percentile("smooth", 0.5).alias("mid"))
        nxt = now.crossJoin(F.broadcast(cut)).withColumn("new", F.when((F.col("smooth") > F.col("cut")) & (F.col("smooth") - F.col("mid") > 0), 1).otherwise(0))
        changed = nxt.agg(F.avg((F.col("new") != F.col("objects")).cast("double"))).first()[0] or 0.0
        step = nxt.withColumn("objects", F.greatest("new", "objects")).drop("cut", "mid", "new").persist()
        step.count()
        now.unpersist()
        now = step
        if changed < tolerance:
            break
    return now.drop("smooth")


def split_fft(pixels: DataFrame, scale: float = 10.0, seed: int = 0) -> DataFrame:
    """SKY-20, D17: low and high spatial frequencies of each image's sky residual.

    Objects are filled with noise of the sky's deviation; frequencies of a wavelength above ``scale``
    pixels go to ``sky_lo``.  One image is one group: the transform needs the whole image.
    """
    keys = keys_of(pixels)
    schema = "".join(f"{k} string, " for k in keys) + "x int, y int, sky_lo double, sky_hi double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        z = np.full((x.max(), y.max()), np.nan)
        free = ((pdf["objects"] if "objects" in pdf else 0) == 0) & pdf["flux"].notna()
        z[x[free] - 1, y[free] - 1] = pdf["flux"].to_numpy()[free]
        hole = np.isnan(z)
        sd = np.nanstd(z) if (~hole).any() else 0.0
        z[hole] = np.random.default_rng(seed).normal(np.nanmean(z) if (~hole).any() else 0.0, sd, hole.sum())
        f = np.fft.fft2(z)
        fx, fy = np.meshgrid(np.fft.fftfreq(z.shape[0]), np.fft.fftfreq(z.shape[1]), indexing="ij")
        lo = np.fft.ifft2(np.where(np.hypot(fx, fy) <= 1 / scale, f, 0)).real
        out = pd.DataFrame({"x": x, "y": y, "sky_lo": lo[x - 1, y - 1], "sky_hi": (z - lo)[x - 1, y - 1]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return pixels.withColumn("one", F.lit(1)).groupBy(*(keys or ["one"])).applyInPandas(run, schema)
