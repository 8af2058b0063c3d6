"""Coverage of pixels by circles, ellipses and polygons, and photometry through them (APR-*).

A shape is joined with pixels through cells: a pixel has one cell, a shape all cells of its bounding
box, so the range join is an equi-join with a residual test.  Coverage samples 4 ** depth sub-centres of
a pixel, and only pixels that the edge crosses are sampled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import ellipse_radius, sersic_weight
from ..functions.units import flux_to_mag, flux_to_sb
from ..model import keys_of, shared_keys

PI = 3.141593  # fixed value: the constant of the ellipse tests
CELL = 16


def sub_centres(depth: int) -> list[float]:
    n = 2**depth
    return [(i + 0.5) / n - 0.5 for i in range(n)]


def _sampled(inside, depth: int) -> Column:
    """Share of sub-centres for which ``inside(dx, dy)`` holds."""
    at = sub_centres(depth)
    if depth <= 2:
        hits = [inside(F.lit(i), F.lit(j)).cast("int") for i in at for j in at]
        return reduce(lambda a, b: a + b, hits) / len(hits)
    xs = F.array(*map(F.lit, at))
    row = lambda i: F.aggregate(xs, F.lit(0), lambda n, j: n + inside(i, j).cast("int"))
    return F.aggregate(xs, F.lit(0), lambda n, i: n + row(i)) / (len(at) ** 2)


def circle_cover(dx: Column, dy: Column, rad: Column, depth: int) -> Column:
    """APR-1: share of the unit pixel at offset (dx, dy) inside a circle about the origin."""
    d = F.sqrt(dx * dx + dy * dy)
    edge = _sampled(lambda i, j: F.pow(dx + i, 2) + F.pow(dy + j, 2) <= rad * rad, depth)
    return F.when(d >= rad + 0.7071068, 0.0).when(d <= rad - 0.7071068, 1.0).otherwise(edge)


def ellipse_cover(dx: Column, dy: Column, rad: Column, ang: Column, axrat: Column, depth: int) -> Column:
    """APR-3: the same for an ellipse; angle in degrees from the y axis."""
    t = ang * (PI / 180)
    c, s = F.cos(t), F.sin(t)

    def inside(i: Column, j: Column) -> Column:
        u, v = (dx + i) * c + (dy + j) * s, -(dx + i) * s + (dy + j) * c
        return F.pow(u / (rad * axrat), 2) + F.pow(v / rad, 2) <= 1

    d = F.sqrt(dx * dx + dy * dy)
    return F.when(d >= rad + 0.7071068, 0.0).when(d <= rad * axrat - 0.7071068, 1.0).otherwise(_sampled(inside, depth))


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule: the parity of edges crossed to the right."""
    crossed = [
        F.when(F.lit(y0).cast("double") > y, True).otherwise(False).cast("int").bitwiseXOR(F.when(F.lit(y1).cast("double") > y, True).otherwise(False).cast("int")).cast("boolean") & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        for (x0, y0), (x1, y1) in zip(vertices, vertices[-1:] + vertices[:-1], strict=True)
        if y0 != y1
    ]
    return reduce(lambda a, b: a != b, crossed)


def polygon_cover(x: Column, y: Column, vertices: list[tuple[float, float]], depth: int) -> Column:
    """APR-6: share of the pixel with centre (x, y) in a polygon; depth 0 tests the centre."""
    if depth == 0:
        return in_polygon(x, y, vertices).cast("double")
    return _sampled(lambda i, j: in_polygon(x + i, y + j, vertices), depth)


def meet(pixels: DataFrame, apertures: DataFrame, cell: int = CELL) -> DataFrame:
    """JN-7: pixels with the apertures whose box they touch; adds dx, dy from the aperture's centre."""
    reach = F.col("rad") + 1
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / cell), F.floor((F.col(c) + reach) / cell))
    shapes = apertures.where("rad > 0").withColumn("__cx", F.explode(span("cx"))).withColumn("__cy", F.explode(span("cy")))
    dealt = pixels.withColumns({"__cx": F.floor((F.col("x") - 0.5) / cell), "__cy": F.floor((F.col("y") - 0.5) / cell)})
    both = dealt.join(shapes, ["__cx", "__cy", *[k for k in keys_of(pixels) if k in apertures.columns]]).drop("__cx", "__cy")
    both = both.withColumns({"dx": F.col("x") - 0.5 - F.col("cx"), "dy": F.col("y") - 0.5 - F.col("cy")})
    return both.where((F.abs(F.col("dx")) <= F.col("rad") + 1) & (F.abs(F.col("dy")) <= F.col("rad") + 1))


def covered(pixels: DataFrame, apertures: DataFrame, depth: int = 4, shape: str = "circle") -> DataFrame:
    """Pixel and aperture pairs with ``cover`` above zero."""
    both = meet(pixels, apertures)
    a = [F.col(c) for c in ("dx", "dy", "rad")]
    cover = circle_cover(*a, depth) if shape == "circle" else ellipse_cover(*a, F.col("ang"), F.col("axrat"), depth)
    return both.withColumn("cover", cover).where("cover > 0")


def _profile(shape: str) -> Column:
    """Light profile at the pixel: 1 without a half-light radius."""
    r = F.sqrt(F.pow(F.col("dx"), 2) + F.pow(F.col("dy"), 2)) if shape == "circle" else ellipse_radius(F.col("dx"), F.col("dy"), 0.0, 0.0, "ang", "axrat")
    return F.when(F.col("rad_re") > 0, sersic_weight(r, "rad_re", "nser")).otherwise(1.0)


def _weight(shape: str, scalar: bool) -> Column:
    """A single weight is used as it is; one for each aperture counts only with a half-light radius."""
    if scalar:
        return F.col("wt")
    area = F.pow(F.col("rad_re"), 2) * (F.lit(1.0) if shape == "circle" else F.col("axrat"))
    return F.when(F.col("rad_re") > 0, F.col("wt") / area).otherwise(0.0)


def with_defaults(apertures: DataFrame) -> DataFrame:
    """D13: missing columns as scalars: wt 1, rad_re 0, nser 1, ang 0, axrat 1."""
    defaults = {"wt": 1.0, "rad_re": 0.0, "nser": 1.0, "ang": 0.0, "axrat": 1.0}
    return apertures.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in apertures.columns})


def _shape(pixels: DataFrame, apertures: DataFrame, shape: str, *more: str) -> list[str]:
    """The columns on which an aperture's pixels and their cover depend."""
    return [*[k for k in keys_of(pixels) if k in apertures.columns], "cx", "cy", "rad", *(() if shape == "circle" else ("ang", "axrat")), *more]


def weight_map(pixels: DataFrame, apertures: DataFrame, depth: int = 4, shape: str = "circle", scalar: bool = True) -> DataFrame:
    """APR-2, APR-4: sum over apertures of weight times cover times profile, at each covered pixel."""
    keys, ap = [*keys_of(pixels), "x", "y"], with_defaults(apertures)
    same = _shape(pixels, ap, shape, "rad_re", "nser")
    # equal shapes count once, with their weights added up
    ap = ap.groupBy(*same).agg(F.sum("wt").alias("wt"))
    return covered(pixels.select(*keys), ap, depth, shape).groupBy(*keys).agg(F.sum(_weight(shape, scalar) * F.col("cover") * _profile(shape)).alias("weight"))


def aperture_flux(pixels: DataFrame, apertures: DataFrame, depth: int = 4, shape: str = "circle", deblend: bool = False, scalar: bool = True, iterations: int = 1) -> DataFrame:
    """APR-7, APR-8: flux through each aperture; missing pixels are skipped.

    With ``deblend`` a pixel is shared by the apertures over it in proportion to their weight, cover and
    profile; ``iterations`` feeds the fluxes back as weights.  Apertures off the image have 0.
    """
    keys, ap = keys_of(pixels), with_defaults(apertures)
    out = None
    for i in range(max(1, iterations)):
        if i:
            ap = ap.drop("wt").join(out.select("k", F.col("flux").alias("wt")), "k")
            scalar = False
        good = pixels.where("flux is not null").select(*keys, "x", "y", "flux")
        if not deblend:
            # equal shapes are measured once
            same = _shape(pixels, ap, shape)
            found = covered(good, ap.select(*same).distinct(), depth, shape).groupBy(*same).agg(F.sum(F.col("flux") * F.col("cover")).alias("flux"))
            found = found.withColumnsRenamed({c: f"__{c}" for c in same})
            got = ap.join(found, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]).groupBy("k").agg(F.sum("flux").alias("flux"))
        else:
            both = covered(good, ap, depth, shape)
            mine = _weight(shape, scalar) * F.col("cover") * _profile(shape)
            both = both.withColumn("mine", mine)
            both = both.withColumn("all", F.sum("mine").over(Window.partitionBy(*keys, "x", "y")))
            value = F.col("flux") * F.col("cover") * F.coalesce(F.try_divide("mine", "all"), F.lit(0.0))
            got = both.groupBy("k").agg(F.sum(value).alias("flux"))
        out = apertures.select("k").join(got, "k", "left").select("k", F.coalesce("flux", F.lit(0.0)).alias("flux"))
    return out


def polygon_flux(pixels: DataFrame, vertices: list[tuple[float, float]], depth: int = 4) -> DataFrame:
    """APR-9: flux inside a polygon; only its bounding box is read."""
    xs, ys = [x for x, _ in vertices], [y for _, y in vertices]
    box = pixels.where(F.col("x").between(int(min(xs)), int(max(xs)) + 2) & F.col("y").between(int(min(ys)), int(max(ys)) + 2))
    cover = polygon_cover(F.col("x") - 0.5, F.col("y") - 0.5, vertices, depth)
    return box.groupBy(*keys_of(pixels)).agg(F.sum(F.col("flux") * cover).alias("flux"), F.sum(cover).alias("area"))


def polygon_mask(pixels: DataFrame, vertices: list[tuple[float, float]], invert: bool = False) -> DataFrame:
    """MSK-2, SEG-20: mask 1 at pixels whose centre is in the polygon (or outside it)."""
    inside = in_polygon(F.col("x") - 0.5, F.col("y") - 0.5, vertices)
    hit = ~inside if invert else inside
    had = F.coalesce(F.col("mask"), F.lit(0)) if "mask" in pixels.columns else F.lit(0)
    return pixels.withColumn("mask", F.when(hit, 1).otherwise(had))


def paint_ellipses(pixels: DataFrame, ellipses: DataFrame) -> DataFrame:
    """SEG-21: labels of ellipses whose inside holds the pixel's centre, added up where they overlap."""
    keys = [*keys_of(pixels), "x", "y"]
    hit = covered(pixels.select(*keys), with_defaults(ellipses), 0, "ellipse").groupBy(*keys).agg(F.sum("k").cast("int").alias("segID"))
    return pixels.drop("segID").join(hit, keys, "left").withColumn("segID", F.coalesce("segID", F.lit(0)))


def segment_photometry(pixels: DataFrame, centres: DataFrame, diameters: list[float], depth: int = 4, magzero: float = 0.0, pixscale: float = 1.0, correct: bool = True) -> DataFrame:
    """APR-10, APR-11: photometry of sources in circular apertures, own segment's pixels only.

    ``centres`` has segID, xcen, ycen; diameters are in arc seconds.  For aperture k: flux, magnitude, surface
    brightness, pixels (cover summed), the share of the aperture's area that was found, and the mean
    flux of edge pixels (weights 1 - 2 |cover - 1/2|), which with ``correct`` fills in or takes off
    the difference between found and full area.
    """
    own = pixels.where("segID > 0 and flux is not null") if "mask" not in pixels.columns else pixels.where("segID > 0 and flux is not null and mask = 0")
    ids = shared_keys(pixels, centres)
    both = own.join(centres.select(*ids, "segID", "xcen", "ycen"), [*ids, "segID"])
    dx, dy = F.col("x") - 0.5 - F.col("xcen"), F.col("y") - 0.5 - F.col("ycen")
    out = centres.select(*ids, "segID", "xcen", "ycen")
    aggs = []
    for k, d in enumerate(diameters, 1):
        r = d / 2 / pixscale
        both = both.withColumn(f"c{k}", circle_cover(dx, dy, F.lit(r), depth))
        w = 1 - 2 * F.abs(F.col(f"c{k}") - 0.5)
        aggs += [F.sum(F.col("flux") * F.col(f"c{k}")).alias(f"f{k}"), F.sum(f"c{k}").alias(f"n{k}"), F.try_divide(F.sum(F.col("flux") * w), F.sum(w)).alias(f"m{k}")]
    got = out.join(both.groupBy(*ids, "segID").agg(*aggs), [*ids, "segID"], "left")
    cols = []
    for k, d in enumerate(diameters, 1):
        full = 3.141592653589793 * (d / 2 / pixscale) ** 2
        flux = F.col(f"f{k}") - (F.col(f"n{k}") - full) * F.coalesce(f"m{k}", F.lit(0.0)) if correct else F.col(f"f{k}")
        cols += [flux.alias(f"flux_app_{k}"), flux_to_mag(flux, magzero).alias(f"mag_app_{k}"), flux_to_sb(flux / full, magzero, pixscale).alias(f"SB_app_{k}"), F.col(f"n{k}").alias(f"N_app_{k}"), (F.col(f"n{k}") / full).alias(f"frac_app_{k}"), F.col(f"m{k}").alias(f"flux_min_{k}")]
    return got.select(*ids, "segID", "xcen", "ycen", *cols)


def random_apertures(pixels: DataFrame, diameter: float, n: int, seed: int = 1, depth: int = 3) -> DataFrame:
    """APR-12, TOP-2: half the 16 to 84 percent range of fluxes of ``n`` apertures on the sky.

    Centres are the sky pixels of the smallest hashes with the seed, so a run can be repeated;
    apertures that are not whole (masked, at an edge, on a source) do not count.
    """
    sky = pixels.where("segID = 0 and flux is not null")
    spots = sky.orderBy(F.xxhash64("x", "y", F.lit(seed)), "y", "x").limit(n)
    ap = spots.select(F.expr("cast(y as bigint) * 4294967296 + x").alias("k"), (F.col("x") - 0.5).alias("cx"), (F.col("y") - 0.5).alias("cy"), F.lit(diameter / 2).alias("rad"))
    got = covered(sky.select("x", "y", "flux"), ap, depth).groupBy("k").agg(F.sum(F.col("flux") * F.col("cover")).alias("flux"), F.sum("cover").alias("n"))
    full = 3.141592653589793 * (diameter / 2) ** 2
    return got.where(F.col("n") > 0.98 * full).agg(F.count(F.lit(1)).alias("N"), ((F.percentile("flux", 0.84) - F.percentile("flux", 0.16)) / 2).alias("err"))


def moment_ellipse(pixels: DataFrame, scale: float = 2**0.5, pixscale: float = 1.0) -> DataFrame:
    """APR-13: an ellipse for each segID from flux-weighted moments; ``radav`` is the mean radius.

    Semi-axes are ``scale`` times the root of the covariance's eigenvalues.
    """
    from ..functions.geometry import cov_angle, cov_eigenvalues
    from .stats import by_segment, moments, usable

    keys = by_segment(pixels)
    mom = moments(pixels)
    w = F.greatest("flux", F.lit(0.0))
    far = F.sqrt(F.pow(F.col("x") - 0.5 - F.col("xcen"), 2) + F.pow(F.col("y") - 0.5 - F.col("ycen"), 2))
    mean = usable(pixels).join(mom.select(*keys, "xcen", "ycen"), keys).groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(w * far), F.sum(w)), F.avg(far)).alias("radav"))
    hi, lo = (F.sqrt(F.abs(v)) for v in cov_eigenvalues("xsd", "ysd", "covxy"))
    return mom.join(mean, keys).select(
        *keys, "xcen", "ycen", (hi * scale * pixscale).alias("radhi"), (lo * scale * pixscale).alias("radlo"), (F.col("radav") * pixscale).alias("radav"), F.try_divide(lo, hi).alias("axrat"), cov_angle("xsd", "ysd", "covxy").alias("ang"), F.lit(0.0).alias("box"), "xsd", "ysd", "covxy", F.try_divide("covxy", F.col("xsd") * F.col("ysd")).alias("corxy")
    )


def simplex(f, start: np.ndarray, step: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nelder and Mead's minimiser inside bounds, for many problems side by side: a row of each array is one of them.

    ``f(rows, p)`` gives the costs of the problems ``rows`` at the points ``p``.  Each row takes the steps it would take alone.
    """
    n = start.shape[1]
    inside = lambda rows, p: np.minimum(np.maximum(p, lower[rows]), upper[rows])
    live = np.arange(len(start))
    pts = np.stack([inside(live, start), *(inside(live, start + np.eye(n)[i] * step) for i in range(n))], axis=1)
    val = np.stack([f(live, pts[:, i]) for i in range(n + 1)], axis=1)
    for _ in range(rounds):
        order = np.argsort(val[live], axis=1)
        pts[live], val[live] = np.take_along_axis(pts[live], order[:, :, None], axis=1), np.take_along_axis(val[live], order, axis=1)
        live = live[~(val[live, -1] - val[live, 0] < 1e-12)]
        if not len(live):
            break
        mid = pts[live, :-1].mean(axis=1)
        towards = pts[live, -1] - mid

        def try_at(t: np.ndarray, at: np.ndarray, mid=mid, towards=towards, live=live) -> tuple[np.ndarray, np.ndarray]:
            q = inside(live[at], mid[at] + t * towards[at])
            return q, f(live[at], q)

        p, v = try_at(-1.0, np.arange(len(live)))
        low, high = v < val[live, 0], v >= val[live, -2]
        if len(far := np.flatnonzero(low)):
            q, u = try_at(-2.0, far)
            better = u < v[far]
            p[far[better]], v[far[better]] = q[better], u[better]
        keep = np.ones(len(live), bool)
        if len(near := np.flatnonzero(high & ~low)):
            p[near], v[near] = try_at(np.where(v[near] < val[live[near], -1], -0.5, 0.5)[:, None], near)
            shrink = near[v[near] >= val[live[near], -1]]
            keep[shrink] = False
            for i in range(1, n + 1 if len(shrink) else 1):
                rows = live[shrink]
                pts[rows, i] = inside(rows, (pts[rows, 0] + pts[rows, i]) / 2)
                val[rows, i] = f(rows, pts[rows, i])
        pts[live[keep], -1], val[live[keep], -1] = p[keep], v[keep]
    return pts[np.arange(len(pts)), np.argmin(val, axis=1)]


def superellipse(pixels: DataFrame, ellipses: DataFrame, pixscale: float = 1.0, batch: int = 2048) -> DataFrame:
    """APR-13 with ``dobox``: radius, angle, axial ratio and box by least variance of the scaled radius about one.

    A fit that ends on a bound is dropped for the moment ellipse.  Segments are fitted side by side: up to ``batch`` neighbouring
    labels are one call, and those with equal numbers of pixels one array.
    """
    both = pixels.where("segID > 0 and flux is not null").select("segID", "x", "y", "flux").join(ellipses.select("segID", "xcen", "ycen", "radhi", "radlo", "axrat", "ang"), "segID")

    def fit(pdf: pd.DataFrame, m: int) -> pd.DataFrame:
        e = pdf.iloc[::m]
        at = lambda c: pdf[c].to_numpy(float).reshape(-1, m)
        dx, dy, w = at("x") - 0.5 - at("xcen"), at("y") - 0.5 - at("ycen"), np.maximum(at("flux"), 0)
        out = e[["segID", "xcen", "ycen", "radhi", "radlo", "axrat", "ang"]].assign(radhi=e["radhi"] * pixscale, radlo=e["radlo"] * pixscale, box=0.0).reset_index(drop=True)
        radhi, axrat, ang = (e[c].to_numpy(float) for c in ("radhi", "axrat", "ang"))
        use = np.flatnonzero((w.sum(axis=1) > 0) & (radhi > 0) & (axrat > 0) & np.isfinite(ang))
        if not len(use):
            return out
        dx, dy, w, radhi, axrat, ang = dx[use], dy[use], w[use], radhi[use], axrat[use], ang[use]

        def cost(rows: np.ndarray, p: np.ndarray) -> np.ndarray:
            t, q, k = np.radians(p[:, 1:2]), 10 ** p[:, 2:3], 2 + p[:, 3:4]
            c, s = np.cos(t), np.sin(t)
            u, v = np.abs(dx[rows] * c + dy[rows] * s) / q, np.abs(-dx[rows] * s + dy[rows] * c)
            r = (u**k + v**k) ** (1 / k) / p[:, 0:1]
            return (w[rows] * (r - 1) ** 2).sum(axis=1) / w[rows].sum(axis=1)

        flat = np.ones(len(use))
        start = np.column_stack([radhi, ang, np.maximum(np.log10(axrat), -1.9), 0 * flat])
        lower, upper = np.column_stack([radhi / 10, 0 * flat, -2 * flat, -flat]), np.column_stack([radhi * 10, 180 * flat, 0 * flat, flat])
        best = simplex(cost, start, np.column_stack([radhi / 5, 10 * flat, -0.1 * flat, 0.2 * flat]), lower, upper)
        good = ((best > lower) & (best < upper)).all(axis=1)
        p = best[good]
        out.loc[use[good], ["radhi", "radlo", "axrat", "ang", "box"]] = np.column_stack([p[:, 0] * pixscale, p[:, 0] * 10 ** p[:, 2] * pixscale, 10 ** p[:, 2], p[:, 1], p[:, 3]])
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["segID", "x", "y"])
        size = pdf.groupby("segID")["segID"].transform("size")
        return pd.concat([fit(part, int(m)) for m, part in pdf.groupby(size.to_numpy())])

    schema = "segID long, xcen double, ycen double, radhi double, radlo double, axrat double, ang double, box double"
    return both.withColumn("__batch", F.floor(F.col("segID") / batch)).groupBy("__batch").applyInPandas(run, schema)


def isophotes(pixels: DataFrame, levels: list[float], magzero: float = 0.0, pixscale: float = 1.0) -> DataFrame:
    """APR-14, WIN-2: the moment ellipse of the pixels strictly between each two levels of enclosed flux."""
    keys = keys_of(pixels)
    good = pixels.where("segID > 0 and flux is not null")
    order = Window.partitionBy(*keys, "segID").orderBy(F.desc("flux"), "y", "x")
    run = good.withColumn("frac", F.try_divide(F.sum("flux").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("flux").over(Window.partitionBy(*keys, "segID"))))
    bins = F.coalesce(*(F.when((F.col("frac") > a) & (F.col("frac") < b), i) for i, (a, b) in enumerate(zip(levels, levels[1:], strict=False))))
    run = run.withColumn("bin", bins).where("bin is not null").withColumn("segID", F.col("segID") * len(levels) + F.col("bin"))
    cat = moment_ellipse(run, pixscale=pixscale)
    sums = run.groupBy(*keys, "segID").agg(F.sum("flux").alias("flux"), F.count(F.lit(1)).alias("N"), F.max("frac").alias("fluxfrac"))
    out = cat.join(sums, [*keys, "segID"])
    return out.select(
        *keys, F.floor(F.col("segID") / len(levels)).alias("segID"), (F.col("segID") % len(levels)).alias("segellipseID"), "fluxfrac", "xcen", "ycen", "radhi", "radlo", "radav", "axrat", "ang", "box", "xsd", "ysd", "covxy", "corxy", "flux", "N", flux_to_sb(F.col("flux") / F.col("N"), magzero, pixscale).alias("SB")
    )


def outline(ellipses: DataFrame, vertices: int = 100) -> DataFrame:
    """SNK-5: points of the (super)ellipses xcen, ycen, rad, axrat, ang, box."""
    t = F.radians(F.col("i") * (360.0 / vertices))
    p = 2 / (2 + F.col("box"))
    u, v = F.signum(F.sin(t)) * F.pow(F.abs(F.sin(t)), p) * F.col("rad") * F.col("axrat"), F.signum(F.cos(t)) * F.pow(F.abs(F.cos(t)), p) * F.col("rad")
    a = F.radians("ang")
    return ellipses.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(vertices - 1)))).withColumns({"px": F.col("xcen") + u * F.cos(a) - v * F.sin(a), "py": F.col("ycen") + u * F.sin(a) + v * F.cos(a)})

