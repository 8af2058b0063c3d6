"""Per-segment statistics: grouped and windowed aggregates over the pixel relation (AGG-*).

Input relations have x, y, flux, segID and optionally image_id, band, mask, sky, skyRMS.  Pixels with
``segID > 0`` count; masked and NULL pixels are left out of sums.  All windows and argmaxima
break ties by (flux, y, x), so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log10

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cov_angle, cov_eigenvalues, tan_pixel_to_sky
from ..functions.special import normal_quantile, significance
from ..functions.units import flux_to_mag, flux_to_sb
from ..model import keys_of

SOFTENING = 0.08333333  # fixed value: variance of a unit pixel


def usable(pixels: DataFrame) -> DataFrame:
    """Segment pixels; flux NULL where masked."""
    out = pixels.where("segID > 0")
    return out.withColumn("flux", F.when(F.col("mask") == 0, F.col("flux"))) if "mask" in pixels.columns else out


def by_segment(pixels: DataFrame) -> list[str]:
    return [*keys_of(pixels), "segID"]


def segment_flux(pixels: DataFrame) -> DataFrame:
    """AGG-1, AGG-12: flux and number of the pixels that count; (0, 0) if none does."""
    return usable(pixels).groupBy(*by_segment(pixels)).agg(F.coalesce(F.sum("flux"), F.lit(0.0)).alias("flux"), F.count("flux").alias("N100"))


def segment_flux_dense(pixels: DataFrame) -> DataFrame:
    """AGG-2: a row for every label from 1 to the largest, 0 where it is missing (one image)."""
    most = pixels.agg(F.max("segID").alias("most")).where("most > 0")
    labels = most.select(F.explode(F.sequence(F.lit(1), "most")).alias("segID"))
    return labels.join(segment_flux(pixels).select("segID", "flux"), "segID", "left").select("segID", F.coalesce("flux", F.lit(0.0)).alias("flux"))


def flux_profile(pixels: DataFrame) -> DataFrame:
    """AGG-3: flux, N50, N90, N100 and cenfrac from the running sum in order of flux.

    The rules of the edges: N100 is the number of pixels; for a positive sum N50 and N90 are interpolated at
    0.5 and 0.1 of the running fraction from the faint end (NULL if the first pixel is past it);
    zero flux gives N50 = N90 = N100, a negative one NULL; without any pixel that counts flux is
    NULL, N50 half and N90 nine tenths of all pixels.
    """
    keys = by_segment(pixels)
    good = usable(pixels)
    order = Window.partitionBy(*keys).orderBy("flux", "y", "x")
    run = good.where("flux is not null").select(
        *keys, "flux", F.row_number().over(order).alias("rn"), F.sum("flux").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("flux").over(Window.partitionBy(*keys)).alias("tot")
    )
    run = run.withColumn("c", F.try_divide("cum", "tot")).withColumn("prev", F.lag("c").over(Window.partitionBy(*keys).orderBy("rn")))
    first = lambda level: F.min(F.when((F.col("tot") > 0) & (F.col("c") >= level), F.struct("rn", "c", "prev")))
    counted = run.groupBy(*keys).agg(F.sum("flux").alias("flux"), F.count("flux").alias("n"), first(0.5).alias("h"), first(0.1).alias("t"), F.max(F.struct("rn", "c", "prev")).alias("e"))
    every = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("all"))

    def at(s: str, level: float) -> Column:
        part = F.col("n") - (F.col(f"{s}.rn") - 1) + F.try_divide(level - F.col(f"{s}.prev"), F.col(f"{s}.c") - F.col(f"{s}.prev"))
        return F.when(F.col("flux") > 0, part).when(F.col("flux") == 0, F.col("all").cast("double"))

    n = lambda share: F.when(F.col("flux").isNull(), F.col("all") * share)
    return every.join(counted, keys, "left").select(
        *keys,
        "flux",
        F.coalesce(n(0.5), at("h", 0.5)).alias("N50"),
        F.coalesce(n(0.9), at("t", 0.1)).alias("N90"),
        F.when(F.col("flux") > 0, F.col("n")).otherwise(F.col("all")).alias("N100"),
        F.when(F.col("flux") > 0, F.col("e.c") - F.col("e.prev")).alias("cenfrac"),
    )


def moments(pixels: DataFrame) -> DataFrame:
    """AGG-4/5/6: flux-weighted centre and population moments; negative weights count as 0.

    Weights that are all equal become 1; a segment without any flux has the plain mean.  The
    moments come from sums of one aggregation, about the segment's first-seen corner, so that large
    coordinates do not cancel.
    """
    keys = by_segment(pixels)
    w = F.greatest(F.when(F.col("same"), F.lit(1.0)).otherwise(F.col("flux")), F.lit(0.0))
    good = usable(pixels)
    span = good.groupBy(*keys).agg((F.min("flux") == F.max("flux")).alias("same"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.avg(F.col("x") - 0.5).alias("xavg"), F.avg(F.col("y") - 0.5).alias("yavg"))
    rows = good.join(span, keys).withColumn("w", w).withColumn("dx", (F.col("x") - F.col("x0")).cast("double")).withColumn("dy", (F.col("y") - F.col("y0")).cast("double"))
    s = rows.groupBy(*keys, "x0", "y0", "xavg", "yavg").agg(
        F.sum("w").alias("s"), *(F.sum(F.expr(f"w * {e}")).alias(n) for n, e in (("sx", "dx"), ("sy", "dy"), ("sxx", "dx * dx"), ("syy", "dy * dy"), ("sxy", "dx * dy")))
    )
    mx, my = F.try_divide("sx", "s"), F.try_divide("sy", "s")
    s = s.select(*keys, "x0", "y0", "xavg", "yavg", mx.alias("mx"), my.alias("my"), *(F.try_divide(c, "s").alias(c) for c in ("sxx", "syy", "sxy")))
    sd = lambda c, m: F.sqrt(F.greatest(F.col(c) - F.col(m) * F.col(m), F.lit(0.0)))
    return s.select(
        *keys,
        F.coalesce(F.col("x0") - 0.5 + F.col("mx"), "xavg").alias("xcen"),
        F.coalesce(F.col("y0") - 0.5 + F.col("my"), "yavg").alias("ycen"),
        sd("sxx", "mx").alias("xsd"),
        sd("syy", "my").alias("ysd"),
        (F.col("sxy") - F.col("mx") * F.col("my")).alias("covxy"),
    )


def shape(mom: DataFrame) -> DataFrame:
    """Adds corxy, semimaj, semimin, axrat and ang to moments (SCL-16)."""
    hi, lo = cov_eigenvalues("xsd", "ysd", "covxy")
    axis = lambda v: F.sqrt(F.abs(v) + SOFTENING)
    return mom.withColumns({"corxy": F.try_divide("covxy", F.col("xsd") * F.col("ysd")), "semimaj": axis(hi), "semimin": axis(lo), "axrat": axis(lo) / axis(hi), "ang": cov_angle("xsd", "ysd", "covxy")})


def brightest(pixels: DataFrame) -> DataFrame:
    """AGG-7, TOP-1: place of the brightest pixel; of equals the one of least (y, x)."""
    top = F.max(F.struct("flux", (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    return usable(pixels).where("flux is not null").groupBy(*by_segment(pixels)).agg(top.alias("t")).select(*by_segment(pixels), (-F.col("t.x") - 0.5).alias("xmax"), (-F.col("t.y") - 0.5).alias("ymax"))


def rotated(pixels: DataFrame, centres: DataFrame) -> DataFrame:
    """AGG-8, AGG-9, JN-1: 180 degree asymmetry and reflected flux.

    A pixel meets its image through the rounded centre by an equi-join; half pixels round to
    even as in IEEE arithmetic.
    """
    keys = by_segment(pixels)
    rel = usable(pixels).where("flux is not null").join(centres.select(*keys, "xcen", "ycen"), keys).select(
        *keys, F.bround(F.col("x") - 0.5 - F.col("xcen")).cast("int").alias("rx"), F.bround(F.col("y") - 0.5 - F.col("ycen")).cast("int").alias("ry"), F.col("flux").alias("w1")
    )
    image = rel.select(*keys, (-F.col("rx")).alias("rx"), (-F.col("ry")).alias("ry"), F.col("w1").alias("w2"))
    both = rel.join(image, [*keys, "rx", "ry"], "left")
    pair = F.expr("w1 > 0 and w2 > 0")
    return both.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(pair, F.abs(F.col("w1") - F.col("w2")))), F.sum(F.when(pair, F.abs(F.col("w1") + F.col("w2"))))).alias("asymm"),
        F.sum(F.when(F.col("w2").isNull(), 2 * F.col("w1")).otherwise(F.col("w1"))).alias("flux_reflect"),
    )


def neighbours(segmap: DataFrame, offset: int = 1) -> DataFrame:
    """JN-5: each pixel with the labels of its four neighbours (NULL outside, 0 sky).

    The map must hold every pixel of the image, sky included.  Neighbours along x and y come from two
    windows over rows and columns; one shuffle each, no join.
    """
    keys = keys_of(segmap)
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    near = lambda c, by, w: F.when(F.lag(c, offset).over(w) == F.col(c) - offset, F.lag(by, offset).over(w))
    far = lambda c, by, w: F.when(F.lead(c, offset).over(w) == F.col(c) + offset, F.lead(by, offset).over(w))
    return segmap.withColumns({"left": near("x", "segID", row), "right": far("x", "segID", row)}).withColumns({"down": near("y", "segID", column), "up": far("y", "segID", column)})


def boundary(segmap: DataFrame, nx: int, ny: int, offset: int = 1) -> DataFrame:
    """AGG-11: Nedge, Nsky, Nobject, Nborder, Nmask, edge_frac and flag_border for each segment."""
    keys = by_segment(segmap)
    n = neighbours(segmap, offset)
    inner = F.expr(f"x > {offset} and x <= {nx - offset} and y > {offset} and y <= {ny - offset}")
    same = F.expr("left = segID and right = segID and up = segID and down = segID")
    sky = F.expr("left = 0 or right = 0 or up = 0 or down = 0")
    edge = inner & ~same
    if "mask" in segmap.columns:
        m = neighbours(segmap.select(*keys_of(segmap), "x", "y", F.col("mask").alias("segID")), 1)
        touch = F.expr("left = 1 or right = 1 or up = 1 or down = 1")
        n = n.join(m.select(*keys_of(segmap), "x", "y", F.coalesce(touch, F.lit(False)).alias("by_mask")), [*keys_of(segmap), "x", "y"])
    else:
        n = n.withColumn("by_mask", F.lit(False))
    sides = {"bottom": "y = 1", "left_": "x = 1", "top": f"y = {ny}", "right_": f"x = {nx}"}
    counts = n.where("segID > 0").groupBy(*keys).agg(
        F.count_if(edge).alias("inner_edge"), F.count_if(inner & sky).alias("Nsky"), F.count_if(edge & F.col("by_mask")).alias("Nmask"), *(F.count_if(F.expr(e)).alias(k) for k, e in sides.items())
    )
    border = F.expr(" + ".join(sides))
    flag = F.expr("1 * cast(bottom > 0 as int) + 2 * cast(left_ > 0 as int) + 4 * cast(top > 0 as int) + 8 * cast(right_ > 0 as int)")
    return counts.select(
        *keys, (F.col("inner_edge") + border).alias("Nedge"), "Nsky", (F.col("inner_edge") - F.col("Nsky")).alias("Nobject"), border.alias("Nborder"), "Nmask", F.try_divide("Nsky", F.col("inner_edge") + border).alias("edge_frac"), flag.alias("flag_border")
    )


def edge_excess(r100_pix: Column, axrat: Column, nedge: Column) -> Column:
    """Edge pixels over the perimeter of the segment's ellipse (Ramanujan's approximation)."""
    a, b = r100_pix, r100_pix * axrat
    h = F.pow(a - b, 2) / F.pow(a + b, 2)
    return nedge / (F.pi() * (a + b) * (1 + 3 * h / (10 + F.sqrt(4 - 3 * h))))


def mask_cover(segmap: DataFrame) -> DataFrame:
    """AGG-16: pixels of each label (sky too), those with mask <= 0 under the name mask_N, and their share."""
    got = segmap.groupBy(*by_segment(segmap)).agg(F.count(F.lit(1)).alias("orig_N"), F.count_if(F.col("mask") <= 0).alias("mask_N"))
    return got.withColumn("frac", F.col("mask_N") / F.col("orig_N"))


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-14: the most frequent value of each key, of equals the least."""
    ids = keys_of(rows)
    counts = rows.groupBy(*ids, key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*ids, key).agg(F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("m")).select(*ids, key, (-F.col("m.v")).alias(value))


def keep_large(segmap: DataFrame, pixcut: int) -> DataFrame:
    """AGG-13: labels with fewer than ``pixcut`` pixels are removed."""
    keys = by_segment(segmap)
    small = segmap.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < pixcut)
    return segmap.join(small.select(*keys), keys, "left_anti")


def quantiles(pixels: DataFrame, probabilities: list[float], keys: list[str], column: str = "flux") -> DataFrame:
    """AGG-17, AGG-22: exact quantiles by linear interpolation, and missing values, for each key."""
    return pixels.groupBy(*keys).agg(F.percentile(column, F.array(*map(F.lit, probabilities))).alias("q"), F.count_if(F.col(column).isNull()).alias("missing"))


def histogram_quantile(pixels: DataFrame, q: float, keys: list[str], column: str = "flux", bins: int = 16384) -> DataFrame:
    """AGG-18: lower edge of the histogram bin reached by the int(N q)-th value."""
    span = pixels.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor(F.try_divide(F.col(column) - F.col("lo"), width)), F.lit(bins - 1))
    joined = pixels.where(F.col(column).isNotNull()).join(span, keys) if keys else pixels.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span))
    hist = joined.groupBy(*keys, "lo", "hi", "n", F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    run = hist.withColumn("cum", F.sum("c").over(Window.partitionBy(*keys).orderBy("bin")))
    return run.where(F.col("cum") > F.floor(F.col("n") * q)).groupBy(*keys).agg(F.min(F.col("lo") + F.col("bin") * width).alias("value"))


def mean_var_mode(pixels: DataFrame, keys: list[str], column: str = "flux", bins: int = 100) -> DataFrame:
    """AGG-19: mean, population variance and the middle of the fullest of ``bins`` bins."""
    good = pixels.where(F.col(column).isNotNull())
    s = good.groupBy(*keys).agg(F.avg(column).alias("mean"), F.var_pop(column).alias("var"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.coalesce(F.least(F.floor(F.try_divide(F.col(column) - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0))
    full = good.join(s, keys).groupBy(*keys, "mean", "var", "lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    best = full.groupBy(*keys, "mean", "var", "lo", "hi").agg(F.max(F.struct("c", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select(*keys, "mean", "var", (F.col("lo") + (0.5 - F.col("m.b")) * width).alias("mode"))


def sky_diagnostics(pixels: DataFrame) -> DataFrame:
    """AGG-20: over sky pixels: reduced chi-square below the sky, means, deviations, correlation."""
    z = (F.col("flux") - F.col("sky")) / F.col("skyRMS")
    below = (F.col("segID") == 0) & (F.col("flux") < F.col("sky"))
    return pixels.agg(
        F.avg(F.when(below, z * z)).alias("sky_chisq"), F.sum(F.when(below, -0.5 * z * z)).alias("sky_loglik"), F.avg("sky").alias("sky_mean"), F.stddev_samp("sky").alias("sky_sd"), F.avg("skyRMS").alias("rms_mean"), F.corr("sky", "skyRMS").alias("sky_rms_cor")
    )


def magnitude_histogram(catalogue: DataFrame, width: float = 0.5) -> DataFrame:
    """AGG-20: counts of magnitudes in bins."""
    return catalogue.where("mag is not null").groupBy((F.floor(F.col("mag") / width) * width).alias("mag_bin")).agg(F.count(F.lit(1)).alias("n"))


def segment_stats(
    pixels: DataFrame,
    nx: int,
    ny: int,
    magzero: float = 0.0,
    gain: float | None = None,
    pixscale: float = 1.0,
    rotstats: bool = False,
    boundstats: bool = False,
    cor_err: dict[float, float] | Callable[[Column], Column] | None = None,
    sortcol: str | None = None,
    decreasing: bool = False,
    app_diam: float | None = None,
    header: dict[str, float] | None = None,
) -> DataFrame:
    """AGG-10: the catalogue of segments; columns that were not asked for are NULL.

    ``pixels`` holds x, y, flux (sky subtracted), segID, and optionally mask, sky, skyRMS; sky pixels are
    needed for ``boundstats``.  ``cor_err`` maps pixel counts to the share of correlated error and is
    interpolated linearly (UDF-2), or is a function from the column of counts to a column (UDF-1): an
    expression or a pandas UDF.  ``app_diam`` (arc seconds) gives ``flux_app``: the circle about the centre over
    the segment's own pixels, corrected to the circle's full area by the mean flux at its edge.  ``header`` (the
    values of an image's header) gives sky coordinates.
    """
    keys = by_segment(pixels)
    has = set(pixels.columns)
    good = usable(pixels)
    null = F.lit(None).cast("double")
    sums = good.groupBy(*keys).agg(
        (F.stddev_samp("sky") if "sky" in has else null).alias("sd_sky"),
        (F.avg("sky") if "sky" in has else null).alias("sky_mean"),
        (F.sum("sky") if "sky" in has else null).alias("sky_sum"),
        (F.sqrt(F.sum(F.col("skyRMS") * F.col("skyRMS"))) if "skyRMS" in has else null).alias("flux_err_skyRMS"),
        (F.avg("skyRMS") if "skyRMS" in has else null).alias("skyRMS_mean"),
        (F.sum(F.pow(F.try_divide("flux", "skyRMS"), 2)) if "skyRMS" in has else null).alias("chi2"),
    )
    mom = shape(moments(pixels))
    cat = flux_profile(pixels).join(mom, keys).join(brightest(pixels), keys, "left").join(sums, keys)
    radius = lambda n: F.sqrt(F.try_divide(F.col(n), F.col("axrat") * F.pi())) * pixscale
    mag = lambda f: flux_to_mag(f, magzero)
    cat = cat.withColumns({
        "mag": mag("flux"),
        "uniqueID": F.ceil("xmax") * 10.0 ** ceil(log10(ny + 1)) + F.ceil("ymax"),
        "sep": F.sqrt(F.pow(F.col("xcen") - F.col("xmax"), 2) + F.pow(F.col("ycen") - F.col("ymax"), 2)) * pixscale,
        "R50": radius("N50"),
        "R90": radius("N90"),
        "R100": radius("N100"),
        "flux_err_sky": F.col("sd_sky") * F.col("N100"),
        "flux_err_shot": F.when(F.col("flux") >= 0, F.sqrt("flux") / gain) if gain else F.lit(0.0),
        "cor_seg": F.lit(0.0) if not cor_err else cor_err(F.col("N100")) if callable(cor_err) else interpolate_knots(F.col("N100"), cor_err),
        "signif": significance("chi2", F.col("N100").cast("double")) if "skyRMS" in has else null,
        "FPlim": normal_quantile(1 - F.col("N100") / (nx * ny)),
    })
    e = F.col("flux_err_sky")
    cat = cat.withColumns({
        "con": F.try_divide("R50", "R90"),
        **{f"SB_N{p}": flux_to_sb(F.try_divide(F.col("flux") * (p / 100), f"N{p}"), magzero, pixscale) for p in (50, 90, 100)},
        "flux_err_cor": F.sqrt(F.try_divide(e * e, 1 - F.col("cor_seg")) - e * e),
    })
    parts = ("flux_err_sky", "flux_err_skyRMS", "flux_err_shot", "flux_err_cor")
    finite = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | F.col(c).isNull(), 0.0).otherwise(F.col(c))
    cat = cat.withColumn("flux_err", F.sqrt(sum((F.pow(finite(c), 2) for c in parts), F.lit(0.0))))
    cat = cat.withColumn("mag_err", 1.0857362047581296 * F.abs(F.try_divide("flux_err", "flux")))
    if rotstats:
        cat = cat.join(rotated(pixels, mom), keys, "left").withColumn("mag_reflect", mag("flux_reflect"))
    else:
        cat = cat.withColumns({c: null for c in ("asymm", "flux_reflect", "mag_reflect")})
    bounds = ("Nedge", "Nsky", "Nobject", "Nborder", "Nmask", "edge_frac", "flag_border")
    if boundstats:
        cat = cat.join(boundary(pixels, nx, ny), keys, "left").withColumn("edge_excess", edge_excess(F.col("R100") / pixscale, F.col("axrat"), F.col("Nedge")))
    else:
        cat = cat.withColumns({c: null for c in (*bounds, "edge_excess")})
    if header:
        values = F.create_map(*(F.lit(v) for k, x in header.items() for v in (k, str(x))))
        cat = cat.withColumn("keyvalues", values)
        for end in ("cen", "max"):  # the header counts from the middle of the first pixel as 1
            ra, dec = tan_pixel_to_sky(F.col(f"x{end}") + 0.5, F.col(f"y{end}") + 0.5)
            cat = cat.withColumns({f"RA{end}": ra, f"Dec{end}": dec})
    else:
        cat = cat.withColumns({c: null for c in ("RAcen", "Deccen", "RAmax", "Decmax")})
    if app_diam:
        from .apertures import segment_photometry

        app = segment_photometry(pixels, mom, [app_diam], magzero=magzero, pixscale=pixscale).select(*keys, F.col("flux_app_1").alias("flux_app"), F.col("mag_app_1").alias("mag_app"))
        cat = cat.join(app, keys, "left")
    else:
        cat = cat.withColumns({"flux_app": null, "mag_app": null})
    out = cat.select(*keys_of(pixels), *SEGSTATS)
    if sortcol:
        out = out.orderBy(F.desc(sortcol) if decreasing else F.asc(sortcol), "segID")
    return out


def interpolate_knots(n: Column, knots: dict[float, float]) -> Column:
    """D16: linear interpolation in a small table of knots, constant beyond its ends."""
    points = sorted(knots.items())
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(n <= x1, y0 + (n - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(n <= points[0][0], F.lit(points[0][1])).otherwise(out)


#: Columns of the catalogue of segments, in order.
SEGSTATS = (
    "segID uniqueID xcen ycen xmax ymax RAcen Deccen RAmax Decmax sep flux mag flux_app mag_app cenfrac N50 N90 N100 R50 R90 R100 SB_N50 SB_N90 SB_N100 "
    "xsd ysd covxy corxy con asymm flux_reflect mag_reflect semimaj semimin axrat ang signif FPlim flux_err mag_err flux_err_sky flux_err_skyRMS flux_err_shot "
    "flux_err_cor cor_seg sky_mean sky_sum skyRMS_mean Nedge Nsky Nobject Nborder Nmask edge_frac edge_excess flag_border"
).split()
