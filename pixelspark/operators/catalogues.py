"""Catalogue operators: stacking, bands side by side, group rows, shared flux (CAT-*, DBL-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import flux_to_mag
from ..model import shared_keys


def stack(pixels: DataFrame, config: dict[str, tuple[float, float]], magzero: float) -> DataFrame:
    """CAT-3: inverse-variance stack of bands; ``config[band]`` is (zero point, sky RMS).

    Bands are brought to one zero point; each pixel is the weighted mean of the bands that have it
    and its RMS is 1 / sqrt(sum of weights).
    """
    scale = F.lit(None).cast("double")
    rms = F.lit(None).cast("double")
    for band, (zp, r) in config.items():
        f = 10 ** (-0.4 * (zp - magzero))
        scale, rms = F.when(F.col("band") == band, f).otherwise(scale), F.when(F.col("band") == band, r * f).otherwise(rms)
    px = pixels.where("flux is not null").withColumns({"v": F.col("flux") * scale, "w": 1 / F.pow(rms, 2)}).where("w is not null")
    keys = [k for k in ("image_id",) if k in pixels.columns]
    return px.groupBy(*keys, "x", "y").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("flux"), (1 / F.sqrt(F.sum("w"))).alias("skyRMS"), F.count(F.lit(1)).alias("Nband"))


def bands_wide(catalogue: DataFrame, bands: list[str], columns: list[str], suffix: str = "t") -> DataFrame:
    """CAT-2, JN-10: one row for each segment, columns named column_band + suffix; all bands in one aggregation."""
    aggs = [F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{c}_{b}{suffix}") for b in bands for c in columns]
    return catalogue.groupBy(*[k for k in ("image_id",) if k in catalogue.columns], "segID").agg(*aggs)


def band_photometry(pixels: DataFrame, segmap: DataFrame, magzero: dict[str, float]) -> DataFrame:
    """CAT-2: flux, magnitude and pixels of each segment in each band, by one grouping of all bands."""
    ids = [k for k in shared_keys(pixels, segmap) if k != "band"]
    got = pixels.join(segmap.where("segID > 0").select(*ids, "x", "y", "segID"), [*ids, "x", "y"]).groupBy(*ids, "band", "segID").agg(F.sum("flux").alias("flux"), F.count("flux").alias("N100"))
    zero = F.coalesce(*(F.when(F.col("band") == b, F.lit(z)) for b, z in magzero.items()))
    return got.withColumn("mag", flux_to_mag("flux", zero))


def merge_groups(segstats: DataFrame, groupstats: DataFrame, groups: DataFrame, wanted: list[int]) -> DataFrame:
    """CAT-1: members of the wanted groups are replaced by the group's row; ``origin`` says which.

    ``groupstats`` has the columns of ``segstats`` and is keyed by groupID in place of segID.
    """
    ids = shared_keys(segstats, groupstats, groups)
    chosen = groups.where(F.col("groupID").isin(wanted))
    members = chosen.select(*ids, F.explode("segIDs").alias("segID"))
    rows = groupstats.join(chosen.select(*ids, "groupID"), [*ids, "groupID"], "left_semi").withColumnRenamed("groupID", "segID").withColumn("origin", F.lit("group"))
    return segstats.join(members, [*ids, "segID"], "left_anti").withColumn("origin", F.lit("seg")).unionByName(rows)


def share_flux(segstats: DataFrame, share: DataFrame, normalise: bool = False) -> DataFrame:
    """DBL-7: flux of segments shared out by ``share(segID, outID, w)``.

    With ``normalise`` the shares of each segment are scaled to sum to one.
    """
    s, ids = share, shared_keys(segstats, share)
    if normalise:
        total = share.groupBy(*ids, "segID").agg(F.sum("w").alias("t"))
        s = share.join(total, [*ids, "segID"]).withColumn("w", F.try_divide("w", "t"))
    both = s.join(segstats.select(*ids, "segID", "flux", "mag", "N50", "N90", "N100"), [*ids, "segID"])
    sums = {"flux": "w * flux", "flux2": "w * flux * flux", "fluxmag": "w * power(10D, -0.4D * mag)", "N50": "w * N50", "N90": "w * N90", "N100": "w * N100"}
    return both.groupBy(*ids, "outID").agg(*(F.sum(F.expr(e)).alias(n) for n, e in sums.items()))


def nearest(left: DataFrame, right: DataFrame, radius: float, x: str = "xcen", y: str = "ycen", key: str = "segID") -> DataFrame:
    """JN-9: for each row of ``left`` the nearest row of ``right`` in the same image within ``radius``: (key, match, dist).

    Equal places count once.  A place starts with the cells of size ``radius`` around its own and goes down to
    cells of a quarter the size three times; only cells that may hold the nearest place are kept: none that
    lies, with all of its places, beyond the farthest corner of another.  So no row is made for a pair that is
    merely within ``radius``.
    """
    ids = shared_keys(left, right)
    at, unit = [*ids, "ax", "ay"], radius / 64 * (1 + 1e-12)
    cell = lambda c, k=0: F.shiftright(F.floor(F.col(c) / unit).cast("long"), 6 - 2 * k)
    a = left.select(*ids, F.col(key), F.col(x).cast("double").alias("ax"), F.col(y).cast("double").alias("ay")).where("ax is not null and ay is not null")
    b = right.select(*ids, F.col(key).alias("match"), F.col(x).cast("double").alias("bx"), F.col(y).cast("double").alias("by")).where("bx is not null and by is not null")
    b = b.groupBy(*ids, "bx", "by").agg(F.min("match").alias("match"))
    around = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    now = a.select(*at).distinct().withColumn("o", F.explode(around)).select(*at, (cell("ax") + F.col("o.i")).alias("cx"), (cell("ay") + F.col("o.j")).alias("cy"))
    beside = lambda p, c: F.greatest(F.col(f"{c}0") - F.col(p), F.col(p) - F.col(f"{c}1"), F.lit(0.0))
    across = lambda p, c: F.greatest(F.col(p) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(p))
    for k in range(4):
        # px, py: the cell one level up, by which the rows meet
        up = [cell(c, max(k - 1, 0)).alias(p) for c, p in (("bx", "px"), ("by", "py"))]
        boxes = b.groupBy(*ids, *up, cell("bx", k).alias("cx"), cell("by", k).alias("cy")).agg(F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("by").alias("y0"), F.max("by").alias("y1"))
        met = now.select(*at, F.col("cx").alias("px"), F.col("cy").alias("py")).join(boxes, [*ids, "px", "py"])
        met = met.select(*at, "cx", "cy", F.hypot(beside("ax", "x"), beside("ay", "y")).alias("least"), F.hypot(across("ax", "x"), across("ay", "y")).alias("most"))
        bound = F.least(F.min("most").over(Window.partitionBy(*at)), F.lit(radius)) * (1 + 1e-9)
        now = met.where(F.col("least") <= radius * (1 + 1e-9)).withColumn("bound", bound).where("least <= bound")
    dist = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    places = b.select(*ids, "match", "bx", "by", cell("bx", 3).alias("cx"), cell("by", 3).alias("cy"))
    met = now.select(*at, "cx", "cy").join(places, [*ids, "cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= radius)
    best = met.groupBy(*at).agg(F.min(F.struct("dist", "match")).alias("m"))
    return a.join(best, at).groupBy(*ids, key).agg(F.min("m").alias("m")).select(*ids, key, "m.match", "m.dist")


def label_at(catalogue: DataFrame, segmap: DataFrame, x: str = "xmax", y: str = "ymax") -> DataFrame:
    """JN-8: ``label``: what the map of its image holds at the pixel of each position."""
    ids = shared_keys(catalogue, segmap)
    at = segmap.select(*ids, F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("segID").alias("label"))
    return catalogue.withColumns({"__x": F.ceil(x).cast("int"), "__y": F.ceil(y).cast("int")}).join(at, [*ids, "__x", "__y"], "left").drop("__x", "__y")
