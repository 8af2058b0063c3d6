"""Pixel maps: ingest, masks, sigma maps, thresholds, membership (SRC-*, SCL-9 to SCL-13, MSK-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import flux_to_sb, signal_to_noise
from ..model import keys_of


def pixels_from_array(spark: SparkSession, image: list[list[float | None]], image_id: str | None = None) -> DataFrame:
    """SRC-1: a pixel relation from rows image[x][y]; NaN becomes NULL."""
    clean = [[None if v is None or v != v else float(v) for v in column] for column in image]
    rows = spark.createDataFrame([(i + 1, c) for i, c in enumerate(clean)], "x int, v array<double>")
    out = rows.select("x", F.posexplode_outer("v").alias("p", "flux")).select("x", (F.col("p") + 1).cast("int").alias("y"), "flux")
    return out if image_id is None else out.withColumn("image_id", F.lit(image_id))


def with_mask(pixels: DataFrame, flag: float | None = None) -> DataFrame:
    """SRC-5: missing pixels, and those equal to the flag value, join the mask; their flux becomes 0."""
    missing = F.col("flux").isNull() | F.isnan("flux")
    hit = missing | (F.col("flux") == flag) if flag is not None else missing
    had = F.coalesce(F.col("mask"), F.lit(0)) != 0 if "mask" in pixels.columns else F.lit(False)
    return pixels.withColumn("mask", F.when(hit | had, 1).otherwise(0)).withColumn("flux", F.when(hit, 0.0).otherwise(F.col("flux")))


def restore_missing(pixels: DataFrame, original: DataFrame) -> DataFrame:
    """SRC-5: NULL again where the original was NULL."""
    keys = [*keys_of(pixels), "x", "y"]
    gone = original.where(F.col("flux").isNull() | F.isnan("flux")).select(*keys, F.lit(True).alias("gone"))
    return pixels.join(gone, keys, "left").withColumn("flux", F.when(F.col("gone"), None).otherwise(F.col("flux"))).drop("gone")


def bands_present(pixels: DataFrame, wanted: list[str]) -> DataFrame:
    """SRC-3, SET-6: pixels of the wanted bands that exist."""
    return pixels.where(F.col("band").isin(wanted))


def union_bands(bands: dict[str, DataFrame]) -> DataFrame:
    """SRC-4, SET-3: one relation of several bands."""
    out = None
    for name, df in bands.items():
        df = df.withColumn("band", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no bands")
    return out


def sigma_map(
    pixels: DataFrame,
    read_rms: float = 0.0,
    dark_rms: float = 0.0,
    skycut: float = 0.0,
    gain: float = 1.0,
    exptime: float = 1.0,
    image_units: str = "ADU",
    sky_units: str = "ADU",
    read_units: str = "ADU",
    dark_units: str = "ADU",
    output_units: str = "ADU",
) -> DataFrame:
    """SCL-9: adds ``sigma``; pixels have flux, objects, sky and skyRMS.

    Each term is converted to electrons ('ADU', 'elec', each optionally '/s'), object flux above
    ``skycut`` RMS counts as shot noise, and the sum goes back to the output units.  With units of
    ADU throughout, the noise terms are taken in the units of the image.
    """

    def to_electrons(units: str) -> float:
        known = {"adu": gain, "adu/s": gain * exptime, "elec": 1.0, "elec/s": exptime}
        if units.lower() not in known:
            raise ValueError(f"units {units!r}: use ADU, ADU/s, elec or elec/s")
        return known[units.lower()]

    i, s, rd, dk, out = map(to_electrons, (image_units, sky_units, read_units, dark_units, output_units))
    if {image_units.lower(), sky_units.lower(), read_units.lower(), dark_units.lower(), output_units.lower()} == {"adu"}:
        i, s, rd, dk, out, shot = 1.0, 1.0, 1.0, 1.0, 1.0, 1.0 / gain
    else:
        shot = 1.0
    above = F.col("flux") * i - F.col("sky") * s
    rms = F.col("skyRMS") * s
    count = F.when((F.col("objects") != 0) & (above >= rms * skycut), above * shot).otherwise(0.0)
    return pixels.withColumn("sigma", F.sqrt(count + rms * rms + (read_rms * rd) ** 2 + (dark_rms * dk) ** 2) / out)


def threshold(pixels: DataFrame, skycut: float, sb_limit: float | None = None, magzero: float = 0.0, pixscale: float = 1.0) -> DataFrame:
    """SCL-11: adds ``sn``, 0 below ``skycut``, below the surface-brightness limit, or masked."""
    sn = signal_to_noise("flux", "sky", "skyRMS")
    keep = sn >= skycut
    if "mask" in pixels.columns:
        keep = keep & (F.coalesce(F.col("mask"), F.lit(0)) == 0)
    if sb_limit is not None:
        keep = keep & (flux_to_sb(F.col("flux") - F.col("sky"), magzero, pixscale) < sb_limit)
    return pixels.withColumn("sn", F.when(keep, sn).otherwise(0.0))


def this_in_that(this: str | Column, that: list[int], invert: bool = False) -> Column:
    """SCL-12, SCL-13: membership of integers; NULL for NULL and negative values."""
    c = F.col(this) if isinstance(this, str) else this
    found = c.isin(that) if that else F.lit(False)
    return F.when(c >= 0, ~found if invert else found)


def semi_join(rows: DataFrame, that: DataFrame, key: str, invert: bool = False) -> DataFrame:
    """SCL-12 over a relation of any size."""
    return rows.join(that.select(key).distinct(), key, "left_anti" if invert else "left_semi")


def sb_limit_map(pixels: DataFrame, skycut: float, magzero: float, pixscale: float, cap: float | None = None) -> DataFrame:
    """PIP-6: surface brightness of the threshold at each pixel."""
    sb = flux_to_sb(F.col("skyRMS") * skycut, magzero, pixscale)
    return pixels.withColumn("SBlim", F.least(sb, F.lit(cap)) if cap is not None else sb)


def stamp_mask(pixels: DataFrame, stamp: DataFrame, places: DataFrame, xsize: int, ysize: int, rot: float = 0.0) -> DataFrame:
    """MSK-1: ``which``: the first place whose stamp covers a pixel, whose flux becomes NULL.

    ``stamp(x, y, mask)`` is centred on each of ``places(i, xcen, ycen)`` and rotated by ``rot`` degrees;
    a pixel takes the stamp's nearest sample.  Places are dealt to cells as large as a stamp, so a
    pixel meets only the places of its cell.
    """
    from math import ceil, cos, hypot, radians, sin

    reach = ceil(hypot(xsize, ysize) / 2) + 1
    near = places.select("i", "xcen", "ycen", F.explode(F.sequence(F.floor((F.col("xcen") - reach) / reach), F.floor((F.col("xcen") + reach) / reach))).alias("cx")).select(
        "i", "xcen", "ycen", "cx", F.explode(F.sequence(F.floor((F.col("ycen") - reach) / reach), F.floor((F.col("ycen") + reach) / reach))).alias("cy")
    )
    c, s = cos(radians(rot)), sin(radians(rot))
    cells = pixels.withColumns({"cx": F.floor((F.col("x") - 0.5) / reach), "cy": F.floor((F.col("y") - 0.5) / reach)})
    dx, dy = F.col("x") - 0.5 - F.col("xcen"), F.col("y") - 0.5 - F.col("ycen")
    met = cells.join(near, ["cx", "cy"]).withColumns({"sx": F.ceil(dx * c + dy * s + xsize / 2).cast("int"), "sy": F.ceil(-dx * s + dy * c + ysize / 2).cast("int")})
    shape = stamp.where("mask <> 0").select(F.col("x").alias("sx"), F.col("y").alias("sy"))
    keys = [*keys_of(pixels), "x", "y"]
    hit = met.join(shape, ["sx", "sy"], "left_semi").groupBy(*keys).agg(F.min("i").alias("which"))
    return pixels.join(hit, keys, "left").withColumn("flux", F.when(F.col("which").isNull(), F.col("flux"))).withColumn("which", F.coalesce("which", F.lit(0)))
