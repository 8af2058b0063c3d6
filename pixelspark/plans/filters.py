"""Queries of the filter family (FLT-*)."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as L
from ..operators import kernels as B
from .fixtures import f1, f2, f3, f4, f5, height, with_fixtures
from .maps import xy
from .registry import query
from .statistics import r

_LINE = ", ".join(f"({i}, {exp(-i * i / 2.0)!r}e0)" for i in range(-4, 5))
_BLUR = f"""k(d, w) AS (VALUES {_LINE}),
  b AS (SELECT f2.x, f2.y, any_value(f2.flux) AS flux, sum(n.flux * a.w * c.w) / sum(a.w * c.w) AS smooth FROM f2, k a, k c JOIN f2 n ON n.x = f2.x + a.d AND n.y = f2.y + c.d GROUP BY 1, 2)"""
PSF = B.gaussian_psf(5, 2.0)


@query(with_fixtures("f2", _BLUR + " SELECT x::BIGINT AS x, y::BIGINT AS y, round(smooth, 5) + 0 AS flux FROM b"))
def flt_blur(spark: SparkSession, d: str) -> DataFrame:
    """FLT-1, JN-6."""
    out = L.blur(f2(spark, d), 1.0)
    return out.select(*xy(out), *r("flux", digits=5))


@query(with_fixtures("f2", _BLUR + " SELECT x::BIGINT AS x, y::BIGINT AS y, round(flux - smooth, 5) + 0 AS flux FROM b"))
def flt_diff(spark: SparkSession, d: str) -> DataFrame:
    """FLT-3."""
    out = L.difference(f2(spark, d), 1.0)
    return out.select(*xy(out), *r("flux", digits=5))


@query(
    with_fixtures(
        "f2",
        """SELECT c.x::BIGINT AS x, c.y::BIGINT AS y, round(sqrt(coalesce((r.flux - l.flux) / 2, r.flux - c.flux, c.flux - l.flux) ** 2 + coalesce((u.flux - dn.flux) / 2, u.flux - c.flux, c.flux - dn.flux) ** 2), 6) AS flux FROM f2 c
  LEFT JOIN f2 l ON l.x = c.x - 1 AND l.y = c.y LEFT JOIN f2 r ON r.x = c.x + 1 AND r.y = c.y LEFT JOIN f2 u ON u.x = c.x AND u.y = c.y + 1 LEFT JOIN f2 dn ON dn.x = c.x AND dn.y = c.y - 1""",
    )
)
def flt_grad(spark: SparkSession, d: str) -> DataFrame:
    """FLT-2."""
    out = L.gradient(f2(spark, d))
    return out.select(*xy(out), *r("flux"))


_CORR = ", ".join(f"round(corr(a{x}, v{x}), 6) AS cor{x}, round(corr(a{x}, v{x}) FILTER (a{x} < 0 AND v{x} < 0), 6) AS cor{x}_neg, round(corr(a{x}, v{x}) FILTER (a{x} > 0 AND v{x} > 0), 6) AS cor{x}_pos, round(stddev_samp(a{x} - v{x}) / sqrt(2e0), 6) AS relsd{x}" for x in "xy")


@query(
    with_fixtures(
        "f1",
        f"""l AS (SELECT unnest([1, 2, 5]) AS lag),
  p AS (SELECT lag, a.flux AS ax, b.flux AS vx, NULL::DOUBLE AS ay, NULL::DOUBLE AS vy FROM l, f1 a JOIN f1 b ON b.x = a.x + lag AND b.y = a.y UNION ALL SELECT lag, NULL, NULL, a.flux, b.flux FROM l, f1 a JOIN f1 b ON b.x = a.x AND b.y = a.y + lag)
  SELECT lag::BIGINT AS lag, {_CORR} FROM p GROUP BY 1""",
    )
)
def flt_pixel_correlation(spark: SparkSession, d: str) -> DataFrame:
    """FLT-10, AGG-21."""
    out = L.pixel_correlation(f1(spark, d), [1, 2, 5])
    return out.select(F.col("lag").cast("long").alias("lag"), *r(*(f"{c}{x}{s}" for x in "xy" for c, s in (("cor", ""), ("cor", "_neg"), ("cor", "_pos"), ("relsd", "")))))


@query(with_fixtures("f1", "SELECT a.x::BIGINT AS i, b.x::BIGINT AS j, round(covar_samp(a.flux, b.flux), 7) + 0 AS cov FROM f1 a JOIN f1 b ON a.y = b.y AND a.x <= b.x GROUP BY 1, 2"))
def flt_covmat(spark: SparkSession, d: str) -> DataFrame:
    """FLT-11."""
    out = L.covariance_matrix(f1(spark, d), "x")
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *r("cov", digits=7))


_K = ", ".join(f"({i}, {j}, {w!r}e0)" for i, j, w in PSF)


@query(
    with_fixtures(
        "f4",
        f"""k(dx, dy, w) AS (VALUES {_K}), s AS (SELECT cx, cy, rad * 100 AS flux, floor(cx + 0.5e0) AS x0, floor(cy + 0.5e0) AS y0, cx + 0.5e0 - floor(cx + 0.5e0) AS fx, cy + 0.5e0 - floor(cy + 0.5e0) AS fy FROM f4),
  c AS (SELECT flux * (CASE WHEN i = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN j = 1 THEN fy ELSE 1 - fy END) AS f, x0 + i AS px, y0 + j AS py FROM s, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
  SELECT (px + dx)::BIGINT AS x, (py + dy)::BIGINT AS y, round(sum(f * w), 6) AS flux FROM c, k WHERE f > 0 AND px + dx BETWEEN 1 AND 64 AND py + dy BETWEEN 1 AND 500 GROUP BY 1, 2""",
    )
)
def fit_render(spark: SparkSession, d: str) -> DataFrame:
    """FLT-9."""
    src = f4(spark, d).select(F.col("cx").alias("xcen"), F.col("cy").alias("ycen"), (F.col("rad") * 100).alias("flux"))
    out = L.render_points(src, PSF, 64, height(spark, d))
    return out.select(*xy(out), *r("flux"))


@query(with_fixtures("f2", "SELECT x::BIGINT AS x, y::BIGINT AS y, flux + CASE WHEN x BETWEEN 10 AND 20 AND y BETWEEN 30 AND 60 THEN flux ELSE 0 END AS flux FROM f2"))
def flt_add(spark: SparkSession, d: str) -> DataFrame:
    """FLT-7, FLT-8: a cut-out added to its image."""
    px = f2(spark, d)
    out = L.add_images(px, L.cutout(px, (10, 20), (30, 60)))
    return out.select(*xy(out), "flux")


@query(with_fixtures("f2", "SELECT sum(flux) AS flux FROM f2 WHERE x BETWEEN 27 AND 37 AND y BETWEEN 95 AND 105"))
def flt_box(spark: SparkSession, d: str) -> DataFrame:
    """FLT-12."""
    return L.box_flux(f2(spark, d), 32, 100, 11)


@query()
def flt_resample_bicubic(spark: SparkSession, d: str) -> DataFrame:
    """FLT-6, bicubic and recentred; compared with a plain model in the tests."""
    return L.resample(f3(spark, d).na.fill(0.0), 100, 100, 1.6, "pixscale", kind="bicubic", recentre=True)


@query(with_fixtures("f5", "s AS (SELECT band, (x + 1) // 2 AS x, (y + 1) // 2 AS y, sum(flux) / 4 AS f FROM f5 GROUP BY 1, 2, 3) SELECT band, x::BIGINT AS x, y::BIGINT AS y, round(f * sum(o.t) / sum(n.t), 6) AS flux FROM s JOIN (SELECT band, sum(flux) AS t FROM f5 GROUP BY 1) o USING (band) JOIN (SELECT band, sum(f) AS t FROM s GROUP BY 1) n USING (band) GROUP BY band, x, y, f"))
def flt_resample_bands(spark: SparkSession, d: str) -> DataFrame:
    """FLT-6 on several images at once."""
    out = L.resample(f5(spark, d), 100, 100, 2.0, "image")
    return out.select("band", *xy(out), *r("flux"))


_AT = "cl AS (SELECT i, j FROM (SELECT unnest(generate_series(-2, 2)) AS i), (SELECT unnest(generate_series(-2, 2)) AS j))"


@query(
    f"""WITH {_AT}, w AS (SELECT 'box' AS shape, i, j, 1e0 AS w FROM cl UNION ALL SELECT 'disc', i, j, 1 FROM cl WHERE i * i + j * j < 6.25 UNION ALL SELECT 'diamond', i, j, 1 FROM cl WHERE abs(i) + abs(j) < 2.5
  UNION ALL SELECT 'gaussian', i, j, exp(-(i * i + j * j) / 4.5e0) / (SELECT sum(exp(-(i * i + j * j) / 4.5e0)) FROM cl) FROM cl UNION ALL SELECT 'line', i, i, 1 FROM cl WHERE i = j)
  SELECT shape, i::BIGINT AS dx, j::BIGINT AS dy, round(w, 9) AS w FROM w"""
)
def flt_brush(spark: SparkSession, d: str) -> DataFrame:
    """FLT-4, FLT-5."""
    rows = [(shape, i, j, float(w)) for shape in ("box", "disc", "diamond", "gaussian", "line") for i, j, w in B.brush(5, shape, sigma=1.5)]
    return spark.createDataFrame(rows, "shape string, dx long, dy long, w double").withColumn("w", F.round("w", 9))


@query(with_fixtures("f3", "s AS (SELECT (x + 1) // 2 AS x, (y + 1) // 2 AS y, avg(coalesce(flux, 0)) AS f FROM f3 GROUP BY 1, 2) SELECT x::BIGINT AS x, y::BIGINT AS y, round(f * (SELECT sum(flux) FROM f3) / (SELECT sum(f) FROM s), 6) AS flux FROM s"))
def flt_resample(spark: SparkSession, d: str) -> DataFrame:
    """FLT-6: half the resolution, the same total flux."""
    out = L.resample(f3(spark, d).na.fill(0.0), 100, 100, 2.0, "image")
    return out.select(*xy(out), *r("flux"))
