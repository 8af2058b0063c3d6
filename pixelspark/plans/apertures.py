"""Queries of the aperture family (APR-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apertures as A
from ..operators import stats as S
from .fixtures import f1, f2, f4, with_fixtures
from .maps import IN_POLY, POLY_SQL, POLYGON, xy
from .registry import query
from .statistics import _MOMENTS, r

_SUB = "g AS (SELECT i, j FROM (SELECT unnest([-0.375e0, -0.125e0, 0.125e0, 0.375e0]) AS i), (SELECT unnest([-0.375e0, -0.125e0, 0.125e0, 0.375e0]) AS j))"
_CIRCLE = f"""{_SUB}, c AS (SELECT k, x, y, flux, count(*) FILTER ((x - 0.5e0 - cx + i) ** 2 + (y - 0.5e0 - cy + j) ** 2 <= rad * rad) / 16e0 AS cover FROM f2 JOIN f4 ON abs(x - 0.5e0 - cx) <= rad + 1 AND abs(y - 0.5e0 - cy) <= rad + 1, g GROUP BY ALL)"""
_ELLIPSE = f"""{_SUB}, c AS (SELECT k, x, y, flux, count(*) FILTER (((dx + i) * co + (dy + j) * si) ** 2 / (rad * axrat) ** 2 + (-(dx + i) * si + (dy + j) * co) ** 2 / rad ** 2 <= 1) / 16e0 AS cover
  FROM (SELECT *, x - 0.5e0 - cx AS dx, y - 0.5e0 - cy AS dy, cos(ang * (3.141593e0 / 180)) AS co, sin(ang * (3.141593e0 / 180)) AS si FROM f2 JOIN f4 ON abs(x - 0.5e0 - cx) <= rad + 1 AND abs(y - 0.5e0 - cy) <= rad + 1), g GROUP BY ALL)"""


def _flux(out: DataFrame) -> DataFrame:
    return out.select(F.col("k").cast("long").alias("k"), *r("flux"))


@query(with_fixtures("f2 f4", _CIRCLE + " SELECT f4.k::BIGINT AS k, round(coalesce(sum(flux * cover), 0), 6) AS flux FROM f4 LEFT JOIN c ON c.k = f4.k GROUP BY 1"))
def apr_circle_flux(spark: SparkSession, d: str) -> DataFrame:
    """APR-1, APR-7, JN-7."""
    return _flux(A.aperture_flux(f2(spark, d), f4(spark, d), depth=2))


@query(with_fixtures("f2 f4", _ELLIPSE + " SELECT f4.k::BIGINT AS k, round(coalesce(sum(flux * cover), 0), 6) AS flux FROM f4 LEFT JOIN c ON c.k = f4.k GROUP BY 1"))
def apr_ellipse_flux(spark: SparkSession, d: str) -> DataFrame:
    """APR-3, APR-8, JN-7."""
    return _flux(A.aperture_flux(f2(spark, d), f4(spark, d), depth=2, shape="ellipse"))


@query(with_fixtures("f2", f"{POLY_SQL}, {_SUB}, c AS (SELECT x, y, flux, g.i, g.j, count(*) FILTER ({IN_POLY.format(x='(x - 0.5e0 + g.i)', y='(y - 0.5e0 + g.j)')}) % 2 AS hit FROM f2, g, v GROUP BY ALL) SELECT round(sum(flux * hit / 16e0), 6) AS flux, round(sum(hit / 16e0), 6) AS area FROM c"))
def apr_poly_flux(spark: SparkSession, d: str) -> DataFrame:
    """APR-6, APR-9."""
    return A.polygon_flux(f2(spark, d), POLYGON, depth=2).select(*r("flux", "area"))


@query(with_fixtures("f2 f4", _CIRCLE + " SELECT x::BIGINT AS x, y::BIGINT AS y, round(sum(cover), 6) AS weight FROM c WHERE cover > 0 GROUP BY 1, 2"))
def apr_weight_map(spark: SparkSession, d: str) -> DataFrame:
    """APR-2."""
    out = A.weight_map(f2(spark, d), f4(spark, d), depth=2)
    return out.select(*xy(out), *r("weight"))


@query(
    with_fixtures(
        "f2 f4",
        _ELLIPSE
        + """, p AS (SELECT c.*, sqrt(((dx * cos(radians(ang)) + dy * sin(radians(ang))) / axrat) ** 2 + (-dx * sin(radians(ang)) + dy * cos(radians(ang))) ** 2) AS rr, (2 + k % 3) AS w, axrat FROM (SELECT c.*, c.x - 0.5e0 - cx AS dx, c.y - 0.5e0 - cy AS dy, ang, axrat FROM c JOIN f4 USING (k)) c)
  SELECT x::BIGINT AS x, y::BIGINT AS y, round(sum(w / (4 * axrat) * cover * exp(-(4 - 1 / 3e0 + 4 / (405 * 2e0)) * (rr / 2e0) ** 0.5e0)), 6) AS weight FROM p WHERE cover > 0 GROUP BY 1, 2""",
    )
)
def apr_ellipse_weight(spark: SparkSession, d: str) -> DataFrame:
    """APR-4, SCL-15, SCL-17: weights for each aperture with a Sersic profile."""
    ap = f4(spark, d).withColumns({"wt": 2.0 + F.col("k") % 3, "rad_re": F.lit(2.0), "nser": F.lit(2.0)})
    out = A.weight_map(f2(spark, d), ap, depth=2, shape="ellipse", scalar=False)
    return out.select(*xy(out), *r("weight"))


@query(
    with_fixtures(
        "f2 f4",
        _CIRCLE + ", w AS (SELECT *, cover / nullif(sum(cover) OVER (PARTITION BY x, y), 0) AS share FROM c WHERE cover > 0) SELECT f4.k::BIGINT AS k, round(coalesce(sum(flux * cover * share), 0), 6) AS flux FROM f4 LEFT JOIN w ON w.k = f4.k GROUP BY 1",
    )
)
def apr_deblend_flux(spark: SparkSession, d: str) -> DataFrame:
    """APR-7 with shared pixels."""
    return _flux(A.aperture_flux(f2(spark, d), f4(spark, d), depth=2, deblend=True))


def _column(k: int, rad: float) -> str:
    full = 3.141592653589793 * rad * rad
    flux = f"f{k} - (n{k} - {full!r}) * coalesce(m{k}, 0)"
    return f"round({flux}, 5) AS flux_app_{k}, round(n{k}, 5) AS N_app_{k}, round(m{k}, 5) AS flux_min_{k}, CASE WHEN {flux} > 0 THEN round(-2.5e0 * log10({flux}) + 30, 4) END AS mag_app_{k}"


_PHOT = f"""{_SUB}, m AS (SELECT segID, x - 0.5e0 AS xcen, y - 0.5e0 AS ycen FROM (SELECT *, row_number() OVER (PARTITION BY segID ORDER BY flux DESC, y, x) AS rn FROM f2 WHERE segID > 0 AND mask = 0) WHERE rn = 1),
  b AS (SELECT segID, x, y, flux, xcen, ycen, count(*) FILTER ((x - 0.5e0 - xcen + i) ** 2 + (y - 0.5e0 - ycen + j) ** 2 <= 2.25e0) / 16e0 AS c1, count(*) FILTER ((x - 0.5e0 - xcen + i) ** 2 + (y - 0.5e0 - ycen + j) ** 2 <= 6.25e0) / 16e0 AS c2 FROM f2 JOIN m USING (segID), g WHERE mask = 0 GROUP BY ALL),
  a AS (SELECT segID, {", ".join(f"sum(flux * c{k}) AS f{k}, sum(c{k}) AS n{k}, sum(flux * (1 - 2 * abs(c{k} - 0.5e0))) / nullif(sum(1 - 2 * abs(c{k} - 0.5e0)), 0) AS m{k}" for k in (1, 2))} FROM b GROUP BY 1)"""


@query(with_fixtures("f2", f"{_PHOT} SELECT segID::BIGINT AS segID, {_column(1, 1.5)}, {_column(2, 2.5)} FROM a"))
def apr_segment_phot(spark: SparkSession, d: str) -> DataFrame:
    """APR-10, APR-11: two apertures about each segment's brightest pixel."""
    px = f2(spark, d)
    centres = S.brightest(px).withColumnsRenamed({"xmax": "xcen", "ymax": "ycen"})
    out = A.segment_photometry(px, centres, [3.0, 5.0], depth=2, magzero=30.0)
    return out.select(F.col("segID").cast("long").alias("segID"), *r(*(f"{c}_app_{k}" for k in (1, 2) for c in ("flux", "N")), "flux_min_1", "flux_min_2", digits=5), *r("mag_app_1", "mag_app_2", digits=4))


@query(
    with_fixtures(
        "f2",
        """q AS (SELECT *, sum(flux) OVER (PARTITION BY segID ORDER BY flux DESC, y, x ROWS UNBOUNDED PRECEDING) / nullif(sum(flux) OVER (PARTITION BY segID), 0) AS frac FROM f2 WHERE segID > 0),
  b AS (SELECT *, CASE WHEN frac > 0 AND frac < 0.4 THEN 0 WHEN frac > 0.4 AND frac < 0.8 THEN 1 WHEN frac > 0.8 AND frac < 1 THEN 2 END AS bin FROM q), s AS (SELECT *, CASE WHEN min(flux) OVER w = max(flux) OVER w THEN 1 ELSE flux END AS w FROM b WHERE bin IS NOT NULL WINDOW w AS (PARTITION BY segID, bin))
  SELECT segID::BIGINT AS segID, bin::BIGINT AS segellipseID, sum(flux) AS flux, count(*) AS N, round(max(frac), 6) AS fluxfrac, round(sum(w * (x - 0.5e0)) / sum(w), 5) AS xcen, round(sum(w * (y - 0.5e0)) / sum(w), 5) AS ycen FROM s GROUP BY 1, 2""",
    )
)
def apr_isophotes(spark: SparkSession, d: str) -> DataFrame:
    """APR-14, WIN-2."""
    out = A.isophotes(f2(spark, d).drop("mask"), [0.0, 0.4, 0.8, 1.0])
    return out.select(F.col("segID").cast("long").alias("segID"), F.col("segellipseID").cast("long").alias("segellipseID"), "flux", "N", *r("fluxfrac"), *r("xcen", "ycen", digits=5))


@query()
def apr_random(spark: SparkSession, d: str) -> DataFrame:
    """APR-12, TOP-2."""
    return A.random_apertures(f1(spark, d).withColumn("segID", F.lit(0)), 5.0, 200)


@query(with_fixtures("f2 f4", "c AS (SELECT x, y, sum(k)::BIGINT AS segID FROM f2 JOIN f4 ON (((x - 0.5e0 - cx) * cos(ang * (3.141593e0 / 180)) + (y - 0.5e0 - cy) * sin(ang * (3.141593e0 / 180))) / (rad * axrat)) ** 2 + ((-(x - 0.5e0 - cx) * sin(ang * (3.141593e0 / 180)) + (y - 0.5e0 - cy) * cos(ang * (3.141593e0 / 180))) / rad) ** 2 <= 1 GROUP BY 1, 2) SELECT f2.x::BIGINT AS x, f2.y::BIGINT AS y, coalesce(c.segID, 0) AS segID FROM f2 LEFT JOIN c ON c.x = f2.x AND c.y = f2.y"))
def seg_ellipse(spark: SparkSession, d: str) -> DataFrame:
    """SEG-21, APR-3 at depth 0."""
    out = A.paint_ellipses(f2(spark, d), f4(spark, d))
    return out.select(*xy(out), F.col("segID").cast("long").alias("segID"))


@query(with_fixtures("f4", "SELECT k::BIGINT AS k, i::BIGINT AS i, round(cx + rad * axrat * sin(radians(i * 3.6e0)) * cos(radians(ang)) - rad * cos(radians(i * 3.6e0)) * sin(radians(ang)), 5) AS px, round(cy + rad * axrat * sin(radians(i * 3.6e0)) * sin(radians(ang)) + rad * cos(radians(i * 3.6e0)) * cos(radians(ang)), 5) AS py FROM f4, (SELECT unnest(generate_series(0, 99)) AS i)"))
def apr_outline(spark: SparkSession, d: str) -> DataFrame:
    """SNK-5: vertices of ellipses."""
    out = A.outline(f4(spark, d).withColumnsRenamed({"cx": "xcen", "cy": "ycen"}).withColumn("box", F.lit(0.0)))
    return out.select(F.col("k").cast("long").alias("k"), F.col("i").cast("long").alias("i"), *r("px", "py", digits=5))


@query(
    with_fixtures(
        "f2",
        _MOMENTS
        + """, e AS (SELECT *, (xsd ** 2 + ysd ** 2) / 2 AS h, sqrt(((xsd ** 2 - ysd ** 2) / 2) ** 2 + covxy ** 2) AS q FROM m)
  SELECT segID::BIGINT AS segID, round(sqrt(2 * abs(h + q)), 5) AS radhi, round(sqrt(2 * abs(h - q)), 5) AS radlo, round(sqrt(abs(h - q)) / sqrt(abs(h + q)), 5) AS axrat, round(sum(greatest(flux, 0) * sqrt((px - e.xcen) ** 2 + (py - e.ycen) ** 2)) / sum(greatest(flux, 0)), 5) AS radav FROM e JOIN s USING (segID) GROUP BY ALL""",
    )
)
def apr_moment_ellipse(spark: SparkSession, d: str) -> DataFrame:
    """APR-13."""
    out = A.moment_ellipse(f2(spark, d))
    return out.select(F.col("segID").cast("long").alias("segID"), *r("radhi", "radlo", "axrat", "radav", digits=5))


@query()
def apr_superellipse(spark: SparkSession, d: str) -> DataFrame:
    """APR-13 with a box fit."""
    px = f2(spark, d)
    return A.superellipse(px, A.moment_ellipse(px))
