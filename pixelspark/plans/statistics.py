"""Queries of the statistics family (AGG-*, SCL-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units as U
from ..operators import maps as M
from ..operators import stats as S
from .fixtures import NY2, f1, f2, height, with_fixtures
from .registry import query


#: A header for sky coordinates.
HEADER = {"CRVAL1": 150.0, "CRVAL2": 2.0, "CRPIX1": 32.5, "CRPIX2": 250.5, "CD1_1": -0.0001, "CD1_2": 0.00002, "CD2_1": 0.00002, "CD2_2": 0.0001}


def r(*names: str, digits: int = 6) -> list:
    return [(F.round(n, digits) + 0.0).alias(n) for n in names]


@query(
    with_fixtures(
        "f1",
        """SELECT segID::BIGINT AS segID, round(sum(flux), 6) + 0 AS flux, count(flux) AS N100,
  round(sum(greatest(flux, 0) * (x - 0.5e0)) / sum(greatest(flux, 0)), 6) AS xcen, round(sum(greatest(flux, 0) * (y - 0.5e0)) / sum(greatest(flux, 0)), 5) AS ycen,
  CASE WHEN sum(flux) > 0 THEN round(-2.5e0 * log10(sum(flux)) + 30, 5) END AS mag FROM f1 WHERE segID > 0 GROUP BY 1""",
    )
)
def agg_segment_flux(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1, AGG-4, SCL-1."""
    px = f1(spark, d)
    cat = S.segment_flux(px).join(S.moments(px).select("segID", "xcen", "ycen"), "segID")
    return cat.select(F.col("segID").cast("long").alias("segID"), *r("flux"), "N100", *r("xcen"), *r("ycen", digits=5), F.round(U.flux_to_mag("flux", 30.0), 5).alias("mag"))


@query(with_fixtures("f2", "m AS (SELECT max(segID) AS most FROM f2) SELECT s::BIGINT AS segID, coalesce(flux, 0) AS flux FROM (SELECT unnest(generate_series(1, most)) AS s FROM m) LEFT JOIN (SELECT segID, sum(flux) FILTER (mask = 0) AS flux FROM f2 WHERE segID > 0 GROUP BY 1) t ON t.segID = s"))
def agg_segment_flux_dense(spark: SparkSession, d: str) -> DataFrame:
    """AGG-2."""
    return S.segment_flux_dense(f2(spark, d)).select(F.col("segID").cast("long").alias("segID"), "flux")


@query(
    with_fixtures(
        "f2",
        """p AS (SELECT segID, flux, row_number() OVER w AS rn, sum(flux) OVER (w ROWS UNBOUNDED PRECEDING) / nullif(sum(flux) OVER (PARTITION BY segID), 0) AS c,
   sum(flux) OVER (PARTITION BY segID) AS tot FROM f2 WHERE segID > 0 AND mask = 0 WINDOW w AS (PARTITION BY segID ORDER BY flux, y, x)),
  q AS (SELECT *, lag(c) OVER (PARTITION BY segID ORDER BY rn) AS prev FROM p),
  a AS (SELECT segID, max(tot) AS flux, count(*) AS n, min(rn) FILTER (c >= 0.5) AS l50, min(rn) FILTER (c >= 0.1) AS l90 FROM q GROUP BY 1)
  SELECT a.segID::BIGINT AS segID, a.flux, round(n - (l50 - 1) + (0.5 - h.prev) / (h.c - h.prev), 6) AS N50, round(n - (l90 - 1) + (0.1 - t.prev) / (t.c - t.prev), 6) AS N90, n AS N100, round(e.c - e.prev, 6) AS cenfrac
  FROM a JOIN q h ON h.segID = a.segID AND h.rn = l50 JOIN q t ON t.segID = a.segID AND t.rn = l90 JOIN q e ON e.segID = a.segID AND e.rn = n""",
    )
)
def agg_flux_profile(spark: SparkSession, d: str) -> DataFrame:
    """AGG-3, WIN-1, WIN-3, TOP-3."""
    return S.flux_profile(f2(spark, d)).select(F.col("segID").cast("long").alias("segID"), "flux", *r("N50", "N90"), F.col("N100").cast("long").alias("N100"), *r("cenfrac"))


_MOMENTS = """s AS (SELECT segID, CASE WHEN min(flux) OVER (PARTITION BY segID) = max(flux) OVER (PARTITION BY segID) THEN 1 ELSE greatest(flux, 0) END AS w, x - 0.5e0 AS px, y - 0.5e0 AS py, x, y, flux FROM f2 WHERE segID > 0 AND mask = 0),
  c AS (SELECT segID, sum(w * px) / sum(w) AS xcen, sum(w * py) / sum(w) AS ycen FROM s GROUP BY 1),
  m AS (SELECT segID, any_value(xcen) AS xcen, any_value(ycen) AS ycen, sqrt(sum(w * (px - xcen) ** 2) / sum(w)) AS xsd, sqrt(sum(w * (py - ycen) ** 2) / sum(w)) AS ysd, sum(w * (px - xcen) * (py - ycen)) / sum(w) AS covxy FROM s JOIN c USING (segID) GROUP BY 1)"""


@query(
    with_fixtures(
        "f2",
        _MOMENTS
        + """, e AS (SELECT *, (xsd ** 2 + ysd ** 2) / 2 + sqrt(((xsd ** 2 - ysd ** 2) / 2) ** 2 + covxy ** 2) AS hi, (xsd ** 2 + ysd ** 2) / 2 - sqrt(((xsd ** 2 - ysd ** 2) / 2) ** 2 + covxy ** 2) AS lo FROM m)
  SELECT segID::BIGINT AS segID, round(xcen, 5) AS xcen, round(ycen, 5) AS ycen, round(xsd, 5) AS xsd, round(ysd, 5) AS ysd, round(covxy, 5) + 0 AS covxy, round(covxy / (xsd * ysd), 5) + 0 AS corxy,
   round(sqrt(abs(hi) + 0.08333333e0), 5) AS semimaj, round(sqrt(abs(lo) + 0.08333333e0), 5) AS semimin, round(sqrt(abs(lo) + 0.08333333e0) / sqrt(abs(hi) + 0.08333333e0), 5) AS axrat FROM e""",
    )
)
def agg_moments(spark: SparkSession, d: str) -> DataFrame:
    """AGG-4, AGG-5, AGG-6, SCL-16."""
    return S.shape(S.moments(f2(spark, d))).select(F.col("segID").cast("long").alias("segID"), *r("xcen", "ycen", "xsd", "ysd", "covxy", "corxy", "semimaj", "semimin", "axrat", digits=5))


@query(with_fixtures("f2", "SELECT segID::BIGINT AS segID, x - 0.5e0 AS xmax, y - 0.5e0 AS ymax FROM (SELECT *, row_number() OVER (PARTITION BY segID ORDER BY flux DESC, y, x) AS rn FROM f2 WHERE segID > 0 AND mask = 0) WHERE rn = 1"))
def agg_argmax(spark: SparkSession, d: str) -> DataFrame:
    """AGG-7, AGG-23, TOP-1."""
    return S.brightest(f2(spark, d)).select(F.col("segID").cast("long").alias("segID"), F.col("xmax").cast("double").alias("xmax"), F.col("ymax").cast("double").alias("ymax"))


_ROTATED = """p AS (SELECT segID, max(x) FILTER (rn = 1) - 0.5e0 AS xc, max(y) FILTER (rn = 1) - 0.5e0 AS yc FROM (SELECT *, row_number() OVER (PARTITION BY segID ORDER BY flux DESC, y, x) AS rn FROM f2 WHERE segID > 0 AND mask = 0) GROUP BY 1),
  a AS (SELECT segID, (x - 0.5e0 - xc)::INT AS rx, (y - 0.5e0 - yc)::INT AS ry, flux FROM f2 JOIN p USING (segID) WHERE mask = 0),
  b AS (SELECT a.segID, a.flux AS w1, z.flux AS w2 FROM a LEFT JOIN a z ON z.segID = a.segID AND z.rx = -a.rx AND z.ry = -a.ry)"""


@query(with_fixtures("f2", _ROTATED + " SELECT segID::BIGINT AS segID, round(sum(abs(w1 - w2)) FILTER (w1 > 0 AND w2 > 0) / nullif(sum(abs(w1 + w2)) FILTER (w1 > 0 AND w2 > 0), 0), 6) AS asymm FROM b GROUP BY 1"))
def agg_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    """AGG-8, JN-1; about the brightest pixel."""
    px = f2(spark, d)
    centres = S.brightest(px).withColumnsRenamed({"xmax": "xcen", "ymax": "ycen"})
    return S.rotated(px, centres).select(F.col("segID").cast("long").alias("segID"), *r("asymm"))


@query(with_fixtures("f2", _ROTATED + " SELECT segID::BIGINT AS segID, sum(CASE WHEN w2 IS NULL THEN 2 * w1 ELSE w1 END) AS flux_reflect FROM b GROUP BY 1"))
def agg_reflect(spark: SparkSession, d: str) -> DataFrame:
    """AGG-9."""
    px = f2(spark, d)
    centres = S.brightest(px).withColumnsRenamed({"xmax": "xcen", "ymax": "ycen"})
    return S.rotated(px, centres).select(F.col("segID").cast("long").alias("segID"), "flux_reflect")


@query(
    with_fixtures(
        "f2",
        f"""n AS (SELECT a.*, l.segID AS le, ri.segID AS r, u.segID AS u, dn.segID AS dn, greatest(coalesce(l.mask, 0), coalesce(ri.mask, 0), coalesce(u.mask, 0), coalesce(dn.mask, 0)) AS near, a.x BETWEEN 2 AND 63 AND a.y BETWEEN 2 AND {NY2} - 1 AS inside
   FROM f2 a LEFT JOIN f2 l ON l.x = a.x - 1 AND l.y = a.y LEFT JOIN f2 ri ON ri.x = a.x + 1 AND ri.y = a.y LEFT JOIN f2 u ON u.x = a.x AND u.y = a.y + 1 LEFT JOIN f2 dn ON dn.x = a.x AND dn.y = a.y - 1),
  c AS (SELECT segID, count(*) FILTER (inside AND NOT (le = segID AND r = segID AND u = segID AND dn = segID)) AS ie, count(*) FILTER (inside AND (le = 0 OR r = 0 OR u = 0 OR dn = 0)) AS Nsky,
   count(*) FILTER (inside AND near = 1 AND NOT (le = segID AND r = segID AND u = segID AND dn = segID)) AS Nmask,
   count(*) FILTER (y = 1) AS b, count(*) FILTER (x = 1) AS l, count(*) FILTER (y = {NY2}) AS t, count(*) FILTER (x = 64) AS rr FROM n WHERE segID > 0 GROUP BY 1)
  SELECT segID::BIGINT AS segID, ie + b + l + t + rr AS Nedge, Nsky, ie - Nsky AS Nobject, b + l + t + rr AS Nborder, Nmask, round(Nsky / nullif(ie + b + l + t + rr, 0), 6) AS edge_frac,
   ((b > 0)::INT + 2 * (l > 0)::INT + 4 * (t > 0)::INT + 8 * (rr > 0)::INT)::BIGINT AS flag_border FROM c""",
    )
)
def agg_boundary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11, JN-5."""
    return S.boundary(f2(spark, d), 64, height(spark, d)).select(*(F.col(c).cast("long").alias(c) for c in ("segID", "Nedge", "Nsky", "Nobject", "Nborder", "Nmask")), *r("edge_frac"), F.col("flag_border").cast("long").alias("flag_border"))


@query(with_fixtures("f2", 'SELECT segID::BIGINT AS segID, count(*) AS "orig_N", count(*) FILTER (mask <= 0) AS "mask_N", round(count(*) FILTER (mask <= 0) / count(*), 6) AS frac FROM f2 GROUP BY 1'))
def agg_mask_cover(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16, AGG-12."""
    return S.mask_cover(f2(spark, d)).select(F.col("segID").cast("long").alias("segID"), "orig_N", "mask_N", *r("frac"))


@query(with_fixtures("f2", "SELECT segID::BIGINT AS segID, count(*) AS n FROM f2 WHERE segID > 0 GROUP BY 1 HAVING count(*) >= 40"))
def agg_having_pixcut(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, AGG-12."""
    kept = S.keep_large(f2(spark, d).where("segID > 0"), 40)
    return kept.groupBy(F.col("segID").cast("long").alias("segID")).agg(F.count(F.lit(1)).alias("n"))


@query(with_fixtures("f2", "b AS (SELECT y, segID, count(*) AS n FROM f2 WHERE segID > 0 GROUP BY 1, 2) SELECT y::BIGINT AS y, segID::BIGINT AS segID FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY n DESC, segID) AS rn FROM b) WHERE rn = 1"))
def agg_majority(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14: the most frequent label of each row."""
    return S.majority(f2(spark, d).where("segID > 0"), "y", "segID").select(F.col("y").cast("long").alias("y"), F.col("segID").cast("long").alias("segID"))


@query(with_fixtures("f2", "SELECT x::BIGINT AS x, round(quantile_cont(flux, 0.1), 6) AS q10, round(quantile_cont(flux, 0.5), 6) AS q50, round(quantile_cont(flux, 0.84), 6) AS q84, (count(*) - count(flux)) AS missing FROM (SELECT x, CASE WHEN mask = 0 THEN flux END AS flux FROM f2) GROUP BY 1"))
def agg_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17, AGG-22."""
    px = f2(spark, d).withColumn("flux", F.when(F.col("mask") == 0, F.col("flux")))
    q = S.quantiles(px, [0.1, 0.5, 0.84], ["x"])
    return q.select(F.col("x").cast("long").alias("x"), *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q10", "q50", "q84"))), "missing")


@query(
    with_fixtures(
        "f2",
        """s AS (SELECT x, min(flux) AS lo, max(flux) AS hi, count(*) AS n, avg(flux) AS mean, var_pop(flux) AS var FROM f2 GROUP BY 1),
  h AS (SELECT x, lo, hi, n, least(floor((flux - lo) / ((hi - lo) / 16384)), 16383) AS bin, count(*) AS c FROM f2 JOIN s USING (x) GROUP BY ALL),
  k AS (SELECT *, sum(c) OVER (PARTITION BY x ORDER BY bin) AS cum FROM h),
  g AS (SELECT x, lo, hi, least(floor((flux - lo) / ((hi - lo) / 100)), 99) AS bin, count(*) AS c FROM f2 JOIN s USING (x) GROUP BY ALL),
  m AS (SELECT x, lo + (bin + 0.5) * (hi - lo) / 100 AS mode FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c DESC, bin) AS rn FROM g) WHERE rn = 1)
  SELECT s.x::BIGINT AS x, round(mean, 5) AS mean, round(var, 3) AS var, round(mode, 5) AS mode, round(min(k.lo + k.bin * (k.hi - k.lo) / 16384), 5) AS median
  FROM s JOIN m USING (x) JOIN k USING (x) WHERE k.cum > floor(k.n * 0.5) GROUP BY ALL""",
    )
)
def agg_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18, AGG-19."""
    px = f2(spark, d)
    both = S.mean_var_mode(px, ["x"]).join(S.histogram_quantile(px, 0.5, ["x"]).withColumnRenamed("value", "median"), "x")
    return both.select(F.col("x").cast("long").alias("x"), *r("mean", digits=5), *r("var", digits=3), *r("mode", "median", digits=5))


@query(
    with_fixtures(
        "f2",
        """SELECT round(avg(z * z) FILTER (segID = 0 AND flux < sky), 6) AS sky_chisq, round(sum(-0.5 * z * z) FILTER (segID = 0 AND flux < sky), 4) AS sky_loglik, round(avg(sky), 6) AS sky_mean, round(stddev_samp(sky), 6) AS sky_sd, round(avg(rms), 6) AS rms_mean, round(corr(sky, rms), 6) AS sky_rms_cor
  FROM (SELECT *, (flux - sky) / rms AS z FROM (SELECT *, (x % 7)::DOUBLE AS sky, 10e0 + y % 5 AS rms FROM f2))""",
    )
)
def agg_sky_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-20, AGG-21."""
    px = f2(spark, d).withColumns({"sky": (F.col("x") % 7).cast("double"), "skyRMS": 10.0 + F.col("y") % 5})
    return S.sky_diagnostics(px).select(*r("sky_chisq"), *r("sky_loglik", digits=4), *r("sky_mean", "sky_sd", "rms_mean", "sky_rms_cor"))


@query(
    with_fixtures(
        "f2",
        """SELECT x::BIGINT AS x, y::BIGINT AS y, CASE WHEN flux > 0 THEN round(-2.5e0 * log10(flux) + 30, 5) END AS mag, CASE WHEN flux > 0 THEN round(-2.5e0 * log10(flux) + 30 + 5 * log10(0.339e0), 5) END AS sb,
  round(10 ** (-0.4e0 * (20 + x / 10e0 - 30)), 4) AS flux_of_mag, round(20e0 + 2.5e0 * log10(pi() * x * x * 0.5) - 2.5e0 * log10(0.5e0) + 5 * log10(0.339e0), 5) AS mu, round(2.0 * 10 ** (-0.4e0 * (25 - 30)), 6) AS gain, round(flux * 10 ** (-0.4e0 * (30 - 8.9e0)), 9) + 0 AS jansky,
  round(10 ** (-0.4e0 * (22 + y % 9 - 5 * log10(0.339e0) - 30)), 4) AS flux_of_sb, round(24 - 2.5e0 * log10(pi() * x * x * 0.5) + 2.5e0 * log10(0.5e0) - 5 * log10(0.339e0), 5) AS mag_of_mu FROM f2""",
    )
)
def scl_units(spark: SparkSession, d: str) -> DataFrame:
    """SCL-1 to SCL-8."""
    px = f2(spark, d)
    return px.select(
        F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.round(U.flux_to_mag("flux", 30.0), 5).alias("mag"), F.round(U.flux_to_sb("flux", 30.0, 0.339), 5).alias("sb"),
        F.round(U.mag_to_flux(20 + F.col("x") / 10.0, 30.0), 4).alias("flux_of_mag"), F.round(U.mag_to_mu(20.0, F.col("x").cast("double"), 0.5, 0.339), 5).alias("mu"), F.round(U.convert_gain(2.0, 30.0, 25.0), 6).alias("gain"),
        (F.round(F.col("flux") * U.flux_scale("Jansky", 30.0), 9) + 0.0).alias("jansky"),
        F.round(U.sb_to_flux(22 + F.col("y") % 9, 30.0, 0.339), 4).alias("flux_of_sb"), F.round(U.mu_to_mag(24.0, F.col("x").cast("double"), 0.5, 0.339), 5).alias("mag_of_mu"),
    )


@query(
    with_fixtures(
        "f2",
        """SELECT x::BIGINT AS x, y::BIGINT AS y, round(sqrt(CASE WHEN segID > 0 AND flux - 5 >= 20 THEN (flux - 5) / 2 ELSE 0 END + 100 + 4 + 1), 6) AS sigma, round(CASE WHEN mask = 0 AND (flux - 5) / 10 >= 2 THEN (flux - 5) / 10 ELSE 0 END, 6) AS sn FROM f2""",
    )
)
def scl_sigma_map(spark: SparkSession, d: str) -> DataFrame:
    """SCL-9, SCL-10, SCL-11."""
    px = f2(spark, d).withColumns({"sky": F.lit(5.0), "skyRMS": F.lit(10.0), "objects": F.when(F.col("segID") > 0, 1).otherwise(0)})
    out = M.threshold(M.sigma_map(px, read_rms=2.0, dark_rms=1.0, skycut=2.0, gain=2.0), 2.0)
    return out.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *r("sigma", "sn"))


@query(with_fixtures("f2", "SELECT x::BIGINT AS x, y::BIGINT AS y, segID IN (1, 3, 5, 8) AS found, segID NOT IN (1, 3, 5, 8) AS missing, CASE WHEN flux < 0 THEN NULL ELSE flux::INT IN (10, 20, 30) END AS by_flux FROM f2"))
def scl_membership(spark: SparkSession, d: str) -> DataFrame:
    """SCL-12, SCL-13, JN-3, JN-11."""
    px = f2(spark, d)
    return px.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), M.this_in_that("segID", [1, 3, 5, 8]).alias("found"), M.this_in_that("segID", [1, 3, 5, 8], invert=True).alias("missing"), M.this_in_that(F.col("flux").cast("int"), [10, 20, 30]).alias("by_flux"))


_PROFILE = """f2s AS (SELECT *, (x % 7)::DOUBLE AS sky, 10e0 + y % 5 AS rms FROM f2 WHERE segID > 0 AND mask = 0),
  p AS (SELECT segID, flux, row_number() OVER w AS rn, sum(flux) OVER (w ROWS UNBOUNDED PRECEDING) / nullif(sum(flux) OVER (PARTITION BY segID), 0) AS c, sum(flux) OVER (PARTITION BY segID) AS tot FROM f2s WINDOW w AS (PARTITION BY segID ORDER BY flux, y, x)),
  q AS (SELECT *, lag(c) OVER (PARTITION BY segID ORDER BY rn) AS prev FROM p),
  a AS (SELECT segID, max(tot) AS flux, count(*) AS n, min(rn) FILTER (c >= 0.5) AS l50, min(rn) FILTER (c >= 0.1) AS l90 FROM q GROUP BY 1),
  pr AS (SELECT a.segID, a.flux, n - (l50 - 1) + (0.5 - h.prev) / (h.c - h.prev) AS N50, n - (l90 - 1) + (0.1 - t.prev) / (t.c - t.prev) AS N90, n AS N100, e.c - e.prev AS cenfrac
   FROM a JOIN q h ON h.segID = a.segID AND h.rn = l50 JOIN q t ON t.segID = a.segID AND t.rn = l90 JOIN q e ON e.segID = a.segID AND e.rn = n),
  t AS (SELECT segID, x - 0.5e0 AS xmax, y - 0.5e0 AS ymax FROM (SELECT *, row_number() OVER (PARTITION BY segID ORDER BY flux DESC, y, x) AS rn FROM f2s) WHERE rn = 1),
  u AS (SELECT segID, stddev_samp(sky) AS sd_sky, avg(sky) AS sky_mean, sum(sky) AS sky_sum, sqrt(sum(rms * rms)) AS e_rms, avg(rms) AS skyRMS_mean FROM f2s GROUP BY 1),
  ev AS (SELECT *, (xsd ** 2 + ysd ** 2) / 2 + sqrt(((xsd ** 2 - ysd ** 2) / 2) ** 2 + covxy ** 2) AS hi, (xsd ** 2 + ysd ** 2) / 2 - sqrt(((xsd ** 2 - ysd ** 2) / 2) ** 2 + covxy ** 2) AS lo FROM m),
  sh AS (SELECT *, sqrt(abs(hi) + 0.08333333e0) AS semimaj, sqrt(abs(lo) + 0.08333333e0) AS semimin, sqrt(abs(lo) + 0.08333333e0) / sqrt(abs(hi) + 0.08333333e0) AS axrat, fmod(90 - degrees(atan((xsd ** 2 - hi) / covxy)), 180) AS ang FROM ev),
  j AS (SELECT *, sqrt(N50 / (axrat * pi())) * 0.339e0 AS R50, sqrt(N90 / (axrat * pi())) * 0.339e0 AS R90, sqrt(N100 / (axrat * pi())) * 0.339e0 AS R100, sd_sky * N100 AS e_sky, sqrt(flux) / 2 AS e_shot,
   CASE WHEN N100 <= 10 THEN 0.1e0 WHEN N100 <= 100 THEN 0.1e0 + (N100 - 10) * (0.02e0 - 0.1e0) / 90 ELSE 0.02e0 END AS cor FROM pr JOIN t USING (segID) JOIN u USING (segID) JOIN sh USING (segID)),
  k AS (SELECT *, sqrt(e_sky ** 2 / (1 - cor) - e_sky ** 2) AS e_cor FROM j), z AS (SELECT *, sqrt(e_sky ** 2 + e_rms ** 2 + e_shot ** 2 + e_cor ** 2) AS e FROM k)"""
_SB = lambda n, p: f"-2.5e0 * log10(flux * {p}e0 / {n}) + 30 + 5 * log10(0.339e0)"
_CATALOGUE = {
    "uniqueID": f"ceil(xmax) * 10 ** ceil(log10({NY2} + 1)) + ceil(ymax)", "xcen": "xcen", "ycen": "ycen", "xmax": "xmax", "ymax": "ymax", "sep": "sqrt((xcen - xmax) ** 2 + (ycen - ymax) ** 2) * 0.339e0", "flux": "flux", "mag": "-2.5e0 * log10(flux) + 30", "cenfrac": "cenfrac",
    "N50": "N50", "N90": "N90", "N100": "N100", "R50": "R50", "R90": "R90", "R100": "R100", "SB_N50": _SB("N50", 0.5), "SB_N90": _SB("N90", 0.9), "SB_N100": _SB("N100", 1.0), "xsd": "xsd", "ysd": "ysd", "covxy": "covxy", "corxy": "covxy / (xsd * ysd)", "con": "R50 / R90",
    "semimaj": "semimaj", "semimin": "semimin", "axrat": "axrat", "ang": "ang", "flux_err": "e", "mag_err": "1.0857362047581296e0 * abs(e / flux)", "flux_err_sky": "e_sky", "flux_err_skyRMS": "e_rms", "flux_err_shot": "e_shot", "flux_err_cor": "e_cor", "cor_seg": "cor",
    "sky_mean": "sky_mean", "sky_sum": "sky_sum", "skyRMS_mean": "skyRMS_mean",
}


@query(with_fixtures("f2", f"{_MOMENTS}, {_PROFILE} SELECT segID::BIGINT AS segID, {', '.join(f'round(({e})::DOUBLE, 4) + 0 AS \"{n}\"' for n, e in _CATALOGUE.items())} FROM z"))
def agg_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10 without the columns of :func:`agg_rotated`, :func:`agg_boundary`, sky coordinates and significance, UDF-1."""
    px = f2(spark, d).withColumns({"sky": (F.col("x") % 7).cast("double"), "skyRMS": 10.0 + F.col("y") % 5})
    shares = lambda n: F.when(n <= 10, 0.1).when(n <= 100, 0.1 + (n - 10) * (0.02 - 0.1) / 90).otherwise(0.02)
    cat = S.segment_stats(px, 64, height(spark, d), magzero=30.0, gain=2.0, pixscale=0.339, cor_err=shares)
    return cat.select(F.col("segID").cast("long").alias("segID"), *((F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in _CATALOGUE))


@query()
def agg_segstats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10 with SCL-21, UDF-1 and UDF-2: the whole catalogue; its parts have SQL of their own."""
    px = f2(spark, d).withColumns({"sky": (F.col("x") % 7).cast("double"), "skyRMS": 10.0 + F.col("y") % 5})
    return S.segment_stats(px, 64, height(spark, d), magzero=30.0, gain=2.0, pixscale=0.339, rotstats=True, boundstats=True, cor_err={10.0: 0.1, 100.0: 0.02}, app_diam=1.7, header=HEADER)
