"""Queries of the sky family (SKY-*)."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sky as K
from .fixtures import f3, with_fixtures
from .maps import xy
from .registry import query
from .statistics import r

_TILES = """t AS (SELECT gx, gy, x, y, flux FROM f3, (SELECT unnest(generate_series(0, 4)) AS gx), (SELECT unnest(generate_series(0, 4)) AS gy)
  WHERE flux IS NOT NULL AND x BETWEEN gx * 20 + 10 - 10 AND gx * 20 + 10 + 10 AND y BETWEEN gy * 20 + 10 - 10 AND gy * 20 + 10 + 10)"""
P = 0.31731050786291415  # 2 * Phi(-1)
_STATS = f"""s AS (SELECT gx, gy, quantile_cont(flux, 0.5) AS sky, count(*) AS n FROM {{t}} GROUP BY 1, 2),
  q AS (SELECT gx, gy, any_value(sky) AS sky, any_value(n) AS n, abs(quantile_cont(flux - sky, {P}) FILTER (flux < sky)) AS skyRMS FROM {{t}} JOIN s USING (gx, gy) GROUP BY 1, 2)"""


@query(with_fixtures("f3", _TILES + ", " + _STATS.format(t="t") + " SELECT gx::BIGINT AS gx, gy::BIGINT AS gy, round(sky, 5) AS sky, round(skyRMS, 5) AS skyRMS, n FROM q"))
def sky_tile_stats(spark: SparkSession, d: str) -> DataFrame:
    """SKY-2, SKY-3, SKY-5, SKY-7."""
    got = K.tile_stats(K.tile_windows(f3(spark, d), 20, 20, 100, 100))
    return got.select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), *r("sky", "skyRMS", digits=5), F.col("n").cast("long").alias("n"))


# the quantile of 1 - 2 / n by the rational approximation that the clip uses
_Q = "sqrt(-2 * ln(2e0 / greatest(n, 4)))"
_AUTO = f"({_Q} - (2.515517e0 + 0.802853e0 * {_Q} + 0.010328e0 * {_Q} * {_Q}) / (1 + 1.432788e0 * {_Q} + 0.189269e0 * {_Q} * {_Q} + 0.001308e0 * {_Q} * {_Q} * {_Q}))"


def _round(i: int, limit: str = "2e0") -> str:
    return f"""r{i} AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY flux, y, x) AS rn, count(*) OVER (PARTITION BY gx, gy) AS n FROM t{i}),
  m{i} AS (SELECT *, max(CASE WHEN rn = greatest(n // 2, 1) THEN flux END) OVER (PARTITION BY gx, gy) AS med,
   coalesce(max(CASE WHEN rn = floor({P / 2} * n - 1) + 1 THEN flux END) OVER (PARTITION BY gx, gy), min(flux) OVER (PARTITION BY gx, gy)) AS lo FROM r{i}),
  t{i + 1} AS (SELECT gx, gy, x, y, flux FROM m{i} WHERE abs(flux - med) <= {limit} * (med - lo) / 1.0)"""


@query(with_fixtures("f3", _TILES.replace("t AS", "t0 AS") + ", " + ", ".join(_round(i) for i in range(5)) + ", " + _STATS.format(t="t5") + " SELECT gx::BIGINT AS gx, gy::BIGINT AS gy, round(sky, 5) AS sky, round(skyRMS, 5) AS skyRMS, n FROM q"))
def sky_tile_clip(spark: SparkSession, d: str) -> DataFrame:
    """SKY-1 with a clip at two sigma."""
    got = K.tile_stats(K.clip(K.tile_windows(f3(spark, d), 20, 20, 100, 100), sigma=2.0))
    return got.select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), *r("sky", "skyRMS", digits=5), F.col("n").cast("long").alias("n"))


def _pad(*columns: str) -> str:
    both = ", ".join(f"2 * a.{c} - b.{c}" for c in columns)
    names = ", ".join(columns)
    return f"""h AS (SELECT gx, gy, {names} FROM q),
  e AS (SELECT gx, gy, {names} FROM h UNION ALL SELECT -1, a.gy, {both} FROM h a JOIN h b ON a.gy = b.gy WHERE a.gx = 0 AND b.gx = 1 UNION ALL SELECT 5, a.gy, {both} FROM h a JOIN h b ON a.gy = b.gy WHERE a.gx = 4 AND b.gx = 3),
  p AS (SELECT gx, gy, {names} FROM e UNION ALL SELECT a.gx, -1, {both} FROM e a JOIN e b ON a.gx = b.gx WHERE a.gy = 0 AND b.gy = 1 UNION ALL SELECT a.gx, 5, {both} FROM e a JOIN e b ON a.gx = b.gx WHERE a.gy = 4 AND b.gy = 3)"""


def _between(*columns: str, more: str = "") -> str:
    values = ", ".join(f"round(a.{c} * (1 - fx) * (1 - fy) + b.{c} * fx * (1 - fy) + g.{c} * (1 - fx) * fy + k.{c} * fx * fy, 8) AS {c}" for c in columns)
    return f"""c AS (SELECT x, y, flux, floor((x - 10.5e0) / 20) AS ix, floor((y - 10.5e0) / 20) AS iy, (x - 10.5e0) / 20 - floor((x - 10.5e0) / 20) AS fx, (y - 10.5e0) / 20 - floor((y - 10.5e0) / 20) AS fy FROM f3)
  SELECT x::BIGINT AS x, y::BIGINT AS y, {more}{values} FROM c
  JOIN p a ON a.gx = ix AND a.gy = iy JOIN p b ON b.gx = ix + 1 AND b.gy = iy JOIN p g ON g.gx = ix AND g.gy = iy + 1 JOIN p k ON k.gx = ix + 1 AND k.gy = iy + 1"""


@query(with_fixtures("f3", ", ".join((_TILES, _STATS.format(t="t"), _pad("sky"), _between("sky")))))
def sky_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """SKY-8, SKY-9, SKY-10."""
    px = f3(spark, d)
    got = K.tile_stats(K.tile_windows(px, 20, 20, 100, 100)).select("gx", "gy", "sky")
    out = K.bilinear(px.select("x", "y"), K.pad_grid(got, 5, 5, ("sky",)), 20, ("sky",))
    return out.select(*xy(out), *r("sky", digits=8))


@query()
def sky_bicubic(spark: SparkSession, d: str) -> DataFrame:
    """SKY-11; compared with a numpy model in the tests."""
    px = f3(spark, d)
    got = K.tile_stats(K.tile_windows(px, 20, 20, 100, 100)).select("gx", "gy", "sky")
    return K.bicubic(px.select("x", "y"), K.pad_grid(got, 5, 5, ("sky",)), 20, "sky")


@query(
    with_fixtures(
        "f3",
        """l AS (SELECT y, quantile_cont(flux, 0.4) AS q FROM f3 GROUP BY 1), s AS (SELECT y, q - (SELECT quantile_cont(q, 0.5) FROM l) AS d FROM l),
  t AS (SELECT a.y, a.d, quantile_cont(b.d, 0.5) AS m FROM s a JOIN s b ON abs(a.y - b.y) <= least(10, a.y - 1, 100 - a.y) GROUP BY 1, 2)
  SELECT f3.x::BIGINT AS x, f3.y::BIGINT AS y, round(flux - coalesce(d - m, 0), 6) + 0 AS flux FROM f3 JOIN t ON t.y = f3.y""",
    )
)
def sky_scan(spark: SparkSession, d: str) -> DataFrame:
    """SKY-16, WIN-4, AGG-22: rows corrected by their quantile less its running median."""
    px = f3(spark, d)
    out = K.scan_correct(px, K.line_scan(px, "y", 0.4))
    return out.select(*xy(out), *r("flux"))


@query(
    with_fixtures(
        "f3",
        """m AS (SELECT avg((x - 0.5e0) / 100) AS u, avg((y - 0.5e0) / 100) AS v, avg(flux) AS f, var_pop((x - 0.5e0) / 100) AS uu, var_pop((y - 0.5e0) / 100) AS vv, covar_pop((x - 0.5e0) / 100, (y - 0.5e0) / 100) AS uv,
   covar_pop((x - 0.5e0) / 100, flux) AS uf, covar_pop((y - 0.5e0) / 100, flux) AS vf FROM f3 WHERE flux IS NOT NULL),
  b AS (SELECT *, (uf * vv - vf * uv) / (uu * vv - uv * uv) AS b1, (vf * uu - uf * uv) / (uu * vv - uv * uv) AS b2 FROM m)
  SELECT x::BIGINT AS x, y::BIGINT AS y, round(f + b1 * ((x - 0.5e0) / 100 - u) + b2 * ((y - 0.5e0) / 100 - v), 4) AS sky FROM f3, b""",
    )
)
def sky_poly(spark: SparkSession, d: str) -> DataFrame:
    """SKY-17, SKY-18: a plane by least squares."""
    out, _ = K.poly_sky(f3(spark, d), 1, 100, 100)
    return out.select(*xy(out), *r("sky", digits=4))


@query(with_fixtures("f3", "SELECT (CASE WHEN x <= 50 THEN 1 ELSE 2 END)::BIGINT AS region, round(quantile_cont(flux, 0.5), 6) AS sky, count(*) AS n FROM f3 WHERE flux IS NOT NULL GROUP BY 1"))
def sky_disco(spark: SparkSession, d: str) -> DataFrame:
    """SKY-19, SKY-21, UDF-4."""
    px = f3(spark, d).withColumn("region", F.when(F.col("x") <= 50, 1).otherwise(2))
    return K.by_region(px).select(F.col("region").cast("long").alias("region"), *r("sky"), "n")


@query(with_fixtures("f3", "SELECT (CASE WHEN x <= 50 THEN 1 ELSE 2 END)::BIGINT AS region, round(CASE WHEN x <= 50 THEN quantile_cont(flux, 0.3) FILTER (flux <= 200) ELSE quantile_cont(flux, 0.5) END, 6) AS sky, count(*) FILTER (x > 50 OR flux <= 200) AS n FROM f3 WHERE flux IS NOT NULL GROUP BY x <= 50").replace("CASE WHEN x <= 50 THEN 1 ELSE 2 END", "CASE WHEN any_value(x) <= 50 THEN 1 ELSE 2 END").replace("CASE WHEN x <= 50 THEN quantile", "CASE WHEN any_value(x) <= 50 THEN quantile"))
def sky_disco_arguments(spark: SparkSession, d: str) -> DataFrame:
    """SKY-19, UDF-4: a quantile and a limit of one region's own."""
    px = f3(spark, d).withColumn("region", F.when(F.col("x") <= 50, 1).otherwise(2))
    own = spark.createDataFrame([(1, 0.3, 200.0)], "region int, quantile double, limit double")
    return K.by_region(px, arguments=own).select(F.col("region").cast("long").alias("region"), *r("sky"), "n")


_GROWN = """l AS (SELECT gx, gy, x, y, flux, greatest(0, ceil((greatest(abs(x - gx * 20 - 10), abs(y - gy * 20 - 10)) - 10) / 5e0)) AS ring
  FROM f3, (SELECT unnest(generate_series(0, 4)) AS gx), (SELECT unnest(generate_series(0, 4)) AS gy) WHERE flux IS NOT NULL AND abs(x - gx * 20 - 10) <= 20 AND abs(y - gy * 20 - 10) <= 20),
  u AS (SELECT gx, gy, CASE WHEN count(*) FILTER (ring <= 0) >= 380 THEN 0 WHEN count(*) FILTER (ring <= 1) >= 380 THEN 1 ELSE 2 END AS used FROM l GROUP BY 1, 2),
  t0 AS (SELECT gx, gy, x, y, flux FROM l JOIN u USING (gx, gy) WHERE ring <= used)"""


@query(with_fixtures("f3", ", ".join((_GROWN, *(_round(i, _AUTO) for i in range(5)), _STATS.format(t="t5"), _pad("sky", "skyRMS"), _between("sky", "skyRMS", more="flux, ")))))
def sky_map(spark: SparkSession, d: str) -> DataFrame:
    """SKY-8 with the automatic clip, growing boxes (SKY-2) and both maps."""
    got = K.sky_map(f3(spark, d), 100, 100, grid=20, box=20, skypixmin=380, boxadd=10, boxiters=2)
    return got.select(*xy(got), "flux", *r("sky", "skyRMS", digits=8))


@query(
    with_fixtures(
        "f3",
        _TILES
        + f""", v AS (SELECT gx, gy, min(flux) AS a, max(flux) AS z, 0.9e0 * least(stddev_samp(flux), (quantile_cont(flux, 0.75) - quantile_cont(flux, 0.25)) / 1.34e0) * pow(count(*), -0.2e0) AS bw FROM t GROUP BY 1, 2),
  b AS (SELECT gx, gy, bw, a - 3 * bw AS lo, (z - a + 6 * bw) / 511 AS step FROM v),
  o AS (SELECT gx, gy, (flux - lo) / step AS place FROM t JOIN b USING (gx, gy)), f AS (SELECT gx, gy, place, least(floor(place), 510) AS j FROM o),
  w AS (SELECT gx, gy, j, sum(w) AS w FROM (SELECT gx, gy, j, j + 1 - place AS w FROM f UNION ALL SELECT gx, gy, j + 1, place - j FROM f) GROUP BY 1, 2, 3),
  k AS (SELECT gx, gy, i, any_value(lo + i * step) AS spot, sum(w * exp(-0.5e0 * ((i - j) * step / bw) ** 2)) AS density FROM w JOIN b USING (gx, gy), (SELECT unnest(generate_series(0, 511)) AS i) GROUP BY 1, 2, 3),
  s AS (SELECT gx, gy, arg_max(spot, density) AS sky FROM k GROUP BY 1, 2), d AS (SELECT gx, gy, sky, flux - sky AS d FROM t JOIN s USING (gx, gy))
  SELECT gx::BIGINT AS gx, gy::BIGINT AS gy, round(any_value(sky), 5) AS sky, count(*) AS n, round(avg(d * d) FILTER (d < 0), 4) AS below,
   round((abs(quantile_cont(d, {P}) FILTER (d < 0)) + abs(quantile_cont(d, {1 - P!r}) FILTER (d > 0))) / 2, 5) AS skyRMS FROM d GROUP BY 1, 2""",
    )
)
def sky_mode(spark: SparkSession, d: str) -> DataFrame:
    """SKY-4: density mode of each tile."""
    got = K.tile_stats(K.tile_windows(f3(spark, d), 20, 20, 100, 100), skytype="mode", rmstype="quanboth")
    return got.select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), *r("sky", "skyRMS", digits=5), *r("below", digits=4), F.col("n").cast("long").alias("n"))


@query()
def sky_converge(spark: SparkSession, d: str) -> DataFrame:
    """SKY-4 (converge), SKY-6; compared with a plain model in the tests."""
    return K.tile_stats(K.tile_windows(f3(spark, d), 20, 20, 100, 100), skytype="converge", rmstype="converge")


_EACH = "list_transform(generate_series(1, len(m)), lambda k: CASE WHEN near[k] THEN {} ELSE 0e0 END)"
_MEAN = f"list_sum({_EACH.format('m[k] / (e[k] * e[k])')}) / list_sum({_EACH.format('1 / (e[k] * e[k])')})"
_NEAR = "list_transform(generate_series(1, len(m)), lambda k: abs(m[k] - sky) <= e[k])"


@query(
    with_fixtures(
        "f3",
        """t0 AS (SELECT 0 AS gx, 0 AS gy, x, y, flux FROM f3 WHERE flux IS NOT NULL AND sqrt((x - 50.5e0) ** 2 + (y - 50.5e0) ** 2) BETWEEN 10 AND 45), """
        + ", ".join(_round(i, _AUTO) for i in range(5))
        + f""", a AS (SELECT flux, ntile(10) OVER (ORDER BY sqrt((x - 50.5e0) ** 2 + (y - 50.5e0) ** 2), y, x) AS ring FROM t5),
  g AS (SELECT ring, quantile_cont(flux, 0.5) AS m, stddev_samp(flux) AS s, count(*)::DOUBLE AS n FROM a GROUP BY 1),
  l AS (SELECT list(m ORDER BY ring) AS m, list(s / sqrt(n) ORDER BY ring) AS e, list(n ORDER BY ring) AS n, stddev_samp(m) AS skyerr FROM g WHERE s > 0),
  it(i, near, number, done) AS (SELECT 0, list_transform(m, lambda v: true), -1, false FROM l UNION ALL SELECT i + 1, nxt, len(list_filter(nxt, lambda v: v)), len(list_filter(nxt, lambda v: v)) = number
   FROM (SELECT i, number, {_NEAR} AS nxt FROM (SELECT it.*, m, e, {_MEAN} AS sky FROM it, l WHERE NOT done))),
  z AS (SELECT near FROM it WHERE done), b AS (SELECT near FROM it WHERE i = (SELECT max(i) - 1 FROM it)),
  k AS (SELECT {_MEAN} AS sky FROM b, l)
  SELECT round(sky, 5) AS sky, round(skyerr, 5) AS skyerr, round(list_sum({_EACH.format('e[k]')}) / list_sum({_EACH.format('1e0')}) * sqrt(list_sum({_EACH.format('n[k]')}) / list_sum({_EACH.format('1e0')})), 5) AS skyRMS,
   len(list_filter(near, lambda v: v))::BIGINT AS Nnear FROM z, l, k""",
        recursive=True,
    )
)
def sky_annulus(spark: SparkSession, d: str) -> DataFrame:
    """SKY-13."""
    return K.annulus_sky(f3(spark, d), 50.0, 50.0, 10.0, 45.0).select(*r("sky", "skyerr", "skyRMS", digits=5), "Nnear")


_LINE = ", ".join(f"({i}, {exp(-i * i / 4.5)!r}e0)" for i in range(-6, 7))


def _chisel_round(i: int) -> str:
    return f"""k{i} AS (SELECT quantile_cont(smooth, 0.95) AS cut, quantile_cont(smooth, 0.5) AS mid FROM o{i} WHERE objects = 0),
  w{i} AS (SELECT o.*, CASE WHEN smooth > cut AND smooth - mid > 0 THEN 1 ELSE 0 END AS new FROM o{i} o, k{i}), h{i} AS (SELECT avg((new <> objects)::INT) AS changed FROM w{i}),
  o{i + 1} AS (SELECT x, y, flux, smooth, CASE WHEN done THEN objects ELSE greatest(objects, new) END AS objects, done OR changed < 0.01 AS done FROM w{i}, h{i})"""


@query(
    with_fixtures(
        "f3",
        f"""line(d, w) AS (VALUES {_LINE}),
  o0 AS (SELECT f3.x, f3.y, any_value(f3.flux) AS flux, sum(n.flux * a.w * c.w) / sum(a.w * c.w) AS smooth, 0 AS objects, false AS done FROM f3, line a, line c JOIN f3 n ON n.x = f3.x + a.d AND n.y = f3.y + c.d WHERE n.flux IS NOT NULL GROUP BY 1, 2),
  {", ".join(_chisel_round(i) for i in range(5))} SELECT x::BIGINT AS x, y::BIGINT AS y, flux, objects::BIGINT AS objects FROM o5""",
    )
)
def sky_chisel(spark: SparkSession, d: str) -> DataFrame:
    """SKY-15, SKY-14."""
    out = K.chisel(f3(spark, d), 0.95, 1.5)
    return out.select(*xy(out), "flux", F.col("objects").cast("long").alias("objects"))


@query()
def sky_fft(spark: SparkSession, d: str) -> DataFrame:
    """SKY-20, D17."""
    return K.split_fft(f3(spark, d).withColumn("objects", F.lit(0)), 10.0)
