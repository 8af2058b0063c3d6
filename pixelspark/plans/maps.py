"""Queries of ingest, masks and sets (SRC-*, MSK-*, SET-*, SRT-*)."""

from __future__ import annotations

from math import cos, radians, sin
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, units
from ..lineage import shared_folder
from ..model import Run
from ..operators import apertures as A
from ..operators import maps as M
from ..operators import stats as S
from .fixtures import f2, f3, f4, f5, grid, height, table, with_fixtures
from .registry import query
from .statistics import HEADER, r

POLYGON = [(5.0, 20.0), (30.0, 8.0), (58.0, 30.0), (40.0, 60.0), (33.0, 35.0), (12.0, 70.0), (8.0, 50.0)]
_VERTICES = ", ".join(f"({i}, {x!r}e0, {y!r}e0, {POLYGON[i - 1][0]!r}e0, {POLYGON[i - 1][1]!r}e0)" for i, (x, y) in enumerate(POLYGON))
POLY_SQL = f"v(i, x0, y0, x1, y1) AS (VALUES {_VERTICES})"
IN_POLY = "((y0 > {y}) <> (y1 > {y})) AND {x} < (x1 - x0) * ({y} - y0) / nullif(y1 - y0, 0) + x0"


def xy(df: DataFrame) -> list:
    return [F.col(c).cast("long").alias(c) for c in ("x", "y")]


@query(with_fixtures("f3", "SELECT x::BIGINT AS x, y::BIGINT AS y, coalesce(CASE WHEN flux = 100 THEN 0 ELSE flux END, 0) AS flux, (flux IS NULL OR flux = 100)::INT::BIGINT AS mask FROM f3"))
def src_mask(spark: SparkSession, d: str) -> DataFrame:
    """SRC-5, D3: missing pixels and those of the flag value."""
    px = M.with_mask(f3(spark, d), flag=100.0)
    return px.select(*xy(px), "flux", F.col("mask").cast("long").alias("mask"))


@query(with_fixtures("f5", "SELECT band, count(*) AS n, sum(flux) AS flux FROM f5 WHERE band IN ('A', 'R') GROUP BY 1 UNION ALL SELECT 'Z', count(*), sum(flux) FROM f3 WHERE flux IS NOT NULL").replace("\nSELECT band", ", f3 AS (SELECT l_partkey % 100 + 1 AS x, l_suppkey % 100 + 1 AS y, sum(l_quantity) AS flux FROM lineitem GROUP BY 1, 2)\nSELECT band"))
def src_bands(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3, SRC-4, SET-3, SET-6: wanted bands that exist, with another image beside them."""
    px = M.bands_present(f5(spark, d), ["A", "R", "Q"]).unionByName(M.union_bands({"Z": f3(spark, d).where("flux is not null")}))
    return px.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("flux").alias("flux"))


@query(
    with_fixtures("f2", "s(x, y) AS (SELECT i, j FROM (SELECT unnest(generate_series(1, 7)) AS i), (SELECT unnest(generate_series(1, 5)) AS j) WHERE abs(i - 4) + abs(j - 3) < 4), p AS (SELECT (s_suppkey + 1)::INT AS i, 5 + (s_suppkey * 37) % 54 + 0.5e0 AS xcen, 5e0 + (s_suppkey * 91) % 490 AS ycen FROM supplier),"
    f" w AS (SELECT a.x, a.y, min(p.i) AS which FROM f2 a JOIN p ON abs(a.x - p.xcen) < 8 AND abs(a.y - p.ycen) < 8 JOIN s ON s.x = ceil((a.x - 0.5e0 - p.xcen) * {cos(radians(30))!r}e0 + (a.y - 0.5e0 - p.ycen) * {sin(radians(30))!r}e0 + 3.5e0) AND s.y = ceil(-(a.x - 0.5e0 - p.xcen) * {sin(radians(30))!r}e0 + (a.y - 0.5e0 - p.ycen) * {cos(radians(30))!r}e0 + 2.5e0) GROUP BY 1, 2)"
    " SELECT f2.x::BIGINT AS x, f2.y::BIGINT AS y, coalesce(which, 0)::BIGINT AS which FROM f2 LEFT JOIN w ON w.x = f2.x AND w.y = f2.y")
)
def msk_stamp(spark: SparkSession, d: str) -> DataFrame:
    """MSK-1, SCL-19: the first stamp over each pixel; a diamond turned by 30 degrees."""
    px = f2(spark, d)
    stamp = spark.range(1, 8).selectExpr("cast(id as int) as x", "explode(sequence(1, 5)) as y").withColumn("mask", (F.abs(F.col("x") - 4) + F.abs(F.col("y") - 3) < 4).cast("int"))
    k = F.col("s_suppkey")
    places = table(spark, d, "supplier").select((k + 1).cast("int").alias("i"), (5 + (k * 37) % 54 + F.lit(0.5)).alias("xcen"), (F.lit(5.0) + (k * 91) % 490).alias("ycen"))
    out = M.stamp_mask(px, stamp, places, 7, 5, 30.0)
    return out.select(*xy(out), F.col("which").cast("long").alias("which"))


@query(with_fixtures("f2", f"{POLY_SQL} SELECT f2.x::BIGINT AS x, f2.y::BIGINT AS y, (count(*) FILTER ({IN_POLY.format(x='(f2.x - 0.5e0)', y='(f2.y - 0.5e0)')}) % 2)::BIGINT AS mask FROM f2, v GROUP BY 1, 2"))
def msk_polygon(spark: SparkSession, d: str) -> DataFrame:
    """MSK-2, SEG-20, APR-6 at depth 0."""
    px = A.polygon_mask(f2(spark, d).drop("mask"), POLYGON)
    return px.select(*xy(px), F.col("mask").cast("long").alias("mask"))


@query(with_fixtures("f2", "SELECT segID::BIGINT AS segID, sum(flux) AS flux, count(flux) AS N100 FROM f2 WHERE segID > 0 AND mask = 0 GROUP BY 1 ORDER BY flux DESC, segID"))
def srt_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """SRT-1, SRT-2: a catalogue sorted by a column."""
    return S.segment_flux(f2(spark, d)).select(F.col("segID").cast("long").alias("segID"), "flux", "N100").orderBy(F.desc("flux"), "segID")


@query(with_fixtures("f2", "SELECT x::BIGINT AS x, y::BIGINT AS y, round(least(-2.5e0 * log10((10 + y % 5) * 2e0) + 30 + 5 * log10(0.339e0), 24.2e0), 5) AS SBlim FROM f2"))
def pip_sblimit(spark: SparkSession, d: str) -> DataFrame:
    """PIP-6, SCL-3."""
    px = M.sb_limit_map(f2(spark, d).withColumn("skyRMS", 10.0 + F.col("y") % 5), 2.0, 30.0, 0.339, cap=24.2)
    return px.select(*xy(px), *r("SBlim", digits=5))


@query("SELECT x::BIGINT AS x, y::BIGINT AS y, CASE WHEN x = 3 AND y = 2 THEN NULL ELSE x * 10e0 + y END AS flux FROM (SELECT unnest(generate_series(1, 6)) AS x), (SELECT unnest(generate_series(1, 4)) AS y)")
def src_array(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1: an image from memory."""
    px = M.pixels_from_array(spark, [[float("nan") if (x, y) == (3, 2) else x * 10.0 + y for y in range(1, 5)] for x in range(1, 7)])
    return px.select(*xy(px), "flux")


@query(
    """WITH h AS (SELECT s_suppkey AS k, -0.0001e0 - (s_suppkey % 5) * 0.00001e0 AS a, 0.00002e0 AS b, 0.00001e0 * (s_suppkey % 3) AS c, 0.0001e0 AS d FROM supplier)
  SELECT k::BIGINT AS k, round(3600 * sqrt(abs(a * d - b * c)), 9) AS pixscale, round((1000 + k) * 2000e0 * abs(a * d - b * c), 9) AS area FROM h"""
)
def src_header(spark: SparkSession, d: str) -> DataFrame:
    """SRC-6, SRC-7: pixel scale and area of images from their headers."""
    k = F.col("s_suppkey")
    values = {"CD1_1": -0.0001 - (k % 5) * F.lit(0.00001), "CD1_2": F.lit(0.00002), "CD2_1": F.lit(0.00001) * (k % 3), "CD2_2": F.lit(0.0001)}
    rows = table(spark, d, "supplier").select(k.alias("k"), F.create_map(*(c for n, v in values.items() for c in (F.lit(n), v.cast("string")))).alias("keyvalues"))
    scale = geometry.pixel_scale()
    return rows.select(F.col("k").cast("long").alias("k"), F.round(scale, 9).alias("pixscale"), F.round(units.image_area(1000.0 + F.col("k"), 2000.0, scale), 9).alias("area"))


@query(
    with_fixtures(
        "f4",
        """p AS (SELECT k, cx + 0.5e0 AS x, cy + 0.5e0 AS y FROM f4), q AS (SELECT *, radians(-0.0001e0 * (x - 32.5e0) + 0.00002e0 * (y - 250.5e0)) AS xi, radians(0.00002e0 * (x - 32.5e0) + 0.0001e0 * (y - 250.5e0)) AS eta, cos(radians(2e0)) AS c, sin(radians(2e0)) AS s FROM p)
  SELECT k::BIGINT AS k, round(150 + degrees(atan2(xi, c - eta * s)), 9) AS ra, round(degrees(atan2(s + eta * c, sqrt(xi * xi + (c - eta * s) ** 2))), 9) AS dec, round(x, 6) AS x, round(y, 6) AS y FROM q""",
    )
)
def scl_sky(spark: SparkSession, d: str) -> DataFrame:
    """SCL-20: positions to sky coordinates and back."""
    header = F.create_map(*(F.lit(v) for k, x in HEADER.items() for v in (k, str(x))))
    ra, dec = geometry.tan_pixel_to_sky(F.col("cx") + 0.5, F.col("cy") + 0.5)
    out = f4(spark, d).withColumn("keyvalues", header).withColumns({"ra": ra, "dec": dec})
    x, y = geometry.tan_sky_to_pixel("ra", "dec")
    return out.select(F.col("k").cast("long").alias("k"), *r("ra", "dec", digits=9), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(with_fixtures("f2", "s AS (SELECT segID, sum(flux) AS flux FROM f2 WHERE segID > 0 AND mask = 0 GROUP BY 1) SELECT (segID // 10)::BIGINT AS groupID, segID::BIGINT AS segID, flux, row_number() OVER (ORDER BY segID // 10, flux DESC, segID) AS place FROM s"))
def srt_composite(spark: SparkSession, d: str) -> DataFrame:
    """SRT-3: by group, the brightest of each first; ``place`` numbers the sorted rows."""
    cat = S.segment_flux(f2(spark, d)).withColumn("groupID", F.expr("segID div 10"))
    per = Window.partitionBy("groupID").orderBy(F.desc("flux"), "segID")
    sizes = cat.groupBy("groupID").agg(F.count(F.lit(1)).alias("n"))  # one small row for each group
    sizes = sizes.withColumn("start", F.sum("n").over(Window.orderBy("groupID")) - F.col("n"))
    out = cat.withColumn("rank", F.row_number().over(per)).join(sizes, "groupID").orderBy("groupID", F.desc("flux"), "segID")
    return out.select(F.col("groupID").cast("long").alias("groupID"), F.col("segID").cast("long").alias("segID"), "flux", (F.col("start") + F.col("rank")).alias("place"))


@query(with_fixtures("f2", "SELECT DISTINCT segID::BIGINT AS segID FROM f2"))
def set_distinct(spark: SparkSession, d: str) -> DataFrame:
    """SET-1: the labels of a map."""
    return f2(spark, d).select(F.col("segID").cast("long").alias("segID")).distinct()


@query(with_fixtures("f2", "SELECT x::BIGINT AS x, y::BIGINT AS y FROM (SELECT unnest(generate_series(1, 64)) AS x), (SELECT unnest(generate_series(1, (SELECT max(y) FROM f2))) AS y)"))
def set_grid(spark: SparkSession, d: str) -> DataFrame:
    """SET-5: every pixel of the image."""
    out = grid(spark, 64, height(spark, d))
    return out.select(*xy(out))


@query(with_fixtures("f5", "SELECT band, count(*) AS n, sum(flux) AS flux FROM f5 GROUP BY 1 UNION ALL SELECT 'all', count(*), sum(flux) FROM f5"))
def snk_run(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1: maps and catalogues of a run, written by image and read again."""
    px = f5(spark, d).withColumnRenamed("band", "image_id")
    path = f"{shared_folder(spark)}/run-{uuid4().hex[:12]}"
    Run({"pixels": px, "total": px.agg(F.count(F.lit(1)).alias("n"), F.sum("flux").alias("flux"))}).write(path)
    each = spark.read.parquet(f"{path}/pixels").groupBy(F.col("image_id").cast("string").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("flux").alias("flux"))
    return each.unionByName(spark.read.parquet(f"{path}/total").withColumn("band", F.lit("all")))
