"""Queries of the catalogue family (CAT-*, DBL-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogues as C
from ..operators import stats as S
from .fixtures import f2, f4, f5, grid, with_fixtures
from .maps import xy
from .registry import query
from .statistics import r

CONFIG = {"A": (25.0, 10.0), "N": (26.0, 20.0), "R": (27.0, 20.0)}
_CASE = "CASE band " + " ".join(f"WHEN '{b}' THEN {10 ** (-0.4 * (z - 25.0))!r}e0" for b, (z, _) in CONFIG.items()) + " END"
_RMS = "CASE band WHEN 'A' THEN 10e0 ELSE 20e0 END"


@query(with_fixtures("f5", f"s AS (SELECT x, y, flux * {_CASE} AS v, 1 / ({_RMS} * {_CASE}) ** 2 AS w FROM f5) SELECT x::BIGINT AS x, y::BIGINT AS y, round(sum(v * w) / sum(w), 5) AS flux, round(1 / sqrt(sum(w)), 6) AS skyRMS, count(*) AS Nband FROM s GROUP BY 1, 2"))
def cat_stack(spark: SparkSession, d: str) -> DataFrame:
    """CAT-3."""
    out = C.stack(f5(spark, d), CONFIG, 25.0)
    return out.select(*xy(out), *r("flux", digits=5), *r("skyRMS"), "Nband")


def _mag(b: str, z: float) -> str:
    f = f"sum(flux) FILTER (band = '{b}')"
    return f'{f} AS "flux_{b}t", count(*) FILTER (band = \'{b}\') AS "N100_{b}t", CASE WHEN {f} > 0 THEN round(-2.5e0 * log10({f}) + {z}, 5) END AS "mag_{b}t"'


@query(with_fixtures("f5", f"SELECT ((x - 1) // 10 + 10 * ((y - 1) // 10) + 1)::BIGINT AS segID, {', '.join(_mag(b, z) for b, (z, _) in CONFIG.items())} FROM f5 GROUP BY 1"))
def cat_multiband_wide(spark: SparkSession, d: str) -> DataFrame:
    """CAT-2, JN-10: all bands in one grouping, then columns for each band."""
    seg = grid(spark, 100, 100).withColumn("segID", F.expr("(x - 1) div 10 + 10 * ((y - 1) div 10) + 1").cast("int"))
    wide = C.bands_wide(C.band_photometry(f5(spark, d), seg, {b: z for b, (z, _) in CONFIG.items()}), list(CONFIG), ["flux", "N100", "mag"])
    return wide.select(F.col("segID").cast("long").alias("segID"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) if c.startswith("N100") else F.round(c, 5).alias(c) if c.startswith("mag") else F.col(c) for c in wide.columns if c != "segID"))


@query(
    with_fixtures(
        "f2",
        """s AS (SELECT segID, sum(flux) AS flux, count(*) AS N100 FROM f2 WHERE segID > 0 GROUP BY 1)
  SELECT segID::BIGINT AS segID, flux, N100, 'seg' AS origin FROM s WHERE segID NOT IN (1, 2, 9, 10, 3, 4) UNION ALL SELECT min(segID), sum(flux), sum(N100)::BIGINT, 'group' FROM s WHERE segID IN (1, 2, 9, 10) UNION ALL SELECT min(segID), sum(flux), sum(N100)::BIGINT, 'group' FROM s WHERE segID IN (3, 4)""",
    )
)
def cat_merge(spark: SparkSession, d: str) -> DataFrame:
    """CAT-1."""
    groups = spark.createDataFrame([(1, [1, 2, 9, 10]), (3, [3, 4]), (20, [20, 21])], "groupID int, segIDs array<int>")
    stats = S.segment_flux(f2(spark, d).drop("mask"))
    both = groups.select("groupID", F.explode("segIDs").alias("segID")).join(stats, "segID").groupBy("groupID").agg(F.sum("flux").alias("flux"), F.sum("N100").alias("N100"))
    out = C.merge_groups(stats, both, groups, [1, 3])
    return out.select(F.col("segID").cast("long").alias("segID"), "flux", "N100", "origin")


@query(
    with_fixtures(
        "f2",
        """s AS (SELECT segID, sum(flux) AS flux, count(*) AS n FROM f2 WHERE segID > 0 AND mask = 0 GROUP BY 1), w AS (SELECT segID, segID % 7 AS outID, 1.0 + segID % 3 AS w FROM s UNION ALL SELECT segID, (segID + 1) % 7, 2.0 FROM s),
  t AS (SELECT w.*, w / sum(w) OVER (PARTITION BY segID) AS p FROM w) SELECT outID::BIGINT AS outID, round(sum(p * flux), 5) AS flux, round(sum(p * n), 5) AS N100, round(sum(p * 10 ** (-0.4e0 * (-2.5e0 * log10(flux) + 30))), 9) AS fluxmag FROM t JOIN s USING (segID) WHERE flux > 0 GROUP BY 1""",
    )
)
def dbl_share(spark: SparkSession, d: str) -> DataFrame:
    """DBL-7."""
    stats = S.flux_profile(f2(spark, d)).where("flux > 0").withColumn("mag", -2.5 * F.log10("flux") + 30)
    one = stats.select("segID", (F.col("segID") % 7).alias("outID"), (1.0 + F.col("segID") % 3).alias("w"))
    share = one.unionByName(stats.select("segID", ((F.col("segID") + 1) % 7).alias("outID"), F.lit(2.0).alias("w")))
    out = C.share_flux(stats, share, normalise=True)
    return out.select(F.col("outID").cast("long").alias("outID"), *r("flux", "N100", digits=5), *r("fluxmag", digits=9))


@query(
    with_fixtures(
        "f4",
        "p AS (SELECT a.k, b.k AS match, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS dist FROM f4 a JOIN f4 b ON a.k % 2 = 0 AND b.k % 2 = 1) SELECT k::BIGINT AS segID, match::BIGINT AS match, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dist, match) AS rn FROM p WHERE dist <= 60) WHERE rn = 1",
    )
)
def jn_nearest(spark: SparkSession, d: str) -> DataFrame:
    """JN-9."""
    src = f4(spark, d).select(F.col("k").alias("segID"), F.col("cx").alias("xcen"), F.col("cy").alias("ycen"))
    out = C.nearest(src.where("segID % 2 = 0"), src.where("segID % 2 = 1"), 60.0)
    return out.select(F.col("segID").cast("long").alias("segID"), F.col("match").cast("long").alias("match"), *r("dist"))


@query(with_fixtures("f2 f4", "SELECT k::BIGINT AS k, segID::BIGINT AS label FROM f4 LEFT JOIN f2 ON f2.x = ceil(cx) AND f2.y = ceil(cy)"))
def jn_label_at(spark: SparkSession, d: str) -> DataFrame:
    """JN-8."""
    out = C.label_at(f4(spark, d), f2(spark, d), "cx", "cy")
    return out.select(F.col("k").cast("long").alias("k"), F.col("label").cast("long").alias("label"))
