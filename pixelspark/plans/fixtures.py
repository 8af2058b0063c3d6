"""Images built from the driver's tables, in Spark and in DuckDB SQL.

F1 real-valued image; F2 integer-valued image with mask and labels; F3 sky image with holes; F4
apertures on F2; F5 three bands; F6 sparse counts.  ``SQL`` holds the same relations as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The height of F2 in its SQL.
NY2 = "(SELECT max(y) FROM f2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    return rows.select((F.col("pos") + 1).cast("int").alias("x"), (F.col("vec_id") + 1).cast("int").alias("y"), F.col("v").cast("double").alias("flux"), (F.col("label") + 1).cast("int").alias("segID"))


def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    flux = f1(spark, sf_dir).select("x", "y", F.floor(F.col("flux") * 1000).cast("double").alias("flux"))
    block = F.expr("(x - 1) div 8 + 8 * ((y - 1) div 10) + 1").cast("int")
    return flux.select("x", "y", "flux", F.when(F.col("flux") < -300, 1).otherwise(0).alias("mask"), F.when(F.col("flux") > 0, block).otherwise(0).alias("segID"))


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of F2: the largest y of the whole table."""
    return table(spark, sf_dir, "embeddings").agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)).cast("int")).first()[0]


def grid(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """SET-5: every pixel of an image."""
    xs = spark.range(1, nx + 1).select(F.col("id").cast("int").alias("x"))
    return xs.select("x", F.explode(F.sequence(F.lit(1), F.lit(ny))).alias("y"))


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 100 + 1).cast("int").alias("x"), (F.col("l_suppkey") % 100 + 1).cast("int").alias("y")).agg(F.sum("l_quantity").alias("flux"))
    return grid(spark, 100, 100).join(sums, ["x", "y"], "left")


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (k + 1).cast("int").alias("k"), (5 + (k * 37) % 54 + F.lit(0.5)).alias("cx"), (F.lit(5.0) + (k * 91) % 490).alias("cy"), (F.lit(2.0) + k % 4).alias("rad"), (F.lit(0.0) + (k * 29) % 180).alias("ang"), (F.lit(0.3) + F.lit(0.1) * (k % 8)).alias("axrat")
    )


def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy((F.col("l_partkey") % 100 + 1).cast("int").alias("x"), (F.col("l_suppkey") % 100 + 1).cast("int").alias("y"), F.col("l_returnflag").alias("band")).agg(F.sum("l_quantity").alias("flux"))


def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")) + 1
    return table(spark, sf_dir, "events").groupBy(day.cast("int").alias("x"), (F.col("user_id") + 1).cast("int").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("flux"))


_F1 = "SELECT generate_subscripts(embedding, 1)::INT AS x, (vec_id + 1)::INT AS y, unnest(embedding)::DOUBLE AS flux, (label + 1)::INT AS segID FROM embeddings"
_F2 = """SELECT x, y, flux, CASE WHEN flux < -300 THEN 1 ELSE 0 END AS mask,
  CASE WHEN flux > 0 THEN (x - 1) // 8 + 8 * ((y - 1) // 10) + 1 ELSE 0 END AS segID
  FROM (SELECT x, y, floor(flux * 1000)::DOUBLE AS flux FROM f1)"""
_GRID = "SELECT x, y FROM (SELECT unnest(generate_series(1, 100))::INT AS x), (SELECT unnest(generate_series(1, 100))::INT AS y)"
_F3 = f"""SELECT g.x, g.y, s.flux FROM ({_GRID}) g LEFT JOIN (SELECT l_partkey % 100 + 1 AS x, l_suppkey % 100 + 1 AS y, sum(l_quantity) AS flux
  FROM lineitem GROUP BY 1, 2) s USING (x, y)"""
_F4 = """SELECT (s_suppkey + 1)::INT AS k, 5 + (s_suppkey * 37) % 54 + 0.5e0 AS cx, 5e0 + (s_suppkey * 91) % 490 AS cy,
  2e0 + s_suppkey % 4 AS rad, 0e0 + (s_suppkey * 29) % 180 AS ang, 0.3e0 + 0.1e0 * (s_suppkey % 8) AS axrat FROM supplier"""
_F5 = "SELECT (l_partkey % 100 + 1)::INT AS x, (l_suppkey % 100 + 1)::INT AS y, l_returnflag AS band, sum(l_quantity) AS flux FROM lineitem GROUP BY 1, 2, 3"
_F6 = "SELECT (datediff('day', DATE '2024-01-01', ts::DATE) + 1)::INT AS x, (user_id + 1)::INT AS y, count(*)::DOUBLE AS flux FROM events GROUP BY 1, 2"

SQL = {"f1": _F1, "f2": _F2, "f3": _F3, "f4": _F4, "f5": _F5, "f6": _F6}
_NEEDS = {"f2": ["f1"]}


def with_fixtures(names: str, body: str, recursive: bool = False) -> str:
    """SQL that starts with the named fixtures; ``body`` is more common tables and the SELECT.

    The body starts either with SELECT or with ``name AS (...)``.
    """
    wanted: list[str] = []
    for name in names.split():
        for n in (*_NEEDS.get(name, ()), name):
            if n not in wanted:
                wanted.append(n)
    tables = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in wanted)
    body = body.strip()
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables}{glue}{body}"
