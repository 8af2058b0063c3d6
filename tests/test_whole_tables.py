"""Registered queries read the whole of their tables, also where these are larger than the image of sf0.01."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pixelspark.operators import segments
from pixelspark.plans import fixtures, registry

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_f2_has_every_vector(spark):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert n > 500 and fixtures.height(spark, DATA) == n
    assert fixtures.f2(spark, DATA).agg(F.count(F.lit(1)), F.max("y")).first() == (64 * n, n)


@pytest.mark.parametrize("name", ["agg_segment_flux", "agg_boundary", "seg_dilate"])
def test_queries_on_f2_equal_the_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    sql = registry.oracle_sql()[name]
    got = registry.queries()[name](spark, DATA)
    result = con.execute(sql)
    order = [c[0] for c in result.description]
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(result.fetchall())


def test_superellipse_of_every_segment(spark):
    d = "/root/testdata/sf0.001"
    labels = fixtures.f2(spark, d).where("segID > 0").select("segID").distinct()
    got = registry.queries()["apr_superellipse"](spark, d).select("segID").distinct()
    assert labels.count() == 400 and got.count() == 400


@pytest.mark.parametrize("name", ["dbl_spline", "dbl_psf"])
def test_every_group_is_deblended(spark, name):
    d = "/root/testdata/sf0.001"
    groups = segments.group_segments(fixtures.f2(spark, d).select("x", "y", "segID"))[0].where("Ngroup > 1")
    expected = groups.select("groupID", F.explode("segIDs").alias("segID")).collect()
    got = registry.queries()[name](spark, d).select("groupID", "segID").collect()
    assert len(expected) > 9 and sorted(map(tuple, got)) == sorted(map(tuple, expected))
