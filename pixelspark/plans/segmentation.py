"""Queries of the segmentation family (SEG-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels as B
from ..operators import pipeline as P
from ..operators import segments as G
from ..operators import stats as S
from ..operators.watershed import watershed
from .fixtures import NY2, f2, f3, f5, f6, height, table, with_fixtures
from .maps import xy
from .registry import query
from .statistics import r

DISC = B.brush(5, "disc")
_DISC = ", ".join(f"({i}, {j})" for i, j, _ in DISC)
_ALIVE = "seg AS (SELECT x, y, segID FROM f2 WHERE segID > 0 AND flux > 40)"


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """F2's labels on its brighter pixels, so there is room to grow."""
    return f2(spark, d).where("segID > 0 and flux > 40").select("x", "y", "segID")


@query(
    with_fixtures(
        "f2",
        f"""{_ALIVE}, k(dx, dy) AS (VALUES {_DISC}), c AS (SELECT x + dx AS x, y + dy AS y, min(segID) AS s FROM seg, k WHERE segID IN (SELECT segID FROM seg GROUP BY 1 HAVING count(*) >= 30) GROUP BY 1, 2)
  SELECT coalesce(a.x, c.x)::BIGINT AS x, coalesce(a.y, c.y)::BIGINT AS y, coalesce(a.segID, c.s)::BIGINT AS segID FROM seg a FULL JOIN c ON a.x = c.x AND a.y = c.y WHERE coalesce(a.x, c.x) BETWEEN 1 AND 64 AND coalesce(a.y, c.y) BETWEEN 1 AND {NY2}""",
    )
)
def seg_dilate(spark: SparkSession, d: str) -> DataFrame:
    """SEG-7, SEG-6, JN-6: labels of 30 pixels or more grow by a disc."""
    seg = sparse(spark, d)
    out = G.dilate(seg, DISC, 64, height(spark, d), expand=seg.groupBy("segID").count().where("count >= 30").select("segID"))
    return out.select(*xy(out), F.col("segID").cast("long").alias("segID"))


@query(
    with_fixtures(
        "f2",
        f"""{_ALIVE}, k(dx, dy) AS (VALUES {_DISC}), c AS (SELECT x + dx AS x, y + dy AS y, min(segID) AS s FROM seg, k GROUP BY 1, 2)
  SELECT c.x::BIGINT AS x, c.y::BIGINT AS y, coalesce(a.segID, c.s)::BIGINT AS segID FROM c LEFT JOIN seg a ON a.x = c.x AND a.y = c.y WHERE c.x BETWEEN 1 AND 64 AND c.y BETWEEN 1 AND {NY2}""",
    )
)
def seg_dilate_edges(spark: SparkSession, d: str) -> DataFrame:
    """SEG-7 sending edge pixels only."""
    out = G.dilate_edges(sparse(spark, d), DISC, 64, height(spark, d))
    return out.select(*xy(out), F.col("segID").cast("long").alias("segID"))


_NEAR = """n AS (SELECT a.segID, unnest([l.segID, r.segID, u.segID, d.segID]) AS o FROM f2 a JOIN f2 l ON l.x = a.x - 1 AND l.y = a.y JOIN f2 r ON r.x = a.x + 1 AND r.y = a.y JOIN f2 u ON u.x = a.x AND u.y = a.y + 1 JOIN f2 d ON d.x = a.x AND d.y = a.y - 1 WHERE a.segID > 0),
  p AS (SELECT segID, array_to_string(list_sort(list(DISTINCT o)), ',') AS nearID, count(DISTINCT o) AS Nnear FROM n WHERE o > 0 AND o <> segID GROUP BY 1)"""


@query(with_fixtures("f2", _NEAR + " SELECT s.segID::BIGINT AS segID, coalesce(nearID, '') AS nearID, coalesce(Nnear, 0) AS Nnear FROM (SELECT DISTINCT segID FROM f2 WHERE segID > 0) s LEFT JOIN p USING (segID)"))
def seg_near(spark: SparkSession, d: str) -> DataFrame:
    """SEG-9, AGG-15, SET-2, D9."""
    out = G.near(f2(spark, d).select("x", "y", "segID"))
    return out.select(F.col("segID").cast("long").alias("segID"), F.array_join("nearID", ",").alias("nearID"), F.col("Nnear").cast("long").alias("Nnear"))


@query(
    with_fixtures(
        "f2",
        "SELECT a.x::BIGINT AS x, a.y::BIGINT AS y, a.segID::BIGINT AS segID FROM f2 a LEFT JOIN f2 l ON l.x = a.x - 1 AND l.y = a.y LEFT JOIN f2 r ON r.x = a.x + 1 AND r.y = a.y LEFT JOIN f2 u ON u.x = a.x AND u.y = a.y + 1 LEFT JOIN f2 d ON d.x = a.x AND d.y = a.y - 1 WHERE a.segID > 0 AND NOT coalesce(l.segID = a.segID AND r.segID = a.segID AND u.segID = a.segID AND d.segID = a.segID, false)",
    )
)
def seg_edge(spark: SparkSession, d: str) -> DataFrame:
    """SEG-13."""
    out = G.edge_pixels(f2(spark, d).select("x", "y", "segID"))
    return out.select(*xy(out), F.col("segID").cast("long").alias("segID"))


_OTHER = "m2 AS (SELECT x, y, CASE WHEN flux > 20 THEN x // 11 + 6 * (y // 7) + 1 ELSE 0 END AS segID FROM f2)"


@query(
    with_fixtures(
        "f2",
        f"""{_OTHER}, c AS (SELECT a.segID AS s1, b.segID AS s2, count(*) AS common FROM f2 a JOIN m2 b USING (x, y) WHERE a.segID > 0 AND b.segID > 0 GROUP BY 1, 2), n1 AS (SELECT segID AS s1, count(*) AS n1 FROM f2 GROUP BY 1), n2 AS (SELECT segID AS s2, count(*) AS n2 FROM m2 GROUP BY 1)
  SELECT s1::BIGINT AS s1, s2::BIGINT AS s2, common, round(common / n1, 6) AS frac1, round(common / n2, 6) AS frac2, round((common / n1) * (common / n2), 6) AS product FROM c JOIN n1 USING (s1) JOIN n2 USING (s2) WHERE (common / n1) * (common / n2) > 0.1""",
    )
)
def seg_compare(spark: SparkSession, d: str) -> DataFrame:
    """SEG-12, JN-4."""
    one = f2(spark, d)
    two = one.select("x", "y", F.when(F.col("flux") > 20, F.expr("x div 11 + 6 * (y div 7) + 1").cast("int")).otherwise(0).alias("segID"))
    out = G.compare(one.select("x", "y", "segID"), two, least=0.1)
    return out.select(F.col("s1").cast("long").alias("s1"), F.col("s2").cast("long").alias("s2"), "common", *r("frac1", "frac2", "product"))


@query(with_fixtures("f2", "SELECT x::BIGINT AS x, y::BIGINT AS y, (CASE WHEN segID IN (9, 2, 17) THEN 2 WHEN segID IN (31, 40) THEN 31 ELSE segID END)::BIGINT AS segID FROM f2"))
def seg_keep(spark: SparkSession, d: str) -> DataFrame:
    """SEG-15, SEG-17, JN-2, D10: lists become their least label; lists with label 50 are dropped."""
    merges = spark.createDataFrame([([9, 2, 17],), ([31, 40],), ([50, 3],)], "segIDs array<int>")
    out = G.relabel(f2(spark, d).select("x", "y", "segID"), G.merge_lists_mapping(G.zap_lists(merges, [50])))
    return out.select(*xy(out), F.col("segID").cast("long").alias("segID"))


_STATS = """SELECT segID, sum(flux) AS flux, max(px) * 1000 + max(py) AS uniqueID FROM (SELECT *, first_value(x) OVER w AS px, first_value(y) OVER w AS py FROM {t} WHERE segID > 0 WINDOW w AS (PARTITION BY segID ORDER BY flux DESC, y, x)) GROUP BY 1"""


@query(
    with_fixtures(
        "f2",
        f"""m2 AS (SELECT x, y, flux, CASE WHEN flux > 20 THEN x // 11 + 6 * (y // 7) + 1 ELSE 0 END AS segID FROM f2),
  s1 AS ({_STATS.format(t="f2")}), s2 AS ({_STATS.format(t="m2")}), p AS (SELECT s1.segID AS a, s2.segID AS b, s1.flux AS f1, s2.flux AS f2 FROM s1 JOIN s2 USING (uniqueID)),
  one AS (SELECT x, y, segID FROM f2 WHERE segID > 0 AND segID NOT IN (SELECT a FROM p WHERE f2 > f1)), two AS (SELECT x, y, segID + (SELECT max(segID) FROM f2) AS segID FROM m2 WHERE segID > 0 AND segID NOT IN (SELECT b FROM p WHERE f2 <= f1))
  SELECT coalesce(one.x, two.x)::BIGINT AS x, coalesce(one.y, two.y)::BIGINT AS y, coalesce(two.segID, one.segID)::BIGINT AS segID FROM one FULL JOIN two ON one.x = two.x AND one.y = two.y""",
    )
)
def seg_merge(spark: SparkSession, d: str) -> DataFrame:
    """SEG-11, SET-4."""
    one, ny = f2(spark, d).drop("mask"), height(spark, d)
    two = one.withColumn("segID", F.when(F.col("flux") > 20, F.expr("x div 11 + 6 * (y div 7) + 1").cast("int")).otherwise(0))

    def stats(px: DataFrame) -> DataFrame:
        top = S.brightest(px).select("segID", G.unique_id(F.col("xmax"), F.col("ymax"), ny).alias("uniqueID"))
        return S.segment_flux(px).join(top, "segID")

    out = G.merge_maps(one.select("x", "y", "segID"), two.select("x", "y", "segID"), stats(one), stats(two))
    return out.select(*xy(out), F.col("segID").cast("long").alias("segID"))


_COMPONENTS = """px AS (SELECT x, y, y * 4294967296 + x AS id FROM {t}),
  e AS (SELECT a.id AS a, b.id AS b FROM px a JOIN px b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
  reach AS (SELECT id AS a, id AS b FROM px UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b WHERE e.b >= 0),
  comp AS (SELECT a AS id, min(b) AS comp FROM reach GROUP BY 1)"""


@query(with_fixtures("f6", "t AS (SELECT x, y FROM f6 WHERE flux >= 4), " + _COMPONENTS.format(t="t") + " SELECT px.x::BIGINT AS x, px.y::BIGINT AS y, comp::BIGINT AS comp FROM comp JOIN px USING (id)", recursive=True))
def seg_components(spark: SparkSession, d: str) -> DataFrame:
    """SEG-10: connected pixels of the sparse image."""
    out = G.components(f6(spark, d).where("flux >= 4").select("x", "y"))
    return out.select(*xy(out), "comp")


_SMALL = "t AS (SELECT x, y, (x - 1) // 3 + 10 * ((y - 1) // 3) + 1 AS segID FROM f6 WHERE flux >= 4)"


@query(
    with_fixtures(
        "f6",
        _SMALL + ", " + _COMPONENTS.format(t="t")
        + """, h AS (SELECT segID, comp, count(*) AS n FROM t JOIN px USING (x, y) JOIN comp USING (id) GROUP BY 1, 2), m AS (SELECT segID, comp FROM (SELECT *, row_number() OVER (PARTITION BY segID ORDER BY n DESC, comp) AS rn FROM h) WHERE rn = 1)
  SELECT min(m.segID)::BIGINT AS groupID, array_to_string(list_sort(list(m.segID)), ',') AS segIDs, count(*) AS Ngroup, sum(n)::BIGINT AS Npix FROM m JOIN (SELECT segID, sum(n) AS n FROM h GROUP BY 1) USING (segID) GROUP BY comp""",
        recursive=True,
    )
)
def seg_group(spark: SparkSession, d: str) -> DataFrame:
    """SEG-10, D8, AGG-14."""
    seg = f6(spark, d).where("flux >= 4").select("x", "y", F.expr("(x - 1) div 3 + 10 * ((y - 1) div 3) + 1").cast("int").alias("segID"))
    groups, _ = G.group_segments(seg)
    return groups.select(F.col("groupID").cast("long").alias("groupID"), F.array_join("segIDs", ",").alias("segIDs"), F.col("Ngroup").cast("long").alias("Ngroup"), "Npix")


@query(
    """WITH RECURSIVE l AS (SELECT s_suppkey AS a, s_suppkey + 1 + s_suppkey % 3 AS b FROM supplier WHERE s_suppkey % 4 < 2), n AS (SELECT a AS v FROM l UNION SELECT b FROM l),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach AS (SELECT v AS a, v AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), c AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
  SELECT array_to_string(list_sort(list(a)), ',') AS segIDs FROM c GROUP BY c"""
)
def seg_merge_closure(spark: SparkSession, d: str) -> DataFrame:
    """SEG-16: lists of two labels, made of the suppliers."""
    lists = table(spark, d, "supplier").where("s_suppkey % 4 < 2").select(F.expr("array(cast(s_suppkey as int), cast(s_suppkey + 1 + s_suppkey % 3 as int))").alias("segIDs"))
    return G.merge_closure(lists).select(F.array_join("segIDs", ",").alias("segIDs"))


@query(
    with_fixtures(
        "f2",
        f"""{_ALIVE}, k(dx, dy, w) AS (VALUES {", ".join(f"({i}, {j}, {w!r}e0)" for i, j, w in B.brush(5, "gaussian", sigma=1.5))}),
  c AS (SELECT x + dx AS x, y + dy AS y, segID, sum(w) AS w FROM seg, k GROUP BY 1, 2, 3 HAVING sum(w) > 0.01), b AS (SELECT x, y, segID FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY round(w, 12) DESC, segID) AS rn FROM c) WHERE rn = 1)
  SELECT f2.x::BIGINT AS x, f2.y::BIGINT AS y, (CASE WHEN seg.segID IS NOT NULL THEN seg.segID WHEN f2.flux / 10 > 1 THEN coalesce(b.segID, 0) ELSE 0 END)::BIGINT AS segID FROM f2 LEFT JOIN seg ON seg.x = f2.x AND seg.y = f2.y LEFT JOIN b ON b.x = f2.x AND b.y = f2.y""",
    )
)
def seg_expand(spark: SparkSession, d: str) -> DataFrame:
    """SEG-5."""
    px = f2(spark, d).select("x", "y", (F.col("flux") / 10).alias("sn"), F.when(F.col("flux") > 40, F.col("segID")).otherwise(0).alias("segID"))
    out = G.expand_by_blur(px, B.brush(5, "gaussian", sigma=1.5))
    return out.select(*xy(out), F.col("segID").cast("long").alias("segID"))


@query()
def seg_watershed(spark: SparkSession, d: str) -> DataFrame:
    """SEG-1, WIN-5; compared with a plain model in the tests."""
    return watershed(f2(spark, d).select("x", "y", (F.col("flux") / 10).alias("sn")), skycut=15.0, pixcut=2, ext=1, abstol=2.0)


@query()
def seg_watershed_old(spark: SparkSession, d: str) -> DataFrame:
    """SEG-2."""
    return watershed(f2(spark, d).select("x", "y", (F.col("flux") / 10).alias("sn")), skycut=15.0, pixcut=2, ext=1, abstol=2.0, variant="old")


@query()
def seg_automerge(spark: SparkSession, d: str) -> DataFrame:
    """SEG-18, SEG-10."""
    px = f2(spark, d)
    cat = S.flux_profile(px).join(S.moments(px), "segID").join(S.brightest(px), "segID")
    cat = cat.withColumn("sep", F.sqrt(F.pow(F.col("xcen") - F.col("xmax"), 2) + F.pow(F.col("ycen") - F.col("ymax"), 2)))
    out = G.auto_merge(px.select("x", "y", "segID"), cat, 0.03)
    return out.select("groupID", F.array_join("segIDs", ",").alias("segIDs"), "Ngroup", "Npix")


@query(
    with_fixtures(
        "f2",
        f"""{_ALIVE}, found AS (SELECT x, y, x // 11 + 6 * (y // 7) + 1 AS segID FROM f2 WHERE flux > 20)
  SELECT x::BIGINT AS x, y::BIGINT AS y, segID::BIGINT AS segID FROM seg UNION ALL SELECT x, y, segID + (SELECT max(segID) FROM seg) FROM found WHERE (x, y) NOT IN (SELECT (x, y) FROM seg)""",
    )
)
def seg_extend(spark: SparkSession, d: str) -> DataFrame:
    """SEG-14, SET-4."""
    found = f2(spark, d).where("flux > 20").select("x", "y", F.expr("x div 11 + 6 * (y div 7) + 1").cast("int").alias("segID"))
    out = G.extend_map(sparse(spark, d), found)
    return out.select(*xy(out), F.col("segID").cast("long").alias("segID"))


_OF_BANDS = """t AS (SELECT band, x, y, ((x - 1) // 5 + 20 * ((y - 1) // 5) + 1)::INT AS segID FROM f5 WHERE flux >= 90), px AS (SELECT band, x, y, y * 4294967296 + x AS id FROM t),
  e AS (SELECT a.band, a.id AS a, b.id AS b FROM px a JOIN px b ON a.band = b.band AND b.x BETWEEN a.x - 1 AND a.x + 1 AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
  reach AS (SELECT band, id AS a, id AS b FROM px UNION SELECT r.band, r.a, e.b FROM reach r JOIN e ON e.a = r.b AND e.band = r.band WHERE e.b >= 0), comp AS (SELECT band, a AS id, min(b) AS comp FROM reach GROUP BY 1, 2),
  h AS (SELECT band, segID, comp, count(*) AS n FROM t JOIN px USING (band, x, y) JOIN comp USING (band, id) GROUP BY 1, 2, 3), m AS (SELECT band, segID, comp FROM (SELECT *, row_number() OVER (PARTITION BY band, segID ORDER BY n DESC, comp) AS rn FROM h) WHERE rn = 1)
  SELECT band, min(m.segID)::BIGINT AS groupID, array_to_string(list_sort(list(m.segID)), ',') AS segIDs, count(*) AS Ngroup, sum(n)::BIGINT AS Npix FROM m JOIN (SELECT band, segID, sum(n) AS n FROM h GROUP BY 1, 2) USING (band, segID) GROUP BY band, comp"""


@query(with_fixtures("f5", _OF_BANDS, recursive=True))
def seg_group_bands(spark: SparkSession, d: str) -> DataFrame:
    """SEG-10 on several images at once."""
    seg = f5(spark, d).where("flux >= 90").select("band", "x", "y", F.expr("(x - 1) div 5 + 20 * ((y - 1) div 5) + 1").cast("int").alias("segID"))
    groups, _ = G.group_segments(seg)
    return groups.select("band", F.col("groupID").cast("long").alias("groupID"), F.array_join("segIDs", ",").alias("segIDs"), F.col("Ngroup").cast("long").alias("Ngroup"), "Npix")


@query()
def seg_propagate(spark: SparkSession, d: str) -> DataFrame:
    """SEG-8: from the brightest pixels; compared with a plain model in the tests."""
    px = f3(spark, d).select("x", "y", (F.coalesce("flux", F.lit(0.0)) / 100).alias("flux"))
    return P.propagate(px, px.where("flux > 2.2").select("x", "y", F.expr("x * 1000 + y").cast("int").alias("segID")))
