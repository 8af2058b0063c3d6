"""Queries of deblending, PSF photometry and the pipelines (DBL-*, FIT-*, PIP-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels as B
from ..operators import models as D
from ..operators import pipeline as P
from ..operators import segments as G
from ..operators import stats as S
from .catalogues import CONFIG
from .filters import _K, PSF
from .fixtures import f2, f3, f4, f5, height, with_fixtures
from .registry import query
from .statistics import _MOMENTS, r

def groups_of(px: DataFrame) -> DataFrame:
    """Every two by two blocks of F2 as a group, so that all segments are deblended."""
    block = F.expr("((segID - 1) % 8) div 2 + 4 * (((segID - 1) div 8) div 2)")
    one = px.where("segID > 0").groupBy("segID").agg(F.count(F.lit(1)).alias("n")).withColumn("block", block)
    return one.groupBy("block").agg(F.min("segID").alias("groupID"), F.array_sort(F.collect_list("segID")).alias("segIDs"), F.sum("n").alias("Npix"), F.count(F.lit(1)).cast("int").alias("Ngroup")).drop("block")


_GROUPS = "g AS (SELECT segID, min(segID) OVER (PARTITION BY ((segID - 1) % 8) // 2, ((segID - 1) // 8) // 2) AS groupID FROM (SELECT DISTINCT segID FROM f2 WHERE segID > 0))"
_SHARE = """sh1 AS (SELECT *, coalesce(w / nullif(sum(w) OVER (PARTITION BY groupID, x, y), 0), 0) AS w1 FROM b), sh2 AS (SELECT *, CASE WHEN w1 < 0.1 THEN 0 ELSE w1 END AS w2 FROM sh1),
  e AS (SELECT *, coalesce(w2 / nullif(sum(w2) OVER (PARTITION BY groupID, x, y), 0), 0) AS w3 FROM sh2)
  SELECT groupID::BIGINT AS groupID, segID::BIGINT AS segID, round(sum(w3 * flux), 4) AS flux_db, round(sum(w3), 5) AS N100_db, round(greatest(coalesce(sum(flux) FILTER (own = segID), 0), 0) / sum(flux), 6) AS flux_segfrac FROM e GROUP BY 1, 2"""


def _out(df: DataFrame) -> DataFrame:
    return df.select(F.col("groupID").cast("long").alias("groupID"), F.col("segID").cast("long").alias("segID"), *r("flux_db", digits=4), *r("N100_db", digits=5), *r("flux_segfrac"))


_GAUSS = f"""{_MOMENTS}, {_GROUPS}, fl AS (SELECT segID, sum(flux) AS sflux FROM f2 WHERE segID > 0 AND mask = 0 GROUP BY 1),
  p AS (SELECT h.groupID, f2.segID AS own, x, y, flux FROM f2 JOIN g h ON h.segID = f2.segID),
  q AS (SELECT p.*, g.segID, xcen, ycen, xsd, ysd, covxy, sflux, xsd ** 2 * ysd ** 2 - covxy ** 2 AS det FROM p JOIN g ON g.groupID = p.groupID JOIN m ON m.segID = g.segID JOIN fl ON fl.segID = g.segID),
  b AS (SELECT *, CASE WHEN det > 0 THEN sflux * exp(-0.5e0 * (((x - xcen) * ysd) ** 2 - 2 * covxy * (x - xcen) * (y - ycen) + ((y - ycen) * xsd) ** 2) / det) / (2 * pi() * sqrt(det)) ELSE 0 END AS w FROM q), """


@query(
    with_fixtures(
        "f2",
        _GAUSS
        + _SHARE,
    )
)
def dbl_gauss(spark: SparkSession, d: str) -> DataFrame:
    """DBL-1, DBL-3."""
    px = f2(spark, d)
    stats = S.segment_flux(px).join(S.moments(px), "segID")
    return _out(D.deblend_gauss(px.where("segID > 0").select("x", "y", "flux", "segID"), groups_of(px), stats))


@query(
    with_fixtures(
        "f2",
        f"""{_GROUPS}, t AS (SELECT segID, x - 0.5e0 AS xmax, y - 0.5e0 AS ymax FROM (SELECT *, row_number() OVER (PARTITION BY segID ORDER BY flux DESC, y, x) AS rn FROM f2 WHERE segID > 0 AND mask = 0) WHERE rn = 1),
  p AS (SELECT h.groupID, f2.segID AS own, x, y, flux FROM f2 JOIN g h ON h.segID = f2.segID),
  q AS (SELECT p.*, g.segID, sqrt((x - xmax - 0.5e0) ** 2 / 0.64e0 + (y - ymax - 0.5e0) ** 2) AS rad FROM p JOIN g ON g.groupID = p.groupID JOIN t ON t.segID = g.segID),
  k AS (SELECT groupID, segID, regr_slope(log10(flux), rad) FILTER (own = segID AND flux > 0) AS s, regr_intercept(log10(flux), rad) FILTER (own = segID AND flux > 0) AS i, max(rad) FILTER (own = segID) AS reach FROM q GROUP BY 1, 2),
  b AS (SELECT q.*, CASE WHEN rad > 2 * reach THEN 0 ELSE 10 ** (i + s * rad) END AS w FROM q JOIN k USING (groupID, segID)), """
        + _SHARE,
    )
)
def dbl_line(spark: SparkSession, d: str) -> DataFrame:
    """DBL-1, DBL-2 (line), AGG-24."""
    px = f2(spark, d)
    stats = S.brightest(px).withColumns({"ang": F.lit(0.0), "axrat": F.lit(0.8)})
    return _out(D.deblend_line(px.where("segID > 0").select("x", "y", "flux", "segID"), groups_of(px), stats))


def all_groups(px: DataFrame) -> DataFrame:
    """The groups of touching segments of the whole map."""
    return G.group_segments(px.select("x", "y", "segID"))[0]


def _stats(px: DataFrame) -> DataFrame:
    return S.segment_flux(px).join(S.brightest(px), "segID").withColumns({"ang": F.lit(0.0), "axrat": F.lit(0.8)})


_ERRORS = """, db AS (SELECT groupID, segID, sum(w3 * flux) AS fdb, sum(w3) AS ndb FROM e GROUP BY 1, 2), st AS (SELECT segID, sum(flux) AS f, count(*) AS n, 2e0 + segID % 3 AS es, sqrt(sum(flux)) / 2 AS eh FROM f2 WHERE segID > 0 AND mask = 0 GROUP BY 1),
  o AS (SELECT *, (SELECT greatest(max(fdb / f), 0) FROM st JOIN db USING (segID)) AS most, abs(f - fdb) * 0.5e0 AS eq FROM st JOIN db USING (segID)), v AS (SELECT *, es * sqrt(ndb / n) AS a, 3 * sqrt(ndb / n) AS b, eh * sqrt(most) AS c FROM o)
  SELECT segID::BIGINT AS segID, round(a, 5) AS flux_err_sky_db, round(b, 5) AS flux_err_skyRMS_db, round(c, 4) AS flux_err_shot_db, round(eq, 4) AS flux_err_Qseg_db, round(sqrt(a * a + b * b + c * c + eq * eq), 4) AS flux_err_db FROM v"""


@query(with_fixtures("f2", _GAUSS + _SHARE.split("\n  SELECT ")[0] + _ERRORS))
def dbl_errors(spark: SparkSession, d: str) -> DataFrame:
    """DBL-6."""
    px = f2(spark, d)
    stats = S.segment_flux(px).join(S.moments(px), "segID")
    db = D.deblend_gauss(px.where("segID > 0").select("x", "y", "flux", "segID"), groups_of(px), stats).withColumn("Qseg_db", F.lit(0.5))
    with_errors = stats.withColumns({"mag": -2.5 * F.log10("flux"), "flux_err_sky": 2.0 + F.col("segID") % 3, "flux_err_skyRMS": F.lit(3.0), "flux_err_shot": F.sqrt("flux") / 2})
    out = D.deblend_errors(db, with_errors)
    return out.select(F.col("segID").cast("long").alias("segID"), *r("flux_err_sky_db", "flux_err_skyRMS_db", digits=5), *r("flux_err_shot_db", "flux_err_Qseg_db", "flux_err_db", digits=4))


@query()
def dbl_spline(spark: SparkSession, d: str) -> DataFrame:
    """DBL-2 (spline), DBL-5."""
    px = f2(spark, d)
    return D.deblend_iterative(px.where("segID > 0").select("x", "y", "flux", "segID"), all_groups(px), _stats(px))


@query()
def dbl_psf(spark: SparkSession, d: str) -> DataFrame:
    """DBL-4."""
    px = f2(spark, d)
    return D.deblend_psf(px.where("segID > 0").select("x", "y", "flux", "segID"), all_groups(px), _stats(px), PSF)


@query(
    with_fixtures(
        "f2 f4",
        f"""k(dx, dy, w) AS (VALUES {_K}), s AS (SELECT k, rad * 100 AS f, floor(cx + 0.5e0)::INT AS px, floor(cy + 0.5e0)::INT AS py FROM f4),
  m AS (SELECT s.k, f, f2.flux, f * w AS m, 100e0 + f2.x AS var FROM s, k JOIN f2 ON f2.x = px + dx AND f2.y = py + dy),
  t AS (SELECT k, f, sum(flux * m / var) AS a, sum(m * m / var) AS b, sum(-0.5e0 * flux * flux / var) AS psfLL FROM m GROUP BY 1, 2),
  u AS (SELECT *, greatest({10**-0.4 - 1!r}e0, least({10**0.4 - 1!r}e0, a / b)) AS s FROM t)
  SELECT k::BIGINT AS k, round(f * (1 + s), 5) AS flux, round(sqrt(f * f / b + (s * f) ** 2), 5) AS flux_err, round(psfLL, 4) AS psfLL FROM u""",
    )
)
def fit_psf_update(spark: SparkSession, d: str) -> DataFrame:
    """FIT-2, FIT-3, FIT-7."""
    image = f2(spark, d).select("x", "y", "flux", F.sqrt(100.0 + F.col("x")).alias("sigma"))
    src = f4(spark, d).select("k", F.col("cx").alias("xcen"), F.col("cy").alias("ycen"), (F.col("rad") * 100).alias("flux"))
    return D.psf_update(image, src, PSF).select(F.col("k").cast("long").alias("k"), *r("flux", "flux_err", digits=5), *r("psfLL", digits=4))


def _fit_round(i: int) -> str:
    return f"""o{i} AS (SELECT px + dx AS x, py + dy AS y, sum(f * w) AS model FROM n{i}, k GROUP BY 1, 2),
  d{i} AS (SELECT f2.x, f2.y, flux - coalesce(model, 0) AS flux FROM f2 LEFT JOIN o{i} o ON o.x = f2.x AND o.y = f2.y),
  t{i} AS (SELECT n.k, f, sum(flux * f * w / 100) AS a, sum(f * w * f * w / 100) AS b, sum(-0.5e0 * flux * flux / 100) AS psfLL FROM n{i} n, k JOIN d{i} d ON d.x = px + dx AND d.y = py + dy GROUP BY 1, 2),
  u{i} AS (SELECT *, greatest({10**-0.4 - 1!r}e0, least({10**0.4 - 1!r}e0, coalesce(a / nullif(b, 0), 0))) AS s FROM t{i}),
  n{i + 1} AS (SELECT n.k, n.cx, n.cy, px, py, greatest((n.f + coalesce(u.f * (1 + s), n.f)) / 2, 1e-12) AS f FROM n{i} n LEFT JOIN u{i} u ON u.k = n.k)"""


@query(
    with_fixtures(
        "f2 f4",
        f"""k(dx, dy, w) AS (VALUES {_K}), n0 AS (SELECT k, cx, cy, floor(cx + 0.5e0)::INT AS px, floor(cy + 0.5e0)::INT AS py, rad * 100 AS f FROM f4), {", ".join(_fit_round(i) for i in range(3))}
  SELECT n3.k::BIGINT AS k, cx AS xcen, cy AS ycen, round(n3.f, 5) AS flux, round(sqrt(u2.f * u2.f / nullif(b, 0) + (s * u2.f) ** 2), 5) AS flux_err, round(psfLL, 3) AS psfLL, round(-2.5e0 * log10(n3.f), 6) AS mag FROM n3 LEFT JOIN u2 ON u2.k = n3.k""",
    )
)
def fit_psf(spark: SparkSession, d: str) -> DataFrame:
    """FIT-1: three rounds on F2."""
    image = f2(spark, d).select("x", "y", "flux", F.lit(10.0).alias("sigma"))
    src = f4(spark, d).select("k", F.col("cx").alias("xcen"), F.col("cy").alias("ycen"), (F.col("rad") * 100).alias("flux"))
    got = D.psf_fit(image, src, PSF, 64, height(spark, d), rounds=3)
    return got.select(F.col("k").cast("long").alias("k"), "xcen", "ycen", *r("flux", "flux_err", digits=5), *r("psfLL", digits=3), *r("mag"))


@query(
    with_fixtures(
        "f2 f4",
        f"""k(dx, dy, w) AS (VALUES {_K}), s AS (SELECT k, cx, cy, rad * 100 AS f, floor(cx + 0.5e0)::INT AS px, floor(cy + 0.5e0)::INT AS py FROM f4),
  m AS (SELECT s.k, cx, cy, f2.x, f2.y, f2.flux, f * w AS m FROM s, k JOIN f2 ON f2.x = px + dx AND f2.y = py + dy),
  c AS (SELECT k, sum(flux * (x - 0.5e0)) / nullif(sum(flux), 0) AS nx, sum(flux * (y - 0.5e0)) / nullif(sum(flux), 0) AS ny FROM m WHERE flux > 10 GROUP BY 1),
  e AS (SELECT k, sum(flux * share) AS flux FROM (SELECT *, m / sum(m) OVER (PARTITION BY x, y) AS share FROM m) GROUP BY 1)
  SELECT s.k::BIGINT AS k, round(cx + greatest(-0.5, least(0.5, coalesce(nx - cx, 0))), 5) AS xcen, round(cy + greatest(-0.5, least(0.5, coalesce(ny - cy, 0))), 5) AS ycen, round(e.flux, 5) AS flux FROM s LEFT JOIN c ON c.k = s.k LEFT JOIN e ON e.k = s.k""",
    )
)
def fit_recentre(spark: SparkSession, d: str) -> DataFrame:
    """FIT-4, FIT-5."""
    image = f2(spark, d).select("x", "y", "flux", F.lit(10.0).alias("sigma"))
    src = f4(spark, d).select("k", F.col("cx").alias("xcen"), F.col("cy").alias("ycen"), (F.col("rad") * 100).alias("flux"))
    out = D.psf_recentre(image, src, PSF).drop("flux").join(D.psf_extract(image, src, PSF), "k", "left")
    return out.select(F.col("k").cast("long").alias("k"), *r("xcen", "ycen", "flux", digits=5))


@query()
def fit_gain(spark: SparkSession, d: str) -> DataFrame:
    """FIT-10."""
    gain = D.gain_estimate(f3(spark, d).where("flux is not null").withColumn("sky", F.lit(150.0)))
    return spark.createDataFrame([(gain,)], "gain double")


@query()
def fit_extra(spark: SparkSession, d: str) -> DataFrame:
    """FIT-6: sources found on what PSF photometry leaves; compared with its parts in the tests."""
    image = f3(spark, d).select("x", "y", F.coalesce("flux", F.lit(0.0)).alias("flux"), F.lit(10.0).alias("sigma"))
    src = f4(spark, d).where("cy < 95").select("k", F.col("cx").alias("xcen"), F.col("cy").alias("ycen"), (F.col("rad") * 100).alias("flux"))
    return P.fit_with_extra(image, src, PSF, P.Config(100, 100, grid=25, box=25, iters=1, redosky=False), rounds=2)


@query(with_fixtures("f2", "SELECT segID::BIGINT AS segID, sum(flux) AS flux, count(*) AS N100, round(-2.5e0 * log10(sum(flux)) + 30, 5) AS mag FROM f2 WHERE segID > 0 AND mask = 0 GROUP BY 1"))
def pip_static(spark: SparkSession, d: str) -> DataFrame:
    """PIP-3: photometry of given segments as they are."""
    px = f2(spark, d)
    run = P.detect(px.select("x", "y", "flux", "mask"), P.static_photometry(P.Config(64, height(spark, d), magzero=30.0)), segmap=px.select("x", "y", "segID"))
    return run.segstats.select(F.col("segID").cast("long").alias("segID"), "flux", F.col("N100").cast("long").alias("N100"), *r("mag", digits=5))


@query()
def pip_detect(spark: SparkSession, d: str) -> DataFrame:
    """PIP-1, PIP-2, PIP-4, PIP-5, SEG-4: the whole pipeline on F3."""
    c = P.Config(100, 100, skycut=1.0, grid=25, box=25, iters=3, magzero=30.0, boundstats=True, redoskysize=7)
    return P.detect(f3(spark, d), c).segstats


@query()
def cat_multiband(spark: SparkSession, d: str) -> DataFrame:
    """CAT-2: detection on the stack of two bands, photometry in three."""
    c = P.Config(100, 100, grid=25, box=25, iters=1, magzero=25.0, redosky=False)
    return P.multiband(f5(spark, d), ["A", "R"], ["A", "N", "R"], CONFIG, c).cat_tot


@query(
    with_fixtures(
        "f2",
        """t AS (SELECT *, min(flux) OVER w AS lo, max(flux) OVER w AS hi FROM f2 WHERE segID > 0 WINDOW w AS (PARTITION BY segID)),
  g AS (SELECT segID, x, y, CASE WHEN hi = lo THEN 0 ELSE least(floor((flux - lo) / (hi - lo) * 8), 7) END AS g FROM t),
  q AS (SELECT a.segID, a.g AS a, b.g AS b FROM g a JOIN g b ON a.segID = b.segID AND (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1)), p AS (SELECT segID, a, b FROM q UNION ALL SELECT segID, b, a FROM q),
  c AS (SELECT segID, a, b, count(*) / sum(count(*)) OVER (PARTITION BY segID) AS p FROM p GROUP BY 1, 2, 3),
  l AS (SELECT segID, a, sum(p) AS p FROM c GROUP BY 1, 2), lh AS (SELECT segID, sum(-p * ln(p)) AS hx FROM l GROUP BY 1), h1 AS (SELECT c.segID, sum(-c.p * ln(x.p * y.p)) AS h FROM c JOIN l x ON x.segID = c.segID AND x.a = c.a JOIN l y ON y.segID = c.segID AND y.a = c.b GROUP BY 1),
  su AS (SELECT segID, sum(p * v) AS m, sum(p * v * v) AS q, sum(-p * ln(p)) AS h FROM (SELECT segID, a + b AS v, sum(p) AS p FROM c GROUP BY 1, 2) GROUP BY 1), di AS (SELECT segID, sum(p * v) AS m, sum(p * v * v) AS q, sum(-p * ln(p)) AS h FROM (SELECT segID, abs(a - b) AS v, sum(p) AS p FROM c GROUP BY 1, 2) GROUP BY 1),
  m AS (SELECT segID, sum(p * p) AS asm, sum(p * (a - b) ** 2) AS contrast, sum(p * a) AS ma, sum(p * a * a) AS maa, sum(p * a * b) AS mab, sum(p / (1 + (a - b) ** 2)) AS idm, sum(-p * ln(p)) AS entropy FROM c GROUP BY 1)
  SELECT m.segID::BIGINT AS segID, round(asm, 10) AS asm, round(contrast, 10) AS contrast, round((mab - ma * ma) / nullif(maa - ma * ma, 0), 5) AS correlation, round(maa - ma * ma, 6) AS variance, round(idm, 6) AS idm, round(su.m, 6) AS sum_average, round(su.q - su.m * su.m, 6) AS sum_variance, round(su.h, 6) AS sum_entropy,
   round(entropy, 6) AS entropy, round(di.q - di.m * di.m, 6) AS diff_variance, round(di.h, 6) AS diff_entropy, round((entropy - h1.h) / hx, 5) AS information1, round(sqrt(greatest(0, 1 - exp(-2 * (2 * hx - entropy)))), 5) AS information2
  FROM m JOIN lh USING (segID) JOIN h1 USING (segID) JOIN su USING (segID) JOIN di USING (segID)""",
    )
)
def agg_texture(spark: SparkSession, d: str) -> DataFrame:
    """AGG-25."""
    out = P.texture(f2(spark, d))
    return out.select(F.col("segID").cast("long").alias("segID"), *r("asm", "contrast", digits=10), *r("correlation", "information1", "information2", digits=5), *r("variance", "idm", "sum_average", "sum_variance", "sum_entropy", "entropy", "diff_variance", "diff_entropy"))


def fuzz_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that the dilated labels of F2's brighter pixels reach, with the catalogue's values."""
    px = f2(spark, d).withColumn("segID", F.when(F.col("flux") > 40, F.col("segID")).otherwise(0))
    seg = px.where("segID > 0").select("x", "y", "segID")
    ring = G.dilate(seg, B.brush(5, "disc"), 64, height(spark, d)).join(px.select("x", "y", "flux"), ["x", "y"]).withColumn("sigma", F.lit(10.0))
    cat = S.segment_flux(px).join(S.shape(S.moments(px)), "segID").withColumns({"mag": -2.5 * F.log10("flux"), "R50": F.col("semimaj")})
    return D.annulus_sources(seg, ring, cat)


@query()
def fit_fuzz(spark: SparkSession, d: str) -> DataFrame:
    """FIT-8: compared with known profiles in the tests."""
    return D.fuzz_fit(fuzz_rows(spark, d))


@query()
def fit_psf_fuzz(spark: SparkSession, d: str) -> DataFrame:
    """FIT-9: compared with known profiles in the tests."""
    out, shape = D.fuzz_fit_shared(fuzz_rows(spark, d), rounds=3)
    return out.withColumns({n: F.lit(v) for n, v in shape.items()})
