"""Units, geometry and special functions against plain arithmetic."""

from math import log, log10, pi

import pytest
from pyspark.sql import functions as F

from pixelspark.functions import geometry as G
from pixelspark.functions import special as X
from pixelspark.functions import units as U


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_units(spark):
    r = one(spark, mag=U.flux_to_mag(100.0, 30.0), none=U.flux_to_mag(-1.0), zero=U.flux_to_mag(0.0), flux=U.mag_to_flux(25.0, 30.0), back=U.mu_to_mag(U.mag_to_mu(20.0, 3.0, 0.5, 0.3), 3.0, 0.5, 0.3), sb=U.sb_to_flux(U.flux_to_sb(7.0, 30.0, 0.3), 30.0, 0.3))
    assert r["mag"] == pytest.approx(25) and r["none"] is None and r["zero"] is None
    assert r["flux"] == pytest.approx(100) and r["back"] == pytest.approx(20) and r["sb"] == pytest.approx(7)
    assert U.flux_scale("jansky", 8.9) == 1 and U.flux_scale("RAW", 3) == 1
    with pytest.raises(ValueError):
        U.flux_scale("stone", 0)


def test_signal_to_noise_is_zero_where_not_finite(spark):
    assert one(spark, a=U.signal_to_noise(5.0, 1.0, 2.0), b=U.signal_to_noise(5.0, 1.0, 0.0)).asDict() == {"a": 2.0, "b": 0.0}


def test_normal_and_chi_square_tails():
    assert X.normal_quantile_log(log(0.975)) == pytest.approx(1.959963985, abs=1e-8)
    assert X.normal_quantile_log(log(1e-20)) == pytest.approx(-9.262340090, abs=1e-8)
    for x in (-37.0, -8.0, -0.3, 0.0, 2.5):
        assert X.normal_quantile_log(X.log_normal_cdf(x)) == pytest.approx(x, abs=1e-7)
    assert X.chi2_to_sigma(3.841458820694124, 1) == pytest.approx(1.644853627, abs=1e-8)
    assert 60 < X.chi2_to_sigma(5000, 50) < 70  # a tail far below the smallest double


def test_ellipse_radius_and_angle(spark):
    r = one(spark, circle=G.ellipse_radius(3.0, 4.0, 0.0, 0.0, 30.0, 1.0), minor=G.ellipse_radius(2.0, 0.0, 0.0, 0.0, 0.0, 0.5), ang=G.cov_angle(1.0, 2.0, 0.5))
    assert r["circle"] == pytest.approx(5) and r["minor"] == pytest.approx(4) and 0 <= r["ang"] < 180


def test_sky_coordinates_round_trip(spark):
    header = {"CRVAL1": "150.1", "CRVAL2": "2.2", "CRPIX1": "50", "CRPIX2": "60", "CD1_1": "-0.0001", "CD2_2": "0.0001", "CD1_2": "0", "CD2_1": "0"}
    df = spark.createDataFrame([(header, 12.5, 80.25)], "keyvalues map<string,string>, x double, y double")
    ra, dec = G.tan_pixel_to_sky("x", "y")
    x, y = G.tan_sky_to_pixel("ra", "dec")
    r = df.withColumns({"ra": ra, "dec": dec}).select(x.alias("x"), y.alias("y"), G.pixel_scale().alias("s")).first()
    assert r["x"] == pytest.approx(12.5, abs=1e-6) and r["y"] == pytest.approx(80.25, abs=1e-6) and r["s"] == pytest.approx(0.36)
    assert spark.createDataFrame([({}, 1.0)], "keyvalues map<string,string>, x double").select(G.tan_pixel_to_sky("x", "x")[0].alias("r")).first()["r"] is None


def test_mag_to_mu_value(spark):
    assert one(spark, m=U.mag_to_mu(20.0, 2.0, 0.5, 1.0))["m"] == pytest.approx(20 + 2.5 * log10(pi * 4 * 0.5) - 2.5 * log10(0.5))
    assert one(spark, b=G.sersic_bn(F.lit(4.0)))["b"] == pytest.approx(7.669, abs=2e-3)
