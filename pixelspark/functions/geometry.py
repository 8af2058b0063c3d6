"""Geometry as column expressions (SCL-15 to SCL-20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import Value, col


def ellipse_radius(x: Value, y: Value, xcen: Value, ycen: Value, ang: Value, axrat: Value, box: Value = 0.0) -> Column:
    """SCL-15: semi-major radius of the (super)ellipse through a point; angle from the y axis."""
    t = F.radians(col(ang))
    dx, dy = col(x) - col(xcen), col(y) - col(ycen)
    across = (dx * F.cos(t) + dy * F.sin(t)) / col(axrat)
    along = -dx * F.sin(t) + dy * F.cos(t)
    p = 2.0 + col(box)
    return F.pow(F.pow(F.abs(across), p) + F.pow(F.abs(along), p), 1.0 / p)


def cov_eigenvalues(xsd: Value, ysd: Value, covxy: Value) -> tuple[Column, Column]:
    """SCL-16: larger and smaller eigenvalue of a 2 x 2 covariance."""
    vx, vy = F.pow(col(xsd), 2), F.pow(col(ysd), 2)
    half, root = (vx + vy) / 2, F.sqrt(F.pow((vx - vy) / 2, 2) + F.pow(col(covxy), 2))
    return half + root, half - root


def cov_angle(xsd: Value, ysd: Value, covxy: Value) -> Column:
    """SCL-16: position angle in degrees, 0 to 180, from the y axis; NULL without covariance."""
    slope = F.try_divide(F.pow(col(xsd), 2) - cov_eigenvalues(xsd, ysd, covxy)[0], col(covxy))
    return F.pmod(90.0 - F.degrees(F.atan(slope)), F.lit(180.0))


def sersic_bn(nser: Value) -> Column:
    """SCL-17."""
    n = col(nser)
    return 2 * n - 1 / F.lit(3.0) + 4 / (405 * n)


def sersic_weight(r: Value, re: Value, nser: Value) -> Column:
    """SCL-17: profile relative to the centre."""
    return F.exp(-sersic_bn(nser) * F.pow(col(r) / col(re), 1 / col(nser)))


def warp(x: Value, y: Value, xcen: float, ycen: float, in_size: tuple[float, float], out_size: tuple[float, float], rot: float, backward: bool = False) -> tuple[Column, Column]:
    """SCL-19: shift, scale and rotate between a stamp's frame and a place in an image."""
    from math import cos, radians, sin

    c, s = cos(radians(rot)), sin(radians(rot))
    sx, sy = out_size[0] / in_size[0], out_size[1] / in_size[1]
    if backward:
        dx, dy = col(x) - xcen, col(y) - ycen
        return (dx * c + dy * s) / sx + in_size[0] / 2, (-dx * s + dy * c) / sy + in_size[1] / 2
    dx, dy = (col(x) - in_size[0] / 2) * sx, (col(y) - in_size[1] / 2) * sy
    return dx * c - dy * s + xcen, dx * s + dy * c + ycen


def tan_pixel_to_sky(x: Value, y: Value, header: str = "keyvalues") -> tuple[Column, Column]:
    """SCL-20: gnomonic projection from the header map (CRVAL, CRPIX, CD or CDELT); NULL without."""
    key = lambda k: F.try_element_at(F.col(header), F.lit(k)).cast("double")
    dx, dy = col(x) - key("CRPIX1"), col(y) - key("CRPIX2")
    cd11, cd22 = F.coalesce(key("CD1_1"), key("CDELT1")), F.coalesce(key("CD2_2"), key("CDELT2"))
    xi = F.radians(cd11 * dx + F.coalesce(key("CD1_2"), F.lit(0.0)) * dy)
    eta = F.radians(F.coalesce(key("CD2_1"), F.lit(0.0)) * dx + cd22 * dy)
    ra0, dec0 = F.radians(key("CRVAL1")), F.radians(key("CRVAL2"))
    down = F.cos(dec0) - eta * F.sin(dec0)
    ra = ra0 + F.atan2(xi, down)
    dec = F.atan2(F.sin(dec0) + eta * F.cos(dec0), F.sqrt(xi * xi + down * down))
    return F.pmod(F.degrees(ra), F.lit(360.0)), F.degrees(dec)


def tan_sky_to_pixel(ra: Value, dec: Value, header: str = "keyvalues") -> tuple[Column, Column]:
    """SCL-20: inverse of :func:`tan_pixel_to_sky`."""
    key = lambda k: F.try_element_at(F.col(header), F.lit(k)).cast("double")
    ra0, dec0, a, d = F.radians(key("CRVAL1")), F.radians(key("CRVAL2")), F.radians(col(ra)), F.radians(col(dec))
    down = F.sin(d) * F.sin(dec0) + F.cos(d) * F.cos(dec0) * F.cos(a - ra0)
    xi = F.degrees(F.cos(d) * F.sin(a - ra0) / down)
    eta = F.degrees((F.sin(d) * F.cos(dec0) - F.cos(d) * F.sin(dec0) * F.cos(a - ra0)) / down)
    cd11, cd22 = F.coalesce(key("CD1_1"), key("CDELT1")), F.coalesce(key("CD2_2"), key("CDELT2"))
    cd12, cd21 = F.coalesce(key("CD1_2"), F.lit(0.0)), F.coalesce(key("CD2_1"), F.lit(0.0))
    det = cd11 * cd22 - cd12 * cd21
    return (cd22 * xi - cd12 * eta) / det + key("CRPIX1"), (cd11 * eta - cd21 * xi) / det + key("CRPIX2")


def pixel_scale(header: str = "keyvalues") -> Column:
    """SRC-6: arc seconds a pixel, from the CD matrix or CDELT."""
    key = lambda k: F.try_element_at(F.col(header), F.lit(k)).cast("double")
    cd = F.sqrt(F.abs(key("CD1_1") * key("CD2_2") - F.coalesce(key("CD1_2"), F.lit(0.0)) * F.coalesce(key("CD2_1"), F.lit(0.0))))
    return 3600.0 * F.coalesce(cd, F.sqrt(F.abs(key("CDELT1") * key("CDELT2"))))
