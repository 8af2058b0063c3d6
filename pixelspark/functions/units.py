"""Unit conversions as column expressions (SCL-1 to SCL-8, SCL-10, SRC-7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | float


def col(v: Value) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))


def flux_to_mag(flux: Value, magzero: Value = 0.0) -> Column:
    """SCL-1: NULL for missing, zero or negative flux."""
    f = col(flux)
    return F.when(f > 0, -2.5 * F.log10(f) + col(magzero))


def mag_to_flux(mag: Value, magzero: Value = 0.0) -> Column:
    """SCL-2."""
    return F.pow(F.lit(10.0), -0.4 * (col(mag) - col(magzero)))


def flux_to_sb(flux: Value, magzero: Value = 0.0, pixscale: Value = 1.0) -> Column:
    """SCL-3: magnitude per square arc second."""
    return flux_to_mag(flux, magzero) + 5 * F.log10(col(pixscale))


def sb_to_flux(sb: Value, magzero: Value = 0.0, pixscale: Value = 1.0) -> Column:
    """SCL-4."""
    return mag_to_flux(col(sb) - 5 * F.log10(col(pixscale)), magzero)


def mag_to_mu(mag: Value, re: Value = 1.0, axrat: Value = 1.0, pixscale: Value = 1.0) -> Column:
    """SCL-5: mean surface brightness within the half-light ellipse."""
    return col(mag) + 2.5 * F.log10(F.pi() * F.pow(col(re), 2) * col(axrat)) - 2.5 * F.log10(F.lit(0.5)) + 5 * F.log10(col(pixscale))


def mu_to_mag(mu: Value, re: Value = 1.0, axrat: Value = 1.0, pixscale: Value = 1.0) -> Column:
    """SCL-6."""
    return col(mu) - 2.5 * F.log10(F.pi() * F.pow(col(re), 2) * col(axrat)) + 2.5 * F.log10(F.lit(0.5)) - 5 * F.log10(col(pixscale))


def convert_gain(gain: Value, magzero: Value, magzero_new: Value) -> Column:
    """SCL-7."""
    return col(gain) * F.pow(F.lit(10.0), -0.4 * (col(magzero_new) - col(magzero)))


def flux_scale(unit: str, magzero: float) -> float:
    """SCL-8: the factor from counts to the unit."""
    # AB zero points of the units.
    zero = {"raw": None, "jansky": 8.9, "microjansky": 23.9}
    if unit.lower() not in zero:
        raise ValueError(f"flux unit {unit!r}: use Raw, Jansky or Microjansky")
    z = zero[unit.lower()]
    return 1.0 if z is None else 10 ** (-0.4 * (magzero - z))


def signal_to_noise(flux: Value, sky: Value, rms: Value) -> Column:
    """SCL-10: 0 where it is not finite."""
    s = F.try_divide(col(flux) - col(sky), col(rms))
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), 0.0).otherwise(s)


def image_area(nx: Value, ny: Value, pixscale: Value) -> Column:
    """SRC-7: square degrees."""
    return col(nx) * col(ny) * F.pow(col(pixscale), 2) / (3600.0**2)
