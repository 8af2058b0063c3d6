"""Structuring elements and point-spread functions as small lists of offsets (FLT-4, FLT-5)."""

from __future__ import annotations

from math import ceil, cos, exp, radians, sin, tan

Kernel = list[tuple[int, int, float]]


def brush(size: int, shape: str = "disc", sigma: float = 0.3, angle: float = 45.0) -> Kernel:
    """FLT-4: offsets of a brush; even sizes grow by one.

    box; disc (squared distance below (size/2) squared); diamond (city distance below size/2);
    gaussian (weights that sum to one, ``sigma`` in pixels); line (at ``angle`` degrees).
    """
    size += 1 - size % 2
    h = size // 2
    at = [(i, j) for j in range(-h, h + 1) for i in range(-h, h + 1)]
    if shape == "box":
        return [(i, j, 1.0) for i, j in at]
    if shape == "disc":
        return [(i, j, 1.0) for i, j in at if i * i + j * j < (size / 2) ** 2]
    if shape == "diamond":
        return [(i, j, 1.0) for i, j in at if abs(i) + abs(j) < size / 2]
    if shape == "gaussian":
        return normalised([(i, j, exp(-(i * i + j * j) / (2 * sigma * sigma))) for i, j in at])
    if shape == "line":
        a = angle % 180
        if a <= 45 or a > 135:
            return [(i, round(i * tan(radians(a))), 1.0) for i in range(-h, h + 1)]
        return [(round(j * cos(radians(a)) / sin(radians(a))), j, 1.0) for j in range(-h, h + 1)]
    raise ValueError(f"brush shape {shape!r}: use box, disc, diamond, gaussian or line")


def gaussian_1d(sigma: float) -> list[tuple[int, float]]:
    """A truncated Gaussian to four sigma, not normalised."""
    h = max(1, ceil(4 * sigma))
    return [(i, exp(-i * i / (2 * sigma * sigma))) for i in range(-h, h + 1)]


def normalised(kernel: Kernel) -> Kernel:
    """D11: weights that sum to one."""
    total = sum(w for _, _, w in kernel)
    return [(i, j, w / total) for i, j, w in kernel]


def gaussian_psf(size: int, fwhm: float) -> Kernel:
    s = fwhm / 2.3548200450309493
    h = size // 2
    return normalised([(i, j, exp(-(i * i + j * j) / (2 * s * s))) for j in range(-h, h + 1) for i in range(-h, h + 1)])
