"""Image filters on binary columns of raw RGB pixels, one Arrow batch at a time.

Pixels are ``height * width * 3`` bytes; decoding files is a plug-in's matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of red, green and blue in luminance.
LUMA = np.array([0.299, 0.587, 0.114])


def _pad(x: np.ndarray, k: int) -> np.ndarray:
    return np.pad(x, [(k, k), (k, k)] + [(0, 0)] * (x.ndim - 2), mode="reflect" if min(x.shape[:2]) > k else "edge")


def _correlate(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    k = len(kernel) // 2
    padded = np.moveaxis(_pad(x, k), axis, 0)
    n = x.shape[axis]
    out = sum(w * padded[i : i + n] for i, w in enumerate(kernel))
    out = np.moveaxis(out, 0, axis)
    other = 1 - axis
    return np.take(out, range(k, k + x.shape[other]), axis=other)


def gaussian_blur(x: np.ndarray, size: int = 21) -> np.ndarray:
    size += size % 2 == 0
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    at = np.arange(size) - size // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    return _bytes(_correlate(_correlate(x.astype(float), kernel, 0), kernel, 1))


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def grayscale(x: np.ndarray) -> np.ndarray:
    return np.repeat(_bytes(x @ LUMA)[:, :, None], 3, 2)


def _shrunk(x: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Area averages on a smaller grid, and the grid's row and column of every pixel."""
    h, w = x.shape[:2]
    at_row, at_col = np.arange(h) * rows // h, np.arange(w) * cols // w
    sums, counts = np.zeros((rows, cols, 3)), np.zeros((rows, cols, 1))
    np.add.at(sums, (at_row[:, None], at_col[None, :]), x)
    np.add.at(counts, (at_row[:, None], at_col[None, :]), 1)
    return _bytes(sums / counts), at_row, at_col


def downscale(x: np.ndarray, factor: float = 0.25) -> np.ndarray:
    """Area average to a smaller grid and nearest-neighbour back."""
    h, w = x.shape[:2]
    small, at_row, at_col = _shrunk(x, max(1, int(h * factor)), max(1, int(w * factor)))
    return small[at_row[:, None], at_col[None, :]]


def grid_repetition(x: np.ndarray, n: int = 3) -> np.ndarray:
    """The shrunk image ``n`` times across and down, in an image of the size it had."""
    h, w = x.shape[:2]
    tiled = np.tile(_shrunk(x, max(1, h // n), max(1, w // n))[0], (n, n, 1))
    rows, cols = np.arange(h) * tiled.shape[0] // h, np.arange(w) * tiled.shape[1] // w
    return tiled[rows[:, None], cols[None, :]]


def gradient_magnitude(x: np.ndarray) -> np.ndarray:
    gray = (x @ LUMA).astype(float)
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    gx = _correlate(_correlate(gray, slope, 1), smooth, 0)
    gy = _correlate(_correlate(gray, slope, 0), smooth, 1)
    return np.repeat(_bytes(np.hypot(gx, gy))[:, :, None], 3, 2)


def canny_edges(x: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Thin edges: gradient maxima above ``high``, and those above ``low`` that touch them."""
    gray = _bytes(x @ LUMA).astype(float)
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    gx = _correlate(_correlate(gray, slope, 1), smooth, 0)
    gy = _correlate(_correlate(gray, slope, 0), smooth, 1)
    strength = np.abs(gx) + np.abs(gy)
    (h, w), around = strength.shape, np.pad(strength, 1)
    shifted = lambda a, dy, dx: a[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx]
    octant = np.floor((np.rad2deg(np.arctan2(gy, gx)) + 22.5) / 45).astype(int) % 4
    peak = np.zeros((h, w), bool)
    for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        peak |= (octant == k) & (strength > shifted(around, dy, dx)) & (strength >= shifted(around, -dy, -dx))
    maybe, sure = peak & (strength > low), peak & (strength > high)
    while True:
        padded = np.pad(sure, 1)
        grown = sure | maybe & np.logical_or.reduce([shifted(padded, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        if (grown == sure).all():
            return np.repeat(np.where(sure, 255, 0).astype(np.uint8)[:, :, None], 3, 2)
        sure = grown


def histogram_equalization(x: np.ndarray) -> np.ndarray:
    """Equalises luminance and keeps colour differences."""
    y = _bytes(x @ LUMA)
    counts = np.bincount(y.ravel(), minlength=256).cumsum()
    low = counts[counts > 0][0]
    span = counts[-1] - low
    table = np.arange(256) if span == 0 else np.rint((counts - low) * 255.0 / span)
    return _bytes(x.astype(float) + (table[y] - y)[:, :, None])


def gamma_correction(x: np.ndarray, gamma: float = 2.2) -> np.ndarray:
    return _bytes(255.0 * (x / 255.0) ** (1.0 / gamma))


FILTERS = {
    "none": lambda x: x, "gaussian_blur": gaussian_blur, "downscale": downscale, "grid_repetition": grid_repetition, "gradient_magnitude": gradient_magnitude,
    "grayscale": grayscale, "canny_edges": canny_edges, "histogram_equalization": histogram_equalization, "gamma_correction": gamma_correction,
    "histogram_blur": lambda x: gaussian_blur(histogram_equalization(x)), "gamma_blur": lambda x: gaussian_blur(gamma_correction(x)),
    "blur_gradient": lambda x: gradient_magnitude(gaussian_blur(x)), "blur_histogram": lambda x: histogram_equalization(gaussian_blur(x)),
}


def apply_filter(df: DataFrame, name: str, pixels: str = "pixels", height: str = "height", width: str = "width") -> DataFrame:
    """The pixels after a named filter; an unknown name is a ``ValueError``."""
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name!r}")

    @F.pandas_udf("binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([FILTERS[name](np.frombuffer(d, np.uint8).reshape(a, b, 3)).tobytes() for d, a, b in zip(data, h, w)])

    return df.withColumn(pixels, run(pixels, height, width))


def turned(x: np.ndarray, degrees: float, factor: float) -> np.ndarray:
    """Rotated and scaled about the centre, nearest pixel, black outside."""
    h, w = x.shape[:2]
    angle = np.deg2rad(degrees)
    rows, cols = np.mgrid[:h, :w].astype(float)
    dy, dx = (rows - (h - 1) / 2) / factor, (cols - (w - 1) / 2) / factor
    at_row = np.rint(np.cos(angle) * dy - np.sin(angle) * dx + (h - 1) / 2).astype(int)
    at_col = np.rint(np.sin(angle) * dy + np.cos(angle) * dx + (w - 1) / 2).astype(int)
    inside = (at_row >= 0) & (at_row < h) & (at_col >= 0) & (at_col < w)
    return np.where(inside[:, :, None], x[np.clip(at_row, 0, h - 1), np.clip(at_col, 0, w - 1)], 0).astype(np.uint8)


def augment(df: DataFrame, id_col: str, seed: int = 42, pixels: str = "pixels", height: str = "height", width: str = "width") -> DataFrame:
    """Random turn (up to 15 degrees), scale (0.9 to 1.1), brightness (0.8 to 1.2) and flips, each applied to half of the rows.

    What a row gets depends on the seed and its id alone.
    """
    if seed < 0:
        raise ValueError("a seed isn't negative")

    def u(name: str):
        return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("double") / float(2**32)

    def half(name: str, value, neutral: float):
        return F.when(u(f"{name}?") < 0.5, value).otherwise(neutral)

    @F.pandas_udf("binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, degrees: pd.Series, factor: pd.Series, light: pd.Series, flip: pd.Series, turn: pd.Series) -> pd.Series:
        out = []
        for d, a, b, angle, scale, bright, across, over in zip(data, h, w, degrees, factor, light, flip, turn):
            x = _bytes(turned(np.frombuffer(d, np.uint8).reshape(a, b, 3), angle, scale) * bright)
            out.append(np.ascontiguousarray(x[:: -1 if over else 1, :: -1 if across else 1]).tobytes())
        return pd.Series(out)

    angle, scale, light = half("turn", u("turn") * 30 - 15, 0.0), half("scale", u("scale") * 0.2 + 0.9, 1.0), half("light", u("light") * 0.4 + 0.8, 1.0)
    return df.withColumn(pixels, run(pixels, height, width, angle, scale, light, u("across") < 0.5, u("over") < 0.5))
