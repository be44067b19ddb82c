"""Quality of page images, as figures and as the decisions that follow from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Least resolution, most skew, least contrast, most noise, most unevenness.
MIN_DPI, MAX_SKEW, MIN_CONTRAST, MAX_NOISE, MAX_UNEVEN = 200.0, 0.5, 0.3, 0.4, 0.5
SCHEMA = "img long, dpi double, skew double, contrast double, noise double, uneven double"


def gray(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return x[..., 0] if channels == 1 else (x[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def dpi(g: np.ndarray) -> float:
    """Six times the median height of text lines in pixels (twelve points are a sixth of an inch); -1 with fewer than three lines."""
    if min(g.shape) < 50:
        return -1.0
    ink = np.concatenate([[False], (g < g.mean()).sum(1) > 0.01 * g.shape[1], [False]])
    edge = np.flatnonzero(np.diff(ink.astype(np.int8)))
    heights = edge[1::2] - edge[::2]
    if len(edge) and edge[-1] == len(g):
        heights = heights[:-1]  # a line that runs to the lower edge is cut off
    heights = heights[(heights >= 5) & (heights <= 200)]
    return float(np.median(heights)) * 6 if len(heights) >= 3 else -1.0


def skew(g: np.ndarray) -> float:
    """The angle, in half degrees up to 15, whose sheared rows have the sharpest profile; the smaller one on ties."""
    h, w = g.shape
    if min(h, w) < 50:
        return 0.0
    total = np.zeros((h, w + 1))
    np.cumsum(g < g.mean(), axis=1, out=total[:, 1:])
    rows, best, at = np.arange(h), -1.0, 0.0
    for step in sorted(range(-30, 31), key=lambda s: (abs(s), -s)):
        shift = np.round((rows - h / 2) * np.tan(np.radians(step / 2))).astype(int)
        margin = int(np.abs(shift).max())
        if margin >= w // 2 or w - 2 * margin < 10:
            continue
        a, b = np.clip(margin + shift, 0, w), np.clip(w - margin + shift, 0, w)
        sharp = float(np.var(total[rows, b] - total[rows, a]))
        if sharp > best:
            best, at = sharp, step / 2
    return at


def contrast(g: np.ndarray) -> float:
    lo, hi = np.percentile(g, (5, 95)) if g.size else (0, 0)
    return float(hi - lo) / 255


def noise(g: np.ndarray) -> float:
    """Mean of two shares: how far the Laplacian's variance is beyond that of text, and how many pixels are extreme."""
    if min(g.shape, default=0) < 3:
        return 0.0
    x = g.astype(float)
    around = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    return float(np.clip((around.var() - 2000) / 8000, 0, 1) + min(1.0, 5 * float(((g < 5) | (g > 250)).mean()))) / 2


def uneven(g: np.ndarray) -> float:
    h, w = g.shape
    if min(h, w) < 40:
        return 0.0
    cells = g[: h // 4 * 4, : w // 4 * 4].reshape(4, h // 4, 4, w // 4)
    return min(1.0, float(cells.mean((1, 3)).std()) / 50)


def diagnosed(images: DataFrame) -> DataFrame:
    """The five figures of images (img, data, width, height, channels), raw bytes row by row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                g = gray(r.data, r.width, r.height, r.channels)
                out.append((r.img, dpi(g), skew(g), contrast(g), noise(g), uneven(g)))
            yield pd.DataFrame(out, columns=["img", "dpi", "skew", "contrast", "noise", "uneven"])

    return images.select("img", "data", "width", "height", "channels").mapInPandas(rows, SCHEMA)


def decisions(report: DataFrame) -> DataFrame:
    """Adds what each image needs."""
    need = {
        "needs_upscale": (F.col("dpi") != -1) & (F.col("dpi") < MIN_DPI), "needs_deskew": F.abs("skew") > MAX_SKEW, "needs_contrast": F.col("contrast") < MIN_CONTRAST,
        "needs_denoise": F.col("noise") > MAX_NOISE, "needs_binarize": F.col("uneven") > MAX_UNEVEN,
    }
    out = report.withColumns(need)
    return out.withColumn("is_clean", ~F.greatest(*(F.col(k) for k in need)))


def crop_box(box: tuple, page: tuple, pixels: tuple, padding: int = 5) -> tuple:
    """Pixel columns (left, top, right, bottom) of a box on a page, with padding, inside the image."""
    (x0, y0, x1, y1), (pw, ph), (w, h) = box, page, pixels
    zero = F.lit(0)
    return (
        F.greatest(zero, F.floor(x0 * w / pw) - padding), F.greatest(zero, F.floor(y0 * h / ph) - padding),
        F.least(w, F.ceil(x1 * w / pw) + padding), F.least(h, F.ceil(y1 * h / ph) + padding),
    )
