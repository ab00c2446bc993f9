"""Array kernels over images, as NumPy functions and as pandas UDFs that return one struct a row.

Images are binary columns of 8-bit grey pixels in row order with height and width; thermal frames are
arrays of floats. Pixels of a row are one image, so no shuffle is needed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-6
OPTICAL = ("mean", "std", "entropy", "p95", "glare", "sharpness", "dark")
QUALITY = ("pct_dark_clipped", "pct_highlight_saturated", "rms_contrast", "michelson", "laplacian_variance", "tenengrad", "noise_proxy", "spatial_frequency", "average_gradient", "log_rms")
THERMAL = ("mean", "std", "max", "p95_p05_delta", "fg_fraction", "anomaly_score")
FUSION = ("mi", "ssim", "fg_contrast")


def doubles(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def grey(data: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8)[: height * width].reshape(height, width)


def reflected(a: np.ndarray, n: int) -> np.ndarray:
    return np.pad(a, n, mode="reflect") if min(a.shape) > n else np.pad(a, n, mode="edge")


def convolved(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with a small kernel; borders are mirrored."""
    k = kernel.shape[0] // 2
    p, out = reflected(a.astype(np.float64), k), np.zeros(a.shape)
    for i in range(kernel.shape[0]):
        for j in range(kernel.shape[1]):
            if kernel[i, j]:
                out += kernel[i, j] * p[i : i + a.shape[0], j : j + a.shape[1]]
    return out


def gaussian(n: int, sigma: float = 0.0) -> np.ndarray:
    sigma = sigma or 0.3 * ((n - 1) * 0.5 - 1) + 0.8
    x = np.exp(-((np.arange(n) - n // 2) ** 2) / (2 * sigma**2))
    return np.outer(x, x) / x.sum() ** 2


LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)


def entropy(a: np.ndarray) -> float:
    p = np.bincount(a.ravel(), minlength=256) / max(1, a.size)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def optical(a: np.ndarray) -> tuple:
    """Mean, deviation, entropy, p95, share over 240, variance of the Laplacian, share under 30."""
    return (float(a.mean()), float(a.std()), entropy(a), float(np.percentile(a, 95)), float((a > 240).mean()), float(convolved(a, LAPLACE).var()), float((a < 30).mean()))


def quality(a: np.ndarray) -> tuple:
    f = a.astype(np.float64)
    low, high = np.percentile(f, [5, 95])
    gx, gy = convolved(f, SOBEL), convolved(f, SOBEL.T)
    dy, dx = np.diff(f, axis=0), np.diff(f, axis=1)
    thin = min(f.shape) < 2
    frequency = 0.0 if thin else float(np.sqrt((dy**2).mean() + (dx**2).mean()))
    gradient = 0.0 if thin else float(np.sqrt((dx[:-1] ** 2 + dy[:, :-1] ** 2) / 2).mean())
    blurred = np.round(convolved(f, gaussian(5)))
    return (
        float((a <= 5).mean()), float((a >= 250).mean()), float(f.std()), float((high - low) / max(high + low, EPS)), float(convolved(a, LAPLACE).var()),
        float((gx * gx + gy * gy).mean()), float((f - blurred).std()), frequency, gradient, float(np.log1p(np.sqrt((f**2).mean()))),
    )


def thermal(t: np.ndarray) -> tuple:
    m, s = float(t.mean()), float(t.std())
    p95, p5 = np.percentile(t, [95, 5])
    return (m, s, float(t.max()), float(p95 - p5), float((t > m + 1.5 * s).mean()), float((t.max() - np.median(t)) / (s + 1e-6)))


def mutual_information(a: np.ndarray, b: np.ndarray, bins: int = 32) -> float:
    h, _, _ = np.histogram2d(a.ravel(), b.ravel(), bins=bins, range=((0, 255), (0, 255)))
    p = h / h.sum()
    e = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    return float((p[p > 0] * np.log2(p[p > 0] / e[p > 0])).sum())


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    x, y, g = a.astype(float), b.astype(float), gaussian(7, 1.5)
    mx, my = convolved(x, g), convolved(y, g)
    vx, vy, cov = convolved(x * x, g) - mx * mx, convolved(y * y, g) - my * my, convolved(x * y, g) - mx * my
    score = (2 * mx * my + 6.5025) * (2 * cov + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225) + EPS)
    return float(np.clip(score.mean(), -1, 1))


def foreground_contrast(a: np.ndarray, mask: np.ndarray) -> float | None:
    m = mask > 0
    if not m.any() or (~m).sum() < 4:
        return None
    return float((a[m].mean() - a[~m].mean()) / (a[~m].astype(float).std() + EPS))


def difference_hash(a: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 cells is darker than its right neighbour, highest bit first."""
    c = cells(a, 8, 9)
    return signed((c[:, 1:] > c[:, :-1]).ravel())


def cells(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of an image's rows x columns cells."""
    r, c = np.linspace(0, a.shape[0], rows + 1).astype(int), np.linspace(0, a.shape[1], columns + 1).astype(int)
    return np.array([[a[y0 : max(y0 + 1, y1), x0 : max(x0 + 1, x1)].mean() for x0, x1 in zip(c, c[1:], strict=False)] for y0, y1 in zip(r, r[1:], strict=False)])


def signed(bits: np.ndarray) -> int:
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - 2**64 if value >= 2**63 else value


def average_hash(a: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 cells is at least as bright as their mean, first cell lowest."""
    c = cells(a, 8, 8)
    return signed((c >= c.mean()).ravel()[::-1])


def saturation(colour: np.ndarray) -> float:
    """Mean saturation, 0 to 255, of an image with three channels."""
    top, low = colour.max(-1).astype(float), colour.min(-1).astype(float)
    return float(np.where(top > 0, np.round(255 * (top - low) / np.maximum(top, 1)), 0).mean())


def edge_ratio(a: np.ndarray, b: np.ndarray, fused: np.ndarray) -> float:
    """Sharpness of a fused image as a share of its sharper source, 0 to 1."""
    v = [float(convolved(x, LAPLACE).var()) for x in (a, b, fused)]
    return float(np.clip(v[2] / max(v[0], v[1], EPS), 0, 1))


def stretched(t: np.ndarray, low: float = 2.0, high: float = 98.0) -> np.ndarray:
    """Percentile stretch to 8 bits."""
    a, b = np.percentile(t, [low, high])
    return np.zeros(t.shape, np.uint8) if b <= a else (np.clip((t - a) / (b - a), 0, 1) * 255).astype(np.uint8)


def blended(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    return np.clip(np.round(alpha * a.astype(float) + (1 - alpha) * b.astype(float)), 0, 255).astype(np.uint8)


def transition_weight(level: float, low: float, high: float) -> float:
    return float(np.clip((level - low) / (high - low), 0, 1)) if high > low else float(level >= high)


def detections(raw: np.ndarray, scale: float, zero: int, threshold: float) -> list[tuple[float, float, float]]:
    """(score, x, y) of the cells of an 8-bit output grid (rows, columns, classes) over the threshold,
    best first; softmax over classes, or a sigmoid if there is one."""
    p = (raw.astype(np.float32) - zero) * scale
    if p.shape[-1] >= 2:
        e = np.exp(p - p.max(-1, keepdims=True))
        hot = (e / e.sum(-1, keepdims=True))[..., 1]
    else:
        hot = 1 / (1 + np.exp(-p[..., 0]))
    found = [(float(hot[r, c]), (c + 0.5) / hot.shape[1], (r + 0.5) / hot.shape[0]) for r, c in np.argwhere(hot >= threshold)]
    return sorted(found, reverse=True)


def unmap_centroid(x: float, y: float, width: int, height: int, mode: str) -> tuple[float, float]:
    """Place in the image of a point in the model's square input (crop, letterbox or passthrough)."""
    if mode == "passthrough":
        return x * width, y * height
    if mode not in ("crop", "letterbox"):
        raise ValueError(mode)
    side = min(width, height) if mode == "crop" else max(width, height)
    sign = 1 if mode == "crop" else -1
    return sign * (abs(width - side) // 2) + x * side, sign * (abs(height - side) // 2) + y * side


def glare_metrics(a: np.ndarray, high: float = 95.0, saturate: float = 233.0) -> tuple[bool, bool, float, float, float]:
    """Whether highlights need compressing, whether the display needs it, and three levels."""
    hist = np.cumsum(np.bincount(a.ravel(), minlength=256))

    def level(p: float) -> float:
        n = int(hist[-1])
        rank = max(0, min(int(np.ceil(p / 100 * n)) - 1, n - 1))
        return float(np.searchsorted(hist, rank, side="left"))

    hi, p99, top = level(high), level(99.0), float(a.max())
    return hi >= saturate or p99 >= 242 or top >= 249, hi >= 248 or (p99 >= 254 and top >= 254), hi, p99, top


def overlaid(a: np.ndarray, b: np.ndarray, mask: np.ndarray, weight: float = 0.45) -> np.ndarray:
    """b over a where the mask (0 to 255) is set, with this weight; fractions are dropped."""
    w = weight * mask.astype(float) / 255
    return np.clip(a * (1 - w) + b * w, 0, 255).astype(np.uint8)


def heat_weighted(a: np.ndarray, b: np.ndarray, low: float = 0.15, high: float = 0.65) -> np.ndarray:
    """b over a, each pixel with its own heat as weight, within limits."""
    w = np.clip(b.astype(float) / 255, low, high)
    return np.clip(a * (1 - w) + b * w, 0, 255).astype(np.uint8)


def coloured(a: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Grey levels through a table of 32, 64, 128 or 256 colours; other sizes are an error."""
    n = len(table)
    if n not in (32, 64, 128, 256):
        raise ValueError(n)
    return table[a if n == 256 else a.astype(np.uint16) * (n - 1) // 255]


def edge_enhanced(a: np.ndarray, strength: float = 0.2) -> np.ndarray:
    """Levels plus a share of the size of the Laplacian of aperture 3."""
    kernel = np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]], float)
    return a if abs(strength) < 1e-6 else np.clip(a + strength * np.abs(convolved(a, kernel)), 0, 255).astype(np.uint8)


def needs_compression(a: np.ndarray, percent: float = 99.0, saturate: float = 240.0) -> bool:
    return float(np.percentile(a, percent)) >= saturate


def hot_display(a: np.ndarray, percent: float = 99.5, saturate: float = 252.0, top: float = 253.0) -> bool:
    """Whether the hot end is at the limit and pixels reach it."""
    return float(np.percentile(a, percent)) >= saturate and float(a.max()) >= top


def compressed(a: np.ndarray, percent: float = 99.0, saturate: float = 240.0, gamma: float = 0.74) -> np.ndarray:
    """Gamma over all levels if the hot end needs it."""
    return np.clip((a / 255.0) ** gamma * 255, 0, 255).astype(np.uint8) if needs_compression(a, percent, saturate) else a


def contribution(a: np.ndarray, fused: np.ndarray, deltas: tuple[int, ...]) -> list[float]:
    """Per cent of the pixels that differ by more than each delta."""
    d = np.abs(fused.astype(int) - a.astype(int))
    return [round(float((d > x).mean()) * 100, 2) for x in deltas]


def background_residual(residuals: np.ndarray, share: float = 0.15) -> tuple[float, float, float]:
    """Root mean square, median size and deviation of the residuals (frames, pixels) of pixels whose mean
    size is under `share` of the largest; NaN if there are none."""
    size = np.abs(residuals).mean(0)
    calm = residuals[:, size < share * (size + 1e-6).max()]
    return tuple(round(float(x), 6) for x in (np.sqrt((calm**2).mean()), np.median(np.abs(calm)), calm.std())) if calm.size else (float("nan"),) * 3


def _struct(f, names: tuple[str, ...]):
    @F.pandas_udf(doubles(names))
    def udf(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(grey(d, h, w)) for d, h, w in zip(data, height, width, strict=True)], columns=list(names))

    return udf


optical_stats = _struct(optical, OPTICAL)
quality_metrics = _struct(quality, QUALITY)


@F.pandas_udf(doubles(THERMAL))
def thermal_stats(frames: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([thermal(np.asarray(t, np.float32)) for t in frames], columns=list(THERMAL))


@F.pandas_udf(T.LongType())
def dhash(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([difference_hash(grey(d, h, w)) for d, h, w in zip(data, height, width, strict=True)])


@F.pandas_udf(doubles(FUSION))
def fusion_metrics(a: pd.Series, b: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    out = []
    for x, y, h, w in zip(a, b, height, width, strict=True):
        p, q = grey(x, h, w), grey(y, h, w)
        out.append((mutual_information(p, q), ssim(p, q), foreground_contrast(p, q > np.percentile(q, 85))))
    return pd.DataFrame(out, columns=list(FUSION))


@F.pandas_udf(T.BinaryType())
def alpha_blend(a: pd.Series, b: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([blended(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), k).tobytes() for x, y, k in zip(a, b, alpha, strict=True)])
