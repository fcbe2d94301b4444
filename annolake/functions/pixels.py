"""Pixel operators in NumPy (I1, I5, I7, I9, M3, M12, M14, W8, K3, K6, E1), for Arrow UDFs; ``masks`` and
``recipes`` have the others.

Images are height x width x channel uint8 in BGR order, as Spark's image source gives them. What
needs an imaging library, network or trained weights (JPEG encoding, EXIF, GrabCut, inpainting,
foundation-model embeddings and cutouts) raises ``Unavailable`` and never gives an empty result.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Unavailable(RuntimeError):
    """The operation needs a library or model that is not installed."""


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area average in both directions; exact for whole and fractional factors."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        lo, hi = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(1, n + 1))
        w = np.clip(hi - lo, 0, None)
        return w / w.sum(1, keepdims=True)

    a = img.astype(np.float64)
    a = np.tensordot(weights(img.shape[0], height), a, (1, 0))
    return np.moveaxis(np.tensordot(weights(img.shape[1], width), a, (1, 1)), 0, 1)


def gray(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 2 else img[..., 0] if img.shape[2] == 1 else img[..., :3] @ np.array([0.114, 0.587, 0.299])


def dct2(a: np.ndarray) -> np.ndarray:
    def basis(n: int) -> np.ndarray:
        k = np.arange(n)
        m = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
        m[0] /= np.sqrt(2)
        return m

    return basis(a.shape[0]) @ a @ basis(a.shape[1]).T


def phash64(img: np.ndarray) -> int:
    """64 bits of the low frequencies above their median (the first left out of it), signed."""
    c = dct2(resize(np.rint(gray(img.astype(np.float64))), 32, 32))[:8, :8].ravel()
    bits = c > np.median(c[1:])
    return int(np.packbits(bits).view(">i8")[0])


def _lab(bgr: np.ndarray) -> np.ndarray:
    c = bgr[..., ::-1].astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    lum = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    return np.stack([lum * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1) / 255


# The descriptor's layout (a grid of 4 x 4 cells with means and deviations, the 63 lowest
# frequencies after the first, 8 directions) and, in ``EFFECTS`` below, what is drawn without settings.
def appearance(img: np.ndarray) -> np.ndarray:
    """167 numbers: colour moments of a 4 x 4 grid, low frequencies, gradient directions; unit length."""
    if img is None or img.size == 0:
        raise ValueError("empty image")
    small = np.rint(resize(np.repeat(img, 3, 2) if img.shape[2] == 1 else img[..., :3], 64, 64))
    cells = _lab(small).reshape(4, 16, 4, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16, 256, 3)
    moments = np.concatenate([cells.mean(1), cells.std(1)], 1).ravel()
    g = gray(small) / 255
    low = dct2(g)[:8, :8].ravel()[1:]
    p = np.pad(g, 1, mode="reflect")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    turn = (np.arctan2(gy, gx) % (2 * np.pi)) / (2 * np.pi)
    hist = np.bincount(np.minimum(7, (turn * 8).astype(int)).ravel(), np.hypot(gx, gy).ravel(), 8)
    v = np.concatenate([moments, low / (np.linalg.norm(low) + 1e-8), hist / (hist.sum() + 1e-8)])
    return (v / (np.linalg.norm(v) + 1e-8)).astype(np.float32)


#: Embedding backends by name; others may be registered by the caller.
BACKENDS = {"appearance-v1": appearance}


def backend(name: str):
    if name not in BACKENDS:
        raise Unavailable(f"embedding backend {name!r} needs weights that are not installed; available: {sorted(BACKENDS)}")
    return BACKENDS[name]


def rasterize(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Even-odd fill of a polygon at pixel centres, with its border pixels."""
    mask = np.zeros((height, width), bool)
    p = np.asarray(points, float)
    if len(p) < 3:
        return mask
    q = np.roll(p, -1, 0)
    for y in range(max(0, int(p[:, 1].min())), min(height - 1, int(np.ceil(p[:, 1].max()))) + 1):
        cross = (p[:, 1] <= y) != (q[:, 1] <= y)
        xs = np.sort(p[cross, 0] + (y - p[cross, 1]) / (q[cross, 1] - p[cross, 1]) * (q[cross, 0] - p[cross, 0]))
        for a, b in zip(xs[0::2], xs[1::2], strict=False):
            mask[y, max(0, int(np.ceil(a))) : max(0, min(width - 1, int(np.floor(b))) + 1)] = True
    for a, b in zip(p, q, strict=True):
        n = int(np.abs(b - a).max()) + 1
        line = np.rint(np.linspace(a, b, n + 1)).astype(int)
        line = line[(line[:, 0] >= 0) & (line[:, 0] < width) & (line[:, 1] >= 0) & (line[:, 1] < height)]
        mask[line[:, 1], line[:, 0]] = True
    return mask


def polygon_iou(a: np.ndarray, b: np.ndarray, raster: int = 256) -> float:
    """Overlap of two polygons in unit coordinates, drawn with their borders on a square raster (M3)."""
    if len(a) < 3 or len(b) < 3:
        return 0.0
    x, y = (rasterize(np.rint(np.clip(p, 0, 1) * (raster - 1)), raster, raster) for p in (a, b))
    union = int((x | y).sum())
    return int((x & y).sum()) / union if union else 0.0


def mask_bbox(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else None


def visible_masks(masks: list[np.ndarray]) -> list[np.ndarray]:
    """What of each mask later ones leave to be seen."""
    covered, out = None, []
    for m in reversed(masks):
        out.append(m & ~covered if covered is not None else m.copy())
        covered = m | covered if covered is not None else m.copy()
    return out[::-1]


def shift(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    out = np.zeros_like(mask)
    h, w = mask.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def grow(mask: np.ndarray, pixels: int) -> np.ndarray:
    """Dilation by a positive, erosion by a negative number of pixels."""
    m = mask if pixels >= 0 else ~mask
    for _ in range(abs(pixels)):
        m = m | shift(m, 1, 0) | shift(m, -1, 0) | shift(m, 0, 1) | shift(m, 0, -1)
    return m if pixels >= 0 else ~m


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Everything the outside cannot reach."""
    out = np.pad(np.zeros_like(mask), 1, constant_values=True)
    free = np.pad(~mask, 1, constant_values=True)
    while True:
        new = grow(out, 1) & free
        if (new == out).all():
            return ~out[1:-1, 1:-1]
        out = new


def oriented_box(points: np.ndarray) -> np.ndarray:
    """Corners of the smallest rectangle about the points, by angle from the top left one."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 2:
        return np.repeat(p, 4, 0)[:4]

    def half(q: np.ndarray) -> list:
        out: list = []
        for a in q:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (a[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (a[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(a)
        return out

    hull = np.array(half(p)[:-1] + half(p[::-1])[:-1])
    edges = np.roll(hull, -1, 0) - hull
    best = None
    for t in np.unique(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2)):
        r = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        lo, hi = (hull @ r.T).min(0), (hull @ r.T).max(0)
        if best is None or np.prod(hi - lo) < best[0]:
            best = (np.prod(hi - lo), np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]]) @ r)
    c = best[1]
    mid = c.mean(0)
    c = c[np.argsort(np.arctan2(c[:, 1] - mid[1], c[:, 0] - mid[0]))]
    return np.roll(c, -int(np.lexsort((c[:, 0], c.sum(1)))[0]), 0)


def encode_png(img: np.ndarray, level: int = 6) -> bytes:
    """Gray, BGR or BGRA pixels (8 or 16 bit gray) as PNG."""
    a = img[..., None] if img.ndim == 2 else img
    a = a[..., [2, 1, 0, 3][: a.shape[2]]] if a.shape[2] >= 3 else a
    kind = {1: 0, 3: 2, 4: 6}[a.shape[2]]
    raw = a.astype(">u2" if a.dtype == np.uint16 else np.uint8).reshape(a.shape[0], -1)
    rows = b"".join(b"\0" + r.tobytes() for r in raw)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 16 if a.dtype == np.uint16 else 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows, level)) + part(b"IEND", b"")


def encode_jpeg(img: np.ndarray, quality: int = 90) -> bytes:
    raise Unavailable("JPEG encoding needs an imaging library")


def _between(rng: random.Random, cfg: dict, key: str, lo: float, hi: float) -> float:
    a, b = cfg.get(key, (lo, hi))
    return rng.uniform(min(a, b), max(a, b))


def _noise(a: np.ndarray, rng: random.Random, c: dict) -> tuple[np.ndarray, dict]:
    s = max(0.0, _between(rng, c, "sigma", 1.0, 6.0))
    return a + np.random.default_rng(rng.getrandbits(32)).normal(0, s, a.shape), {"sigma": s}


def _brightness(a: np.ndarray, rng: random.Random, c: dict) -> tuple[np.ndarray, dict]:
    b, k = _between(rng, c, "brightness", -0.05, 0.05), _between(rng, c, "contrast", 0.9, 1.1)
    return a * k + b * 255, {"brightness": b, "contrast": k}


def _gamma(a: np.ndarray, rng: random.Random, c: dict) -> tuple[np.ndarray, dict]:
    g = max(0.05, _between(rng, c, "range", 0.9, 1.1))
    return (a / 255) ** g * 255, {"gamma": g}


def _blur(a: np.ndarray, rng: random.Random, c: dict) -> tuple[np.ndarray, dict]:
    lo, hi = c.get("ksize", (3, 7))
    k, t = max(3, rng.randint(int(lo), int(hi)) | 1), rng.uniform(0, np.pi)
    steps = [(round(np.sin(t) * i), round(np.cos(t) * i)) for i in range(-(k // 2), k // 2 + 1)]
    p = np.pad(a, ((k, k), (k, k), (0, 0)), mode="reflect" if min(a.shape[:2]) > k else "edge")
    return sum(p[k + y : k + y + a.shape[0], k + x : k + x + a.shape[1]] for y, x in steps) / len(steps), {"ksize": k, "angle": float(np.degrees(t))}


def _downscale(a: np.ndarray, rng: random.Random, c: dict) -> tuple[np.ndarray, dict]:
    s = min(1.0, max(0.1, _between(rng, c, "scale", 0.7, 0.95)))
    h, w = a.shape[:2]
    return resize(resize(a, max(2, round(w * s)), max(2, round(h * s))), w, h), {"scale": s}


def _vignette(a: np.ndarray, rng: random.Random, c: dict) -> tuple[np.ndarray, dict]:
    s = min(0.95, max(0.0, _between(rng, c, "strength", 0.05, 0.25)))
    y, x = np.linspace(-1, 1, a.shape[0])[:, None], np.linspace(-1, 1, a.shape[1])[None]
    return a * (1 - s * np.clip(np.hypot(x, y), 0, 1))[..., None], {"strength": s}


#: Scene effects in the order they are applied.
EFFECTS = {"brightness_contrast": _brightness, "gamma": _gamma, "gaussian_noise": _noise, "motion_blur": _blur, "downscale": _downscale, "vignette": _vignette}


def apply_recipe(img: np.ndarray, recipe: dict, seed: int) -> tuple[np.ndarray, list[dict]]:
    """The recipe's effects, each with its probability, and what was applied."""
    rng, a, applied = random.Random(seed), img, []
    unknown = set(recipe.get("effects", {})) - set(EFFECTS) - {"jpeg"}
    if unknown:
        raise ValueError(f"unknown effects: {sorted(unknown)}")
    for name, effect in EFFECTS.items():
        c = recipe.get("effects", {}).get(name)
        if isinstance(c, dict) and rng.random() < min(1.0, max(0.0, float(c.get("p", 0)))):
            out, facts = effect(a.astype(np.float64), rng, c)
            a = np.clip(out, 0, 255).astype(np.uint8)
            applied.append({"effect": name, **facts})
    if rng.random() < float(recipe.get("effects", {}).get("jpeg", {}).get("p", 0)):
        raise Unavailable("the jpeg effect needs an imaging library")
    return a, applied


def blend(canvas: np.ndarray, patch: np.ndarray, alpha: np.ndarray, x: int, y: int) -> np.ndarray:
    """The patch over the canvas by its alpha (0-1), clipped to it."""
    out = canvas.copy()
    x1, y1, x2, y2 = max(0, x), max(0, y), min(canvas.shape[1], x + patch.shape[1]), min(canvas.shape[0], y + patch.shape[0])
    if x1 < x2 and y1 < y2:
        a = alpha[y1 - y : y2 - y, x1 - x : x2 - x, None]
        out[y1:y2, x1:x2] = np.rint(out[y1:y2, x1:x2] * (1 - a) + patch[y1 - y : y2 - y, x1 - x : x2 - x] * a).astype(np.uint8)
    return out


def image_features(images: DataFrame, embed: str | None = "appearance-v1") -> DataFrame:
    """(path, width, height, phash, vec) of decoded images; unreadable ones have nulls. One pass
    feeds duplicates, leakage and diversity."""
    fn = backend(embed) if embed else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for o, h, w, c, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if not data or h <= 0:
                    out.append({"path": o})
                    continue
                img = np.frombuffer(data, np.uint8).reshape(h, w, c)
                out.append({"path": o, "width": w, "height": h, "phash": phash64(img), "vec": fn(img).tolist() if fn else None})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("phash", pa.int64()), ("vec", pa.list_(pa.float32()))]))

    return images.select(F.col("origin"), "height", "width", "nChannels", "data").mapInArrow(rows, "path string, width int, height int, phash bigint, vec array<float>")
