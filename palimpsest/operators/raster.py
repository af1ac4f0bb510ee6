"""Raster pages in numpy: PNG, clean-up, crops, tensors. ``clean_pages`` and ``crops`` run them over tables of images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Channel statistics of the models' inputs.
IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
HALF = ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))
LETTERBOX = 114 / 255


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of 8-bit gray (h, w) or RGB (h, w, 3)."""
    high, wide = pixels.shape[:2]
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]
    lines = np.zeros((high, wide * channels + 1), dtype=np.uint8)
    lines[:, 1:] = pixels.reshape(high, -1)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", wide, high, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """Pixels of an 8-bit gray or colour PNG that is not interlaced; anything else is a ValueError."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(raw):
        n, name = struct.unpack(">I4s", raw[at : at + 8])
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", raw[at + 8 : at + 8 + n])
        elif name == b"IDAT":
            body += raw[at + 8 : at + 8 + n]
        at += n + 12
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("only 8-bit gray and colour PNGs that are not interlaced are read")
    wide, high, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(high, wide * channels + 1)
    out = np.zeros((high, wide * channels), dtype=np.uint8)
    above = np.zeros(wide * channels, dtype=np.int32)
    for k in range(high):
        kind, line = int(lines[k, 0]), lines[k, 1:].astype(np.int32)
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            now = line.tolist()
            up = above.tolist()
            for i in range(len(now)):
                left, corner = (now[i - channels], up[i - channels]) if i >= channels else (0, 0)
                if kind == 1:
                    add = left
                elif kind == 3:
                    add = (left + up[i]) // 2
                else:
                    p = left + up[i] - corner
                    a, b, c = abs(p - left), abs(p - up[i]), abs(p - corner)
                    add = left if a <= b and a <= c else up[i] if b <= c else corner
                now[i] = (now[i] + add) & 255
            line = np.array(now, dtype=np.int32)
        above = line & 255
        out[k] = above
    return out.reshape(high, wide) if channels == 1 else out.reshape(high, wide, channels)


def gray(pixels: np.ndarray) -> np.ndarray:
    """8-bit luma."""
    if pixels.ndim == 2:
        return pixels
    if pixels.shape[2] <= 2:
        return pixels[..., 0]
    return np.rint(pixels[..., :3].astype(np.float64) @ [0.2126, 0.7152, 0.0722]).astype(np.uint8)


def rgb(pixels: np.ndarray) -> np.ndarray:
    return np.repeat(gray(pixels)[..., None], 3, axis=2) if pixels.ndim == 2 or pixels.shape[2] < 3 else pixels[..., :3]


def denoised(pixels: np.ndarray, sigma: float = 0.8) -> np.ndarray:
    """Gray, blurred by a Gaussian."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = gray(pixels).astype(np.float64)
    for axis in (0, 1):
        edge = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        out = sum(w * np.take(edge, np.arange(out.shape[axis]) + k, axis=axis) for k, w in enumerate(kernel))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def otsu_threshold(pixels: np.ndarray) -> int:
    """The level that parts the gray values best; 128 where none does."""
    counts = np.bincount(pixels.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(counts), counts.sum()
    sums = np.cumsum(counts * np.arange(256))
    rest = total - below
    ok = (below > 0) & (rest > 0)
    spread = np.zeros(256)
    spread[ok] = below[ok] * rest[ok] * (sums[ok] / below[ok] - (sums[-1] - sums[ok]) / rest[ok]) ** 2
    return int(np.argmax(spread)) if spread.max() > 0 else 128


def binarized(pixels: np.ndarray) -> np.ndarray:
    flat = gray(pixels)
    return np.where(flat >= otsu_threshold(flat), 255, 0).astype(np.uint8)


def projection_variance(pixels: np.ndarray) -> float:
    """Variance of the rows' numbers of dark pixels."""
    return float((pixels < 128).sum(axis=1).var()) if len(pixels) else 0.0


def rotated(pixels: np.ndarray, radians: float) -> np.ndarray:
    """Turned about the centre, nearest pixel, white outside, same size."""
    high, wide = pixels.shape
    cy, cx = high / 2, wide / 2
    y, x = np.mgrid[0:high, 0:wide]
    c, s = np.cos(radians), np.sin(radians)
    away = lambda v: (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(int)
    sx, sy = away(c * (x - cx) + s * (y - cy) + cx), away(-s * (x - cx) + c * (y - cy) + cy)
    ok = (sx >= 0) & (sx < wide) & (sy >= 0) & (sy < high)
    out = np.full_like(pixels, 255)
    out[ok] = pixels[sy[ok], sx[ok]]
    return out


def skew_angle(pixels: np.ndarray) -> float:
    """Degrees that make the rows of text most even: a search by 0.1 to 10 either way, then by 0.2 around the best; as it is where
    nothing is better."""
    high, wide = pixels.shape
    small = pixels
    if wide > 500:  # the nearest pixel of each of 500 columns, and of as many rows as keep the shape
        tall = max(1, high * 500 // wide)
        small = pixels[(2 * np.arange(tall) + 1) * high // (2 * tall)][:, (2 * np.arange(500) + 1) * wide // 1000]
    worth = lambda a: projection_variance(rotated(small, np.deg2rad(a)))
    best, top = 0.0, projection_variance(small)
    for a in np.arange(-100, 101) / 10:
        if (v := worth(a)) > top:
            best, top = float(a), v
    for a in best + np.arange(-5, 6) / 5:
        if abs(a) <= 15 and (v := worth(a)) > top:
            best, top = float(a), v
    return best


def deskewed(pixels: np.ndarray) -> np.ndarray:
    flat = gray(pixels)
    angle = skew_angle(flat)
    return flat if abs(angle) < 0.2 else rotated(flat, np.deg2rad(angle))


def cropped(pixels: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part of a box in the image, at least one pixel."""
    high, wide = pixels.shape[:2]
    x, y = min(max(x, 0), wide - 1), min(max(y, 0), high - 1)
    return pixels[y : y + max(1, min(h, high - y)), x : x + max(1, min(w, wide - x))]


def resized(pixels: np.ndarray, wide: int, high: int) -> np.ndarray:
    """Bilinear."""
    src = pixels.astype(np.float64)
    y = np.clip((np.arange(high) + 0.5) * src.shape[0] / high - 0.5, 0, src.shape[0] - 1)
    x = np.clip((np.arange(wide) + 0.5) * src.shape[1] / wide - 0.5, 0, src.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, src.shape[0] - 1), np.minimum(x0 + 1, src.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if src.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    top, low = src[y0][:, x0] * (1 - fx) + src[y0][:, x1] * fx, src[y1][:, x0] * (1 - fx) + src[y1][:, x1] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def normalized(pixels: np.ndarray, mean, std) -> np.ndarray:
    """Tensor (1, 3, h, w) of (value / 255 - mean) / std."""
    out = (rgb(pixels).astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)
    return np.ascontiguousarray(out.transpose(2, 0, 1)[None])


def orientation_tensor(pixels: np.ndarray) -> np.ndarray:
    return normalized(resized(rgb(pixels), 224, 224), *IMAGENET)


def table_tensor(pixels: np.ndarray) -> np.ndarray:
    return normalized(resized(rgb(pixels), 800, 800), *IMAGENET)


def layout_tensor(pixels: np.ndarray, side: int = 1024) -> tuple[np.ndarray, float, float]:
    """The page at the top left of a square, and what boxes are multiplied by to go back."""
    high, wide = pixels.shape[:2]
    scale = min(side / wide, side / high)
    w, h = max(1, int(wide * scale)), max(1, int(high * scale))
    out = np.full((1, 3, side, side), LETTERBOX, dtype=np.float32)
    out[0, :, :h, :w] = resized(rgb(pixels), w, h).transpose(2, 0, 1).astype(np.float32) / 255
    return out, wide / w, high / h


def detection_tensor(pixels: np.ndarray) -> np.ndarray:
    """Sides rounded up to multiples of 32."""
    high, wide = pixels.shape[:2]
    return normalized(resized(rgb(pixels), -(-wide // 32) * 32, -(-high // 32) * 32), *IMAGENET)


def recognition_tensor(pixels: np.ndarray) -> np.ndarray:
    high, wide = pixels.shape[:2]
    return normalized(resized(rgb(pixels), max(wide * 48 // high, 1), 48), *HALF)


def recognition_batch(crops: list[np.ndarray]) -> np.ndarray:
    """Several lines as one tensor, zeros to the right of the shorter."""
    tensors = [recognition_tensor(c) for c in crops]
    out = np.zeros((len(tensors), 3, 48, max((t.shape[3] for t in tensors), default=0)), dtype=np.float32)
    for k, t in enumerate(tensors):
        out[k, :, :, : t.shape[3]] = t[0]
    return out


def regions(score_map: np.ndarray, threshold: float, smallest: int) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of the 4-connected parts above a threshold, in the order of their first pixels."""
    on = score_map > threshold
    label = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    while True:  # every pixel takes the smallest label around it, along whole runs
        before = label
        for axis in (0, 1):
            for back in (False, True):
                run = np.flip(label, axis) if back else label
                run = np.moveaxis(run, axis, 0).copy()
                for k in range(1, len(run)):
                    both = (run[k] > 0) & (run[k - 1] > 0)
                    run[k] = np.where(both, np.minimum(run[k], run[k - 1]), run[k])
                run = np.moveaxis(run, 0, axis)
                label = np.flip(run, axis) if back else run
        if (label == before).all():
            break
    out = []
    for name in np.unique(label[label > 0]).tolist():
        y, x = np.nonzero(label == name)
        w, h = int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)
        if w >= smallest and h >= smallest:
            out.append((int(x.min()), int(y.min()), w, h))
    return out


def upright(pixels: np.ndarray, orientation: str) -> np.ndarray:
    """The page turned back from ``orientation``; sides change with it."""
    return np.rot90(pixels, {"Normal": 0, "Rotado90": 1, "Rotado180": 2, "Rotado270": 3}[orientation])


def clean_pages(images: DataFrame, denoise: bool = True, binarize: bool = True, deskew: bool = True) -> DataFrame:
    """``images`` (doc_id, page_no, png) cleaned; pages without bytes stay as they are."""

    def run(batches: Iterator[pd.DataFrame]):
        for rows in batches:
            out = []
            for raw in rows["png"]:
                if raw is not None:
                    pixels = decode_png(raw)
                    for wanted, step in ((denoise, denoised), (binarize, binarized), (deskew, deskewed)):
                        pixels = step(pixels) if wanted else pixels
                    raw = encode_png(pixels)
                out.append(raw)
            yield rows.assign(png=out)

    return images.mapInPandas(run, images.schema)


def crops(elements: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, page_no, block_idx and png of every element's box on its page; null where the page has no bytes."""
    rows = elements.select("doc_id", "page_no", "block_idx", "x", "y", "w", "h").join(images, ["doc_id", "page_no"], "left")

    def run(batches: Iterator[pd.DataFrame]):
        for part in batches:
            png = [None if r.png is None else encode_png(cropped(decode_png(r.png), r.x, r.y, r.w, r.h)) for r in part.itertuples()]
            yield part[["doc_id", "page_no", "block_idx"]].assign(png=png)

    return rows.mapInPandas(run, f"doc_id {dict(elements.dtypes)['doc_id']}, page_no int, block_idx int, png binary")
