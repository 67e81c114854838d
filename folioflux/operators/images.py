"""Image kernels on numpy arrays: thresholding, text rows, ruled grids, lighting, skew, crops.

Pixels come from Spark's own image source; nothing here needs an image library.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import hypot
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from folioflux.functions.schemas import GRIDS
from folioflux.plans.pages import Edge, Grid, by_running_median


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """The image source's bytes (B, G, R order) as an array."""
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image.astype(np.float32)
    return image[..., 0].astype(np.float32) if image.shape[2] == 1 else image[..., :3].astype(np.float32) @ np.array([0.114, 0.587, 0.299], np.float32)


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window, edges repeated, from an integral image."""
    r = size // 2
    padded = np.pad(image.astype(np.float64), r, mode="edge")
    total = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    return ((total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]) / n**2).astype(np.float32)


def dark(image: np.ndarray, window: int = 31, offset: float = 12.0) -> np.ndarray:
    """Pixels darker than their surroundings by the offset."""
    g = gray(image)
    return g < box_mean(box_mean(g, window // 2 | 1), window // 2 | 1) - offset


def long_runs(mask: np.ndarray, length: int) -> np.ndarray:
    """Pixels of horizontal runs of at least `length`: an opening by a flat line."""
    total = np.pad(np.cumsum(mask, 1, dtype=np.int32), ((0, 0), (1, 0)))
    if mask.shape[1] < length:
        return np.zeros_like(mask)
    full = total[:, length:] - total[:, :-length] == length
    marks = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    marks[:, : full.shape[1]] += full
    marks[:, length : length + full.shape[1]] -= full
    return np.cumsum(marks, 1)[:, :-1] > 0


def labelled_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and component of each horizontal run; runs that touch (8 neighbours) share a component.

    Each run is joined with touching runs of the row above by union-find, so the work follows the runs, not the area.
    """
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, x1 = np.nonzero(edge == 1)
    x2 = np.nonzero(edge == -1)[1]
    up = list(range(len(ys)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    first = np.searchsorted(ys, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if x1[i] <= x2[j] and x1[j] <= x2[i]:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if x2[i] < x2[j]:
                i += 1
            else:
                j += 1
    label = np.unique([root(k) for k in range(len(ys))], return_inverse=True)[1] if len(ys) else np.zeros(0, int)
    return ys, x1, x2, label


@dataclass(frozen=True)
class Segment:
    """A near-horizontal stroke: slope, height at the middle, length."""

    slope: float
    at: float
    length: float


def segments(mask: np.ndarray, middle: float, steepest: float = 0.20, family: float = 0.055) -> list[Segment]:
    """Straight strokes of a mask of horizontal runs: connected runs over 16 % of the width with a line fitted through
    them; steep ones and ones far off the median slope are dropped."""
    ys, x1, x2, label = labelled_runs(mask)
    if not len(ys):
        return []
    n, size, x = label.max() + 1, (x2 - x1).astype(float), (x1 + x2) / 2
    total = np.bincount(label, size)
    mx, my = np.bincount(label, size * x) / total, np.bincount(label, size * ys) / total
    dx, dy = x - mx[label], ys - my[label]
    # a run's own spread keeps a single run level
    spread = np.bincount(label, size * (dx**2 + size**2 / 12))
    slope = np.bincount(label, size * dx * dy) / np.maximum(spread, 1e-9)
    low, high = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    np.minimum.at(low, label, x1)
    np.maximum.at(high, label, x2)
    length = np.hypot(high - low, slope * (high - low))
    out = [Segment(float(slope[k]), float(my[k] + slope[k] * (middle - mx[k])), float(length[k])) for k in np.flatnonzero((length >= 0.16 * mask.shape[1]) & (np.abs(slope) <= steepest))]
    if len(out) < 3:
        return out
    usual = median(s.slope for s in out)
    return [s for s in out if abs(s.slope - usual) <= family]


def edges_of(strokes: list[Segment], middle: float, dimension: int, tolerance: float) -> list[Edge]:
    """Strokes clustered by height; support is their length over the dimension, 0.18 at least."""
    out = []
    for cluster in by_running_median(sorted(strokes, key=lambda s: s.at), lambda s: s.at, tolerance):
        total = sum(s.length for s in cluster)
        support = min(1.0, total / dimension)
        if support >= 0.18:
            slope = sum(s.slope * s.length for s in cluster) / total
            out.append((slope, median(s.at for s in cluster) - slope * middle, support))
    return sorted(out, key=lambda e: e[0] * middle + e[1])


def grid_confidence(rows: list[Edge], columns: list[Edge]) -> float:
    if len(rows) < 3 or len(columns) < 2:
        return 0.0
    support = [e[2] for e in (*rows, *columns)]
    return round(0.40 * min(1.0, (len(rows) - 2) / 8) + 0.35 * min(1.0, (len(columns) - 1) / 6) + 0.25 * sum(support) / len(support), 4)


def with_bottom_edge(rows: list[Edge], width: int, height: int) -> list[Edge]:
    """Edges with one below where the page ends within 1.6 usual steps of the last."""
    middle = width / 2
    at = [s * middle + b for s, b, _ in rows]
    gaps = [b - a for a, b in zip(at, at[1:]) if b > a]
    if len(rows) < 4 or not gaps:
        return rows
    typical = median(gaps[-8:])
    if not max(6.0, 0.008 * height) < height - at[-1] < 1.60 * typical:
        return rows
    last = rows[-5:]
    slope = median(e[0] for e in last)
    return [*rows, (slope, at[-1] + typical - slope * middle, min(0.50, median(e[2] for e in last)))]


def detect_grid(image: np.ndarray, least: float = 0.55) -> Grid | None:
    """Ruled lines of a page as a grid, if its confidence reaches `least`."""
    ink = dark(image)
    height, width = ink.shape
    across = segments(long_runs(ink, max(20, width // 35)), width / 2)
    down = segments(long_runs(ink.T, max(20, height // 35)), height / 2, family=0.07)
    rows = with_bottom_edge(edges_of(across, width / 2, width, max(4.0, 0.006 * height)), width, height)
    columns = edges_of(down, height / 2, height, max(4.0, 0.004 * width))
    sure = grid_confidence(rows, columns)
    return Grid(rows, columns, sure) if sure >= least else None


def overlay(image: np.ndarray, grid: Grid) -> np.ndarray:
    """A copy with the grid's lines drawn, rows green, columns blue."""
    out = np.repeat(gray(image)[..., None], 3, 2).astype(np.uint8)
    height, width = out.shape[:2]
    x, y = np.arange(width), np.arange(height)
    for s, b, _ in grid.rows:
        at = np.round(s * x + b).astype(int)
        ok = (at >= 0) & (at < height)
        out[at[ok], x[ok]] = (0, 180, 0)
    for s, b, _ in grid.columns:
        at = np.round(s * y + b).astype(int)
        ok = (at >= 0) & (at < width)
        out[y[ok], at[ok]] = (220, 80, 0)
    return out


@dataclass(frozen=True)
class TextRow:
    """A band of text: left, top, right, bottom, strength, baseline."""

    x1: int
    y1: int
    x2: int
    y2: int
    strength: float
    baseline: float | None = None

    @property
    def y(self) -> float:
        return (self.y1 + self.y2) / 2 if self.baseline is None else self.baseline

    @property
    def tall(self) -> int:
        return self.y2 - self.y1


def blobs(mask: np.ndarray) -> np.ndarray:
    """Connected components as rows left, top, width, height, area, mean y."""
    ys, x1, x2, label = labelled_runs(mask)
    if not len(ys):
        return np.zeros((0, 6))
    n, size = label.max() + 1, (x2 - x1).astype(float)
    out = np.zeros((n, 6))
    low, high = np.full((2, n), np.iinfo(np.int64).max), np.zeros((2, n), np.int64)
    for k, (a, b) in enumerate(((x1, x2), (ys, ys + 1))):
        np.minimum.at(low[k], label, a)
        np.maximum.at(high[k], label, b)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = low[0], low[1], high[0] - low[0], high[1] - low[1]
    out[:, 4] = np.bincount(label, size)
    out[:, 5] = np.bincount(label, size * ys) / out[:, 4]
    return out


def text_rows(image: np.ndarray) -> list[TextRow]:
    """Bands around the peaks of letter-sized blobs' heights: strongest first, 6.5 % of the page apart, 60 at most."""
    height, width = image.shape[:2]
    b = blobs(dark(image, 31, 15.0))
    letters = b[(b[:, 3] >= 3) & (b[:, 3] <= max(20, round(0.09 * height))) & (b[:, 2] >= 2) & (b[:, 2] <= max(80, round(0.18 * width))) & (b[:, 4] >= 8)]
    profile = np.bincount(np.round(letters[:, 5]).astype(int), np.minimum(letters[:, 4], 100.0), height)[:height] if len(letters) else np.zeros(height)
    n = max(15, round(0.038 * height)) | 1
    smooth = np.convolve(profile, np.ones(n) / n, "same")
    apart, top = max(35, round(0.065 * height)), smooth.max(initial=0.0)
    peaks: list[int] = []
    for y in sorted(np.flatnonzero(smooth >= max(4.0, 0.12 * top)).tolist(), key=lambda y: -smooth[y]) if top > 0 else ():
        if len(peaks) < 60 and all(abs(y - p) >= apart for p in peaks):
            peaks.append(y)
    peaks.sort()
    if len(peaks) < 3:
        return []
    half = max(24, apart // 2)
    cuts = [peaks[0] - half, *((a + b) // 2 for a, b in zip(peaks, peaks[1:])), peaks[-1] + half]
    rows = [TextRow(0, max(0, a), width, min(height, b), float(smooth[p]), float(p)) for p, a, b in zip(peaks, cuts, cuts[1:])]
    return [r for r in rows if r.tall >= 18]


def rows_of_grid(grid: Grid, width: int, height: int) -> list[TextRow]:
    """Bands between a grid's rows within its columns; narrow and flat ones are dropped."""
    out = []
    for (s, b, p), (s2, b2, p2) in zip(grid.rows, grid.rows[1:]):
        middle = (s * width / 2 + b + s2 * width / 2 + b2) / 2
        xs = Grid._at(grid.columns, middle)
        left, right = (max(0, round(min(xs))), min(width, round(max(xs)))) if len(xs) >= 2 else (0, width)
        top, bottom = max(0, round(min(s * left, s * right) + b)), min(height, round(max(s2 * left, s2 * right) + b2))
        if right - left >= 40 and bottom - top >= 18:
            out.append(TextRow(left, top, right, bottom, (p + p2) / 2, middle))
    return out


Point = tuple[float, float]


@dataclass(frozen=True)
class Cell:
    row: int
    column: int
    corners: tuple[Point, Point, Point, Point]  # clockwise from the top left

    def _side(self, a: int, b: int, c: int, d: int) -> int:
        p = self.corners
        return max(12, round((hypot(p[b][0] - p[a][0], p[b][1] - p[a][1]) + hypot(p[d][0] - p[c][0], p[d][1] - p[c][1])) / 2))

    @property
    def width(self) -> int:
        return self._side(0, 1, 3, 2)

    @property
    def height(self) -> int:
        return self._side(0, 3, 1, 2)

    def at(self, u: float, v: float) -> Point:
        """The point at shares u across and v down."""
        a, b, c, d = (np.array(p) for p in self.corners)
        x, y = (a * (1 - u) + b * u) * (1 - v) + (d * (1 - u) + c * u) * v
        return float(x), float(y)

    def padded(self, share: float = 0.03) -> "Cell":
        return Cell(self.row, self.column, (self.at(0, -share), self.at(1, -share), self.at(1, 1 + share), self.at(0, 1 + share)))


def crossing(row: Edge, column: Edge) -> Point:
    """Where y = s x + b meets x = t y + c."""
    d = 1.0 - row[0] * column[0]
    y = row[1] if abs(d) < 1e-6 else (row[0] * column[1] + row[1]) / d
    return column[0] * y + column[1], y


def cells_of(grid: Grid) -> list[Cell]:
    return [
        Cell(i, j, (crossing(a, c), crossing(a, d), crossing(b, d), crossing(b, c)))
        for i, (a, b) in enumerate(zip(grid.rows, grid.rows[1:]))
        for j, (c, d) in enumerate(zip(grid.columns, grid.columns[1:]))
    ]


def warped(image: np.ndarray, corners, width: int, height: int) -> np.ndarray:
    """The quadrilateral as an upright image: inverse homography and bilinear sampling."""
    to = np.array([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], float)
    rows, values = [], []
    for (x, y), (u, v) in zip(to, corners):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    h = np.append(np.linalg.lstsq(np.array(rows), np.array(values), rcond=None)[0], 1).reshape(3, 3)
    gy, gx = np.mgrid[0:height, 0:width]
    u, v, w = h @ np.stack([gx.ravel(), gy.ravel(), np.ones(gx.size)])
    return _sampled(image, u / w, v / w).reshape(height, width, *image.shape[2:])


def _sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = np.clip(x, 0, image.shape[1] - 1), np.clip(y, 0, image.shape[0] - 1)
    x0, y0 = np.minimum(x.astype(int), max(image.shape[1] - 2, 0)), np.minimum(y.astype(int), max(image.shape[0] - 2, 0))
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = (x - x0), (y - y0)
    if image.ndim == 3:
        fx, fy = fx[:, None], fy[:, None]
    top, low = image[y0, x0] * (1 - fx) + image[y0, x1] * fx, image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def has_ink(image: np.ndarray, least: float = 0.004) -> bool:
    """Some stroke inside the cell's frame."""
    h, w = image.shape[:2]
    inner = dark(image[h // 8 : h - h // 8, w // 20 : w - w // 20], 15, 18.0)
    return bool(inner.size) and float(inner.mean()) >= least


def even_light(image: np.ndarray) -> np.ndarray:
    """Each channel over its blurred self, a quarter of the original kept."""
    image = image if image.ndim == 3 else image[..., None]
    size = max(31, min(image.shape[:2]) // 12) | 1
    out = [0.75 * np.clip(255.0 * c / np.maximum(box_mean(box_mean(c, size), size), 1.0), 0, 255) + 0.25 * c for c in np.moveaxis(image.astype(np.float32), 2, 0)]
    return np.stack(out, 2).astype(np.uint8)


def stretched(image: np.ndarray, cut: float = 0.01) -> np.ndarray:
    """Contrast stretched between the cut quantiles."""
    low, high = np.quantile(image, [cut, 1 - cut])
    return np.clip((image - low) * 255.0 / max(high - low, 1.0), 0, 255).astype(np.uint8)


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    height, width = max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale))
    y, x = np.mgrid[0:height, 0:width]
    return _sampled(image, (x.ravel() + 0.5) / scale - 0.5, (y.ravel() + 0.5) / scale - 0.5).reshape(height, width, *image.shape[2:])


def skew(image: np.ndarray) -> float | None:
    """Degrees of the median long stroke; None with fewer than four, or if their middle half spreads over 5 degrees."""
    ink = dark(image)
    strokes = segments(long_runs(ink, max(20, ink.shape[1] // 60)), ink.shape[1] / 2, steepest=0.25, family=1.0)
    angles = np.degrees(np.arctan([s.slope for s in strokes]))
    if len(angles) < 4 or np.subtract(*np.quantile(angles, [0.75, 0.25])) > 5:
        return None
    return float(np.median(angles))


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    h, w = image.shape[:2]
    t = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x.ravel() - (w - 1) / 2, y.ravel() - (h - 1) / 2
    return _sampled(image, np.cos(t) * dx - np.sin(t) * dy + (w - 1) / 2, np.sin(t) * dx + np.cos(t) * dy + (h - 1) / 2).reshape(image.shape)


def sharpened(image: np.ndarray, amount: float = 1.2) -> np.ndarray:
    blurred = np.stack([box_mean(c, 3) for c in np.moveaxis(image, 2, 0)], 2)
    return np.clip(image + amount * (image - blurred), 0, 255).astype(np.uint8)


def ordered_corners(points: np.ndarray) -> np.ndarray:
    """Four points clockwise from the top left."""
    total, difference = points.sum(1), points[:, 1] - points[:, 0]
    return np.array([points[total.argmin()], points[difference.argmin()], points[total.argmax()], points[difference.argmax()]])


def upright(image: np.ndarray) -> np.ndarray:
    """The sheet as a rectangle, if its bright region is a quadrilateral of 55 % of the image near its edges."""
    g = gray(image)
    h, w = g.shape
    bright = g > (g.min() + g.max()) / 2
    ys, xs = np.nonzero(bright)
    if len(xs) < 0.55 * h * w or len(xs) > 0.97 * h * w:
        return image
    corners = ordered_corners(np.stack([xs, ys], 1).astype(float))
    x, y = corners[:, 0], corners[:, 1]
    area = abs(np.dot(x, np.roll(y, 1)) - np.dot(y, np.roll(x, 1))) / 2
    target = np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float)
    width, height = (round(max(hypot(*(corners[b] - corners[a])), hypot(*(corners[d] - corners[c])))) for a, b, c, d in ((0, 1, 3, 2), (0, 3, 1, 2)))
    if area < 0.55 * h * w or (np.abs(corners - target) > 0.15 * np.array([w, h])).any() or min(width, height) < 300:
        return image
    return warped(image, corners, width, height)


def preprocess(image: np.ndarray, least: int = 1600) -> np.ndarray:
    """Upright, evenly lit, at least `least` on its long side, straight (skews of 3 to 12 degrees), stretched, sharp."""
    out = even_light(upright(image if image.ndim == 3 else image[..., None]))
    scale = least / max(out.shape[:2])
    if scale > 1:
        out = resized(out, scale)
    angle = skew(out)
    if angle is not None and 3 <= abs(angle) <= 12:
        out = rotated(out, angle)
    return sharpened(stretched(out))


def detect_grids(images: DataFrame) -> DataFrame:
    """Grids (functions.schemas.GRIDS) of rows image_id and Spark's image struct; a page without one gives no row."""

    def detect(frames):
        for f in frames:
            rows = []
            for image_id, i in zip(f["image_id"], f["image"]):
                g = detect_grid(pixels(i["height"], i["width"], i["nChannels"], i["data"]))
                if g:
                    edges = lambda es: [{"slope": s, "intercept": b, "support": p} for s, b, p in es]
                    rows.append((image_id, edges(g.rows), edges(g.columns), g.confidence))
            yield pd.DataFrame(rows, columns=["image_id", "horizontal", "vertical", "confidence"])

    return images.select("image_id", "image").mapInPandas(detect, GRIDS)
