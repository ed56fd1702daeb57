"""Raster kernels on gray images: thresholds, morphology, component boxes, ruling lines, drawing, PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from gridspark.kernels import font


def adaptive_threshold(gray: np.ndarray, size: int, c: float) -> np.ndarray:
    """True for ink: pixels at or below the Gaussian-weighted mean of their surroundings less ``c``; edges are repeated."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    half = size // 2
    out = gray.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = out.shape[axis]
        out = sum(w * padded.take(range(i, i + n), axis=axis) for i, w in enumerate(k))
    return gray <= np.rint(out) - c


def _counts(mask: np.ndarray, size: int, axis: int, fill: bool) -> np.ndarray:
    """How many of the ``size`` cells around each are set along an axis; outside counts as ``fill``."""
    before = size // 2
    pad = [(before, size - 1 - before) if a == axis else (0, 0) for a in (0, 1)]
    total = np.cumsum(np.pad(mask.astype(np.int32), pad, constant_values=fill), axis=axis)
    zero = np.zeros_like(total.take([0], axis=axis))
    total = np.concatenate([zero, total], axis=axis)
    n = mask.shape[axis]
    return total.take(range(size, size + n), axis=axis) - total.take(range(n), axis=axis)


def dilate(mask: np.ndarray, width: int, height: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = _counts(mask, width, 1, False) > 0
        mask = _counts(mask, height, 0, False) > 0
    return mask


def erode(mask: np.ndarray, width: int, height: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = _counts(mask, width, 1, True) == width
        mask = _counts(mask, height, 0, True) == height
    return mask


def close(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return erode(dilate(mask, width, height), width, height)


def runs(mask: np.ndarray) -> np.ndarray:
    """Rows ``(y, x0, x1)`` of the runs of set pixels, x1 excluded."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y0, x0 = np.nonzero(edge == 1)
    _, x1 = np.nonzero(edge == -1)
    return np.stack([y0, x0, x1], axis=1)


def _labels(found: np.ndarray, reach: int) -> np.ndarray:
    """The component of each run; ``reach`` 1 joins runs that touch at corners, 0 only those above one another."""
    root = np.arange(len(found))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    start = np.searchsorted(found[:, 0], np.arange(found[-1, 0] + 2 if len(found) else 1))
    for y in range(len(start) - 2):
        i, j = start[y], start[y + 1]
        while i < start[y + 1] and j < start[y + 2]:
            if found[i, 1] < found[j, 2] + reach and found[j, 1] < found[i, 2] + reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if found[i, 2] < found[j, 2]:
                i += 1
            else:
                j += 1
    return np.array([find(i) for i in range(len(found))], int)


def outer_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes ``(x, y, w, h)`` of the 8-connected components that do not lie in a hole of another one."""
    found = runs(mask)
    if not len(found):
        return []
    label = _labels(found, 1)
    ground = runs(~np.pad(mask, 1))
    below = _labels(ground, 0)
    outside = np.zeros((mask.shape[0] + 2, mask.shape[1] + 2), bool)
    for y, a, b in ground[below == below[0]]:
        outside[y, a:b] = True
    near = outside.copy()
    near[1:] |= outside[:-1]
    near[:-1] |= outside[1:]
    near[:, 1:] |= outside[:, :-1]
    near[:, :-1] |= outside[:, 1:]
    boxes = []
    for k in np.unique(label):
        part = found[label == k]
        if any(near[y + 1, a + 1 : b + 1].any() for y, a, b in part):
            x, y = int(part[:, 1].min()), int(part[:, 0].min())
            boxes.append((x, y, int(part[:, 2].max()) - x, int(part[:, 0].max()) + 1 - y))
    return sorted(boxes, key=lambda b: (b[1], b[0]))


def panels(gray: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Raw boxes of panels: ink spread far enough to join the lines and words of one."""
    return outer_boxes(dilate(adaptive_threshold(gray, 15, 2), 25, 8))


def text_boxes(gray: np.ndarray) -> list[tuple[int, int, int, int]]:
    return outer_boxes(close(adaptive_threshold(gray, 15, 2), 3, 3))


def _bridged(found: np.ndarray, gap: int) -> np.ndarray:
    """Runs of a row joined over gaps of up to ``gap``."""
    if not len(found):
        return found
    new = np.concatenate([[True], (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] - found[:-1, 2] > gap)])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(found)) - 1
    return np.stack([found[at, 0], found[at, 1], found[ends, 2]], axis=1)


def horizontal_lines(gray: np.ndarray, min_length: int = 40, gap: int = 5, kernel: int = 25, times: int = 2) -> list[float]:
    """The y of ruling lines, unmerged: opening by a long flat kernel, then a scan for long runs; adjacent rows are one line."""
    mask = adaptive_threshold(gray, 11, 2)
    opened = dilate(erode(mask, kernel, 1, times), kernel, 1, times)
    found = _bridged(runs(opened), gap)
    rows = np.unique(found[found[:, 2] - found[:, 1] >= min_length][:, 0]) if len(found) else np.empty(0)
    if not len(rows):
        return []
    return [float(x.mean()) for x in np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1)]


def vertical_lines(gray: np.ndarray, min_length: int = 40, gap: int = 5, kernel: int = 25, times: int = 2) -> list[float]:
    return horizontal_lines(np.ascontiguousarray(gray.T), min_length, gap, kernel, times)


def _sampled(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The nearest pixels of ``image`` at another size."""
    return image[np.arange(height) * image.shape[0] // height][:, np.arange(width) * image.shape[1] // width]


def _part(page: np.ndarray, box) -> tuple[np.ndarray, int, int, int, int]:
    """The part of a page inside ``box``, and the box's whole height and width and where in it the part begins."""
    x0, y0, x1, y1 = (round(v) for v in box)
    part = page[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]
    return part, max(1, y1 - y0), max(1, x1 - x0), max(0, -y0), max(0, -x0)


def paint(page: np.ndarray, images) -> None:
    """Gray images ``(box, pixels)`` onto a page."""
    for box, pixels in images:
        part, h, w, top, left = _part(page, box)
        if part.size and pixels.size:
            part[:] = _sampled(pixels, h, w)[top : top + part.shape[0], left : left + part.shape[1]]


def write_words(page: np.ndarray, words) -> None:
    """Words ``(box, text)`` in dots that fill their boxes."""
    for box, text in words:
        part, h, w, top, left = _part(page, box)
        if part.size and text:
            part[_sampled(font.dots(text), h, w)[top : top + part.shape[0], left : left + part.shape[1]]] = 0


def render(width: int, height: int, lines=(), boxes=(), thickness: int = 2, images=()) -> np.ndarray:
    """A white page with images painted, rules ``(x0, y0, x1, y1)`` stroked and boxes filled, in pixels."""
    page = np.full((height, width), 255, np.uint8)
    paint(page, images)
    for x0, y0, x1, y1 in lines:
        a, b = sorted((round(y0), round(y1)))
        c, d = sorted((round(x0), round(x1)))
        page[max(0, a - thickness // 2) : max(0, b - thickness // 2) + thickness, max(0, c - thickness // 2) : max(0, d - thickness // 2) + thickness] = 0
    for x0, y0, x1, y1 in boxes:
        page[max(0, round(y0)) : max(0, round(y1)), max(0, round(x0)) : max(0, round(x1))] = 0
    return page


# Colours of overlay shapes.
COLOURS = {"region": (0, 160, 0), "explicit": (0, 0, 200), "filler": (255, 140, 0), "inferred": (140, 0, 180)}


def draw(gray: np.ndarray, shapes: list[tuple[str, float, float, float, float]]) -> np.ndarray:
    """Outlines ``(kind, x0, y0, x1, y1)`` in their colours over a gray page."""
    rgb = np.repeat(gray[:, :, None], 3, axis=2)
    h, w = gray.shape
    for kind, x0, y0, x1, y1 in shapes:
        a, b, c, d = (int(np.clip(v, 0, m - 1)) for v, m in ((x0, w), (x1, w), (y0, h), (y1, h)))
        colour = COLOURS[kind]
        rgb[c, a : b + 1] = rgb[d, a : b + 1] = colour
        rgb[c : d + 1, a] = rgb[c : d + 1, b] = colour
    return rgb


def unpng(data: bytes) -> np.ndarray:
    """The gray image of a file that :func:`png` made."""
    w, h = struct.unpack(">II", data[16:24])
    at, parts = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        parts += [data[at + 8 : at + 8 + n]] if kind == b"IDAT" else []
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, w + 1)[:, 1:]


def png(image: np.ndarray) -> bytes:
    """A gray (h, w) or RGB (h, w, 3) image as a PNG file."""
    h, w = image.shape[:2]

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
