"""NumPy kernels over the pixels of one image. Images are uint8 arrays of height, width, 3 (blue, green, red)."""

from __future__ import annotations

import numpy as np

from ..settings import DEFAULT, Settings


def to_bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels of Spark's image source as three channels; alpha is dropped, gray is repeated."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma in fixed point with 14 bits, rounded."""
    b, g, r = (bgr[:, :, k].astype(np.int32) for k in range(3))
    return ((1868 * b + 9617 * g + 4899 * r + (1 << 13)) >> 14).astype(np.uint8)


def _shifted(a: np.ndarray, radius: int, pick, fill: int) -> np.ndarray:
    """`pick` over the square of side 2 * radius + 1 around each pixel; windows are made of windows of half their length."""
    for axis in (0, 1):
        n, size = a.shape[axis], 2 * radius + 1
        at = lambda p, lo, hi: p[lo:hi] if axis == 0 else p[:, lo:hi]  # noqa: B023, E731
        p = np.full((n + 2 * radius, a.shape[1]) if axis == 0 else (a.shape[0], n + 2 * radius), fill, a.dtype)
        at(p, radius, radius + n)[...] = a
        have = 1
        while have < size:
            step = min(have, size - have)
            p = pick(at(p, 0, p.shape[axis] - step), at(p, step, p.shape[axis]))
            have += step
        a = p
    return a


def close_mask(mask: np.ndarray, radius: int = 4) -> np.ndarray:
    """Morphological closing with a square of side 2 * radius + 1; what lies outside the image has no effect.

    A 5x5 square applied twice is a 9x9 square.
    """
    grown = _shifted(mask.astype(np.uint8), radius, np.maximum, 0)
    return _shifted(grown, radius, np.minimum, 1).astype(bool)


def canny(g: np.ndarray, low: int, high: int) -> np.ndarray:
    """Edges: Sobel gradients, thinning along the gradient, hysteresis."""
    p = np.pad(g.astype(np.int32), 1, mode="edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    mag = np.abs(dx) + np.abs(dy)
    m = np.pad(mag, 1)
    c = m[1:-1, 1:-1]
    ax, ay = np.abs(dx), np.abs(dy)
    flat, steep = ay * 1000 < ax * 414, ay * 1000 > ax * 2414
    same = (dx < 0) == (dy < 0)
    before = np.where(flat, m[1:-1, :-2], np.where(steep, m[:-2, 1:-1], np.where(same, m[:-2, :-2], m[:-2, 2:])))
    after = np.where(flat, m[1:-1, 2:], np.where(steep, m[2:, 1:-1], np.where(same, m[2:, 2:], m[2:, :-2])))
    thin = (c > before) & (c >= after)
    weak, strong = thin & (mag > low), thin & (mag > high)
    labels = components(weak)
    keep = np.unique(labels[strong])
    return weak & np.isin(labels, keep[keep > 0])


def components(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Labels from 1 of the components of a mask, 0 elsewhere; 8-connected, or 4-connected where corners don't count.

    Runs of each row are joined to the runs of the row above that they touch.
    """
    h, w = mask.shape
    least = 0 if corners else 1  # pixels that runs have above each other
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    _, ends = np.nonzero(edge == -1)
    parent = list(range(len(rows)))
    begin, end = starts.tolist(), ends.tolist()

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    first = np.searchsorted(rows, np.arange(h + 1)).tolist()
    for y in range(1, h):
        a, b = first[y - 1], first[y]
        stop = first[y]
        for k in range(b, first[y + 1]):
            while a < stop and end[a] < begin[k] + least:
                a += 1
            j = a
            while j < stop and begin[j] <= end[k] - least:
                parent[root(j)] = root(k)
                j += 1
            a = max(a, j - 1) if j > a else a
    names: dict[int, int] = {}
    label = np.array([names.setdefault(root(k), len(names) + 1) for k in range(len(rows))], np.int32)
    size = ends - starts
    out = np.zeros(h * w, np.int32)
    out[np.repeat(rows * w + starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = np.repeat(label, size)
    return out.reshape(h, w)


def outer_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (x, y, w, h) of the components that no other component encloses."""
    labels = components(mask)
    n = int(labels.max())
    if not n:
        return []
    touching = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    if np.count_nonzero(touching) < n:  # what doesn't reach the image's border
        # background that 4-connects to the outside; a component that doesn't touch it lies in a hole
        outside = _flood(np.pad(labels == 0, 1, constant_values=True))
        near = outside.copy()
        for axis in (0, 1):
            near |= np.roll(outside, 1, axis) | np.roll(outside, -1, axis)
        touching = np.unique(labels[near[1:-1, 1:-1]])
    out = []
    ys, xs = np.nonzero(labels)
    of = labels[ys, xs]
    order = np.argsort(of, kind="stable")
    ys, xs, of = ys[order], xs[order], of[order]
    first = np.searchsorted(of, np.arange(1, n + 2))
    for k in np.intersect1d(touching, np.arange(1, n + 1)).tolist():
        y, x = ys[first[k - 1]:first[k]], xs[first[k - 1]:first[k]]
        out.append((int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)))
    return out


def _flood(free: np.ndarray) -> np.ndarray:
    """The 4-connected region of `free` that holds the corner, found by alternating sweeps."""
    seen = np.zeros_like(free)
    seen[0, 0] = True
    while True:
        before = int(seen.sum())
        for axis in (0, 1):
            for flip in (False, True):
                f = np.flip(free, axis) if flip else free
                s = np.flip(seen, axis) if flip else seen
                # carry a seen cell along its run of free cells
                n = f.shape[axis]
                index = np.arange(n).reshape((-1, 1) if axis == 0 else (1, -1))
                wall = np.maximum.accumulate(np.where(f, -1, index), axis=axis)
                last = np.maximum.accumulate(np.where(s, index, -1), axis=axis)
                grown = f & (last > wall)
                seen |= np.flip(grown, axis) if flip else grown
        if int(seen.sum()) == before:
            return seen


def edge_fraction(edges: np.ndarray, x: int, y: int, w: int, h: int, side: str, band: int = 5) -> float:
    """Share of edge pixels in the band around the inner border of a bar; 0 for an empty band."""
    img_h, img_w = edges.shape
    if side in ("left", "right"):
        at = x + w if side == "left" else x
        part = edges[y:y + h, max(0, at - band):min(img_w, at + band)]
    else:
        at = y + h if side == "top" else y
        part = edges[max(0, at - band):min(img_h, at + band), x:x + w]
    return float(part.mean()) if part.size else 0.0


def side_of(x: int, y: int, w: int, h: int, img_w: int, img_h: int, tolerance: float = 0.03) -> str:
    if x <= img_w * tolerance:
        return "left"
    if x + w >= img_w * (1 - tolerance):
        return "right"
    if y <= img_h * tolerance:
        return "top"
    return "bottom" if y + h >= img_h * (1 - tolerance) else "interior"


def dark_components(bgr: np.ndarray, settings: Settings = DEFAULT) -> list[dict]:
    """Rows for operators.raster: the dark components of an image with their mean gray and edge fraction."""
    g = gray(bgr)
    img_h, img_w = g.shape
    out, dark = [], g <= settings.raster_mean_intensity_max
    boxes = outer_boxes(close_mask(dark)) if dark.any() else []
    edges = canny(g, settings.raster_canny_low, settings.raster_canny_high) if boxes else None
    for x, y, w, h in boxes:
        side = side_of(x, y, w, h, img_w, img_h)
        out.append({"x": x, "y": y, "w": w, "h": h, "img_w": img_w, "img_h": img_h, "mean_intensity": float(g[y:y + h, x:x + w].mean()),
                    "edge_fraction": edge_fraction(edges, x, y, w, h, side)})
    return out


def background(bgr: np.ndarray, bands: list[dict]) -> tuple[int, int, int]:
    """Median of each channel outside the bands, cut to integers; white where nothing is left."""
    free = np.ones(bgr.shape[:2], bool)
    for b in bands:
        free[b["y"]:b["y"] + b["h"], b["x"]:b["x"] + b["w"]] = False
    if not free.any():
        return 255, 255, 255
    return tuple(int(np.median(bgr[:, :, k][free])) for k in range(3))


def crop(bgr: np.ndarray, bands: list[dict]) -> np.ndarray:
    at = {b["side"]: b for b in reversed(bands)}
    h, w = bgr.shape[:2]
    size = lambda side, key: at[side][key] if side in at else 0
    return bgr[size("top", "h"):h - size("bottom", "h"), size("left", "w"):w - size("right", "w")]


def paint(bgr: np.ndarray, bands: list[dict]) -> np.ndarray:
    """The bands filled with the background; the corner (x + w, y + h) belongs to what is filled."""
    out, color = bgr.copy(), background(bgr, bands)
    for b in bands:
        out[b["y"]:b["y"] + b["h"] + 1, b["x"]:b["x"] + b["w"] + 1] = color
    return out
