"""Plain image operators on arrays, one image at a time, that the plans are compared with."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np


def rectangle(height: int, width: int | None = None) -> np.ndarray:
    return np.ones((height, width or height), bool)


#: Kernel of a pixel and its four neighbours; places outside the image count as unset in ``outline_distance``.
CROSS_OPEN = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)


def ellipse(height: int, width: int | None = None) -> np.ndarray:
    """Filled ellipse inscribed in a rectangle."""
    width = width or height
    cy, cx = height // 2, width // 2
    out = np.zeros((height, width), bool)
    for i in range(height):
        dy = i - cy
        half = int(round(cx * np.sqrt(max(0, (cy * cy - dy * dy)) / (cy * cy)))) if cy else cx
        out[i, max(cx - half, 0) : min(cx + half + 1, width)] = True
    return out


def _shifted(mask: np.ndarray, kernel: np.ndarray, anchor: tuple[int, int] | None, fill: bool) -> Iterator[np.ndarray]:
    ay, ax = anchor or (kernel.shape[0] // 2, kernel.shape[1] // 2)
    h, w = mask.shape
    pad = np.full((h + 2 * kernel.shape[0], w + 2 * kernel.shape[1]), fill, bool)
    pad[kernel.shape[0] : kernel.shape[0] + h, kernel.shape[1] : kernel.shape[1] + w] = mask
    for i, j in zip(*np.nonzero(kernel)):
        y, x = kernel.shape[0] + i - ay, kernel.shape[1] + j - ax
        yield pad[y : y + h, x : x + w]


def dilate(mask: np.ndarray, kernel: np.ndarray, times: int = 1, anchor: tuple[int, int] | None = None) -> np.ndarray:
    for _ in range(times if kernel.size else 0):
        mask = np.logical_or.reduce(list(_shifted(mask, kernel, anchor, False)))
    return mask


def erode(mask: np.ndarray, kernel: np.ndarray, times: int = 1, anchor: tuple[int, int] | None = None) -> np.ndarray:
    for _ in range(times if kernel.size else 0):
        mask = np.logical_and.reduce(list(_shifted(mask, kernel, anchor, True)))
    return mask


def close(mask: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    return erode(dilate(mask, kernel, times), kernel, times)


def open_(mask: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    return dilate(erode(mask, kernel, times), kernel, times)


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Components (8-connected, or 4-connected) numbered from 1 in scan order (union-find over row runs)."""
    touch = 0 if diagonal else 1
    h, w = mask.shape
    ids, parent = np.zeros((h, w), np.int64), [0]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    before: list[tuple[int, int, int]] = []
    for y in range(h):
        edge = np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]]))
        runs, k = [], 0
        for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()):
            own = 0
            while k < len(before) and before[k][1] < a + touch:
                k += 1
            j = k
            while j < len(before) and before[j][0] <= b - touch:
                other = root(before[j][2])
                own = other if not own else own
                if other != own:
                    low, high = min(own, other), max(own, other)
                    parent[high] = own = low
                j += 1
            if not own:
                own = len(parent)
                parent.append(own)
            ids[y, a:b] = own
            runs.append((a, b, own))
        before = runs
    roots = np.array([root(k) for k in range(len(parent))])
    names = {r: k + 1 for k, r in enumerate(sorted(set(roots[1:].tolist())))}
    table = np.array([0] + [names[r] for r in roots[1:].tolist()])
    return table[ids], len(names)


def boxes_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Bounding rows and columns (first, last + 1 of each) of the components 1 to ``n``."""
    ys, xs = np.nonzero(ids)
    k = ids[ys, xs] - 1
    out = np.empty((n, 4), np.int64)
    for at, values in ((0, ys), (2, xs)):
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(low, k, values)
        np.maximum.at(high, k, values)
        out[:, at], out[:, at + 1] = low, high + 1
    return out


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with everything it encloses: the background's 4-connected parts that touch no border."""
    ids, n = components(~np.pad(mask, 1), diagonal=False)
    return (ids != ids[0, 0])[1:-1, 1:-1] if n else np.ones_like(mask)


def filled(ids: np.ndarray, k: int, box: np.ndarray) -> np.ndarray:
    """Component ``k`` with its holes, within its bounding box."""
    return fill_holes(ids[box[0] : box[1], box[2] : box[3]] == k)


def outline_area(part: np.ndarray) -> float:
    """Area of the polygon through the centres of the outline's pixels, of a filled region: less than its pixels."""
    p = part.astype(np.int8)
    held = p[:-1, :-1] + p[1:, :-1] + p[:-1, 1:] + p[1:, 1:]
    return float((held == 4).sum() + 0.5 * (held == 3).sum())


def outline_distance(part: np.ndarray, y: float, x: float) -> float:
    """Distance of a place to the outline of a filled region, whether it lies inside or outside."""
    edge = part & ~erode(np.pad(part, 1), CROSS_OPEN)[1:-1, 1:-1]
    ys, xs = np.nonzero(edge)
    return float(np.hypot(ys - y, xs - x).min())


def by_area(mask: np.ndarray) -> list[tuple[float, int, np.ndarray, np.ndarray]]:
    """Components as (outline area, number, box, filled part), largest first, ties by number."""
    ids, n = components(mask)
    boxes = boxes_of(ids, n)
    parts = [(k, filled(ids, k, boxes[k - 1])) for k in range(1, n + 1)]
    return sorted(((outline_area(part), k, boxes[k - 1], part) for k, part in parts), key=lambda a: (-a[0], a[1]))


def paste(shape: tuple[int, int], box: np.ndarray, part: np.ndarray) -> np.ndarray:
    out = np.zeros(shape, bool)
    out[box[0] : box[1], box[2] : box[3]] = part
    return out


def largest_filled(mask: np.ndarray, least: float = 0) -> np.ndarray:
    """The component with the largest outline area (first on ties) if above ``least``, filled.

    A bounding box bounds the area, so components are filled from the largest box on until no other can win.
    """
    ids, n = components(mask)
    boxes = boxes_of(ids, n)
    most = (boxes[:, 1] - boxes[:, 0] - 1) * (boxes[:, 3] - boxes[:, 2] - 1) if n else np.zeros(0)
    best, area, number = np.zeros_like(mask), least, 0
    for k in np.argsort(-most, kind="stable").tolist():
        if most[k] < area or most[k] <= least:
            break
        part = filled(ids, k + 1, boxes[k])
        own = outline_area(part)
        if own > area or own == area > least and k + 1 < number:
            best, area, number = paste(mask.shape, boxes[k], part), own, k + 1
    return best


def gaussian5(image: np.ndarray) -> np.ndarray:
    """5 x 5 Gaussian with the binomial-like weights of sigma 1.1, borders reflected."""
    x = np.arange(-2, 3)
    k = np.exp(-(x**2) / (2 * 1.1**2))
    k /= k.sum()
    pad = np.pad(image.astype(float), [(2, 2), (2, 2)] + [(0, 0)] * (image.ndim - 2), mode="reflect")
    rows = sum(k[i] * pad[i : i + image.shape[0]] for i in range(5))
    return np.clip(np.rint(sum(k[j] * rows[:, j : j + image.shape[1]] for j in range(5))), 0, 255).astype(np.uint8)


def box_mean(image: np.ndarray, size: int, weight: float | None = None, most: float | None = 255) -> np.ndarray:
    """Square neighbourhood sums times ``weight`` (default: the mean), at most ``most``, by cumulated sums; borders reflected."""
    half = size // 2
    pad = np.pad(image.astype(float), half, mode="reflect" if min(image.shape) > half else "edge")
    sums = np.pad(pad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    total = sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]
    total = total * (weight if weight is not None else 1 / size**2)
    return total if most is None else np.minimum(total, most)


def to_hsv(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., k].astype(float) for k in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = v - low
    s = np.where(v > 0, 255 * d / np.where(v > 0, v, 1), 0)
    safe = np.where(d > 0, d, 1)
    h = np.select([d == 0, v == r, v == g], [0, 30 * (g - b) / safe, 60 + 30 * (b - r) / safe], 120 + 30 * (r - g) / safe)
    h = np.floor(np.where(h < 0, h + 180, h) + 0.5) % 180
    return np.stack([h, np.floor(s + 0.5), v], axis=-1).astype(np.uint8)


def to_grey(bgr: np.ndarray) -> np.ndarray:
    return np.floor(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299 + 0.5).astype(np.uint8)


def sobel(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(image.astype(float), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return gx, gy


def canny(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: gradient, thinning along it, then weak edges kept where a strong one reaches them."""
    gx, gy = sobel(image)
    size = np.abs(gx) + np.abs(gy)
    turn = (np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    pad = np.pad(size, 1)
    h, w = size.shape
    thin = np.zeros((h, w), bool)
    for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        ahead, behind = pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], pad[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        thin |= (turn == k) & (size >= ahead) & (size > behind)
    weak = thin & (size > low)
    ids, n = components(weak)
    strong = np.zeros(n + 1, bool)
    strong[ids[weak & (size > high)]] = True
    strong[0] = False
    return strong[ids]


def hough_circles(grey: np.ndarray, low: int, high: int, apart: float, edge: float = 100, votes: int = 20) -> list[tuple[float, float, float, int]]:
    """Circles ``(x, y, radius, votes)`` by gradient voting, most votes first, centres at least ``apart`` from better ones."""
    edges = canny(grey, edge / 2, edge)
    gx, gy = sobel(grey)
    ys, xs = np.nonzero(edges)
    norm = np.hypot(gx[ys, xs], gy[ys, xs])
    ok = norm > 0
    ys, xs, ux, uy = ys[ok], xs[ok], (gx[ys, xs] / np.maximum(norm, 1e-9))[ok], (gy[ys, xs] / np.maximum(norm, 1e-9))[ok]
    h, w = grey.shape
    tally = np.zeros(h * w, np.int64)
    for radius in range(low, high + 1):
        for sign in (1, -1):
            cx, cy = np.rint(xs + sign * radius * ux).astype(int), np.rint(ys + sign * radius * uy).astype(int)
            inside = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            tally += np.bincount(cy[inside] * w + cx[inside], minlength=h * w)
    tally = box_mean(tally.reshape(h, w), 3, 1.0, most=None)
    found: list[tuple[float, float, float, int]] = []
    order = np.argsort(-tally, axis=None, kind="stable")
    order = order[: int((tally >= votes).sum())]
    cy, cx = np.divmod(order, w)
    while len(order):  # the best cell left; then the cells around it are passed over
        y, x = int(cy[0]), int(cx[0])
        far = np.rint(np.hypot(xs - x, ys - y)).astype(int)
        counts = np.bincount(far[(far >= low) & (far <= high)], minlength=high + 1)
        left = np.arange(len(order)) > 0
        if counts.max() >= votes:
            found.append((float(x), float(y), float(counts.argmax()), int(counts.max())))
            left = np.hypot(cx - x, cy - y) >= apart
        order, cy, cx = order[left], cy[left], cx[left]
    return found


def find_plates(bgr: np.ndarray, bands: tuple[tuple[int, int], ...] = ((280, 300), (192, 195), (176, 184))) -> list[tuple[float, float, float]]:
    """Up to two plates: circles of the first band, without those that hold a centre of the smaller bands."""
    grey = to_grey(bgr)
    apart = grey.shape[0] / 2
    found = [[c[:3] for c in hough_circles(grey, lo, hi, apart)] for lo, hi in bands]
    plates = found[0]
    for others in found[1:]:
        plates = [p for p in plates if not any(np.hypot(int(p[0]) - int(o[0]), int(p[1]) - int(o[1])) < int(p[2]) for o in others)] if len(plates) > 2 or others is found[1] else plates
    return plates[:2]


def find_bowl(bgr: np.ndarray, plates: list[tuple[float, float, float]], seen: bool, bands: tuple[tuple[int, int], ...] = ((192, 195), (193, 202))) -> list[tuple[float, float, float]]:
    """The salad bowl: one circle of the first band, else those of the second that no plate overlaps."""
    grey = to_grey(bgr)
    first = [c[:3] for c in hough_circles(grey, *bands[0], grey.shape[0] / 2)]
    if len(first) == 1 or not seen:
        return first[:1]
    second = [c[:3] for c in hough_circles(grey, *bands[1], grey.shape[0] / 2, edge=150)]
    if len(second) > 1:
        second = [b for b in second if not any(np.hypot(int(b[0]) - int(p[0]), int(b[1]) - int(p[1])) < int(p[2]) for p in plates)]
    return second[:1]


def disc(shape: tuple[int, int], circle: tuple[float, float, float], scale: float = 1.0) -> np.ndarray:
    x, y, radius = int(circle[0]), int(circle[1]), int(circle[2] * scale)
    yy, xx = np.ogrid[: shape[0], : shape[1]]
    return (yy - y) ** 2 + (xx - x) ** 2 <= radius * radius


def plate_mask(bgr: np.ndarray, circle: tuple[float, float, float]) -> np.ndarray:
    """Food on a plate: colour and disc tests, the large regions near the centre, filled and closed."""
    hsv = to_hsv(gaussian5(bgr))
    h, s = hsv[..., 0], hsv[..., 1]
    full = 3.141 * circle[2] ** 2
    areas = [a for a in by_area(((s > 80) | ((h > 20) & (h < 25))) & disc(h.shape, circle)) if a[0] >= 0.005 * full]
    out = np.zeros(h.shape, bool)
    for _, _, box, part in areas[: 1 if any(a[0] > 0.07 * full for a in areas) else 2]:
        if outline_distance(part, circle[1] - box[0], circle[0] - box[2]) <= 0.75 * circle[2]:
            out |= paste(h.shape, box, part)
    size = int(circle[2] / 5)
    return close(out, ellipse(size)) if size and out.any() else out


def salad_mask(bgr: np.ndarray, circle: tuple[float, float, float]) -> np.ndarray:
    hsv = to_hsv(gaussian5(bgr))
    mask = close(((hsv[..., 1] > 175) | (hsv[..., 2] > 245)) & disc(hsv.shape[:2], circle), ellipse(max(1, int(circle[2] / 3))))
    out = np.zeros_like(mask)
    for area, _, box, part in by_area(mask):
        if area >= 0.001 * 3.141 * circle[2] ** 2:
            out |= paste(mask.shape, box, part)
    return out


def refine(label: int, bgr: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Refinement by label: pesto pasta (1), pilaf (5), pork cutlet (6); others as they are."""
    hsv = to_hsv(bgr)
    if label == 1:
        green = mask & (hsv[..., 1] > 0.6 * 255) & (bgr[..., 1] >= 85)
        return largest_filled(open_(close(dilate(green, rectangle(5)), ellipse(3), 10), ellipse(3), 2))
    if label == 5:
        return largest_filled(mask & (hsv[..., 1] > 0.35 * 255))
    if label == 6 and mask.any():
        ys = np.nonzero(mask.any(axis=1))[0]
        size = int(ys[-1] - ys[0] + 1) // 4
        return close(mask, ellipse(size)) if size else mask
    return mask


def refine_tomato(bgr: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return largest_filled(close(mask & (bgr[..., 2] > 160), ellipse(3), 5))


def find_bread(bgr: np.ndarray, plates: list, bowl: list) -> np.ndarray:
    """Bread: what is left of the chroma band without plates and bowl, thinned to the textured, unsaturated area."""
    left = np.ones(bgr.shape[:2], bool)
    for p in plates:
        left &= ~disc(left.shape, p)
    for b in bowl:
        left &= ~disc(left.shape, b, 1.4)
    u = np.clip(np.floor(0.492 * (bgr[..., 0] - (0.114 * bgr[..., 0] + 0.587 * bgr[..., 1] + 0.299 * bgr[..., 2])) + 128.5), 0, 255)
    band = largest_filled(close(left & (u >= 70) & (u <= 117), rectangle(11)))
    dense = box_mean(band * 255, 51, 1 / 45**2) > 111
    edges = canny(np.where(dense, to_grey(bgr), 0), 50, 150)
    busy = box_mean(edges * 255, 7) > 115
    busy = dilate(erode(close(dilate(busy, ellipse(5), 10), ellipse(5), 4), ellipse(5), 6), ellipse(5), 20)
    s = to_hsv(bgr)[..., 1]
    return largest_filled(dilate(erode(busy & (s > 1) & (s <= 140), ellipse(5)), ellipse(5), 12), 20_000)


def split_foreground(bgr: np.ndarray, mask: np.ndarray, rounds: int = 3, parts: int = 4) -> np.ndarray:
    """Foreground of the mask's bounding box by colour mixtures of inside and outside, refitted; smoothed by a neighbourhood vote.

    An approximation of iterated graph cuts: the cut is replaced by the vote.
    """
    if not mask.any():
        return mask
    ys, xs = np.nonzero(mask)
    box = np.zeros_like(mask)
    box[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] = True
    fore, colours = box.copy(), bgr.astype(float)

    def spread(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Centres, weights and pooled variance of a mixture, by a few rounds of k-means from quantiles of brightness."""
        order = points[np.argsort(points.sum(axis=1), kind="stable")]
        centres = order[np.linspace(0, len(order) - 1, parts).astype(int)]
        for _ in range(5):
            near = nearest(points, centres)[0]
            centres = np.stack([points[near == k].mean(0) if (near == k).any() else centres[k] for k in range(parts)])
        near, far = nearest(points, centres)
        return centres, np.bincount(near, minlength=parts) / len(points), float(far.mean()) / 3 + 25.0

    def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.stack([((points - c) ** 2).sum(-1) for c in centres])
        return far.argmin(0), far.min(0)

    def fit(mixture: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
        """Log likelihood of every pixel under the best component."""
        centres, weights, variance = mixture
        return np.stack([np.log(max(w, 1e-9)) - ((colours - c) ** 2).sum(-1) / (2 * variance) for c, w in zip(centres, weights)]).max(0) - 1.5 * np.log(variance)

    for _ in range(rounds):
        if fore.all() or not fore.any():
            break
        a, b = spread(colours[fore]), spread(colours[~fore])
        fore = box & (box_mean((fit(a) > fit(b)) * 255, 5) > 127)
    return fore


def bread_mask(bgr: np.ndarray, area: np.ndarray) -> np.ndarray:
    return largest_filled(split_foreground(bgr, erode(area, ellipse(5), 3, anchor=(1, 1))))


def equalise(values: np.ndarray) -> np.ndarray:
    counts = np.bincount(values.ravel(), minlength=256)
    seen = counts.cumsum()
    least = counts[np.nonzero(counts)[0][0]]
    if seen[-1] == least:
        return values
    return np.rint((seen - least).clip(0) * 255 / (seen[-1] - least)).astype(np.uint8)[values]


def hue_histogram(bgr: np.ndarray, mask: np.ndarray, bins: int = 60) -> np.ndarray:
    """Hue histogram under a mask, scaled to 100: value is equalised, and the result is converted once more as if it were blue, green, red."""
    hsv = to_hsv(bgr)
    hsv[..., 2] = np.where(mask, equalise(np.where(mask, hsv[..., 2], 0)), hsv[..., 2])
    again = to_hsv(hsv)[..., 0]
    counts = np.bincount(again[mask] // (180 // bins), minlength=bins)[:bins]
    return np.minimum(np.rint(100 * counts / max(1, counts.sum())), 255).astype(np.int16)


def tiles(mask: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Non-empty square tiles of a mask's bounding box: row, column, mask of the tile."""
    if not mask.any():
        return
    ys, xs = np.nonzero(mask)
    y0, x0 = int(ys.min()), int(xs.min())
    size = min(size, int(ys.max()) - y0 + 1, int(xs.max()) - x0 + 1)
    for k in np.unique((ys - y0) // size * 100_000 + (xs - x0) // size).tolist():
        row, col = divmod(k, 100_000)
        part = np.zeros_like(mask)
        part[y0 + row * size : y0 + (row + 1) * size, x0 + col * size : x0 + (col + 1) * size] = mask[y0 + row * size : y0 + (row + 1) * size, x0 + col * size : x0 + (col + 1) * size]
        yield row, col, part


def components_by_bfs(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """The same components by search, for comparison in tests."""
    ids, n = np.zeros(mask.shape, np.int64), 0
    for y, x in zip(*np.nonzero(mask)):
        if ids[y, x]:
            continue
        n += 1
        queue = deque([(y, x)])
        ids[y, x] = n
        while queue:
            a, b = queue.popleft()
            for i in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for j in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[i, j] and not ids[i, j]:
                        ids[i, j] = n
                        queue.append((i, j))
    return ids, n
