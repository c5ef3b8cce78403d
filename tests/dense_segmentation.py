"""Segmentation of a photo held as an array, that the plan is compared with."""

from __future__ import annotations

import dense as im
import numpy as np

from platewise.model import LABELS

FIRST, SECOND, SIDE = (tuple(i for i, _, f in LABELS if f == k) for k in ("first", "second", "side"))
SALAD, BREAD, COARSE, FINE, PIECE = 12, 13, 150, 50, 500


def ranked(histogram: np.ndarray, prototypes: np.ndarray, allowed: set[int]) -> list[tuple[float, int]]:
    return sorted((float(np.sqrt(((prototypes[k].astype(float) - histogram) ** 2).sum())), k) for k in allowed)


def two_plates(lists: list[list[tuple[float, int]]]) -> list[set[int]]:
    """Family allowed on each of two plates: the plate with the larger relative gap chooses, the other gets the rest."""
    def best(found, family):
        return next((d for d, k in found if k in family), None)

    gaps = [(best(f, FIRST), best(f, SECOND), f[-1][0] if f else 0) for f in lists]
    if any(a is None or b is None for a, b, _ in gaps):
        return [set(FIRST) if a is not None and (b is None or a < b) else set(SECOND + SIDE) for a, b, _ in gaps]
    loss = [abs(a - b) / w if w else 0 for a, b, w in gaps]
    lead = 0 if loss[0] >= loss[1] else 1
    first = gaps[lead][0] < gaps[lead][1]
    own, rest = (set(FIRST), set(SECOND + SIDE)) if first else (set(SECOND + SIDE), set(FIRST))
    return [own, rest] if lead == 0 else [rest, own]


def neighbours_mode(grid: np.ndarray) -> np.ndarray:
    """Most frequent label among the neighbours of every set cell (-1 without any), by votes over shifted grids; ties to the label whose last vote comes first."""
    pad = np.pad(grid, 1, constant_values=-1)
    h, w = grid.shape
    votes = np.stack([pad[a : a + h, b : b + w] for a in range(3) for b in range(3) if (a, b) != (1, 1)])
    labels = np.arange(grid.max(initial=0) + 1)
    counts = np.stack([(votes == k).sum(axis=0) for k in labels])
    last = np.stack([np.where(votes == k, np.arange(8)[:, None, None], -1).max(axis=0) for k in labels])
    best = (counts * 16 - last).argmax(axis=0)
    return np.where((grid >= 0) & (counts.max(axis=0) > 0), best, -1)


def mixed_plate(bgr: np.ndarray, mask: np.ndarray, prototypes: np.ndarray, allowed: set[int]) -> dict[int, np.ndarray]:
    """Masks by label of a plate with a second course and side dishes: coarse votes choose labels, fine tiles deal them out."""
    if not allowed:
        return {}
    label = lambda part, among: ranked(im.hue_histogram(bgr, part), prototypes, among)[0][1]
    votes: dict[int, int] = {}
    for _, _, part in im.tiles(mask, COARSE):
        k = label(part, allowed)
        votes[k] = votes.get(k, 0) + 1
    order = sorted(votes, key=lambda k: (-votes[k], k))
    kept = [k for k in order if k in SECOND][:1] + [k for k in order if k in SIDE][:2]
    if not kept:
        return {}
    found = [(r, c, part, label(part, set(kept))) for r, c, part in im.tiles(mask, FINE)]
    if not found:
        return {}
    grid = np.full((max(f[0] for f in found) + 1, max(f[1] for f in found) + 1), -1)
    for r, c, _, k in found:
        grid[r, c] = k
    grid = neighbours_mode(grid)
    out: dict[int, np.ndarray] = {k: np.zeros_like(mask) for k in kept}
    for r, c, part, _ in found:
        if grid[r, c] in out:
            out[grid[r, c]] |= part
    return reassign(out, kept) if len(kept) == 2 else out


def reassign(masks: dict[int, np.ndarray], kept: list[int], piece: int = PIECE) -> dict[int, np.ndarray]:
    """Masks of two labels with small pieces moved to the other one.

    Of a label's pieces the largest stays if it has over ``piece`` pixels of outline
    area, and the second if it also has over nine tenths of the largest.
    """
    moved = {k: np.zeros_like(masks[k]) for k in kept}
    for k, other in (kept, kept[::-1]):
        ids, n = im.components(masks[k])
        boxes = im.boxes_of(ids, n)
        areas = {j: im.outline_area(im.filled(ids, j, boxes[j - 1])) for j in range(1, n + 1)}
        order = sorted(areas, key=lambda j: (-areas[j], j))
        for i, j in enumerate(order):
            stays = areas[j] > piece and (i == 0 or i == 1 and areas[j] > 0.9 * areas[order[0]])
            moved[k if stays else other] |= ids == j
    return moved


def segment(bgr: np.ndarray, prototypes: np.ndarray, labels: set[int] | None = None) -> tuple[np.ndarray, set[int]]:
    """Label mask of a photo and its labels; ``labels`` limits them to those of an earlier photo."""
    mask, seen = np.zeros(bgr.shape[:2], np.int64), set()
    allowed = set(FIRST + SECOND + SIDE) & labels if labels else set(FIRST + SECOND + SIDE)
    circles = im.find_plates(bgr)
    foods = [m for m in (im.plate_mask(bgr, c) for c in circles) if m.any()]
    lists = [ranked(im.hue_histogram(bgr, m), prototypes, allowed) for m in foods]
    families = two_plates(lists) if len(foods) == 2 else [set(FIRST) if f and f[0][1] in FIRST else set(SECOND + SIDE) for f in lists]
    for food, found, family in zip(foods, lists, families):
        own = [k for _, k in found if k in family]
        parts = {own[0]: food} if own and own[0] in FIRST else mixed_plate(bgr, food, prototypes, allowed & family)
        for k, part in parts.items():
            part = im.refine(k, bgr, part)
            mask[part] = k
            seen |= {k} if part.any() else set()
    bowl = im.find_bowl(bgr, circles, labels is None or SALAD in labels)
    if bowl and (salad := im.salad_mask(bgr, bowl[0])).any():
        mask += salad * SALAD
        seen.add(SALAD)
    if (labels is None or BREAD in labels) and (bread := im.bread_mask(bgr, im.find_bread(bgr, circles, bowl))).any():
        mask += bread * BREAD
        seen.add(BREAD)
    return np.minimum(mask, 255).astype(np.uint8), seen
