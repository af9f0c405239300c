"""Scene-specific picture kernels (numpy, RGB or gray arrays): what a recording shows before any model is asked."""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np

from penduline.operators.masks import blur5, clear_of_border, closed, component_boxes, component_table, erode, expanded_box, label_components, median_background, opened


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in [0, 180), saturation and value in [0, 255]."""
    x = rgb.astype(float)
    top, low = x.max(-1), x.min(-1)
    span = np.where(top > low, top - low, 1.0)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    hue = np.select([top == low, top == r, top == g], [0.0, ((g - b) / span) % 6, (b - r) / span + 2], (r - g) / span + 4) * 30
    return np.stack([hue % 180, np.where(top > 0, (top - low) / np.where(top > 0, top, 1) * 255, 0), top], -1)


def within(picture: np.ndarray, low: tuple[float, float, float], high: tuple[float, float, float]) -> np.ndarray:
    return ((picture >= np.array(low)) & (picture <= np.array(high))).all(-1)


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest component, all False if there is none."""
    found = component_table(mask, 1, 1)
    return label_components(mask)[0] == found[0][3] if found else np.zeros_like(mask, bool)


def filled(mask: np.ndarray) -> np.ndarray:
    """A mask with its holes: whatever the background can't reach from the border."""
    padded = np.pad(~mask, 1, constant_values=True)
    labels, _ = label_components(padded)
    return ~(labels == labels[0, 0])[1:-1, 1:-1]


def disk_objects(rgb: np.ndarray, low: tuple[float, float, float], high: tuple[float, float, float], least_share: float = 0.05, edge: int = 3) -> np.ndarray:
    """Objects on a turntable of one colour: what is within its outline, away from the edge, and of another colour."""
    colour = within(hsv(rgb), low, high)
    disk = filled(largest_component(colour))
    if disk.mean() < least_share:
        raise ValueError("circular_disk_not_found")
    return opened(erode(disk.astype(np.uint8), edge).astype(bool) & ~colour, 3).astype(bool)


class Blob(NamedTuple):
    x: float
    y: float
    area: int
    mask: np.ndarray


# Limits of the protocol for balls on a rail.
RAIL = {
    "least_saturation": 45, "least_value": 35, "top": 0.78, "bottom": 0.9, "least_area": 6, "most_area": 500, "most_candidates": 32,
    "split_area": 100, "split_aspect": 1.45, "least_separation": 7.0, "most_separation": 36.0, "most_y_difference": 9.0,
    "most_striker_y_difference": 14.0, "area_reward": 0.05, "expand": 1.5, "least_side": 18,
}


def _blob(mask: np.ndarray) -> Blob:
    ys, xs = np.nonzero(mask)
    return Blob(float(xs.mean()), float(ys.mean()), len(ys), mask)


def track_candidates(rgb: np.ndarray, config: dict[str, float]) -> list[Blob]:
    """Colourful, bright blobs in the band of a rail, largest first, neither too small nor too large. A large blob much wider
    than high is two balls that touch: it is halved if both halves are large enough. ValueError for fewer than three."""
    picture = hsv(rgb)
    gate = (np.rint(picture[..., 1]) >= config["least_saturation"]) & (picture[..., 2] >= config["least_value"])
    gate[: round(len(rgb) * config["top"])] = gate[round(len(rgb) * config["bottom"]) :] = False
    labels, _ = label_components(opened(gate.astype(np.uint8), 3).astype(bool))
    rows = component_table(labels > 0, config["least_area"], int(config["most_candidates"]))
    out: list[Blob] = []
    for blob in (_blob(labels == r[3]) for r in rows if r[0] <= config["most_area"]):
        ys, xs = np.nonzero(blob.mask)
        parts = [blob.mask]
        if blob.area >= config["split_area"] and (np.ptp(xs) + 1) / (np.ptp(ys) + 1) >= config["split_aspect"]:
            left = blob.mask & (np.arange(rgb.shape[1]) <= (xs.min() + xs.max()) // 2)
            halves = [left, blob.mask & ~left]
            if min(h.sum() for h in halves) >= config["least_area"]:
                parts = halves
        out += map(_blob, parts)
    if len(out) < 3:
        raise ValueError("collision_frame_zero_objects_missing")
    return out


def rail_roles(blobs: list[Blob], config: dict[str, float]) -> list[Blob]:
    """[striker, left target, right target]: the targets are the closest pair side by side, large ones preferred; the striker is
    the leftmost blob before them on their height."""
    pairs = [
        (apart - config["area_reward"] * (a.area + b.area), i, j)
        for (i, a), (j, b) in itertools.combinations(enumerate(blobs), 2)
        if config["least_separation"] <= (apart := abs(a.x - b.x)) <= config["most_separation"] and abs(a.y - b.y) <= config["most_y_difference"]]
    if not pairs:
        raise ValueError("collision_target_pair_missing")
    chosen = min(pairs)[1:]
    left, right = sorted((blobs[k] for k in chosen), key=lambda t: t.x)
    height = (left.y + right.y) / 2
    before = [t for k, t in enumerate(blobs) if k not in chosen and t.x < left.x - config["least_separation"] and abs(t.y - height) <= config["most_striker_y_difference"]]
    if not before:
        raise ValueError("collision_striker_missing")
    return [min(before, key=lambda t: t.x), left, right]


def rail_prompts(rgb: np.ndarray, config: dict[str, float] = RAIL) -> list[tuple[tuple[float, float, float, float], tuple[float, float]]]:
    """(box, point) of striker and targets in the first picture."""
    out = []
    for t in rail_roles(track_candidates(rgb, config), config):
        out.append((expanded_box(*_extent(t.mask), config["expand"], config["least_side"], rgb.shape[1], rgb.shape[0], of_pixels=True), (t.x, t.y)))
    return out


def _extent(mask: np.ndarray) -> tuple[int, int, int, int]:
    ys, xs = np.nonzero(mask)
    return int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1


def points_along(mask: np.ndarray, count: int = 6) -> list[tuple[float, float]]:
    """Medians of narrow bands of rows from the top to the bottom of a component."""
    ys, xs = np.nonzero(mask)
    low, reach = ys.min(), np.ptp(ys)
    band = max(3, round((reach + 1) * 0.012))
    bands = (np.abs(ys - round(low + f * reach)) <= band for f in np.linspace(0.08, 0.94, count))
    return [(float(np.median(xs[b])), float(np.median(ys[b]))) for b in bands if b.any()] or [(float(np.median(xs)), float(np.median(ys)))]


def bright_motion_prompt(
    stack: np.ndarray, threshold: float, least_area: int, expand: float = 1.08, least_side: float = 24.0,
) -> tuple[int, tuple[float, float, float, float], list[tuple[float, float, bool]]]:
    """(frame, box, points) of a rope and bob brighter than the background: of the components that are high enough and keep off
    the border the one of most area x (1 + 3 height) x (1 + 2 width), sides as shares of the picture's. points: (x, y, whether
    it belongs to the object); a last one that doesn't is put below the pivot, where a pole may stand, unless the object is there."""
    ground = blur5(median_background(stack))
    height, width = stack.shape[1:]
    margins = max(2, int(width * 0.015)), max(2, int(height * 0.015))
    best = None
    for k, frame in enumerate(stack):
        mask = opened((blur5(frame) - ground >= threshold).astype(np.uint8), 3).astype(bool)
        for label, area, x, y, w, h in component_boxes(mask):
            if area < least_area or h < max(least_side, int(height * 0.08)) or not clear_of_border(x, y, w, h, width, height, *margins):
                continue
            score = area * (1 + 3 * h / height) * (1 + 2 * w / width)
            if best is None or score > best[0]:
                best = (score, k, label_components(mask)[0] == label, (x, y, w, h))
    if best is None:
        raise ValueError("motion_prompt_failed")
    _, k, mask, (x, y, w, h) = best
    points = points_along(mask)
    ys, xs = np.nonzero(mask)
    pivot, pole = float(np.median(xs[ys <= np.quantile(ys, 0.08)])), y + 0.58 * h
    nearest = min(points, key=lambda p: abs(p[1] - pole))
    marks = [(*p, True) for p in points]
    if abs(nearest[0] - pivot) >= max(12.0, width * 0.015):
        marks.append((pivot, pole, False))
    return k, expanded_box(x, y, w, h, expand, least_side, width, height), marks


def gray_small(rgb: np.ndarray, width: int = 320) -> np.ndarray:
    """Gray picture of a width, by means over areas."""
    gray = rgb.astype(float) @ np.array([0.299, 0.587, 0.114])
    height = max(1, round(gray.shape[0] * width / gray.shape[1]))
    rows = np.linspace(0, gray.shape[0], height + 1).astype(int)
    cols = np.linspace(0, gray.shape[1], width + 1).astype(int)
    sums = np.pad(gray.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r0, r1, c0, c1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    return (sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]) / area


def entry_components(frame: np.ndarray, ground: np.ndarray, threshold: float = 12.0, least_area: int = 8) -> list[tuple[int, float, float]]:
    """(area, x, y) of what enters a picture: the difference to the background, freed of its own median."""
    moved = frame.astype(float) - ground
    mask = closed(opened((np.abs(moved - np.median(moved)) > threshold).astype(np.uint8), 3), 3).astype(bool)
    return [(n, x, y) for n, x, y, _ in component_table(mask, least_area)]
