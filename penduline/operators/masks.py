"""Binary masks as bit sets: 64 pixels a word, row after row. Overlaps, areas and unions stay within the JVM; shapes that
need neighbourhoods (components, morphology, motion) are numpy kernels behind Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(pixels: Column) -> Column:
    """array<boolean> -> array<bigint>. Null pixels are not set."""
    words = F.sequence(F.lit(0), F.ceil(F.size(pixels) / F.lit(64)).cast("int") - 1)
    word = lambda w: F.aggregate(
        F.transform(F.slice(pixels, w * 64 + 1, F.lit(64)), lambda p, i: F.when(p, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(pixels) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


def _bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, w: s + F.bit_count(w))


def area(mask: Column) -> Column:
    return _bits(mask)


def _both(a: Column, b: Column, how: str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.zip_with(a, b, lambda x, y: getattr(F.coalesce(x, zero), how)(F.coalesce(y, zero)))


def union(a: Column, b: Column) -> Column:
    """Pixels of either; the shorter mask counts as empty beyond its end."""
    return _both(a, b, "bitwiseOR")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, null if both are empty: nothing was observed."""
    return F.try_divide(_bits(_both(a, b, "bitwiseAND")).cast("double"), _bits(union(a, b)))


def iou_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(iou(a, b), F.lit(0.0))


def iou_summary(frames: DataFrame, iou_column: str, *keys: str) -> DataFrame:
    """(keys, mean, lowest, highest, observed_frame_ratio, reason_code)"""
    v = F.col(iou_column)
    return frames.groupBy(*keys).agg(F.avg(v).alias("mean"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.try_divide(F.count(v).cast("double"), F.count("*")).alias("observed_frame_ratio"),
                                     F.when(F.count(v) == 0, "no_observed_mask_iou").alias("reason_code"))


def pixels(masks: DataFrame, mask: str, width: int, *keys: str) -> DataFrame:
    """(keys, x, y) of every set pixel."""
    rows = masks.select(*keys, F.posexplode(mask).alias("_w", "_bits"))
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("_bits"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1))
    return rows.select(*keys, "_w", at.alias("_b")).select(
        *keys, ((F.col("_w") * 64 + F.col("_b")) % width).alias("x"), F.floor((F.col("_w") * 64 + F.col("_b")) / width).cast("int").alias("y"))


def centroids(masks: DataFrame, mask: str, width: int, *keys: str) -> DataFrame:
    """(keys, area, x, y); x and y null for empty masks."""
    found = pixels(masks, mask, width, *keys).groupBy(*keys).agg(F.count("*").alias("area"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return masks.select(*keys).distinct().join(found, list(keys), "left").na.fill(0, ["area"])


def area_gate(area_column: Column, least: int, frame_area: int, largest_share: float) -> Column:
    """Whether an area is neither too small nor too large."""
    return area_column.between(least, round(frame_area * largest_share))


def clipped(points: DataFrame, top: Column) -> DataFrame:
    """Set pixels without the rows above a row."""
    return points.where(F.col("y") >= top)


def prompt_boxes(points: DataFrame, width: int, height: int, expand: float, least: float, *keys: str) -> DataFrame:
    """(keys, x0, y0, x1, y1): the box of each mask's set pixels about the centre of its outermost pixels, grown and no smaller
    than least, within the picture; null for masks without pixels, which give no row."""
    box = points.groupBy(*keys).agg(F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("t"), F.max("y").alias("b"))

    def side(low: str, high: str, limit: int) -> tuple[Column, Column]:
        middle, half = (F.col(low) + F.col(high)) / 2, F.greatest(F.lit(float(least)), (F.col(high) - F.col(low) + 1) * expand) / 2
        return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(limit - 1.0), middle + half)

    (x0, x1), (y0, y1) = side("l", "r", width), side("t", "b", height)
    return box.select(*keys, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def pivot_and_bob(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, pivot_x, pivot_y, bob_x, bob_y, reason_ok) from set pixels: the top rows (6 % quantile) give the pivot, the
    bottom rows (76 %) the bob."""
    cuts = points.groupBy(*keys).agg(F.percentile("y", F.lit(0.06)).alias("_top"), F.percentile("y", F.lit(0.76)).alias("_low"))
    p = points.join(cuts, list(keys))
    top, low = F.col("y") <= F.col("_top"), F.col("y") >= F.col("_low")
    return p.groupBy(*keys).agg(F.percentile(F.when(top, F.col("x")), F.lit(0.5)).alias("pivot_x"), F.min(F.when(top, F.col("y"))).alias("pivot_y"), F.avg(F.when(low, F.col("x"))).alias("bob_x"), F.avg(F.when(low, F.col("y"))).alias("bob_y"),
                                ((F.count_if(top) >= 2) & (F.count_if(low) >= 3)).alias("valid"))


# numpy kernels


def unpack(words: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bit set -> boolean picture."""
    bits = np.unpackbits(np.asarray(words, np.int64).view(np.uint8), bitorder="little")
    return bits[: height * width].reshape(height, width).astype(bool)


def label_components(picture: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components, numbered from 1 in the order of their first pixel row by row."""
    height, width = picture.shape
    label = np.where(picture, np.arange(1, height * width + 1).reshape(height, width), 0)
    big = height * width + 1
    while True:  # each pixel takes the least label around it, then that label's own label, until nothing changes
        padded = np.pad(np.where(label > 0, label, big), 1, constant_values=big)
        least = np.min([padded[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        new = np.where(picture, least, 0)
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(picture, flat[new], 0)
        if (new == label).all():
            break
        label = new
    names, numbered = np.unique(label, return_inverse=True)
    numbered = numbered.reshape(height, width)
    return (numbered if names[0] == 0 else numbered + 1), int((names > 0).sum())


def component_table(picture: np.ndarray, least_area: int = 1, most: int | None = None) -> list[tuple[int, float, float, int]]:
    """(area, x, y, label), largest first, ties by label."""
    labels, n = label_components(picture)
    ys, xs = np.nonzero(labels)
    which = labels[ys, xs]
    areas = np.bincount(which, minlength=n + 1)
    cx, cy = np.bincount(which, xs, n + 1), np.bincount(which, ys, n + 1)
    rows = [(int(areas[k]), float(cx[k] / areas[k]), float(cy[k] / areas[k]), k) for k in range(1, n + 1) if areas[k] >= least_area]
    return sorted(rows, key=lambda r: (-r[0], r[3]))[:most]


def components(masks: DataFrame, mask: str, height: int, width: int, *keys: str, least_area: int = 1, most: int | None = None) -> DataFrame:
    """(keys, component, area, x, y): the connected components of each mask, largest first."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in masks.select(*keys).schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for values in batch.itertuples(index=False):
                held, words = values[:-1], values[-1]
                if words is not None and len(words):
                    for k, (n, x, y, _) in enumerate(component_table(unpack(words, height, width), least_area, most)):
                        rows.append((*held, k, n, x, y))
            yield pd.DataFrame(rows, columns=[*keys, "component", "area", "x", "y"])

    return masks.select(*keys, mask).mapInPandas(run, f"{kinds}, component int, area bigint, x double, y double")


def ellipse(size: int) -> np.ndarray:
    """The pixels of an ellipse inscribed in a square of odd size: a cross for 3."""
    r = size // 2
    dy = np.arange(-r, r + 1)
    reach = np.rint(r * np.sqrt(1 - (dy / max(r, 1)) ** 2)).astype(int)
    return np.abs(np.arange(-r, r + 1))[None, :] <= reach[:, None]


def _shifted(picture: np.ndarray, size: int, fill: int) -> list[np.ndarray]:
    padded = np.pad(picture, size // 2, constant_values=fill)
    h, w = picture.shape
    return [padded[dy : dy + h, dx : dx + w] for dy, dx in zip(*np.nonzero(ellipse(size)), strict=True)]


def erode(picture: np.ndarray, size: int) -> np.ndarray:
    return np.min(_shifted(picture, size, 1), axis=0)


def dilate(picture: np.ndarray, size: int) -> np.ndarray:
    return np.max(_shifted(picture, size, 0), axis=0)


def opened(picture: np.ndarray, size: int) -> np.ndarray:
    return dilate(erode(picture, size), size)


def closed(picture: np.ndarray, size: int) -> np.ndarray:
    return erode(dilate(picture, size), size)


def blur5(gray: np.ndarray) -> np.ndarray:
    """5 x 5 binomial blur, edges mirrored."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    rows = np.pad(gray.astype(float), ((2, 2), (2, 2)), mode="reflect")
    rows = sum(k[i] * rows[i : i + gray.shape[0], :] for i in range(5))
    return sum(k[i] * rows[:, i : i + gray.shape[1]] for i in range(5))


def median_background(stack: np.ndarray) -> np.ndarray:
    """Median of each pixel over time, cut to whole numbers."""
    if not len(stack):
        raise ValueError("empty_timeline")
    return np.median(stack, axis=0).astype(np.uint8)


def motion_masks(stack: np.ndarray, threshold: float, close: int = 5, least_area: int = 20) -> np.ndarray:
    """What differs from the background in each frame: blurred, cut, opened, closed (by an odd size of 3 at least), without
    small components."""
    ground = blur5(median_background(stack))
    out = np.zeros(stack.shape, bool)
    for k, frame in enumerate(stack):
        moved = closed(opened(np.abs(blur5(frame) - ground) >= threshold, 3), max(3, int(close) | 1))
        labels, n = label_components(moved)
        large = np.bincount(labels.ravel(), minlength=n + 1) >= least_area
        large[0] = False
        out[k] = large[labels]
    return out


def component_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(label, area, x, y, width, height) of each component."""
    labels, n = label_components(mask)
    ys, xs = np.nonzero(labels)
    which = labels[ys, xs]
    out = []
    for k in range(1, n + 1):
        y, x = ys[which == k], xs[which == k]
        out.append((k, len(y), int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
    return out


def clear_of_border(x: int, y: int, w: int, h: int, width: int, height: int, margin_x: int, margin_y: int) -> bool:
    """Whether a box keeps more than a margin from each side of the picture."""
    return x > margin_x and y > margin_y and x + w < width - margin_x and y + h < height - margin_y


def best_proposal(masks: np.ndarray, least_area: int = 1, border: float = 0.01) -> tuple[int, int, float] | None:
    """(frame, label, score) of the component of at least least_area that keeps off the border (by that share of each side, a
    pixel at least) with the most area x (0.5 + compactness); of equals the first frame and label. None if there is none."""
    best = None
    height, width = masks.shape[1:]
    margins = max(1, round(width * border)), max(1, round(height * border))
    for k, mask in enumerate(masks):
        for label, area, x, y, w, h in component_boxes(mask):
            if area >= least_area and clear_of_border(x, y, w, h, width, height, *margins):
                score = area * (0.5 + area / (w * h))
                if best is None or score > best[2]:
                    best = (k, label, float(score))
    return best


def expanded_box(x: int, y: int, w: int, h: int, expand: float, least: float, width: int, height: int, of_pixels: bool = False) -> tuple[float, float, float, float]:
    """(x0, y0, x1, y1) about the centre of a box of w x h pixels, grown and no smaller than least, within the picture. The
    centre is that of the box's edges, or with of_pixels that of its outermost pixels, half a pixel before."""
    cx, cy = x + (w - of_pixels) / 2, y + (h - of_pixels) / 2
    rx, ry = max(least, w * expand) / 2, max(least, h * expand) / 2
    return max(0.0, cx - rx), max(0.0, cy - ry), min(width - 1.0, cx + rx), min(height - 1.0, cy + ry)


def motion_prompt(stack: np.ndarray, threshold: float, least_area: int, expand: float, least_side: float) -> tuple[int, tuple[float, float, float, float], tuple[float, float]]:
    """(frame, box, point) of the best moving component; ValueError motion_prompt_failed if there is none."""
    moved = motion_masks(stack, threshold, least_area=least_area)
    best = best_proposal(moved, least_area)
    if best is None:
        raise ValueError("motion_prompt_failed")
    k, label, _ = best
    _, _, x, y, w, h = component_boxes(moved[k])[label - 1]
    ys, xs = np.nonzero(label_components(moved[k])[0] == label)
    return k, expanded_box(x, y, w, h, expand, least_side, stack.shape[2], stack.shape[1]), (float(xs.mean()), float(ys.mean()))


def rectified(picture: np.ndarray, origin: tuple[float, float], direction: tuple[float, float], length: float, size: tuple[int, int] = (160, 512), share: float = 0.8) -> np.ndarray:
    """A strip along an axis: share of its width shows `length`, nearest pixels, black beyond the picture."""
    height, width = size
    scale = length / (share * width)
    u = (np.arange(width) - (width - 1) / 2) * scale
    v = (np.arange(height) - (height - 1) / 2) * scale
    dx, dy = direction
    x = np.rint(origin[0] + u[None, :] * dx - v[:, None] * dy).astype(int)
    y = np.rint(origin[1] + u[None, :] * dy + v[:, None] * dx).astype(int)
    inside = (x >= 0) & (y >= 0) & (x < picture.shape[1]) & (y < picture.shape[0])
    return np.where(inside, picture[np.clip(y, 0, picture.shape[0] - 1), np.clip(x, 0, picture.shape[1] - 1)], 0)


def rectified_circle(picture: np.ndarray, centre: tuple[float, float], radius: float, size: int = 320, shown: float = 120.0) -> np.ndarray:
    """A square about a circle, in which its radius is `shown` pixels."""
    k = (np.arange(size) - (size - 1) / 2) * radius / shown
    x, y = np.rint(centre[0] + k).astype(int)[None, :], np.rint(centre[1] + k).astype(int)[:, None]
    x, y = np.broadcast_arrays(x, y)
    inside = (x >= 0) & (y >= 0) & (x < picture.shape[1]) & (y < picture.shape[0])
    return np.where(inside, picture[np.clip(y, 0, picture.shape[0] - 1), np.clip(x, 0, picture.shape[1] - 1)], 0)
