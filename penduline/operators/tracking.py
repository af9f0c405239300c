"""Identity of several objects from frame to frame, and choices among candidates."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates up to which all assignments are tried, so that ties are settled by order.
TRIED = 6


def assign_nearest(known: np.ndarray, candidates: np.ndarray) -> tuple[int, ...]:
    """For each known point the index of its own candidate, so that the sum of distances is least. There may be more candidates
    than points. Of equal assignments of at most TRIED candidates the lexicographically first counts, of more any one."""
    n, m = len(known), len(candidates)
    if m < n:
        raise ValueError("assignment needs as many candidates as objects")
    far = np.hypot(known[:, None, 0] - candidates[None, :, 0], known[:, None, 1] - candidates[None, :, 1])
    if m > TRIED:
        return least_assignment(far)
    return min(permutations(range(m), n), key=lambda p: (sum(far[i, j] for i, j in enumerate(p)), p)) if n else ()


def least_assignment(cost: np.ndarray) -> tuple[int, ...]:
    """A column of its own for each row, of least total cost; there are no fewer columns than rows. Rows enter one after the
    other, each by the cheapest augmenting path under prices of rows and columns that keep all reduced costs at 0 or above."""
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for new in range(n):
        reach, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, via, dist = new, -1, 0.0
        while row >= 0:
            step = dist + cost[row] - row_price[row] - column_price
            better = ~done & (step < reach)
            reach[better], before[better] = step[better], via
            via = int(np.where(done, np.inf, reach).argmin())
            dist, done[via], row = reach[via], True, owner[via]
        row_price[new] += dist
        passed = done & (owner >= 0)
        row_price[owner[passed]] += dist - reach[passed]
        column_price[done] -= dist - reach[done]
        while via >= 0:  # the path back to the new row
            owner[via] = new if before[via] < 0 else owner[before[via]]
            via = before[via]
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.nonzero(owner >= 0)[0]
    return tuple(int(j) for j in out)


def track(points: DataFrame, expected: int, key: str = "series_id") -> DataFrame:
    """(key, frame, obj, x, y) from candidates(key, frame, x, y, area). In the first frame with enough candidates the
    largest ones are numbered from left to right; later frames are matched to the last seen places; frames with fewer
    candidates are passed over. A series is a recording: its candidates are few and go through one task in order."""
    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values(["frame", "x", "y"], kind="stable")[["frame", "x", "y", "area"]].to_numpy(float)
        cuts = np.flatnonzero(np.diff(data[:, 0])) + 1
        last, out = None, []
        for group in np.split(data, cuts):
            if len(group) < expected:
                continue
            spots = group[:, 1:3]
            if last is None:
                last = spots[np.sort(np.argsort(-group[:, 3], kind="stable")[:expected])]
            else:
                last = spots[list(assign_nearest(last, spots))]
            out.append(np.column_stack([np.full(expected, group[0, 0]), np.arange(expected), last]))
        rows = np.concatenate(out) if out else np.zeros((0, 4))
        return pd.DataFrame({key: pdf[key].iloc[0], "frame": rows[:, 0].astype("int64"), "obj": rows[:, 1].astype("int32"), "x": rows[:, 2], "y": rows[:, 3]}, index=range(len(rows)))

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, F.col("frame").cast("bigint").alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "area").groupBy(key).applyInPandas(
        follow, f"{key} {kind}, frame bigint, obj int, x double, y double")


def best_pair(points: DataFrame, key: str, name: str, nearest: float, farthest: float, level: float, reward: float) -> DataFrame:
    """(key, left_id, right_id, cost): of the pairs of a group's points whose distance along x is within bounds and whose
    y differ by level at most, the one with the least distance - reward x area. Points of a group are the few candidates
    of one picture; the pairs are found by a range join on sorted x."""
    a = points.select(key, *(F.col(c).alias(f"a_{c}") for c in (name, "x", "y", "area")))
    b = points.select(key, *(F.col(c).alias(f"b_{c}") for c in (name, "x", "y", "area")))
    apart = F.col("b_x") - F.col("a_x")
    pairs = a.join(b, key).where(apart.between(nearest, farthest) & (F.abs(F.col("a_y") - F.col("b_y")) <= level))
    cost = apart - reward * (F.col("a_area") + F.col("b_area"))
    pick = F.min(F.struct(cost.alias("cost"), F.col(f"a_{name}").alias("left_id"), F.col(f"b_{name}").alias("right_id")))
    return pairs.groupBy(key).agg(pick.alias("p")).select(key, "p.left_id", "p.right_id", "p.cost")
