"""Kernels that turn differences into similarities in [0, 1]; exactly 1 for no difference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the least scale.
TINY = 1e-12


def scaled_delta(reference: Column, predicted: Column, scale: Column | float) -> Column:
    return F.abs(predicted - reference) / F.greatest(F.lit(scale) if isinstance(scale, float) else scale, F.lit(TINY))


def relative_delta(reference: Column, predicted: Column, least: float = TINY) -> Column:
    return F.abs(predicted - reference) / F.greatest(F.abs(reference), F.lit(max(least, TINY)))


def decay(error: Column, scale: Column | float = 1.0) -> Column:
    """exp(-error / scale), errors below 0 counting as 0."""
    return F.exp(-F.greatest(error, F.lit(0.0)) / F.greatest(F.lit(scale) if isinstance(scale, float) else scale, F.lit(TINY)))


def delta_similarity(reference: Column, predicted: Column, scale: Column | float) -> Column:
    return F.exp(-scaled_delta(reference, predicted, scale))


def ratio_similarity(reference: Column, predicted: Column) -> Column:
    """For shares: 1 - min(difference, 1)."""
    return 1 - F.least(F.abs(predicted - reference), F.lit(1.0))


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the parts that aren't null, their weights renormalised."""
    up = [F.coalesce(F.lit(weights[k]) * v, F.lit(0.0)) for k, v in parts.items()]
    down = [F.when(v.isNotNull(), weights[k]).otherwise(0.0) for k, v in parts.items()]
    add = lambda xs: sum(xs[1:], xs[0])
    return F.try_divide(add(up), add(down))
