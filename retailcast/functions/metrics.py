"""Scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def msle_term(y: Column, p: Column) -> Column:
    """(ln(1 + y) - ln(1 + p))^2; averaged it is the mean squared log error."""
    diff = F.log1p(y) - F.log1p(p)
    return diff * diff


def clip_lower(c: Column, lower: float = 0.0) -> Column:
    """max(c, lower) that keeps NULL as NULL (greatest(NULL, 0) would be 0)."""
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(c, F.lit(float(lower))))


def reciprocal_weight(score: Column) -> Column:
    """Ensemble weight e = 1 / RMSLE."""
    return F.lit(1.0) / score
