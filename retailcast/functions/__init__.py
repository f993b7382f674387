"""Column-level (scalar) functions; all are built-in Spark expressions."""

from retailcast.functions.dates import (date_parts, fourier_terms, payday, weekday0,
                                        workday)
from retailcast.functions.metrics import clip_lower, msle_term, reciprocal_weight

__all__ = ["date_parts", "fourier_terms", "payday", "weekday0", "workday", "clip_lower",
           "msle_term", "reciprocal_weight"]
