"""Per-series OLS of every fold of an expanding-window split from one aggregation.

A row of block b trains the folds after b, so the training sums of fold f are those of the blocks before
f: cross-products are summed once per (series, block) and run over the blocks of a series (a handful of
rows). From them come the fits of all folds, and of any subset of the regressors, whose cross-products
are a sub-matrix. Scoring reads the rows once more, with the coefficients of all folds beside them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.functions.dates import fourier_terms
from retailcast.functions.metrics import clip_lower, msle_term
from retailcast.operators.evaluate import date_blocks
from retailcast.operators.joins import bounded_broadcasts, join_dimension, materialize
from retailcast.operators.ols import RCOND, _solve_batch, linear_prediction
from retailcast.operators.panel import dedup_last
from retailcast.sources.schemas import SERIES


@dataclass
class FoldDesign:
    """``dates``: date, block and the regressors x1_0.. of each training date (trend over the number of
    dates); ``names``: what these are; ``lengths``: training dates of each fold."""
    dates: DataFrame
    names: list[str]
    lengths: list[int]

    @property
    def columns(self) -> list[str]:
        return [f"x1_{i}" for i in range(len(self.names))]

    def factors(self) -> np.ndarray:
        """(fold, regressor): a fold's own regressor over the one in ``dates`` (its trend ends at 1)."""
        out = np.ones((len(self.lengths), len(self.names)))
        out[:, self.names.index("trend")] = self.lengths[-1] / np.array(self.lengths, float)
        return out


def fold_design(x: DataFrame, splits: int, fourier: list, linear_cols: list[str]) -> FoldDesign:
    """Constant, trend, Fourier terms and linear columns for each date of ``x``."""
    blocks = materialize(date_blocks(x, splits), "blocks")
    counts = {r["block"]: r["n"] for r in blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # splits + 1 rows
    lengths = [sum(n for b, n in counts.items() if b < fold) for fold in range(1, splits + 1)]
    terms = {"const": F.lit(1.0), "trend": (F.col("pos") + 1) / F.lit(float(lengths[-1]))}
    for freq, k in fourier:
        terms.update(fourier_terms(F.col("date"), freq, k))
    names = [*terms, *linear_cols]
    dates = blocks.withColumns(terms)
    if linear_cols:
        last = dedup_last(x.select("date", *SERIES, *linear_cols), "date", SERIES).drop(*SERIES)
        dates = dates.join(last, "date", "left").fillna(0.0, subset=linear_cols)
    dates = dates.select("date", "block", *(F.col(f"`{n}`").cast("double").alias(f"x1_{i}") for i, n in enumerate(names)))
    return FoldDesign(materialize(dates, "fold-design"), names, lengths)


@dataclass
class FoldFits:
    """``coefs``: (series..., coefs): an array of coefficients for each (subset, fold), fold by fold within
    a subset, NULL where a series has no training rows; ``pooled``: those of all series together."""
    coefs: DataFrame
    pooled: list[list[float] | None]
    columns: list[str]
    series: tuple[str, ...]

    def add_fits(self, rows: DataFrame, out: str = "fits", dates: DataFrame | None = None) -> DataFrame:
        """``rows`` with an array of the fits of each (subset, fold); a series without training rows
        has the pooled ones. ``dates``: the design's, for rows that don't have its columns yet; they are joined
        behind the series' coefficients, so that a shuffle of the rows doesn't carry them."""
        (small,) = bounded_broadcasts(self.coefs)
        both = rows.join(small.withColumnRenamed("coefs", "_coefs"), list(self.series), "left")
        if dates is not None:
            both = join_dimension(both, dates, "date", "inner")

        def fit(k: int, pooled: list[float] | None) -> Column:
            other = F.array(*(F.lit(v) for v in pooled)) if pooled is not None else F.lit(None).cast("array<double>")
            return linear_prediction(F.coalesce(F.col("_coefs")[k], other), self.columns)

        return both.withColumn(out, F.array(*(fit(k, p) for k, p in enumerate(self.pooled)))).drop("_coefs")


def fit_folds(rows: DataFrame, y: str, design: FoldDesign, by=SERIES, subsets: list[list[str]] | None = None,
              rcond: float = RCOND) -> FoldFits:
    """Fits of ``rows`` (series, y, block and the design's columns) for each subset of the design's names
    (all by default) and each fold; a regressor outside the subset has coefficient 0."""
    cols, by = design.columns, list(by)
    p, splits = len(cols), len(design.lengths)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    subsets = [[i for i, n in enumerate(design.names) if n in keep] for keep in (subsets or [design.names])]
    ok = F.col(y).isNotNull()
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    sums = {f"s{k}": F.sum(F.col(cols[i]) * F.col(cols[j])) for k, (i, j) in enumerate(pairs)}
    sums |= {f"t{i}": F.sum(F.col(c) * F.col(y).cast("double")) for i, c in enumerate(cols)}
    per_block = materialize(rows.filter(ok).groupBy(*by, "block").agg(*(e.alias(n) for n, e in sums.items()), F.count(F.lit(1)).alias("n")), "fold-sums")
    upper = np.triu_indices(p)
    factors = design.factors()

    def solve(values: np.ndarray) -> list:
        """Coefficients for each (subset, fold) of series, from values (series, block, sums and n)."""
        before = np.cumsum(values, axis=1)[:, :splits]  # of the blocks before fold 1, 2, ...
        xtx = np.zeros((*before.shape[:2], p, p))
        xtx[..., upper[0], upper[1]] = xtx[..., upper[1], upper[0]] = before[..., :len(pairs)]
        xtx *= factors[None, :, :, None] * factors[None, :, None, :]
        xty = before[..., len(pairs):-1] * factors[None]
        out = np.zeros((len(values), len(subsets), splits, p))
        for s, keep in enumerate(subsets):
            if keep:
                part = xtx[:, :, keep][:, :, :, keep].reshape(-1, len(keep), len(keep))
                coef, _ = _solve_batch(part, xty[:, :, keep].reshape(-1, len(keep)), rcond)
                out[:, s, :, keep] = np.moveaxis(coef.reshape(len(values), splits, -1), -1, 0)
        out *= factors[None, None]
        none = before[..., -1] == 0
        return [[None if none[r, f] else out[r, s, f].tolist() for s in range(len(subsets)) for f in range(splits)] for r in range(len(values))]

    def table(parts: list) -> np.ndarray:
        """(block, sums) of one series."""
        out = np.zeros((splits + 1, len(pairs) + p + 1))
        for part in parts:
            out[part["block"]] = part["v"]
        return out

    schema = T.StructType([f for f in per_block.schema.fields if f.name in by] + [T.StructField("coefs", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def solve_batches(batches):
        for pdf in batches:
            if len(pdf):
                out = pdf[by].copy()
                out["coefs"] = solve(np.stack([table(parts) for parts in pdf["parts"]]))
                yield out[schema.fieldNames()]

    vector = F.array(*(F.col(n) for n in sums), F.col("n").cast("double"))
    grouped = per_block.groupBy(*by).agg(F.collect_list(F.struct("block", vector.alias("v"))).alias("parts"))
    coefs = materialize(grouped.mapInPandas(solve_batches, schema), "fold-coefs")
    whole = per_block.groupBy("block").agg(*(F.sum(n).alias(n) for n in sums), F.sum("n").alias("n"))
    parts = [{"block": r["block"], "v": [*(r[n] for n in sums), float(r["n"])]} for r in whole.collect()]  # a row for each block
    return FoldFits(coefs, solve(table(parts)[None])[0], cols, tuple(by))


def fold_scores(rows: DataFrame, splits: int, y: str = "sales", fits: str = "fits", first: int = 0) -> DataFrame:
    """(fold, msle, n_rows, train_msle) of the clipped fits ``first``.. of each fold, from one pass; a row
    without a fit raises."""
    aggs = []
    for fold in range(1, splits + 1):
        term = msle_term(F.col(y), clip_lower(F.col(fits)[first + fold - 1]))
        now, earlier = F.col("block") == fold, F.col("block") < fold
        aggs += [F.avg(F.when(now, term)).alias(f"v{fold}"), F.avg(F.when(earlier, term)).alias(f"t{fold}"), F.count(F.when(now, 1)).alias(f"n{fold}"),
                 F.count(F.when((now | earlier) & term.isNull(), 1)).alias(f"m{fold}")]
    r = rows.agg(*aggs).first()  # one row
    missing = sum(r[f"m{f}"] for f in range(1, splits + 1))
    if missing:
        raise ValueError(f"{missing} rows have no forecast")
    out = [(f, r[f"v{f}"], r[f"n{f}"], r[f"t{f}"]) for f in range(1, splits + 1)]
    return rows.sparkSession.createDataFrame(out, "fold int, msle double, n_rows long, train_msle double")
