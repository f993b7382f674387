"""Feature-subset search of a hybrid with a linear second stage: all subsets from two passes.

Pass 1 sums, for each fold block, the cross-products of all columns that any subset can use: the features
(floats and numbers scaled, categories one-hot), the target and the first stage's fits. A subset's fit of
a fold is then a solve with a sub-matrix of the running sums, so subsets are rows of a trial table that
tasks solve apart. Pass 2 scores every validation row under the coefficients of all trials at once (one
matrix product a batch). The work on the rows doesn't grow with the number of trials but for that product.

The cross-products are (columns)² numbers for each block, whatever the number of rows; ``MAX_COLUMNS``
bounds them, more raise. A missing number counts as its mean, an unseen or missing level as none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.operators.encode import CATEGORY_TYPES, PopulationScaler, apply_codes, category_dictionary, columns_of_type
from retailcast.operators.joins import materialize

MAX_COLUMNS = 1024
RCOND = 1e-10
#: Rows whose matrix is held at once.
BATCH_ROWS = 8192


@dataclass
class Design:
    """Columns of the second stage: a constant, numbers, and a column for each level of each category."""
    numbers: list[str]
    stats: list[tuple[float, float]]
    categories: list[str]
    sizes: list[int]

    @property
    def owners(self) -> list[str]:
        """The feature of each column; the constant belongs to all."""
        return ["", *self.numbers, *(c for c, n in zip(self.categories, self.sizes) for _ in range(n))]

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(self.owners)))
        out[:, 0] = 1
        for k, (c, (mean, std)) in enumerate(zip(self.numbers, self.stats), 1):
            out[:, k] = np.nan_to_num((batch.column(c).to_numpy(zero_copy_only=False).astype(float) - mean) / std)
        at, rows = 1 + len(self.numbers), np.arange(batch.num_rows)
        for c, n in zip(self.categories, self.sizes):
            code = batch.column(c).to_numpy(zero_copy_only=False)
            known = code >= 0
            out[rows[known], at + code[known]] = 1
            at += n
        return out


def _extras(batch: pa.RecordBatch, y: str, fits: str) -> np.ndarray:
    """The target and the fits, a column each."""
    held = batch.column(fits).combine_chunks() if isinstance(batch.column(fits), pa.ChunkedArray) else batch.column(fits)
    values = held.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.column_stack((batch.column(y).to_numpy(zero_copy_only=False).astype(float), values))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(k, BATCH_ROWS)


@dataclass
class Subsets:
    """The written rows with coded categories, and the running cross-products."""
    rows: DataFrame
    design: Design
    grams: np.ndarray
    splits: int
    y: str
    fits: str

    def search(self, trials: DataFrame, fits_of: dict[int, int], boosted: bool = True) -> DataFrame:
        """(trial, fold, msle, n_rows) for ``trials`` (trial, kept array<string>, variant int): the second
        stage learns from the features ``kept``; ``fits_of``: where the fits of a variant's first fold are.
        Boosted: on the residuals of the fits; else on the target, with the fit as one more column."""
        design, grams, splits, y, fits = self.design, self.grams, self.splits, self.y, self.fits
        owners, width = np.array(design.owners), len(design.owners)
        context = self.rows.sparkSession.sparkContext
        summed = context.broadcast(grams)  # (splits + 1) x MAX_COLUMNS² numbers at most

        def solve(batches):
            for pdf in batches:
                out = []
                for trial, kept, variant in pdf[["trial", "kept", "variant"]].itertuples(index=False):
                    use = np.flatnonzero(np.isin(owners, ["", *kept]))
                    for fold in range(1, splits + 1):
                        fit = width + 1 + fits_of[variant] + fold - 1
                        gram = summed.value[fold]
                        own = use if boosted else np.append(use, fit)
                        target = gram[own, width] - (gram[own, fit] if boosted else 0)
                        coef = np.zeros(width + 1)
                        solved = np.linalg.pinv(gram[np.ix_(own, own)], rcond=RCOND, hermitian=True) @ target
                        coef[use] = solved[:len(use)]
                        coef[width] = 1.0 if boosted else solved[-1]
                        out.append((trial, fold, fit - width, coef.tolist()))
                yield pd.DataFrame(out, columns=["trial", "fold", "fit", "coef"])

        solved = materialize(trials.mapInPandas(solve, "trial long, fold int, fit int, coef array<double>"), "subset-coefs")
        table = solved.orderBy("fold", "trial").toPandas()  # trials x folds rows of at most MAX_COLUMNS numbers
        by_fold = {f: (own["trial"].to_numpy(), own["fit"].to_numpy(), np.stack(own["coef"])) for f, own in table.groupby("fold")}
        shared = context.broadcast(by_fold)

        def score(batches):
            sums, counts = {}, {}
            for batch in _small(batches):
                block = batch.column("block").to_numpy(zero_copy_only=False)
                for fold in np.unique(block):
                    if fold not in shared.value:
                        continue
                    own = batch.filter(pa.array(block == fold))
                    _, fit, coef = shared.value[fold]
                    extra = _extras(own, y, fits)
                    pred = design.matrix(own) @ coef[:, :width].T + extra[:, fit] * coef[:, width]
                    terms = (np.log1p(np.maximum(pred, 0)) - np.log1p(extra[:, :1])) ** 2
                    sums[fold] = sums.get(fold, 0) + terms.sum(0)
                    counts[fold] = counts.get(fold, 0) + own.num_rows
            for fold, total in sums.items():
                yield pd.DataFrame({"trial": shared.value[fold][0], "fold": int(fold), "total": total, "n": counts[fold]})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in score(batches):
                yield pa.RecordBatch.from_pandas(part, schema=_SCORED, preserve_index=False)

        parts = self.rows.mapInArrow(run, "trial long, fold int, total double, n long")
        return parts.groupBy("trial", "fold").agg((F.sum("total") / F.sum("n")).alias("msle"), F.sum("n").alias("n_rows"))


_SCORED = pa.schema([("trial", pa.int64()), ("fold", pa.int32()), ("total", pa.float64()), ("n", pa.int64())])


def prepare_subsets(rows: DataFrame, features: list[str], splits: int, y: str = "sales", fits: str = "fits",
                    plain: DataFrame | None = None, add=None, keep: tuple[str, ...] = ()) -> Subsets:
    """Pass 1 over ``rows`` (block, y, fits, features): scale, code, and sum the cross-products. ``plain``: the
    same rows before the fits were joined, for the statistics and levels, so that the join runs once. With ``add``
    the rows have no block and fits yet: ``add(rows)`` adds them, by the columns ``keep``, behind the
    coding, so that a shuffle for it carries codes instead of texts."""
    typed = rows.select(*features)
    categories = columns_of_type(typed, CATEGORY_TYPES)
    numbers = [c for c in features if c not in categories]
    whole = rows
    rows = rows.select(*(["block", y, fits] if add is None else [y, *(F.col(f"`{c}`").alias(f"_key_{c}") for c in keep)]),
                       *(F.col(f"`{c}`").cast("double").alias(c) for c in numbers), *categories)
    plain = whole if plain is None else plain
    plain = plain.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in numbers), *categories)
    stats = PopulationScaler(numbers).fit(plain).stats
    sizes = {}
    if categories:
        dictionary = materialize(category_dictionary(plain, categories), "subset-levels")
        sizes = {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}  # a row for each category
        rows = apply_codes(rows, dictionary, categories)
    if add is not None:
        used = [f"_v_{c}" for c in [*numbers, *categories]]
        apart = rows.select(y, *(F.col(f"_key_{c}").alias(c) for c in keep), *(F.col(f"`{c}`").alias(f"_v_{c}") for c in [*numbers, *categories]))
        rows = add(apart).select("block", y, fits, *(F.col(f"`{c}`").alias(c[3:]) for c in used))
    design = Design(numbers, [(stats[c][0] or 0.0, stats[c][1] or 1.0) for c in numbers], categories, [sizes.get(c, 0) for c in categories])
    width = len(design.owners)
    if width > MAX_COLUMNS:
        raise ValueError(f"{width} columns of features and levels; at most {MAX_COLUMNS} fit into the cross-products")
    rows = materialize(rows, "subset-rows")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = {}
        for batch in _small(batches):
            whole = np.column_stack((design.matrix(batch), _extras(batch, y, fits)))
            block = batch.column("block").to_numpy(zero_copy_only=False)
            for b in np.unique(block):
                own = whole[block == b]
                grams[b] = grams.get(b, 0) + own.T @ own
        for b, gram in grams.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), b, np.int32)), pa.array(np.arange(len(gram), dtype=np.int32)),
                                              pa.array(gram.tolist(), pa.list_(pa.float64()))], names=["block", "i", "line"])

    def add(lines: pd.DataFrame) -> pd.DataFrame:  # a line for each task
        return pd.DataFrame({"block": lines["block"][:1], "i": lines["i"][:1], "line": [np.sum(np.stack(lines["line"]), axis=0).tolist()]})

    schema = "block int, i int, line array<double>"
    lines = rows.mapInArrow(multiply, schema).groupBy("block", "i").applyInPandas(add, schema).collect()  # blocks x columns lines
    size = len(lines[0]["line"]) if lines else width
    blocks = np.zeros((splits + 1, size, size))
    for r in lines:
        blocks[r["block"], r["i"]] = r["line"]
    before = np.concatenate((np.zeros((1, size, size)), np.cumsum(blocks, axis=0)))  # [f]: the blocks before f
    return Subsets(rows, design, before[:splits + 1], splits, y, fits)


def mask_trials(spark, masks: list[dict[str, float]], linear: list[str]) -> tuple[DataFrame, list[list[str]]]:
    """Trials of masks {feature: value, kept if over 0.5}, and the kept linear columns of each variant. Linear
    columns belong to the first stage, of which each subset is a variant; the second one never has them."""
    variants, rows = [], []
    for i, mask in enumerate(masks):
        kept = [f for f in sorted(mask) if mask[f] > 0.5]
        first = [c for c in linear if c in kept]
        if first not in variants:
            variants.append(first)
        rows.append((i, [f for f in kept if f not in linear], variants.index(first)))
    return spark.createDataFrame(rows, "trial long, kept array<string>, variant int").repartition(min(len(rows), 64), "trial"), variants


def trial_scores(scored: DataFrame) -> DataFrame:
    """(trial, target): the negative root of the mean fold error, as a search maximises it."""
    return scored.groupBy("trial").agg((-F.sqrt(F.avg("msle"))).alias("target"))
