"""All folds' and all subsets' fits at once, against one plain fit after the other."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import D
from retailcast.operators import evaluate as ev
from retailcast.operators import fold_ols as fo
from retailcast.operators import subset as ss
from retailcast.operators.hybrid import HybridForecaster, ZeroLearner

SPLITS = 4


@pytest.fixture(scope="module")
def panel(spark):
    """Series of a trend, a week and noise; one begins late, one has a single row, quake columns vary."""
    rng, rows = np.random.default_rng(2), []
    for s in (1, 2, 3):
        for fam in ("A", "B"):
            for i in range(50):
                if (s, fam) == (3, "A") and i < 30 or (s, fam) == (3, "B") and i != 12:
                    continue
                date = D("2024-01-01").fromordinal(D("2024-01-01").toordinal() + i)
                a, b = rng.normal(), rng.normal()
                quake = max(0, i - 20)
                sales = float(max(0.0, 10 * s + 0.3 * i + i % 7 + 2 * a + (3 if i % 3 else 0) + rng.normal()))
                rows.append((s * 1000 + ord(fam) + i * 10_000, date, s, fam, a, None if i % 9 == 4 else b, "x" if i % 3 else "y", i % 2 == 0, quake, quake ** 2, sales))
    df = spark.createDataFrame(rows, "id long, date date, store_nbr long, family string, a double, b double, cat string, flag boolean, "
                                     "time_since_quake int, time_since_quake_sq int, sales double")
    return df.cache()


def _rows(panel, fourier, linear, subsets=None, keep=("date", "store_nbr", "family", "sales")):
    design = fo.fold_design(panel, SPLITS, fourier, linear)
    rows = panel.select(*keep).join(design.dates, "date")
    return rows, fo.fit_folds(rows, "sales", design, subsets=subsets), design


@pytest.mark.parametrize("fourier, linear", [([], []), ([["W", 2]], ["time_since_quake", "time_since_quake_sq"])])
def test_all_folds_at_once_equal_refitting_each(spark, panel, fourier, linear):
    y = panel.select("date", "store_nbr", "family", "sales")

    def fit_predict(tx, ty, vx):
        model = HybridForecaster(ZeroLearner(), fourier=fourier, linear_cols=linear, unseen="pooled").fit(tx, ty)
        return model.predict(vx), model.predict(tx, in_sample=True)

    wanted = ev.time_series_cv_folds(fit_predict, panel.drop("sales"), y, SPLITS, train_score=True).orderBy("fold").collect()
    rows, fits, _ = _rows(panel, fourier, linear)
    got = fo.fold_scores(fits.add_fits(rows), SPLITS).orderBy("fold").collect()
    for w, g in zip(wanted, got):
        assert w["n_rows"] == g["n_rows"]
        assert np.allclose([w["msle"], w["train_msle"]], [g["msle"], g["train_msle"]], rtol=1e-6)


def test_features_are_shuffled_once_for_all_folds(panel):
    rows, fits, _ = _rows(panel, [], [])
    plan = fits.add_fits(rows)._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[1]


def _brute(panel, design_rows, kept, variant_first, boosted):
    """Plain least squares for each fold over the collected rows."""
    pdf = design_rows.toPandas()
    numbers = [c for c in ("a", "b", "time_since_quake") if c in kept]
    msle = []
    stats = {c: (pdf[c].astype(float).mean(), pdf[c].astype(float).std(ddof=0)) for c in numbers}
    cols = [np.ones(len(pdf))] + [((pdf[c].astype(float) - stats[c][0]) / stats[c][1]).fillna(0).to_numpy() for c in numbers]
    for c in ("cat", "flag"):
        if c in kept:
            cols += [(pdf[c] == v).to_numpy(float) for v in sorted(pdf[c].unique(), key=str)]
    z, y, block = np.column_stack(cols), pdf["sales"].to_numpy(), pdf["block"].to_numpy()
    for fold in range(1, SPLITS + 1):
        fit = np.array([f[variant_first + fold - 1] for f in pdf["fits"]])
        train, now = block < fold, block == fold
        w = z if boosted else np.column_stack((z, fit))
        target = y - fit if boosted else y
        coef = np.linalg.lstsq(w[train], target[train], rcond=1e-6)[0]
        pred = np.maximum(w[now] @ coef + (fit[now] if boosted else 0), 0)
        msle.append(((np.log1p(pred) - np.log1p(y[now])) ** 2).mean())
    return msle


@pytest.mark.parametrize("boosted", [True, False])
def test_masks_scored_at_once_equal_one_fit_each(spark, panel, boosted):
    linear = ["time_since_quake"]
    base = ["const", "trend"]
    rows, fits, _ = _rows(panel, [], linear, [base + linear, base], keep=panel.columns)
    rows = fits.add_fits(rows).drop(*(c for c in rows.columns if c.startswith("x1_"))).cache()
    subsets = ss.prepare_subsets(rows, ["a", "b", "cat", "flag", "time_since_quake"], SPLITS)
    kept = [[], ["a"], ["a", "b", "cat"], ["cat", "flag"], ["b", "time_since_quake"], ["a", "b", "cat", "flag", "time_since_quake"]]
    trials = spark.createDataFrame([(i, k, i % 2) for i, k in enumerate(kept)], "trial long, kept array<string>, variant int").repartition(3)
    got = {(r["trial"], r["fold"]): r for r in subsets.search(trials, {0: 0, 1: SPLITS}, boosted).collect()}
    assert len(got) == len(kept) * SPLITS
    for i, k in enumerate(kept):
        wanted = _brute(panel, rows, k, (i % 2) * SPLITS, boosted)
        assert np.allclose(wanted, [got[i, f]["msle"] for f in range(1, SPLITS + 1)], rtol=1e-5), k
    best = ss.trial_scores(subsets.search(trials, {0: 0, 1: SPLITS}, boosted)).orderBy(F.desc("target")).first()
    assert best["target"] <= 0


def test_too_many_levels_raise(spark, panel, monkeypatch):
    monkeypatch.setattr(ss, "MAX_COLUMNS", 3)
    rows, fits, _ = _rows(panel, [], [], keep=panel.columns)
    with pytest.raises(ValueError, match="at most 3"):
        ss.prepare_subsets(fits.add_fits(rows), ["a", "cat", "flag"], SPLITS)
