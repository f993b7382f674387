"""Registered queries for I/O, reshaping, encoding, validation, search and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.functions.metrics import clip_lower, msle_term
from retailcast.operators import ensemble as en
from retailcast.operators import evaluate as ev
from retailcast.operators import fold_ols as fo
from retailcast.operators import knn
from retailcast.operators import panel as pn
from retailcast.operators import search as sr
from retailcast.operators import subset as ss
from retailcast.operators.deterministic import DeterministicProcess
from retailcast.operators.encode import (FLOAT_TYPES, NominalTransformer, OneHot, PopulationScaler,
                                         category_dictionary, columns_of_type)
from retailcast.operators import tuning as tn
from retailcast.operators.histboost import HistBoostRegressor
from retailcast.operators.hybrid import (LINEAR_COLUMNS, DataPreparation, HybridForecaster, KnnLearner,
                                         ZeroLearner, make_learner)
from retailcast.operators.joins import join_dimension, materialize
from retailcast.operators.ols import fit_ols, predict_ols
from retailcast.plans import features as ft
from retailcast.plans.entry import prepare_from_files
from retailcast.plans.oracle import cte, with_ctes
from retailcast.plans.queries import _FT_COLS, _ROUND4, _feature_select, _feature_table, _r, _r46, _upanel, _written_panel, query, rnd
from retailcast.sources import io
from retailcast.sources import schemas as sc
from retailcast.sources import standins as si
from retailcast.sources.schemas import SERIES

SPLITS = 4

# ------------------------------------------------------------------ oracle CTEs
cte("xrows", "SELECT * FROM features WHERE NOT is_test", ("features",))
cte("xblocks", f"""
SELECT date, pos, CASE WHEN pos < n - {SPLITS} * (n // {SPLITS + 1}) THEN 0
       ELSE CAST(floor((pos - (n - {SPLITS} * (n // {SPLITS + 1}))) / (n // {SPLITS + 1}))
                 AS INTEGER) + 1 END AS block
FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n
      FROM (SELECT DISTINCT date FROM xrows) d) x""", ("xrows",))
cte("naive", """
SELECT id, date, store_nbr, family, sales, is_test,
       coalesce(last_value(sales IGNORE NULLS) OVER earlier, 0) AS lag_1,
       coalesce(avg(sales) OVER (PARTITION BY store_nbr, family ORDER BY date
                                 ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
                last_value(sales IGNORE NULLS) OVER earlier, 0) AS mean_7,
       coalesce(lag(sales, 1) OVER (PARTITION BY store_nbr, family, dayofyear(date)
                                    ORDER BY date), 0) AS year_lag
FROM upanel WINDOW earlier AS (PARTITION BY store_nbr, family ORDER BY date
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", ("upanel",))
cte("naive_long", """
SELECT id, date, sales, is_test, 'lag_1' AS model, lag_1 AS pred FROM naive
UNION ALL SELECT id, date, sales, is_test, 'mean_7', mean_7 FROM naive
UNION ALL SELECT id, date, sales, is_test, 'year_lag', year_lag FROM naive""", ("naive",))
cte("naive_scored", """
SELECT n.*, b.block FROM naive_long n JOIN xblocks b ON n.date = b.date WHERE NOT n.is_test""",
    ("naive_long", "xblocks"))
cte("naive_cv", """
SELECT model, sqrt(avg(msle)) AS cv FROM (
  SELECT model, block, avg(pow(ln(1 + sales) - ln(1 + pred), 2)) AS msle
  FROM naive_scored WHERE block > 0 GROUP BY 1, 2) f GROUP BY model""", ("naive_scored",))
cte("trials", """
SELECT search, trial_id, target,
       {'gamma': 1 + 9 * k / 100, 'learning_rate': 1 / (1 + CAST(user_id AS DOUBLE)),
        'max_depth': 3 + 9 * k / 100, 'n_estimators': 10 * k,
        'subsample': value / (value + 1)} AS params,
       secs - min(secs) OVER (PARTITION BY search) AS elapsed, value / 10 AS delta
FROM (SELECT event_type AS search, event_id AS trial_id, -value / 100 AS target,
             CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, user_id, value,
             epoch_us(ts) / 1e6 AS secs FROM events) e""")
cte("best_trials", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY target DESC,
                                             elapsed ASC) AS rn,
                      count(*) OVER (PARTITION BY search) AS n_trials,
                      max(elapsed) OVER (PARTITION BY search) AS wall_time,
                      avg(delta) OVER (PARTITION BY search) AS mean_delta
               FROM trials) t WHERE rn = 1""", ("trials",))


def _x(spark, sf_dir) -> DataFrame:
    return _feature_table(spark, sf_dir).filter(~F.col("is_test"))


def _features_materialized(spark, sf_dir, features: list[str] | None = None) -> DataFrame:
    """The feature table with its target (X and y in one table), computed once and written
    to the shared folder for the model passes; of the features, those named (default: all)."""
    table = _feature_table(spark, sf_dir, with_target=True)
    if features is not None:
        table = table.select("date", *ft.KEY_COLUMNS, *(c for c in features if c not in ft.KEY_COLUMNS), "is_test", "sales")
    return materialize(table, "features")


# ------------------------------------------------------------------ sources and sinks
@query("q_csv_roundtrip", with_ctes(
    "SELECT date, store_nbr, family, " + rnd("sales", 4) + " AS sales FROM train", "train"))
def q_csv_roundtrip(spark, sf_dir):
    """Train rows written to CSV in the shared folder and read back with an explicit schema."""
    path = io.scratch_path(spark, "csv")
    io.write_csv(si.train_frame(spark, sf_dir).select("date", "store_nbr", "family", "sales"),
                 path)
    schema = T.StructType([sc.TRAIN[c] for c in ("date", "store_nbr", "family", "sales")])
    back = io.read_csv(spark, path, schema)
    return back.select("date", "store_nbr", "family", _r("sales", 4))


@query("q_parquet_roundtrip", with_ctes(
    "SELECT id, date, store_nbr, family, " + rnd("sales", 4) + " AS sales, onpromotion, is_test "
    "FROM upanel", "upanel"))
def q_parquet_roundtrip(spark, sf_dir):
    """The union panel persisted as parquet (partitioned by is_test) and read back."""
    path = io.scratch_path(spark, "parquet")
    panel = _upanel(spark, sf_dir)
    io.write_parquet(panel, path, partition_by=("is_test",))
    back = io.read_parquet(spark, path, panel.schema)
    return back.select("id", "date", "store_nbr", "family", _r("sales", 4), "onpromotion",
                       "is_test")


# ------------------------------------------------------------------ reshape
FAMILIES_SQL = ("A", "N", "R")  # l_returnflag domain of the driver tables


@query("q_pivot_series", with_ctes(
    "SELECT date, store_nbr, "
    + ", ".join(f"{rnd(f'SUM(CASE WHEN family = {chr(39)}{v}{chr(39)} THEN sales END)', 4)} AS {v}"
                for v in FAMILIES_SQL)
    + " FROM train GROUP BY date, store_nbr", "train"))
def q_pivot_series(spark, sf_dir):
    """(date, store_nbr) x family sales matrix; the family levels are read from the data."""
    panel = _written_panel(spark, sf_dir).filter(~F.col("is_test"))
    wide = pn.pivot_series(panel)
    return wide.select("date", "store_nbr", *[_r(v, 4) for v in wide.columns[2:]])


@query("q_unpivot_series", with_ctes(
    "SELECT date, store_nbr, family, " + rnd("sales", 4) + " AS sales FROM train", "train"))
def q_unpivot_series(spark, sf_dir):
    """The pivoted matrix back in long form."""
    panel = _written_panel(spark, sf_dir).filter(~F.col("is_test"))
    return pn.unpivot_series(pn.pivot_series(panel)).select("date", "store_nbr", "family", _r("sales", 4))


# ------------------------------------------------------------------ encoders
_CATS = list(sc.CATEGORY_COLUMNS)


@query("q_category_codes", with_ctes(
    "SELECT col AS \"column\", value, CAST(dense_rank() OVER (PARTITION BY col ORDER BY CASE WHEN col = 'store_nbr' THEN lpad(value, 20, '0') ELSE value END) - 1 "
    "AS INTEGER) AS code FROM (SELECT DISTINCT col, value FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM xrows"
                         for c in _CATS)
    + ") u WHERE value IS NOT NULL) d", "xrows"))
def q_category_codes(spark, sf_dir):
    """Dictionary of the categorical feature columns fitted on the training rows."""
    return category_dictionary(_x(spark, sf_dir), _CATS)


def _float_cols(df):
    return columns_of_type(df, FLOAT_TYPES)


_FLOATS = sorted(["Change_in_oil_prices", "dcoilwtico", "onpromotion", "promo_last_7_days",
                  "sales_one_year_lag", "total_other_city_promo", "total_other_promo_store"]
                 + [f"dcoilwtico_lag_{k}" for k in range(1, 8)]
                 + [f"onpromotion_lag_{k}" for k in range(1, 8)])


def _scaled_sql(c):
    expr = (f"({c} - avg({c}) OVER ()) / CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) = 0 "
            f"THEN 1 ELSE stddev_pop({c}) OVER () END")
    return f"{rnd(expr, 6)} AS {c}"


@query("q_scale_by_dtype", with_ctes(
    "SELECT id, " + ", ".join(_scaled_sql(c) for c in _FLOATS) + " FROM xrows", "xrows"))
def q_scale_by_dtype(spark, sf_dir):
    """Float-typed columns picked by dtype, centred and divided by the population std."""
    x = _x(spark, sf_dir)
    floats = _float_cols(x)
    scaled = PopulationScaler(floats).fit(x).transform(x)
    return scaled.select("id", *[_r(c, 6) for c in floats])


@query("q_onehot", with_ctes(
    "SELECT id, 'oh_type_' || type || ',oh_family_' || family AS hot FROM features", "features"))
def q_onehot(spark, sf_dir):
    """One 0/1 column per level of store type and family, fitted on the rows; the names of each row's ones."""
    allx = materialize(_feature_table(spark, sf_dir).select("id", "type", "family"), "levels")
    model = OneHot(["type", "family"], prefix="oh_").fit(allx)
    names = F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in model.output_columns()])
    return model.transform(allx, drop=False).select("id", F.array_join(names, ",").alias("hot"))


_X2_REST = ["day", "dayofyear", "month", "year"]


@query("q_prepare", with_ctes(
    "SELECT id, " + ", ".join(_scaled_sql(c) for c in _FLOATS) + ", " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c if c == 'store_nbr' else f'CAST({c} AS VARCHAR)'}) - 1 END AS {c}"
        for c in _CATS) + ", " + ", ".join(_X2_REST) + " FROM xrows", "xrows"))
def q_prepare(spark, sf_dir):
    """X_2 of the boosted hybrid by the fitted preparation step: every feature but the date and the
    linear columns; floats scaled, the ten categories coded."""
    x = materialize(_x(spark, sf_dir), "x")
    prepared = DataPreparation("nominal").fit(x)
    return prepared.columns(x).select("id", *[_r(c, 6) if c in prepared.floats else c for c in sorted(prepared.names)])


_DP_COLS = ["const", "trend", "trend_2", "sin_1", "cos_1", "sin_2", "cos_2"]


def _dp_sql(src: str, offset: str) -> str:
    f = ", ".join(
        f"{rnd(f'{fn}({2 * 3.141592653589793 * k!r} * ((isodow(date) - 1) / 7.0))', 6)} "
        f"AS {fn}_{k}" for k in (1, 2) for fn in ("sin", "cos"))
    return (f"SELECT date, 1.0 AS const, CAST(pos + {offset} AS DOUBLE) AS trend, "
            f"pow(CAST(pos + {offset} AS DOUBLE), 2.0) AS trend_2, {f} "
            f"FROM (SELECT date, row_number() OVER (ORDER BY date) AS pos "
            f"FROM (SELECT DISTINCT date FROM {src}) d) x")


@query("q_det_process", with_ctes(
    _dp_sql("train", "0") + " UNION ALL " + _dp_sql("test", "(SELECT count(DISTINCT date) "
                                                            "FROM train)"),
    "train", "test"))
def q_det_process(spark, sf_dir):
    """Constant, trend, trend^2 and weekly Fourier terms; the trend continues on test dates."""
    train, test = si.train_frame(spark, sf_dir), si.test_frame(spark, sf_dir)
    model = DeterministicProcess(order=2, constant=True, fourier=[["W", 2]]).fit(train)
    both = model.in_sample(train).unionByName(model.out_of_sample(test))
    ren = {f"{fn}({k},freq=W)": f"{fn}_{k}" for k in (1, 2) for fn in ("sin", "cos")}
    both = both.withColumnsRenamed(ren)
    return both.select("date", "const", "trend", "trend_2",
                       *[_r(c, 6) for c in ("sin_1", "cos_1", "sin_2", "cos_2")])


# ------------------------------------------------------------------ validation
@query("q_ts_folds", with_ctes(f"""
SELECT fold, role, min(date) AS min_date, max(date) AS max_date, count(*) AS n_dates FROM (
  SELECT f.fold, CASE WHEN b.block < f.fold THEN 'train' ELSE 'valid' END AS role, b.date
  FROM xblocks b JOIN (SELECT unnest(range(1, {SPLITS + 1})) AS fold) f ON b.block <= f.fold) x
GROUP BY fold, role""", "xblocks"))
def q_ts_folds(spark, sf_dir):
    """Expanding-window folds over the distinct training dates: span and size per role."""
    blocks = ev.date_blocks(_x(spark, sf_dir), SPLITS)
    folds = ev.fold_table(blocks, SPLITS)
    return folds.groupBy("fold", "role").agg(F.min("date").alias("min_date"),
                                             F.max("date").alias("max_date"),
                                             F.count(F.lit(1)).alias("n_dates"))


cte("year_lag_fold_msle", """
SELECT b.block AS fold,
       avg(pow(ln(1 + t.sales) - ln(1 + greatest(x.sales_one_year_lag, 0)), 2)) AS msle
FROM xrows x JOIN train t USING (id) JOIN xblocks b ON x.date = b.date
WHERE b.block > 0 GROUP BY b.block""", ("xrows", "train", "xblocks"))


@query("q_rmsle", with_ctes(
    f"SELECT fold, {rnd('sqrt(msle)', 6)} AS rmsle FROM year_lag_fold_msle "
    f"UNION ALL SELECT 0, {rnd('sqrt(avg(msle))', 6)} FROM year_lag_fold_msle",
    "year_lag_fold_msle"))
def q_rmsle(spark, sf_dir):
    """RMSLE of the previous-year value as the forecast: per fold, and overall as fold 0."""
    x = _feature_table(spark, sf_dir, with_target=True).filter(~F.col("is_test"))
    scored = ev.assign_blocks(x.select("id", "date", "sales", "sales_one_year_lag"),
                              SPLITS).withColumn(
        "pred", clip_lower(F.col("sales_one_year_lag")))
    rep = ev.rmsle_report(ev.fold_msle(scored))
    return rep.select(F.col("fold").cast("int").alias("fold"), _r("rmsle", 6))


NAIVE = ["lag_1", "mean_7", "year_lag"]


def naive_predictions(panel: DataFrame) -> DataFrame:
    """Last known sales, mean of the previous 7 rows (or the last known) and previous-year value for
    train and test rows of a panel; 0 where there is none. Windows of one series each."""
    w = pn.series_window()
    known = F.last("sales", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = pn.year_lag(pn.partition_by_series(panel), "sales").withColumns({
        "lag_1": F.coalesce(known, F.lit(0.0)),
        "mean_7": F.coalesce(F.avg("sales").over(w.rowsBetween(-7, -1)), known, F.lit(0.0)),
    }).withColumnRenamed("sales_one_year_lag", "year_lag")
    return p.filter(F.col("date") >= F.lit(ft.FEATURE_START).cast("date"))


def _naive(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(long forecasts of all rows, those of training rows with their block)."""
    panel = _written_panel(spark, sf_dir)
    wide = naive_predictions(panel).select("id", "date", "sales", "is_test", *NAIVE)
    longp = materialize(en.long_predictions(wide, ["id", "date", "sales", "is_test"], NAIVE), "naive")
    blocks = ev.date_blocks(panel.filter(~F.col("is_test") & (F.col("date") >= F.lit(ft.FEATURE_START).cast("date"))), SPLITS).drop("pos")
    scored = join_dimension(longp.filter(~F.col("is_test")), blocks, "date", "inner")
    return longp, scored


def _naive_cv(scored):
    ev.require_scored(scored)
    fm = ev.fold_msle(scored, "sales", "pred", by=("model",))
    return fm.groupBy("model").agg(F.sqrt(F.avg("msle")).alias("cv"))


@query("q_cv_scores", with_ctes(
    f"SELECT model, {rnd('cv', 6)} AS cv FROM naive_cv", "naive_cv"))
def q_cv_scores(spark, sf_dir):
    """Time-series CV score (sqrt of mean fold MSLE) of three naive forecasters."""
    return _naive_cv(_naive(spark, sf_dir)[1]).select("model", _r("cv", 6))


_BLEND_SQL = with_ctes(
    f"SELECT id, {rnd('sum(pred / cv) / sum(1 / cv)', 4)} AS sales FROM naive_long "
    "JOIN naive_cv USING (model) WHERE is_test GROUP BY id", "naive_long", "naive_cv")


@query("q_ensemble", _BLEND_SQL)
def q_ensemble(spark, sf_dir):
    """Test-row forecasts of the naive forecasters, blended by 1 / RMSLE of the training folds."""
    longp, scored = _naive(spark, sf_dir)
    blended = en.blend(longp.filter("is_test").select("id", "model", "pred"), _naive_cv(scored))
    return blended.select("id", _r("sales", 4))


@query("q_perm_importance", with_ctes(
    "SELECT 'mean_7' AS feature, count(*) > 1 AS matters FROM naive UNION ALL SELECT 'year_lag', false", "naive"))
def q_perm_importance(spark, sf_dir):
    """Permutation importance of two columns for a forecaster that uses one of them (mean_7): the error
    changes for that one alone."""
    wide = naive_predictions(_written_panel(spark, sf_dir)).filter(~F.col("is_test"))
    wide = materialize(wide.select("id", "sales", "mean_7", "year_lag"), "importance")
    rise = en.permutation_importance(wide, ["mean_7", "year_lag"],
                                     lambda df: df.select("id", F.col("mean_7").alias("pred")))
    return rise.select("feature", (F.abs("rise") > 1e-9).alias("matters"))


# ------------------------------------------------------------------ searches
def _trials_roundtrip(spark, sf_dir) -> DataFrame:
    """Write the trial log as JSON lines (one folder per search) and read it back."""
    path = io.scratch_path(spark, "trials")
    log = si.trial_log(spark, sf_dir)
    log.select("search", "trial_id", "target", "params", "datetime").write.mode("append") \
        .partitionBy("search").json(path)
    schema = T.StructType(sc.TRIAL_LOG.fields + [T.StructField("trial_id", T.LongType()),
                                                  T.StructField("search", T.StringType())])
    return spark.read.schema(schema).json(path)


@query("q_trials", with_ctes(
    "SELECT search, CAST(n_trials AS BIGINT) AS n_trials, "
    f"{rnd('target', 6)} AS best_target, {rnd('params.gamma', 6)} AS gamma, "
    f"{rnd('params.learning_rate', 6)} AS learning_rate, "
    "CAST(floor(params.max_depth) AS INTEGER) AS max_depth, "
    "CAST(floor(params.n_estimators) AS INTEGER) AS n_estimators, "
    f"{rnd('params.subsample', 6)} AS subsample, {rnd('wall_time', 6)} AS wall_time, "
    f"{rnd('mean_delta', 6)} AS mean_delta FROM best_trials", "best_trials"))
def q_trials(spark, sf_dir):
    """Best trial per search from the JSON-lines trial log, with int-truncated tree params."""
    best = sr.best_trials(_trials_roundtrip(spark, sf_dir))
    b = best.select("search", "n_trials", "best_target", "wall_time", "mean_delta",
                    "best_params.*")
    return b.select("search", "n_trials", _r("best_target", 6), _r("gamma", 6),
                    _r("learning_rate", 6),
                    sr.truncate_int(F.col("max_depth")).alias("max_depth"),
                    sr.truncate_int(F.col("n_estimators")).alias("n_estimators"),
                    _r("subsample", 6), _r("wall_time", 6), _r("mean_delta", 6))


def _mask_value(trial: F.Column, j: int) -> F.Column:
    """Stand-in mask value of feature j for a trial (integer hash, exact in SQL too)."""
    return ((trial * F.lit(2654435761) + F.lit((j + 1) * 40503)) % 1000) / 1000.0


_MASK_FEATURES = list(ft.FEATURES)


@query("q_feature_mask", with_ctes(
    "SELECT search, feature, CASE WHEN feature IN ('time_since_quake', 'time_since_quake_sq') "
    "THEN 'linear' ELSE 'nonlinear' END AS role FROM ("
    "SELECT search, trial_id, j, feats[j + 1] AS feature FROM best_trials, "
    "(SELECT unnest(range(" + str(len(_MASK_FEATURES)) + ")) AS j) r, "
    "(SELECT [" + ", ".join(f"'{f}'" for f in _MASK_FEATURES) + "] AS feats) f) m "
    "WHERE ((trial_id * 2654435761 + (j + 1) * 40503) % 1000) / 1000.0 > 0.5",
    "best_trials"))
def q_feature_mask(spark, sf_dir):
    """Report over logged trials: the columns that each search's best trial's mask (a stand-in, made from
    the trial id) keeps. The search itself is q_mask_search."""
    log = si.trial_log(spark, sf_dir)
    masks = log.withColumn("mask", F.array(*[_mask_value(F.col("trial_id"), j)
                                             for j in range(len(_MASK_FEATURES))]))
    order = F.struct(F.col("target"), (-F.col("datetime.elapsed")).alias("e"))
    best = masks.groupBy("search").agg(F.max_by("mask", order).alias("mask"))
    linear = [c for c in LINEAR_COLUMNS if c in _MASK_FEATURES]
    return sr.kept_columns(best, _MASK_FEATURES, linear)


# ------------------------------------------------------------------ linear models
@query("q_trend_slope", with_ctes("""
SELECT store_nbr, family,
       CASE WHEN count(*) >= 2 THEN """ + rnd("regr_slope(sales, pos)", 4) + """ END AS slope,
       CASE WHEN count(*) >= 2 THEN """ + rnd("regr_intercept(sales, pos)", 2) + """ END
           AS intercept
FROM train JOIN (SELECT date, row_number() OVER (ORDER BY date) AS pos
                 FROM (SELECT DISTINCT date FROM train) d) p USING (date)
GROUP BY store_nbr, family""", "train"))
def q_trend_slope(spark, sf_dir):
    """Per-series OLS of sales on [1, trend] (trend = date position, scaled for the solve)."""
    train = si.train_frame(spark, sf_dir)
    dp = DeterministicProcess(order=1, constant=True, fourier=[]).fit(train)
    terms = dp.in_sample(train).withColumn("t", F.col("trend") / F.lit(float(dp.n_dates)))
    rows = join_dimension(train, terms.select("date", "const", "t"), "date", "inner")
    coefs = fit_ols(rows, "sales", ["const", "t"])
    ok = F.col("rank") >= 2
    slope = F.when(ok, F.col("coef")[1] / F.lit(float(dp.n_dates)))
    inter = F.when(ok, F.col("coef")[0])
    return coefs.select("store_nbr", "family", slope.alias("slope"), inter.alias("intercept")) \
        .select("store_nbr", "family", _r("slope", 4), _r("intercept", 2))


@query("q_ols_series", with_ctes(
    "SELECT store_nbr, family, count(*) AS n, 0.0 AS largest FROM xrows x JOIN train t USING (id, store_nbr, family) "
    "GROUP BY store_nbr, family", "xrows", "train"))
def q_ols_series(spark, sf_dir):
    """Stage 1 on constant, trend, weekly Fourier and quake terms: rows of each series, and the largest
    product of its residuals and a regressor over both lengths, 0 for a least-squares fit."""
    x = _features_materialized(spark, sf_dir, LINEAR_COLUMNS).filter(~F.col("is_test"))
    hf = HybridForecaster(learner=None)
    dp = DeterministicProcess(1, True, hf.fourier).fit(x)
    terms = dp.in_sample(x).withColumn("trend", F.col("trend") / F.lit(float(dp.n_dates)))
    lin = pn.dedup_last(x.select("date", "store_nbr", "family", *LINEAR_COLUMNS), "date") \
        .drop("store_nbr", "family")
    names = dp.term_columns() + LINEAR_COLUMNS
    cols = [f"_t{i}" for i in range(len(names))]
    design = terms.join(lin, "date").select("date", *[F.col(f"`{n}`").cast("double").alias(c) for n, c in zip(names, cols)])
    rows = join_dimension(x.select("date", "store_nbr", "family", "sales"), design, "date", "inner")
    fitted = predict_ols(rows, fit_ols(rows, "sales", cols), cols).withColumn("r", F.col("sales") - F.col("fit"))
    products = [F.abs(F.sum(F.col("r") * F.col(c))) / F.sqrt(F.sum(F.col(c) * F.col(c)) * F.sum(F.col("sales") * F.col("sales"))) for c in cols]
    out = fitted.groupBy("store_nbr", "family").agg(
        F.count(F.lit(1)).alias("n"), F.greatest(*[F.coalesce(F.when(F.sum(F.abs(c)) > 0, p), F.lit(0.0)) for p, c in zip(products, cols)]).alias("largest"))
    return out.select("store_nbr", "family", "n", _r("largest", 6))


# ------------------------------------------------------------------ kNN
_KNN_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS DOUBLE) AS label
           FROM embeddings),
d AS (SELECT a.vec_id AS qid, b.vec_id AS pid, b.label,
             sqrt(list_reduce(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])),
                              lambda s, y: s + y)) AS dist
      FROM v a JOIN v b ON a.vec_id <> b.vec_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) AS rk
                     FROM d) x WHERE rk <= 5)
SELECT qid AS vec_id, """ + rnd("avg(label)", 6) + """ AS pred_uniform,
       """ + rnd("CASE WHEN max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) = 1 "
                 "THEN avg(CASE WHEN dist = 0 THEN label END) "
                 "ELSE sum(label / dist) / sum(1 / dist) END", 6) + """ AS pred_distance,
       count(*) AS n_neighbors
FROM t GROUP BY qid"""


@query("q_knn_regress", _KNN_SQL)
def q_knn_regress(spark, sf_dir):
    """Leave-one-out 5-NN regression of the embedding label (uniform and 1/d weights)."""
    pts = si.vectors(spark, sf_dir)
    top = knn.knn_neighbors(pts, None, k=5, metric="euclidean")
    out = top.groupBy("qid").agg(knn.knn_prediction("uniform").alias("pred_uniform"),
                                 knn.knn_prediction("distance").alias("pred_distance"),
                                 F.count(F.lit(1)).alias("n_neighbors"))
    return out.select(F.col("qid").alias("vec_id"), _r("pred_uniform", 6),
                      _r("pred_distance", 6), "n_neighbors")


# ------------------------------------------------------------------ hybrid models
_TEST_KEYS = with_ctes("SELECT id, true AS forecast, true AS not_negative FROM features WHERE is_test", "features")


def _xy_test(spark, sf_dir, features: list[str] | None = None):
    allx = _features_materialized(spark, sf_dir, features)
    return allx.filter(~F.col("is_test")).drop("is_test"), allx.filter(F.col("is_test")).drop("is_test", "sales")


def _hybrid(spark, sf_dir, boosted: bool, learner, features: list[str] | None = None, **options):
    x, test = _xy_test(spark, sf_dir, features)
    return HybridForecaster(learner=learner, boosted=boosted, unseen="pooled", **options).fit(x).predict(test)


def _checked(pred: DataFrame) -> DataFrame:
    """A row for each forecast: it is there, and it isn't negative."""
    there = F.col("pred").isNotNull() & ~F.isnan("pred")
    return pred.select("id", there.alias("forecast"), (F.col("pred") >= 0).alias("not_negative"))


@query("q_hybrid_boosted", _TEST_KEYS)
def q_hybrid_boosted(spark, sf_dir):
    """Per-series OLS trend + GBT on the residuals: a forecast for every test row."""
    return _checked(_hybrid(spark, sf_dir, True, make_learner("gbt", maxIter=20, maxDepth=5)))


@query("q_hybrid_stacked", _TEST_KEYS)
def q_hybrid_stacked(spark, sf_dir):
    """Per-series OLS trend as an extra feature of a GBT on sales: a forecast for every test row."""
    return _checked(_hybrid(spark, sf_dir, False, make_learner("gbt", maxIter=20, maxDepth=5)))


@query("q_rf_hybrid", _TEST_KEYS)
def q_rf_hybrid(spark, sf_dir):
    """Per-series OLS trend + random forest on the one-hot features: a forecast for every test row."""
    return _checked(_hybrid(spark, sf_dir, True, make_learner("rf", numTrees=20, maxDepth=8)))


@query("q_knn_hybrid", _TEST_KEYS)
def q_knn_hybrid(spark, sf_dir):
    """Per-series OLS trend + exact 5-nearest-neighbour regression of the residuals on the scaled,
    one-hot features: a forecast for every test row."""
    return _checked(_hybrid(spark, sf_dir, True, KnnLearner(k=5, weights="uniform", metric="euclidean")))


# The linear trend of each series over training positions p = 1..n; one observation gives the
# least-norm line through it, none the line of all series together.
cte("xpos", "SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM xrows) d", ("xrows",))
cte("ytrain", "SELECT t.id, t.date, t.store_nbr, t.family, t.sales, x.p FROM train t JOIN xpos x ON t.date = x.date "
              "WHERE t.id IN (SELECT id FROM xrows)", ("train", "xpos", "xrows"))


def _fit_sql(n: str, at: str) -> str:
    """Fit of a row at position ``at`` (training rows with n dates), whose sums are joined as s and a."""
    return (f"CASE WHEN s.k >= 2 THEN s.b + s.m * {at} "
            f"WHEN s.k = 1 THEN s.y * (1 + ({at} / {n}) * (s.q / {n})) / (1 + pow(s.q / {n}, 2)) ELSE a.b + a.m * {at} END")


def _trend_sql(rows: str, n: str, at: str) -> str:
    """Forecast of a row at position ``at`` from the training rows ``rows``."""
    return f"greatest(0, {_fit_sql(n, at)})"


_SUMS = ("count(*) AS k, regr_slope(sales, p) AS m, regr_intercept(sales, p) AS b, max(sales) AS y, "
         "CAST(max(p) AS DOUBLE) AS q")


@query("q_hybrid_linear", with_ctes(
    "SELECT f.id, " + rnd(_trend_sql("ytrain", "n.n", "(n.n + tp.p)"), 2) + " AS pred FROM features f "
    "JOIN (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM features WHERE is_test) d) tp "
    "ON f.date = tp.date CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM xpos) n "
    f"LEFT JOIN (SELECT store_nbr, family, {_SUMS} FROM ytrain GROUP BY 1, 2) s "
    "ON f.store_nbr = s.store_nbr AND f.family = s.family "
    f"CROSS JOIN (SELECT {_SUMS} FROM ytrain) a WHERE f.is_test", "features", "xpos", "ytrain"))
def q_hybrid_linear(spark, sf_dir):
    """The hybrid with a zero second stage and no other terms than the trend: test-row forecasts."""
    pred = _hybrid(spark, sf_dir, True, ZeroLearner(), features=[], fourier=[], linear_cols=[])  # it reads none
    return pred.select("id", _r("pred", 2))


cte("fold_rows", f"SELECT y.*, b.block, f.fold FROM ytrain y JOIN xblocks b ON y.date = b.date "
                 f"CROSS JOIN (SELECT unnest(range(1, {SPLITS + 1})) AS fold) f", ("ytrain", "xblocks"))
cte("fold_fits", f"SELECT fold, store_nbr, family, {_SUMS} FROM fold_rows WHERE block < fold GROUP BY 1, 2, 3", ("fold_rows",))
cte("fold_all", f"SELECT fold, {_SUMS}, CAST(max(p) AS DOUBLE) AS n FROM fold_rows WHERE block < fold GROUP BY 1", ("fold_rows",))
_FOLD_ROW = ("fold_rows r JOIN fold_all a ON r.fold = a.fold LEFT JOIN fold_fits s ON r.fold = s.fold "
             "AND r.store_nbr = s.store_nbr AND r.family = s.family")
cte("fold_scores", "SELECT r.fold, avg(pow(ln(1 + r.sales) - ln(1 + pred), 2)) FILTER (WHERE r.block = r.fold) AS valid, "
    "avg(pow(ln(1 + r.sales) - ln(1 + pred), 2)) FILTER (WHERE r.block < r.fold) AS train "
    "FROM (SELECT r.*, " + _trend_sql("fold_rows", "a.n", "r.p") + f" AS pred FROM {_FOLD_ROW}) r GROUP BY 1",
    ("fold_rows", "fold_all", "fold_fits"))


def _cv(spark, sf_dir, make):
    x, _ = _xy_test(spark, sf_dir)

    def fit_predict(tx, _, vx):
        return make().fit(tx).predict(vx).select("date", "store_nbr", "family", "pred")

    return ev.time_series_cv_folds(fit_predict, x, None, SPLITS)


def _fold_fits(x, fourier, linear_cols, subsets=None, keep=("date", "store_nbr", "family", "sales")):
    """Training rows with block and regressors, and the first stage's fits of all folds."""
    design = fo.fold_design(x, SPLITS, fourier, linear_cols)
    rows = join_dimension(x.select(*keep), design.dates, "date", "inner")
    return rows, fo.fit_folds(rows, "sales", design, subsets=subsets)


@query("q_cv_linear", with_ctes(
    f"SELECT CAST(fold AS INTEGER) AS fold, {rnd('sqrt(valid)', 5)} AS rmsle, {rnd('sqrt(train)', 5)} AS train_rmsle FROM fold_scores "
    f"UNION ALL SELECT 0, {rnd('sqrt(avg(valid))', 5)}, {rnd('sqrt(avg(train))', 5)} FROM fold_scores", "fold_scores"))
def q_cv_linear(spark, sf_dir):
    """4-fold expanding-window CV of the hybrid with a zero second stage, all folds fitted from one
    aggregation: RMSLE of the validation and of the training rows, and both overall as fold 0."""
    x, _ = _xy_test(spark, sf_dir, [])  # the trend needs no feature
    rows, fits = _fold_fits(x, [], [])
    folds = fo.fold_scores(fits.add_fits(rows), SPLITS)
    every = folds.agg(F.lit(0).alias("fold"), F.avg("msle").alias("msle"), F.avg("train_msle").alias("train_msle"))
    rows = folds.select("fold", "msle", "train_msle").unionByName(every)
    return rows.select("fold", F.sqrt("msle").alias("rmsle"), F.sqrt("train_msle").alias("train_rmsle")).select(
        "fold", _r("rmsle", 5), _r("train_rmsle", 5))


@query("q_cv_hybrid", with_ctes(
    "SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_rows, true AS scored FROM fold_rows WHERE block = fold GROUP BY 1", "fold_rows"))
def q_cv_hybrid(spark, sf_dir):
    """4-fold expanding-window CV of the hybrid OLS + random forest on the residuals, refitted per
    fold: rows that each fold scored (a row without forecast would raise), and a finite score."""
    folds = _cv(spark, sf_dir, lambda: HybridForecaster(make_learner("rf", numTrees=10, maxDepth=6), unseen="pooled"))
    return folds.select("fold", "n_rows", (F.col("msle") >= 0).alias("scored"))


# ------------------------------------------------------------------ sinks end to end
@query("q_submission", _BLEND_SQL)
def q_submission(spark, sf_dir):
    """Test-row predictions per model and CV scores written to their sinks, blended by 1 / RMSLE
    from what was written, and the submission CSV read back."""
    base = io.scratch_path(spark, "run")
    longp, scored = _naive(spark, sf_dir)
    for row in _naive_cv(scored).collect():  # one row per model
        io.append_score(spark, f"{base}/scores", row["model"], row["cv"])
    for m in NAIVE:
        io.write_predictions(longp.filter(F.col("is_test") & (F.col("model") == m)).select("id", "pred"), f"{base}/predictions", m)
    preds = io.read_parquet(spark, f"{base}/predictions")
    scores = io.read_scores(spark, f"{base}/scores").withColumnRenamed("Model", "model")
    io.write_submission(en.blend(preds, scores), f"{base}/submission")
    sub = spark.read.schema("id long, sales double").option("header", True) \
        .csv(f"{base}/submission")
    return sub.select("id", _r("sales", 4))


@query("q_feature_table_from_csv", with_ctes(f"SELECT {_feature_select(_FT_COLS)} FROM features", "features"))
def q_feature_table_from_csv(spark, sf_dir):
    """The file entry point: five CSV inputs checked and turned into X, X_test and y files; X and X_test read back."""
    base = io.scratch_path(spark, "entry")
    panel = _written_panel(spark, sf_dir)
    inputs = {"train": panel.filter(~F.col("is_test")).drop("is_test"), "test": panel.filter("is_test").drop("is_test", "sales"),
              "stores": si.stores(spark, sf_dir), "oil": si.oil(spark, sf_dir), "holidays_events": si.holidays_events(spark, sf_dir)}
    for name, df in inputs.items():
        io.write_csv(df, f"{base}/{name}.csv")
    out = prepare_from_files(spark, {name: f"{base}/{name}.csv" for name in inputs}, f"{base}/out")
    both = out["X"].withColumn("is_test", F.lit(False)).unionByName(out["X_test"].withColumn("is_test", F.lit(True)))
    return both.select(*[_r46(c) if c in _ROUND4 else F.col(c) for c in _FT_COLS])


# ------------------------------------------------------------------ searches with scoring
KNN_TRIALS, MASK_TRIALS, SEARCH_SEED = 4, 6, 1
_KNN_BOUNDS = {k: sr.KNN_BOUNDS[k] for k in ("n_neighbors", "weights", "metric")}
_MASK_BOUNDS = {m: (0.0, 1.0) for m in NAIVE}


def _knn_trial_sql(i: int, point: dict) -> str:
    o = sr.neighbor_params(point)
    dist = "abs_sum" if o["metric"] == "manhattan" else "root"
    label = ("avg(label)" if o["weights"] == "uniform" else
             "CASE WHEN max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) = 1 THEN avg(CASE WHEN dist = 0 THEN label END) "
             "ELSE sum(label / dist) / sum(1 / dist) END")
    return (f"SELECT {i} AS trial, sqrt(avg(pow(ln(1 + own) - ln(1 + pred), 2))) AS error FROM (SELECT qid, own, {label} AS pred "
            f"FROM (SELECT qid, own, label, {dist} AS dist, row_number() OVER (PARTITION BY qid ORDER BY {dist}, pid) AS rk FROM d) x "
            f"WHERE rk <= {o['k']} GROUP BY qid, own) y")


_POINTS = sr.random_points(_KNN_BOUNDS, KNN_TRIALS, SEARCH_SEED)


@query("q_param_search", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS DOUBLE) AS label FROM embeddings),
d AS (SELECT a.vec_id AS qid, a.label AS own, b.vec_id AS pid, b.label,
             sqrt(list_reduce(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda s, y: s + y)) AS root,
             list_reduce(list_transform(list_zip(a.e, b.e), lambda x: abs(x[1] - x[2])), lambda s, y: s + y) AS abs_sum
      FROM v a JOIN v b ON a.vec_id <> b.vec_id),
t AS (""" + " UNION ALL ".join(_knn_trial_sql(i, p) for i, p in enumerate(_POINTS)) + """)
SELECT CAST(trial AS BIGINT) AS trial, round(-error * 1000000.0) / 1000000.0 AS target,
       row_number() OVER (ORDER BY round(error * 1000000.0), trial) = 1 AS best FROM t""")
def q_param_search(spark, sf_dir):
    """Seeded random search over kNN options (k, weights, metric): each trial a leave-one-out kNN
    regression of the embedding labels scored by RMSLE, appended to a JSON-lines log; run twice on one
    log, the second time to resume."""
    pts = materialize(si.vectors(spark, sf_dir), "points")
    path = io.scratch_path(spark, "knn-trials")
    most = int(round(_KNN_BOUNDS["n_neighbors"][1]))
    found: dict[str, DataFrame] = {}  # the neighbours by metric, measured once for all trials

    def objective(point):
        o = sr.neighbor_params(point)
        metric = "euclidean" if o["metric"] == "minkowski" else o["metric"]
        if metric not in found:
            found[metric] = materialize(knn.knn_neighbors(pts, None, k=most, metric=metric), "neighbours")
        pred = knn.neighbors_regress(found[metric].filter(F.col("rk") <= o["k"]), o["weights"])
        scored = pts.select("vec_id", "label").join(pred, "vec_id", "left")
        ev.require_scored(scored, "label", "prediction")
        return scored.agg(F.sqrt(F.avg(msle_term(F.col("label"), F.col("prediction")))).alias("s")).first()["s"]

    sr.run_search(spark, objective, _KNN_BOUNDS, KNN_TRIALS // 2, path, SEARCH_SEED)
    return _ranked_log(sr.run_search(spark, objective, _KNN_BOUNDS, KNN_TRIALS, path, SEARCH_SEED))


def _ranked_log(log: DataFrame) -> DataFrame:
    log = log.select("trial", _r("target", 6))
    best = F.row_number().over(Window.orderBy(F.desc("target"), "trial")) == 1  # a row for each trial
    return log.withColumn("best", best)


def _mask_trial_sql(i: int, point: dict) -> str:
    kept = [m for m in NAIVE if point[m] > 0.5]
    pred = f"({' + '.join(kept)}) / {len(kept)}.0" if kept else "0.0"
    return (f"SELECT {i} AS trial, sqrt(avg(msle)) AS error FROM (SELECT b.block, avg(pow(ln(1 + n.sales) - ln(1 + {pred}), 2)) AS msle "
            "FROM naive n JOIN xblocks b ON n.date = b.date WHERE NOT n.is_test AND b.block > 0 GROUP BY 1) f")


_MASKS = sr.random_points(_MASK_BOUNDS, MASK_TRIALS, SEARCH_SEED)


@query("q_mask_search", with_ctes(
    "SELECT CAST(trial AS BIGINT) AS trial, " + rnd("-error", 6) + " AS target, "
    "row_number() OVER (ORDER BY round(error * 1000000.0), trial) = 1 AS best FROM ("
    + " UNION ALL ".join(_mask_trial_sql(i, p) for i, p in enumerate(_MASKS)) + ") t", "naive", "xblocks"))
def q_mask_search(spark, sf_dir):
    """Seeded feature-subset search: each trial keeps the columns whose mask value is over 0.5 and is
    scored by the cross-validated RMSLE of a linear forecaster on them (their mean)."""
    panel = _written_panel(spark, sf_dir)
    wide = naive_predictions(panel).filter(~F.col("is_test"))
    blocks = ev.date_blocks(wide, SPLITS).drop("pos")
    wide = materialize(join_dimension(wide.select("id", "date", "store_nbr", "family", "sales", *NAIVE), blocks, "date", "inner"), "masked")

    def objective(point):
        kept = sr.apply_mask(wide, NAIVE, [point[m] for m in NAIVE], keep=("block", "sales"))
        used = [c for c in kept.columns if c in NAIVE]
        scored = kept.withColumn("pred", pn.row_sum(used) / len(used) if used else F.lit(0.0))
        ev.require_scored(scored)
        return ev.fold_msle(scored).agg(F.sqrt(F.avg("msle")).alias("s")).first()["s"]

    path = io.scratch_path(spark, "mask-trials")
    return _ranked_log(sr.run_search(spark, objective, _MASK_BOUNDS, MASK_TRIALS, path, SEARCH_SEED))


# ------------------------------------------------------------------ feature subsets of the linear hybrid
SUBSET_TRIALS = 100  # the reference's budget: 30 first points and 70 more
_NUMBERS = [c for c in ft.FEATURES if c in _FLOATS or c in ("day", "dayofyear", "month", "year")]
cte("fold_residuals", f"SELECT r.id, r.fold, r.block, r.sales, {_fit_sql('a.n', 'r.p')} AS fit FROM {_FOLD_ROW}", ("fold_rows", "fold_all", "fold_fits"))
cte("single_features", " UNION ALL ".join(
    f"SELECT id, '{c}' AS feature, CAST(coalesce({c}, avg({c}) OVER ()) AS DOUBLE) AS v FROM xrows" for c in _NUMBERS), ("xrows",))
cte("single_fits", "SELECT feature, fold, regr_slope(sales - fit, v) AS m, regr_intercept(sales - fit, v) AS b "
    "FROM fold_residuals JOIN single_features USING (id) WHERE block < fold GROUP BY 1, 2", ("fold_residuals", "single_features"))
cte("mean_fits", "SELECT fold, avg(sales - fit) AS b FROM fold_residuals WHERE block < fold GROUP BY 1", ("fold_residuals",))


def _subsets(spark, sf_dir, masks: list[dict], fourier: list, linear: list[str]):
    """(trial, fold, msle, n_rows) of the hybrid with a linear second stage under each mask."""
    x, _ = _xy_test(spark, sf_dir)
    trials, variants = ss.mask_trials(spark, masks, linear)
    design = fo.fold_design(x, SPLITS, fourier, linear)
    rows = join_dimension(x.select("date", *SERIES, "sales"), design.dates, "date", "inner")
    always = [n for n in design.names if n not in linear]
    fits = fo.fit_folds(rows, "sales", design, subsets=[always + v for v in variants])
    features = [f for f in ft.FEATURES if f not in LINEAR_COLUMNS]
    subsets = ss.prepare_subsets(x, features, SPLITS, add=lambda coded: fits.add_fits(coded, dates=design.dates), keep=("date", *SERIES))
    return subsets.search(trials, {v: v * SPLITS for v in range(len(variants))})


@query("q_subset_scores", with_ctes(
    "SELECT feature, " + rnd("sqrt(avg(msle))", 5) + " AS rmsle FROM ("
    "SELECT feature, fold, avg(pow(ln(1 + sales) - ln(1 + greatest(0, fit + b + m * v)), 2)) AS msle FROM fold_residuals "
    "JOIN single_features USING (id) JOIN single_fits USING (feature, fold) WHERE block = fold GROUP BY 1, 2 "
    "UNION ALL SELECT '', fold, avg(pow(ln(1 + sales) - ln(1 + greatest(0, fit + b)), 2)) FROM fold_residuals JOIN mean_fits USING (fold) "
    "WHERE block = fold GROUP BY 2) s GROUP BY feature", "fold_residuals", "single_features", "single_fits", "mean_fits"))
def q_subset_scores(spark, sf_dir):
    """Cross-validated RMSLE of the hybrid (trend of each series, linear second stage on its residuals)
    with no feature and with each numeric one alone: all subsets from one sum of cross-products."""
    names = ["", *_NUMBERS]
    scored = _subsets(spark, sf_dir, [{n: 1.0} if n else {} for n in names], [], [])
    scores = ss.trial_scores(scored)
    named = spark.createDataFrame(list(enumerate(names)), "trial long, feature string")
    return scores.join(named, "trial").select("feature", (-F.col("target")).alias("rmsle")).select("feature", _r("rmsle", 5))


@query("q_subset_search")
def q_subset_search(spark, sf_dir):
    """Seeded feature-subset search over the 35 features, 100 trials: the first stage on trend, Fourier and
    the kept quake terms, the second one linear on the other kept features; target and rank of each."""
    masks = sr.random_points({f: (0.0, 1.0) for f in ft.FEATURES}, SUBSET_TRIALS, SEARCH_SEED)
    scores = ss.trial_scores(_subsets(spark, sf_dir, masks, [["W", 2]], LINEAR_COLUMNS))
    kept = spark.createDataFrame([(i, sum(v > 0.5 for v in m.values())) for i, m in enumerate(masks)], "trial long, n_kept int")
    rank = F.row_number().over(Window.orderBy(F.desc("target"), "trial"))  # a row for each trial
    return scores.join(kept, "trial").withColumn("rank", rank).select("trial", "n_kept", _r("target", 5), "rank")


# ------------------------------------------------------------------ histogram boosting, searched hybrids
_TREE_FEATURES = ["family", "type", "payday", "month", "day"]  # the first three are categories
cte("tree_long", " UNION ALL ".join(
    f"SELECT id, {i} AS f, " + (f"dense_rank() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1" if i < 3 else f"CAST({c} AS BIGINT)") + " AS bin FROM xrows"
    for i, c in enumerate(_TREE_FEATURES)), ("xrows",))
cte("tree_rows0", "SELECT id, 1 AS node, avg(sales) OVER () - sales AS g FROM ytrain", ("ytrain",))
for _level in (0, 1):
    cte(f"tree_cuts{_level}", f"""
SELECT *, sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(g) OVER (PARTITION BY node, f) AS ng, sum(h) OVER (PARTITION BY node, f) AS nh,
       row_number() OVER (PARTITION BY node, f ORDER BY CASE WHEN f < 3 THEN g / h ELSE bin END, bin) AS cut
FROM (SELECT node, f, bin, sum(g) AS g, count(*) AS h FROM tree_rows{_level} JOIN tree_long USING (id) GROUP BY 1, 2, 3) b
WINDOW upto AS (PARTITION BY node, f ORDER BY CASE WHEN f < 3 THEN g / h ELSE bin END, bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        (f"tree_rows{_level}", "tree_long"))
    cte(f"tree_best{_level}", f"""
SELECT * FROM (SELECT node, f, cut, gain, row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, f, cut) AS rk FROM (
  SELECT *, gl * gl / (hl + 1) + (ng - gl) * (ng - gl) / (nh - hl + 1) - ng * ng / (nh + 1) AS gain FROM tree_cuts{_level} WHERE hl >= 1 AND nh - hl >= 1) c) r
WHERE rk = 1 AND gain > 0.000001""", (f"tree_cuts{_level}",))
    cte(f"tree_left{_level}", f"SELECT c.node, c.f, c.bin, max(c.bin) OVER (PARTITION BY c.node) AS top FROM tree_cuts{_level} c "
        f"JOIN tree_best{_level} b ON b.node = c.node AND b.f = c.f AND c.cut <= b.cut", (f"tree_cuts{_level}", f"tree_best{_level}"))
    cte(f"tree_rows{_level + 1}", f"""
SELECT r.id, 2 * r.node + CASE WHEN l.bin IS NOT NULL OR b.f >= 3 AND x.bin <= t.top THEN 0 ELSE 1 END AS node, r.g
FROM tree_rows{_level} r JOIN tree_best{_level} b USING (node) JOIN tree_long x ON x.id = r.id AND x.f = b.f
JOIN (SELECT DISTINCT node, top FROM tree_left{_level}) t ON t.node = r.node LEFT JOIN tree_left{_level} l ON l.node = r.node AND l.bin = x.bin""",
        (f"tree_rows{_level}", f"tree_best{_level}", f"tree_left{_level}", "tree_long"))


@query("q_boost_tree", with_ctes(
    "SELECT n.node, CASE b.f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_TREE_FEATURES)) + " END AS feature, n.h, "
    + rnd("ln(b.gain)", 4) + " AS log_gain, CASE WHEN b.f IS NULL THEN " + rnd("-0.5 * n.g / (n.h + 1)", 3) + " END AS value "
    "FROM (" + " UNION ALL ".join(f"SELECT node, sum(g) AS g, count(*) AS h FROM tree_rows{k} GROUP BY 1" for k in (0, 1, 2)) + ") n "
    "LEFT JOIN (SELECT * FROM tree_best0 UNION ALL SELECT * FROM tree_best1) b ON b.node = n.node",
    "tree_rows0", "tree_rows1", "tree_rows2", "tree_best0", "tree_best1"))
def q_boost_tree(spark, sf_dir):
    """First tree of histogram boosting of the sales, two levels deep, on three categories and two numbers:
    each node's rows, cut and gain or value."""
    x = _features_materialized(spark, sf_dir, _TREE_FEATURES).filter(~F.col("is_test")).select("id", *_TREE_FEATURES, F.col("sales").alias("label"))
    rows = NominalTransformer(exclude=["id", "label"]).fit(x).transform(x).select("id", "features", "label")
    tree = HistBoostRegressor(maxIter=1, maxDepth=2, stepSize=0.5).fit(rows).trees[0]
    out = []
    for node, (_, h) in tree.sums.items():
        split = tree.split.get(node)
        out.append((node, _TREE_FEATURES[split[0]] if split else None, int(h), float(split[2]) if split else None, tree.value.get(node)))
    nodes = spark.createDataFrame(out, "node int, feature string, h long, gain double, value double")
    return nodes.withColumn("log_gain", F.log("gain")).select("node", "feature", "h", _r("log_gain", 4), _r("value", 3))


# Trials and bounds of the queries: small beside the reference's 70 and its 1,000 trees, so that the query is
# done in minutes at any scale factor; both are arguments of ``search_hybrid``.
HYBRID_TRIALS, BLENDED_TRIALS = 4, 2
_BOOSTED_SMALL = {**sr.BOOSTED_BOUNDS, "learning_rate": (0.1, 0.6), "n_estimators": (3.0, 7.0), "max_depth": (3.0, 5.0), "subsample": (0.5, 1.0)}
_FOREST_SMALL = {**sr.RF_BOUNDS, "n_estimators": (2.0, 5.0), "max_depth": (3.0, 5.0), "max_samples": (0.5, 1.0)}
_HYBRIDS = {"boosted": ("boosted", True, _BOOSTED_SMALL), "stacked": ("boosted", False, {**_BOOSTED_SMALL, "gamma": sr.STACKED_BOUNDS["gamma"]}),
            "forest": ("forest", True, _FOREST_SMALL)}


def _searched(spark, sf_dir, names: list[str]) -> dict[str, tuple]:
    """For each named hybrid: the log of its search and its forecasts of the test rows."""
    x, test = _xy_test(spark, sf_dir)
    out = {}
    for name in names:
        kind, boosted, bounds = _HYBRIDS[name]
        base = HybridForecaster(boosted=boosted, unseen="pooled")
        log = tn.search_hybrid(x, kind, bounds, BLENDED_TRIALS, io.scratch_path(spark, "hybrid-trials"), base, 2, SEARCH_SEED, (1 / 3, 1.0))
        out[name] = log, tn.fit_best(x, kind, log, base).predict(test)
    return out


@query("q_hybrid_search")
def q_hybrid_search(spark, sf_dir):
    """Successive halving over the boosted hybrid's options by 4-fold CV: each trial's rungs, trees and target."""
    x, _ = _xy_test(spark, sf_dir)
    log = tn.search_hybrid(x, "boosted", _BOOSTED_SMALL, HYBRID_TRIALS, io.scratch_path(spark, "hybrid-trials"), None, SPLITS, SEARCH_SEED, (1 / 3, 1.0))
    return log.select("trial", "rung", sr.truncate_int(F.col("params")["n_estimators"]).alias("n_estimators"), _r("target", 4))


def searched_submission(spark, sf_dir):
    """Not registered: it takes over three minutes on the smallest tables. A boosted hybrid and a forest, each searched, fitted on all rows and forecast; blended by 1 / CV error
    into a submission: a forecast for each test row, and it lies between the two that it blends."""
    found = _searched(spark, sf_dir, ["boosted", "forest"])
    preds = None
    for name, (_, pred) in found.items():
        own = pred.select("id", F.lit(name).alias("model"), "pred")
        preds = own if preds is None else preds.unionByName(own)
    preds = materialize(preds, "searched")
    scores = spark.createDataFrame([(name, tn.best_error(log)) for name, (log, _) in found.items()], "model string, cv double")
    ends = preds.groupBy("id").agg(F.min("pred").alias("low"), F.max("pred").alias("high"))
    both = en.blend(preds, scores).join(ends, "id")
    inside = F.col("sales").between(F.col("low") - 1e-6, F.col("high") + 1e-6)
    return both.select("id", (F.col("sales").isNotNull() & ~F.isnan("sales")).alias("forecast"), inside.alias("between"))


# ------------------------------------------------------------------ importances of a linear forecaster
_LINEAR = {"lag_1": 0.5, "mean_7": 0.375, "year_lag": 0.125}
_PRED = " + ".join(f"{w} * {c}" for c, w in _LINEAR.items())
_SHIFT = {c: en.feature_shift(c, SEARCH_SEED, 1 << 60) - 1 for c in _LINEAR}
cte("importance_rows", f"SELECT *, row_number() OVER (ORDER BY substr(md5(id || '-{SEARCH_SEED}'), 1, 15), id) - 1 AS rk, count(*) OVER () AS n "
    f"FROM naive WHERE NOT is_test AND date >= DATE '{ft.FEATURE_START}'", ("naive",))


@query("q_importance_values", with_ctes(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, " + rnd("(moved - base)", 6) + " AS rise FROM (SELECT sqrt(avg(pow(ln(1 + a.sales) - ln(1 + "
        + " + ".join(f"{w} * {'b' if k == c else 'a'}.{k}" for k, w in _LINEAR.items())
        + f"), 2))) AS moved, sqrt(avg(pow(ln(1 + a.sales) - ln(1 + " + " + ".join(f"{w} * a.{k}" for k, w in _LINEAR.items())
        + f"), 2))) AS base FROM importance_rows a JOIN importance_rows b ON b.rk = (a.rk + 1 + {_SHIFT[c]} % (a.n - 1)) % a.n) x"
        for c in _LINEAR), "importance_rows"))
def q_importance_values(spark, sf_dir):
    """Permutation importance of each column of a linear forecaster, all of them in one pass over the rows."""
    wide = naive_predictions(_written_panel(spark, sf_dir)).filter(~F.col("is_test"))
    wide = materialize(wide.select("id", "sales", *_LINEAR), "importance")
    pred = sum((F.col(c) * w for c, w in _LINEAR.items()), F.lit(0.0))
    rise = en.permutation_importances(wide, list(_LINEAR), lambda df: df.withColumn("pred", pred), seed=SEARCH_SEED)
    return rise.select("feature", _r("rise", 6))
