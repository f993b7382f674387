"""Encoders, deterministic terms, folds, scoring, ensemble, search helpers."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import D
from retailcast.functions.metrics import clip_lower
from retailcast.operators import ensemble as en
from retailcast.operators import evaluate as ev
from retailcast.operators import search as sr
from retailcast.operators.deterministic import DeterministicProcess
from retailcast.operators.encode import (OneHot, PopulationScaler, RoutedTransformer,
                                         apply_codes, category_dictionary)


def test_category_codes_with_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    dic = category_dictionary(df, ["x"])
    out = [r.x for r in apply_codes(df, dic, ["x"], suffix="_code").orderBy("x").collect()]
    codes = {r.x: r.x_code for r in apply_codes(df, dic, ["x"], suffix="_code").collect()}
    assert codes == {"a": 0, "b": 1, "c": 2, None: -1}
    assert len(out) == 4


def test_numbers_are_coded_in_their_own_order(spark):
    values = [100, 9, -5, None, 12, 10_000_000_000, -70]
    dic = category_dictionary(spark.createDataFrame([(v, str(v)) for v in values], "n long, s string"), ["n", "s"])
    assert [r["value"] for r in dic.filter("column = 'n'").orderBy("code").collect()] == [str(v) for v in sorted(v for v in values if v is not None)]
    assert [r["value"] for r in dic.filter("column = 's'").orderBy("code").collect()] == sorted(map(str, values))


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (5.0,)], "v double")
    model = PopulationScaler(["v"]).fit(df)
    mean, std = model.stats["v"]
    assert mean == 3.0 and math.isclose(std, 1.58113883, rel_tol=1e-8)
    const = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.v for r in PopulationScaler(["v"]).fit(const).transform(const).collect()] == [0, 0]


def test_onehot_unseen_is_zero(spark):
    fit = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    model = OneHot(["x"]).fit(fit)
    row = model.transform(spark.createDataFrame([("z",), ("b",)], "x string")).collect()
    assert [row[0][c] for c in model.output_columns()] == [0, 0, 0]
    assert [row[1][c] for c in model.output_columns()] == [0, 1, 0]


def test_routed_transformer_blocks(spark):
    df = spark.createDataFrame([(1.0, "a", 3), (3.0, "b", 4)], "f double, s string, i int")
    model = RoutedTransformer().fit(df)
    assert model.names == ["f", "oh_s_a", "oh_s_b", "i"]
    vecs = [r.features.toArray().tolist() for r in model.transform(df).collect()]
    assert vecs[0] == [-1.0, 1.0, 0.0, 3.0]


def test_trend_extend_and_fourier(spark):
    train = spark.createDataFrame([(D(f"2024-01-0{i}"),) for i in range(1, 6)], "date date")
    test = spark.createDataFrame([(D("2024-01-06"),), (D("2024-01-07"),)], "date date")
    model = DeterministicProcess(order=2, fourier=[["W", 2]]).fit(train)
    ins = model.in_sample(train).orderBy("date").collect()
    out = model.out_of_sample(test).orderBy("date").collect()
    assert [r.trend for r in ins] == [1, 2, 3, 4, 5] and [r.trend for r in out] == [6, 7]
    assert ins[1].trend_2 == 4.0
    monday = ins[0]  # 2024-01-01 is a Monday
    assert abs(monday["sin(1,freq=W)"]) < 1e-12 and monday["cos(2,freq=W)"] == 1.0


def test_folds_sizes(spark):
    df = spark.createDataFrame([(D(f"2024-01-{i:02d}"),) for i in range(1, 12)], "date date")
    folds = ev.fold_table(ev.date_blocks(df, 4), 4)
    sizes = {(r.fold, r.role): r.n for r in
             folds.groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    assert [sizes[(i, "train")] for i in range(1, 5)] == [3, 5, 7, 9]
    assert all(sizes[(i, "valid")] == 2 for i in range(1, 5))
    # folds are disjoint and ordered: every train date precedes every valid date
    b = folds.groupBy("fold", "role").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    span = {(r.fold, r.role): (r.lo, r.hi) for r in b.collect()}
    assert all(span[(i, "train")][1] < span[(i, "valid")][0] for i in range(1, 5))


def test_rmsle_is_root_of_mean(spark):
    fm = spark.createDataFrame([(1, 1.0), (2, 4.0)], "fold int, msle double")
    overall = [r.rmsle for r in ev.rmsle_report(fm).collect() if r.fold == 0][0]
    assert math.isclose(overall, math.sqrt(2.5))


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-3.0,), (None,), (2.0,)], "v double")
    assert [r.c for r in df.select(clip_lower(F.col("v")).alias("c")).collect()] == \
        [0.0, None, 2.0]


def test_blend(spark):
    preds = spark.createDataFrame([(1, "m1", 10.0), (1, "m2", 20.0)],
                                  "id long, model string, pred double")
    scores = spark.createDataFrame([("m1", 1.0), ("m2", 0.5)], "model string, cv double")
    out = en.blend(preds, scores).collect()[0].sales
    assert math.isclose(out, (10 * 1 + 20 * 2) / 3)
    same = spark.createDataFrame([(1, "m1", 7.0), (1, "m2", 7.0)],
                                 "id long, model string, pred double")
    assert math.isclose(en.blend(same, scores).collect()[0].sales, 7.0)


def test_permute_column_is_permutation(spark):
    df = spark.range(200).withColumn("v", F.col("id") * 2)
    out = en.permute_column(df, "v", "id")
    assert sorted(r.v for r in out.collect()) == list(range(0, 400, 2))
    assert out.filter(F.col("v") != F.col("id") * 2).count() > 100


def test_mask_keeps_linear_survivors(spark):
    feats = ["a", "time_since_quake", "time_since_quake_sq"]
    masks = spark.createDataFrame([("s", [0.9, 0.7, 0.5])], "search string, mask array<double>")
    kept = {(r.feature, r.role) for r in sr.kept_columns(masks, feats, feats[1:]).collect()}
    assert kept == {("a", "nonlinear"), ("time_since_quake", "linear")}


def test_decode_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    out = df.select(sr.knn_metric(F.col("v")).alias("m"), sr.knn_weights(F.col("v")).alias("w"),
                    sr.rf_max_features(F.col("v")).alias("f")).collect()
    assert [r.m for r in out] == ["minkowski", "manhattan", "euclidean"]
    assert [r.w for r in out] == ["distance", "uniform", "uniform"]
    assert [r.f for r in out] == ["log2", "auto", "sqrt"]


def test_best_trial_tie_goes_to_earliest(spark):
    rows = [("s", -1.0, {"gamma": 1.0}, {"elapsed": 5.0, "delta": 1.0}),
            ("s", -1.0, {"gamma": 2.0}, {"elapsed": 2.0, "delta": 1.0}),
            ("s", -3.0, {"gamma": 3.0}, {"elapsed": 1.0, "delta": 1.0})]
    df = spark.createDataFrame(rows, "search string, target double, params struct<gamma:double>,"
                                     " datetime struct<elapsed:double, delta:double>")
    best = sr.best_trials(df).collect()[0]
    assert best.best_params.gamma == 2.0 and best.n_trials == 3


def test_pending_trials_resume(spark):
    cand = sr.random_trials(spark, sr.KNN_BOUNDS, 5, seed=1)
    logged = cand.limit(2)
    assert sr.pending_trials(cand, logged).count() == 3
    for r in cand.collect():
        assert 1.0 <= r.n_neighbors <= 20.0


@pytest.mark.parametrize("bounds", [sr.BOOSTED_BOUNDS, sr.RF_BOUNDS])
def test_random_trials_in_bounds(spark, bounds):
    for r in sr.random_trials(spark, bounds, 4, seed=3).collect():
        for k, (lo, hi) in bounds.items():
            assert lo <= r[k] <= hi


def test_apply_mask_projection(spark):
    df = spark.createDataFrame([(1, 2, "A", 1.0, 2.0, 3.0)],
                               "id long, store_nbr long, family string, a double, b double, "
                               "c double")
    out = sr.apply_mask(df, ["a", "b", "c"], [0.9, 0.5, 0.51])
    assert out.columns == ["id", "store_nbr", "family", "a", "c"]


def test_permutation_importance_ranks_used_feature(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 10).cast("double").alias("a"),
                                 (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("sales", F.col("a") * 3)

    def predict(x):  # a model that uses only feature a
        return x.select("id", (F.col("a") * 3).alias("pred"))

    out = {r.feature: r.rise for r in
           en.permutation_importance(df, ["a", "b"], predict, seed=2).collect()}
    assert out["a"] > 0.1 and abs(out["b"]) < 1e-12


def test_onehot_has_no_limit_of_levels(spark):
    df = spark.range(3000).select(F.concat(F.lit("level "), F.col("id")).alias("x"))
    model = OneHot(["x"]).fit(df)
    row = model.vectors(df.filter("x = 'level 7'")).first()
    assert row["x_levels"].size == 3000 and row["x_levels"].numNonzeros() == 1
    other = model.vectors(spark.createDataFrame([("new",), (None,)], "x string")).collect()
    assert all(r["x_levels"].numNonzeros() == 0 and r["x_levels"].size == 3000 for r in other)


def test_permutation_reaches_all_rows(spark):
    # a value can come to any row, whatever their number: no buckets that keep values inside
    df = spark.range(20_000).withColumn("v", F.col("id"))
    moved = en.permute_column(df, "v", "id").select((F.col("id") / 2000).cast("int").alias("a"), (F.col("v") / 2000).cast("int").alias("b"))
    assert moved.distinct().count() == 100


def test_cv_raises_on_missing_forecasts(spark):
    scored = spark.createDataFrame([(1.0, 1.0), (2.0, None)], "sales double, pred double")
    with pytest.raises(ValueError, match="1 validation rows"):
        ev.require_scored(scored)
    X = spark.createDataFrame([(D(f"2024-01-{i:02d}"), 1, "A", 1.0) for i in range(1, 11)], "date date, store_nbr long, family string, sales double")
    with pytest.raises(ValueError, match="no forecast"):
        ev.time_series_cv_folds(lambda tx, ty, vx: vx.limit(1).withColumn("pred", F.lit(1.0)), X.drop("sales"), X)


def test_search_runs_each_trial_once_and_resumes(spark, tmp_path):
    ran = []

    def objective(point):
        ran.append(point["a"])
        return abs(point["a"] - 0.5)
    path = str(tmp_path / "log")
    assert sr.run_search(spark, objective, {"a": (0.0, 1.0)}, 3, path).count() == 3 and len(ran) == 3
    log = sr.run_search(spark, objective, {"a": (0.0, 1.0)}, 5, path)
    assert log.count() == 5 and len(ran) == 5 == len(set(ran))
    assert sr.run_search(spark, objective, {"a": (0.0, 1.0)}, 5, path).count() == 5 and len(ran) == 5
    assert sr.best_point(log)["a"] == min(ran, key=lambda a: abs(a - 0.5))


def test_trial_values_to_learner_parameters(spark):
    from retailcast.operators.hybrid import make_learner
    mid = lambda bounds: {k: (lo + hi) / 2 for k, (lo, hi) in bounds.items()}
    gbt = make_learner("gbt", **sr.boosted_params(mid(sr.BOOSTED_BOUNDS)))
    assert gbt.getMaxIter() == 500 and gbt.getMaxDepth() == 7 and gbt.getMinInfoGain() == 5.5
    rf = make_learner("rf", **sr.forest_params(mid(sr.RF_BOUNDS)))
    assert rf.getNumTrees() == 550 and rf.getFeatureSubsetStrategy() == "auto"
    assert sr.neighbor_params(mid(sr.KNN_BOUNDS)) == {"k": 10, "weights": "distance", "metric": "manhattan"}


def test_scale_conf():
    from retailcast.session import MAX_SHUFFLE_PARTITIONS, scale_conf
    parts = lambda conf: int(conf["spark.sql.shuffle.partitions"])
    assert parts(scale_conf(2 ** 40, 1000)) == 9000
    assert parts(scale_conf(1, 1000)) == 2000
    assert parts(scale_conf(100 * 2 ** 40, 8000)) <= MAX_SHUFFLE_PARTITIONS


def test_session_leaves_the_master_alone(monkeypatch):
    from retailcast import session
    seen = {}

    class Builder:
        def appName(self, name):
            return self

        def master(self, m):
            seen["master"] = m
            return self

        def config(self, k, v):
            seen[k] = v
            return self

        def getOrCreate(self):
            raise KeyError

    monkeypatch.setattr(session, "SparkSession", type("S", (), {"builder": Builder()}))
    with pytest.raises(KeyError):
        session.get_session()
    assert "master" not in seen and "spark.driver.memory" not in seen and "spark.sql.shuffle.partitions" not in seen


def test_checkpoint_dir_must_be_shared_on_a_cluster():
    from retailcast.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_csv_with_a_bad_date_raises(spark, tmp_path):
    from retailcast.sources import io
    from retailcast.sources.schemas import OIL
    spark.createDataFrame([("2024-01-01", 1.0), ("01/02/2024", 2.0)], "date string, dcoilwtico double").write.option("header", True).csv(str(tmp_path / "oil"))
    with pytest.raises(ValueError, match="1 dates"):
        io.read_csv(spark, str(tmp_path / "oil"), OIL)
    assert io.read_csv(spark, str(tmp_path / "oil"), OIL, bad_dates="null").filter("date IS NULL").count() == 1


def test_broadcast_is_decided_by_bytes(spark):
    from retailcast.operators.joins import bounded_broadcast, row_bytes
    df = spark.createDataFrame([(1, "x" * 1000)], "a long, b string")
    assert df.select(row_bytes(df)).first()[0] == 1032
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(bounded_broadcast(df)) and not hinted(bounded_broadcast(df, max_bytes=1000))


def test_all_importances_in_one_pass_equal_one_after_the_other(spark):
    import hashlib

    import numpy as np
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(0, 9)), float(rng.integers(0, 5)), int(rng.integers(0, 3)), float(rng.integers(0, 20))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c int, sales double")
    got = {r["feature"]: r["rise"] for r in en.permutation_importances(
        df, ["a", "b", "c"], lambda d: d.withColumn("pred", F.col("a") + 2 * F.col("c")), seed=3).collect()}
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}-3".encode()).hexdigest()[:15], r[0]))
    error = lambda x: np.sqrt(np.mean((np.log1p([r[4] for r in x]) - np.log1p([r[1] + 2 * r[3] for r in x])) ** 2))
    for k, f in ((1, "a"), (2, "b"), (3, "c")):
        shift = en.feature_shift(f, 3, 60)
        moved = [(*r[:k], order[(i + shift) % 60][k], *r[k + 1:]) for i, r in enumerate(order)]
        assert got[f] == pytest.approx(error(moved) - error(order), abs=1e-12)
    assert got["b"] == pytest.approx(0, abs=1e-12)
