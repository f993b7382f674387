"""Plans and results of the steps that the queries share: what is shuffled, sorted and written."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailcast.operators import evaluate as ev
from retailcast.operators import knn
from retailcast.operators import panel as pn
from retailcast.operators import subset as ss
from retailcast.operators.encode import NominalTransformer, PopulationScaler, category_dictionary
from retailcast.operators.histboost import BinnedTrees, HistBoostModel, HistForest
from retailcast.operators.hybrid import HybridForecaster, KnnLearner, make_learner
from retailcast.operators.joins import materialize
from retailcast.plans import features as ft
from retailcast.plans import model_queries as mq
from retailcast.plans.queries import _written_panel
from retailcast.sources import standins as si

SMALL = "/root/testdata/sf0.001"


def test_writing_a_table_shuffles_nothing(spark):
    back = materialize(spark.range(0, 30, 1, 3))
    assert len(back.inputFiles()) == 3 and back.count() == 30


def test_feature_table_shuffles_the_panel_once_by_store(spark):
    x = ft.features_of_panel(_written_panel(spark, SMALL), si.stores(spark, SMALL), si.oil(spark, SMALL), si.holidays_events(spark, SMALL))
    physical = x._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(store_nbr") == 1
    assert "hashpartitioning(store_nbr#" in physical and "REPARTITION_BY_COL" in physical
    windows, rest = physical.rindex("Window ["), physical.index("Window [")
    assert "holiday_description" not in physical[rest:windows]  # no sort holds the descriptions


def test_store_window_equals_joined_totals_with_null_keys(spark):
    rows = [("2000-01-01", 1, "A", 2), ("2000-01-01", 1, "B", 3), ("2000-01-02", 1, "A", None), (None, 1, "A", 4), ("2000-01-01", None, "A", 5)]
    df = spark.createDataFrame(rows, "date string, store_nbr long, family string, onpromotion long")
    joined = df.join(pn.store_promo_totals(df), ["date", "store_nbr"], "left")
    names = ["date", "store_nbr", "family", "onpromotion", "total_other_promo_store"]
    assert sorted(map(str, pn.store_promo_window(df).select(names).collect())) == sorted(map(str, joined.select(names).collect()))


def test_dictionary_sorts_distinct_values_only(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (-1, None), (9, "a")], "n long, t string")
    dic = category_dictionary(df, ["n", "t"])
    assert {(r["column"], r["value"]): r["code"] for r in dic.collect()} == {("n", "-1"): 0, ("n", "9"): 1, ("n", "10"): 2, ("t", "a"): 0, ("t", "b"): 1}
    plan = dic._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[column#\d+, value#\d+\]", plan) and not re.search(r"Aggregate \[column#\d+, value#\d+, _key", plan)


def test_written_features_hold_only_the_named_ones(spark):
    x = mq._features_materialized(spark, SMALL, ["month", "family"])
    assert x.columns == ["date", "id", "store_nbr", "family", "month", "is_test", "sales"]


def _one_hot_distance(a, b, levels, metric):
    total = 0.0
    for j, (x, y) in enumerate(zip(a, b)):
        if j in levels:
            total += 0 if x == y else (x < levels[j]) + (y < levels[j])
        else:
            total += abs(x - y) if metric == "manhattan" else (x - y) ** 2
    return total if metric == "manhattan" else total ** 0.5


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_ranged_neighbours_equal_all_pairs_on_one_hot_codes(spark, metric):
    rnd = np.random.default_rng(3)
    levels = {1: 40, 3: 3}

    def rows(n, start):
        return [(start + i, [float(rnd.integers(0, 60)), float(rnd.integers(0, 41)), float(rnd.normal()), float(rnd.integers(0, 4))], float(i % 7)) for i in range(n)]

    pts, ask = rows(700, 0), rows(40, 10_000) + [(20_000, [500.0, 1.0, 0.0, 0.0], 0.0), (20_001, [-9.0, 40.0, 0.0, 3.0], 0.0)]
    schema = "id long, features array<double>, label double"
    top = knn.knn_ranged(spark.createDataFrame(pts, schema), spark.createDataFrame(ask, schema), 5, metric, "id", nominal=levels, block_rows=60, group_rows=8)
    got: dict = {}
    for r in sorted(top.collect(), key=lambda r: (r["qid"], r["rk"])):
        got.setdefault(r["qid"], []).append(r["pid"])
    for qid, v, _ in ask:
        want = sorted((_one_hot_distance(v, p, levels, metric), pid) for pid, p, _ in pts)[:5]
        assert got[qid] == [pid for _, pid in want]


def test_knn_learner_holds_no_column_for_a_level(spark):
    rows = [(i, f"s{i}", float(i % 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, store string, label double").withColumn("x", F.col("id") / 10.0)
    prepared = NominalTransformer(exclude=["id", "label"]).fit(df)
    learned = KnnLearner(k=1).fit(prepared.transform(df).select("id", "features", "label"))
    assert learned.points.agg(F.max(F.size("features"))).first()[0] == 2  # 301 as one-hot columns
    pred = learned.transform(prepared.transform(df).select("id", "label", "features"))
    assert pred.filter(F.abs(F.col("prediction") - F.col("label")) > 0).count() == 0


def test_param_search_measures_each_metric_once(spark, monkeypatch):
    calls, measure = [], knn.knn_neighbors
    monkeypatch.setattr(knn, "knn_neighbors", lambda *a, **k: calls.append(k["metric"] if "metric" in k else a[3]) or measure(*a, **k))
    mq.q_param_search(spark, SMALL).collect()
    assert len(calls) == len(set(calls)) <= 2


def _levels_table(spark, n=600, levels=150):
    df = spark.range(n).withColumns({"store": F.concat(F.lit("s"), (F.col("id") % levels).cast("string")), "x": (F.col("id") * 7919 % n).cast("double")})
    df = df.withColumn("label", F.when(F.col("store") == "s3", 50.0).otherwise(0.0) + F.col("x") / 100)
    return NominalTransformer(exclude=["id", "label"]).fit(df).transform(df).select("id", "features", "label")


def test_boosted_trees_seek_no_more_cuts_than_bins_beside_many_levels(spark):
    rows = _levels_table(spark)
    fitted = BinnedTrees(make_learner("gbt", maxIter=3, maxDepth=3, maxBins=151, stepSize=1.0), 8).fit(rows)
    assert all(len(c) <= 7 for c in fitted.binning.cuts if c is not None)
    assert fitted.transform(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0] < 1.0


def test_forest_cuts_one_level_against_the_others(spark):
    rows = _levels_table(spark)
    fitted = HistForest(maxIter=2, maxDepth=3, bootstrap=False, columns=1.0).fit(rows)
    cuts = [s for t in fitted.trees for s in t.split.values()]
    codes = [len(b) for f, b, _ in cuts if f in fitted.binning.categories]
    assert codes and set(codes) == {1} and fitted.trees[0].split[1][0] in fitted.binning.categories
    assert fitted.transform(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0] < 1.0


def test_forest_means_are_those_of_its_bootstrap_rows(spark):
    rows = _levels_table(spark)
    forest = HistForest(maxIter=1, maxDepth=1, columns=1.0)
    tree = forest.fit(rows).trees[0]
    held = rows.select("id", "label").toPandas()
    w = forest.weights(held["id"].to_numpy(), 0)
    drawn = {"w": w.sum(), "s": (w * held["label"]).sum()}
    assert abs(tree.sums[1][1] - drawn["w"]) < 1e-9 and abs(-tree.sums[1][0] - drawn["s"]) < 1e-6
    assert 450 < drawn["w"] < 750


def test_subset_statistics_do_not_need_the_joined_fits(spark):
    plain = spark.createDataFrame([(b, float(i), float(i % 5), "ab"[i % 2]) for i in range(40) for b in (i % 3,)], "block int, sales double, x double, c string")
    joined = plain.withColumn("fits", F.array(F.lit(1.0), F.lit(2.0)))
    one, two = (ss.prepare_subsets(joined, ["x", "c"], 2, plain=p) for p in (None, plain))
    assert one.design == two.design and np.allclose(one.grams, two.grams)


def test_boosted_trees_of_a_hybrid_ask_for_no_bin_of_each_level(spark):
    rows = [(d * 100 + s, dt.date(2020, 1, 1) + dt.timedelta(days=d), s, "A", float(s % 3 + d % 7), float(d % 7)) for d in range(20) for s in range(90)]
    x = spark.createDataFrame(rows, "id long, date date, store_nbr int, family string, sales double, promo double")
    learner = make_learner("gbt", maxIter=2, maxDepth=3, maxBins=16)  # fewer bins than stores
    model = HybridForecaster(learner, fourier=[], linear_cols=[]).fit(x)
    assert isinstance(model.stage2, HistBoostModel) and len(model.stage2.trees) == 2
    pred = model.predict(x.drop("sales"), in_sample=True).collect()
    assert len(pred) == len(rows) and all(r["pred"] >= 0 for r in pred)


def test_moments_and_levels_of_tasks_are_put_together(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("IF(id % 9 = 0, NULL, CAST(id AS DOUBLE) / 2) AS a", "id % 4 AS n", "IF(id % 3 = 0, NULL, concat('x', id % 11)) AS t", "id % 2 = 0 AS b")
    mean, std = PopulationScaler(["a"]).fit(df).stats["a"]
    wanted = df.selectExpr("avg(a) AS m", "stddev_pop(a) AS s").first()
    assert abs(mean - wanted["m"]) < 1e-9 and abs(std - wanted["s"]) < 1e-9
    codes = {(r["column"], r["value"]): r["code"] for r in category_dictionary(df, ["n", "t", "b"]).collect()}
    assert codes == {**{("n", str(i)): i for i in range(4)}, ("b", "false"): 0, ("b", "true"): 1,
                     **{("t", v): i for i, v in enumerate(sorted(f"x{k}" for k in range(11)))}}


def test_folds_of_rows_with_their_target_need_no_join(spark):
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 2), i % 2, "A", float(i % 5)) for i in range(40)]
    x = spark.createDataFrame(rows, "id long, date date, store_nbr int, family string, sales double")
    seen = []

    def fit_predict(tx, ty, vx):
        seen.append((ty is None, "sales" in tx.columns, "sales" in vx.columns, "SortMergeJoin" in tx._jdf.queryExecution().executedPlan().toString()))
        return vx.crossJoin(tx.agg(F.avg("sales").alias("pred"))).select("date", "store_nbr", "family", "pred")

    got = ev.time_series_cv_folds(fit_predict, x, None, 4).orderBy("fold").collect()
    plain = ev.time_series_cv_folds(lambda tx, ty, vx: vx.crossJoin(ty.agg(F.avg("sales").alias("pred"))).select("date", "store_nbr", "family", "pred"),
                                    x.drop("sales"), x.select("date", "store_nbr", "family", "sales"), 4).orderBy("fold").collect()
    assert seen == [(True, True, False, False)] * 4
    assert [(r["fold"], r["n_rows"]) for r in got] == [(k, 8) for k in (1, 2, 3, 4)] and np.allclose([r["msle"] for r in got], [r["msle"] for r in plain])


def test_fits_are_joined_behind_the_codes(spark):
    rows = spark.createDataFrame([(i, i % 4, i % 3, float(i % 5), "long text " * 9 + str(i % 6), float(i)) for i in range(120)], "id long, s long, block int, x double, c string, sales double")
    made = []

    def add(df):
        made.append(df.dtypes)
        return df.join(rows.select("id", "block"), "id").withColumn("fits", F.array(F.col("s") * 1.0, F.col("s") * 2.0))

    apart = ss.prepare_subsets(rows.drop("block"), ["x", "c"], 2, add=add, keep=("id", "s"))
    plain = ss.prepare_subsets(rows.withColumn("fits", F.array(F.col("s") * 1.0, F.col("s") * 2.0)), ["x", "c"], 2)
    assert not [c for c, t in made[0] if t == "string"] and np.allclose(apart.grams, plain.grams)
