"""A null key is a group like any other, on both sides of every switch by size; NaN, repeated keys, reruns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.config import Experiment, ModelSettings
from wattline.functions import columns as C
from wattline.operators import history as H
from wattline.operators import metrics as M
from wattline.operators import ordering as O
from wattline.operators import scaling as Z
from wattline.operators import splits as D
from wattline.operators import windows as W
from wattline.operators.features import meter_features, one_hot_data, row_slice
from wattline.plans import search as S
from wattline.plans.experiment import check_settings
from wattline.sources import stores as ST


def rows_of(df):
    return sorted((tuple(None if v != v else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def scores(spark):
    return spark.range(60).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), ((F.col("id") * 7 % 20) / 20.0).alias("prob"),
        (F.col("id") % 4 == 0).cast("int").alias("y"), ((F.col("id") * 7 % 20) - 10.0).alias("logit"),
        F.timestamp_micros(F.col("id") * 1_800_000_000).alias("ts"), "id",
    ).cache()


def test_running_totals_and_areas(scores):
    small = M.evaluate_scores(scores, by=["g"], rows=60)
    large = M.evaluate_scores(scores, by=["g"])
    assert small.count() == 3 and rows_of(small) == rows_of(large)
    assert M.average_precision(scores, by=["g"]).count() == M.roc_auc(scores, by=["g"]).count() == 3


@pytest.mark.parametrize("max_rows", [1000, 8])
def test_series_of_a_null_node(scores, max_rows):
    got = meter_features(scores.withColumn("v", F.col("id") * 1.0), "g", ["ts"], "v", max_rows)
    want = meter_features(scores.withColumn("v", F.col("id") * 1.0).fillna(0, ["g"]), "g", ["ts"], "v", 1000)
    assert rows_of(got.fillna(0, ["g"])) == rows_of(want) and got.count() == 60


def test_node_statistics(scores):
    sides = scores.withColumn("split", F.when(F.col("id") < 40, "train").otherwise("val")).withColumn("v", F.sqrt("id"))
    small = Z.node_window_stats(sides, "g", ["ts"], ["v"], 4, 2, 1000)
    large = Z.node_window_stats(sides, "g", ["ts"], ["v"], 4, 2, 8)
    assert small.count() == 6 and rows_of(small) == rows_of(large)
    assert Z.standardize_per_node(sides, "g", ["ts"], ["v"], 4, 2).count() == 60


@pytest.mark.parametrize("few", [1_000_000, 1])
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_time_cutoffs(scores, monkeypatch, few, broadcast):
    monkeypatch.setattr(D, "FEW_ROWS", few)
    monkeypatch.setattr(D, "MAX_BROADCAST_ROWS", broadcast)
    cuts = D.time_cutoffs(scores, "ts", 0.75, ["g"])
    want = scores.toPandas().groupby("g", dropna=False).ts.apply(lambda s: s.sort_values().iloc[int(len(s) * 0.75)])
    assert rows_of(cuts.select(F.coalesce("g", F.lit(0)), F.unix_micros("cutoff"))) == sorted(
        (0 if pd.isna(g) else int(g), t.value // 1000) for g, t in want.items()
    )
    assert D.temporal_split(scores, "ts", 0.75, 0, ["g"]).count() == 60


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_exact_splits(scores, monkeypatch, broadcast):
    monkeypatch.setattr(O, "MAX_BROADCAST_ROWS", broadcast)
    for key in ("id", "y", "g"):  # unique, repeated, repeated and null
        out = D.random_split(scores, key, 0.25, 7, ["g"])
        per = {r["g"]: (r["n"], r["t"]) for r in out.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
        assert per == {None: (20, 5), 1: (20, 5), 2: (20, 5)}
        whole = D.random_split(scores, key, 0.3)
        assert whole.count() == 60 and whole.where("split = 'test'").count() == 18
        assert rows_of(out) == rows_of(D.random_split(scores.repartition(7), key, 0.25, 7, ["g"]))


def test_metrics_and_pruning(spark, scores):
    told = scores.select(F.col("g").alias("round"), F.lit(2).alias("num_examples"), F.create_map(F.lit("f1"), F.col("prob")).alias("metrics"))
    assert H.metric_history(told).count() == 3
    trials = spark.createDataFrame(
        [(None if s else "s", t, step, float(t + step)) for s in (0, 1) for t in range(8) for step in range(12)],
        "study string, trial int, step int, value double",
    )
    got = rows_of(H.median_prune(trials, 5, 3))
    assert [r[1:] for r in got if r[0] is None] == [r[1:] for r in got if r[0] == "s"] != []


def test_first_rows_with_ties(scores):
    near = row_slice(scores, ["y", "id"], 3, 9, ["id"])
    far = O.positions(scores, [], ["y", "id"]).where("_pos >= 3 AND _pos < 9").select("id")
    assert rows_of(near) == rows_of(far)


def test_windows_with_missing_values(spark):
    values = [None if i % 5 == 1 else 1e6 + i * i % 17 for i in range(40)]
    df = spark.createDataFrame([(1, i, v, 0) for i, v in enumerate(values)], "node int, t int, v double, y int")
    stats = {r["start"]: r for r in W.window_stats(df, ["node"], ["t"], ["v"], "y", 12, 8).collect()}
    normed = {r["start"]: r["x_v"] for r in W.instance_norm(df, ["node"], ["t"], ["v"], "y", 12, 8).collect()}
    assert sorted(stats) == sorted(normed) == [0, 8, 16, 24]
    for s, r in stats.items():
        part = np.array([np.nan if v is None else v for v in values[s : s + 12]])
        assert r["n_v"] == (~np.isnan(part)).sum() and r["mean_v"] == pytest.approx(np.nanmean(part))
        assert r["var_v"] == pytest.approx(np.nanvar(part), rel=1e-9)
        want = (part - np.nanmean(part)) / np.sqrt(np.nanvar(part) + 1e-5)
        np.testing.assert_allclose(np.array([np.nan if v is None else v for v in normed[s]], dtype=float), want, rtol=1e-6)


def test_nan_is_missing(spark):
    values = [float("nan") if i == 30 else float(i % 7) for i in range(60)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "node int, t int, v double")
    empty = df.withColumn("v", F.when(F.col("t") != 30, F.col("v")))
    assert rows_of(meter_features(df, "node", ["t"], "v").dropna()) == rows_of(meter_features(empty, "node", ["t"], "v").dropna())
    assert meter_features(df, "node", ["t"], "v").dropna().count() > 30


def test_window_normalisation(spark):
    x = np.random.default_rng(0).normal(5, 3, (6, 4))
    df = spark.createDataFrame([(x.tolist(),)], "x array<array<float>>")
    got = np.array(df.select(C.normalize_window("x")).first()[0])
    x = x.astype(np.float32).astype(float)
    np.testing.assert_allclose(got, (x - x.mean(axis=0)) / np.sqrt(x.var(axis=0) + 1e-5), rtol=1e-5)


def test_many_values(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("v"))
    assert len(one_hot_data(df, "v").columns) == 1499
    with pytest.raises(ValueError, match="more than 1000"):
        one_hot_data(df, "v", limit=1000)


def test_a_study_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "fit_trials", lambda train, val, settings, epochs, patience, study, seed, first: spark.createDataFrame(
        [(study, first + i, 1, 0.5, {k: str(v) for k, v in s.items()}, 0.5) for i, s in enumerate(settings)], ST.TRIALS))
    path, rows = str(tmp_path / "t"), spark.range(1)
    S.search(rows, rows, 3, store=path)
    S.search(rows, rows, 2, store=path)
    S.search(rows, rows, 4, store=path, study="other")
    told = {r["trial"]: r["params"] for r in ST.trial_store(spark, path, "study").collect()}
    assert sorted(told) == [0, 1, 2, 3, 4] and len({str(p) for p in told.values()}) == 5
    assert [{k: str(v) for k, v in s.items()} for s in S.draw_trials(5)] == [told[i] for i in range(5)]
    assert ST.trial_store(spark, path, "other").count() == 4


def test_settings_take_effect():
    params = {"lr": "0.01", "weight_decay": "0.001", "pos_weight_cap": "7.5", "hidden_size": "64", "num_layers": "3"}
    done = Experiment().with_trial(params)
    assert (done.training.learning_rate, done.training.weight_decay, done.model.pos_weight_cap) == (0.01, 0.001, 7.5)
    assert (done.model.name, done.model.hidden_size, done.model.num_layers) == ("mlp", 64, 3)
    check_settings(done)
    for bad in (Experiment(model=ModelSettings(loss="cross_entropy")), Experiment(task="multi_class_classification"),
                Experiment(model=ModelSettings(num_classes=3)), Experiment(model=ModelSettings(loss="none"))):
        with pytest.raises(ValueError):
            check_settings(bad)
