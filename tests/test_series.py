"""Lags, rolling frames and windows against pandas/NumPy, with short and with sliced long series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators.features import meter_features
from wattline.operators.ordering import hot_groups, positions, running_totals
from wattline.operators.scaling import node_window_stats, standardize_per_node
from wattline.operators.windows import instance_norm, stride_windows, window_stats
from wattline.plans.preparation import prepare_readings


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    sizes = {1: 60, 2: 1, 3: 6, 4: 7, 5: 12, 6: 700}  # node 6 holds most of the rows
    rows = []
    for node, n in sizes.items():
        for i in range(n):
            rows.append((node, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), len(rows), float(rng.normal(50, 9)), int(rng.random() < 0.2)))
    return pd.DataFrame(rows, columns=["node", "ts", "key", "v", "y"])


@pytest.fixture(scope="module")
def df(spark, table):
    return spark.createDataFrame(table.sample(frac=1.0, random_state=1)).repartition(5).cache()


def features_of(table):
    out = table.sort_values(["node", "ts", "key"]).copy()
    g = out.groupby("node")["v"]
    out["meter_lag1"], out["meter_lag24"] = g.shift(1), g.shift(24)
    out["meter_roll_mean_24"] = g.transform(lambda x: x.rolling(24, min_periods=1).mean())
    out["meter_roll_std_24"] = g.transform(lambda x: x.rolling(24, min_periods=1).std())
    out["meter_diff_1"], out["meter_diff_24"] = out["v"] - out["meter_lag1"], out["v"] - out["meter_lag24"]
    out["meter_zscore_24"] = (out["v"] - out["meter_roll_mean_24"]) / (out["meter_roll_std_24"] + 1e-6)
    return out


@pytest.mark.parametrize("max_rows", [2_000_000, 50, 7])
def test_meter_features(df, table, max_rows):
    got = meter_features(df, "node", ["ts", "key"], "v", max_rows).toPandas().sort_values("key").reset_index(drop=True)
    want = features_of(table).sort_values("key").reset_index(drop=True)[list(got.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


def windows_of(table, window, stride):
    out = {}
    for node, g in table.sort_values(["node", "ts", "key"]).groupby("node"):
        for s in range(0, len(g) - window, stride):
            out[node, s] = (g["v"].to_numpy()[s : s + window], g["y"].to_numpy()[s + window])
    return out


@pytest.mark.parametrize("window,stride", [(6, 3), (24, 8), (5, 2), (4, 6)])
@pytest.mark.parametrize("max_rows", [2_000_000, 50, 4])
def test_stride_windows(df, table, window, stride, max_rows):
    want = windows_of(table, window, stride)
    got = stride_windows(df, ["node"], ["ts", "key"], ["v"], "y", window, stride, max_rows).collect()
    assert {(r["node"], r["start"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        x, y = want[r["node"], r["start"]]
        assert r["y"] == y
        np.testing.assert_allclose(np.array(r["x"])[:, 0], x.astype(np.float32))
        assert r["label_ts"] > r["start_ts"]


def test_hot_nodes_found_on_wider_rows(df, table):
    """Long series named by node serve groups by (split, node) as well."""
    sides = df.withColumn("split", F.when(F.col("key") % 2 == 0, "a").otherwise("b"))
    args = (["split", "node"], ["ts", "key"], ["v"], "y", 6, 3)
    hot = hot_groups(df, ["node"], 50)
    assert sorted(r[0] for r in hot.collect()) == [1, 6]
    got = stride_windows(sides, *args, max_rows=50, hot=hot)
    want = stride_windows(sides, *args, hot=None)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_window_edges(df):
    """6, 7 and 12 rows with window 6, stride 3: none, one, two windows."""
    got = stride_windows(df.where("node in (3, 4, 5)"), ["node"], ["ts", "key"], ["v"], "y", 6, 3)
    assert sorted((r["node"], r["start"]) for r in got.select("node", "start").collect()) == [(4, 0), (5, 0), (5, 3)]


def test_strict_needs_a_window(df):
    with pytest.raises(ValueError):
        stride_windows(df.where("node = 3"), ["node"], ["ts", "key"], ["v"], "y", 6, 3, strict=True)


def test_null_feature_keeps_its_place(spark):
    rows = [(1, i, None if i == 1 else float(i), 0) for i in range(5)]
    df = spark.createDataFrame(rows, "node int, ts int, v double, y int")
    got = stride_windows(df, ["node"], ["ts"], ["v"], "y", 4, 2).first()["x"]
    assert got == [[0.0], [None], [2.0], [3.0]]


@pytest.mark.parametrize("max_rows", [2_000_000, 30])
def test_window_stats_and_norm(df, table, max_rows):
    want = windows_of(table, 24, 8)
    stats = window_stats(df, ["node"], ["ts", "key"], ["v"], "y", 24, 8, max_rows).collect()
    assert len(stats) == len(want)
    for r in stats:
        x, _ = want[r["node"], r["start"]]
        np.testing.assert_allclose([r["n_v"], r["sum_v"], r["mean_v"], r["var_v"]], [24, x.sum(), x.mean(), x.var()])
    for r in instance_norm(df, ["node"], ["ts", "key"], ["v"], "y", 24, 8, max_rows).collect():
        x, _ = want[r["node"], r["start"]]
        np.testing.assert_allclose(r["x_v"], (x - x.mean()) / np.sqrt(x.var() + 1e-5), atol=1e-9)


def test_window_stats_skip_nulls(spark):
    values = [1.0, None, 3.0, 5.0, 7.0, None, 2.0]
    df = spark.createDataFrame([(1, i, v, 0) for i, v in enumerate(values)], "node int, ts int, v double, y int")
    got = window_stats(df, ["node"], ["ts"], ["v"], "y", 6, 2).first()
    present = np.array([1.0, 3.0, 5.0, 7.0])
    np.testing.assert_allclose(
        [got["n_v"], got["sum_v"], got["mean_v"], got["var_v"]], [4, 16.0, present.mean(), present.var()]
    )


@pytest.mark.parametrize("max_rows", [2_000_000, 30])
def test_per_node_scaling_counts_overlaps(df, table, max_rows):
    """Statistics over all windows of a node, each overlap counted, equal those of the stacked windows."""
    sides = df.withColumn("split", F.when(F.col("node") == 5, "val").otherwise("train")).withColumn("flat", F.lit(5.1))
    stats = node_window_stats(sides, "node", ["ts", "key"], ["v", "flat"], 6, 3, max_rows).collect()
    stacked = {}
    for (node, _), (x, _) in windows_of(table, 6, 3).items():
        stacked.setdefault(node, []).append(x)
    assert {r["node"] for r in stats} == set(stacked)
    for r in stats:
        x = np.concatenate(stacked[r["node"]])
        assert r["n_values"] == len(x)
        np.testing.assert_allclose([r["mean_v"], r["std_v"]], [x.mean(), x.std() or 1.0])
        assert r["std_flat"] == 1.0
    scaled = standardize_per_node(sides, "node", ["ts", "key"], ["v", "flat"], 6, 3, max_rows)
    assert {r[0] for r in scaled.where("fallback").select("node").distinct().collect()} == {5}
    assert scaled.where("abs(flat) > 1e-9").count() == 0


def test_tiny_series(spark):
    rows = [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 4.0), (2, 0, 9.0)]
    df = spark.createDataFrame(rows, "node int, ts int, v double")
    got = {(r["node"], r["ts"]): r["meter_roll_std_24"] for r in meter_features(df, "node", ["ts"], "v").collect()}
    assert got[1, 0] is None and got[2, 0] is None
    np.testing.assert_allclose([got[1, 1], got[1, 2]], [0.70710678, 1.52752523])


def test_preparation_drops_rows_after_the_lags(df, table):
    ready = prepare_readings(df.withColumn("use", F.lit("Office")), "node", ["ts", "key"], "v", "use", ["Office", "Other"])
    got = ready.groupBy("node").count().toPandas().set_index("node")["count"].to_dict()
    assert got == {1: 60 - 24, 6: 700 - 24}
    assert ready.where("use_Office = 1 and use_Other = 0").count() == sum(got.values())


def test_running_totals(df, table):
    got = running_totals(df, ["node"], ["ts", "key"], ["v"]).toPandas().sort_values(["node", "ts", "key"])
    want = table.sort_values(["node", "ts", "key"]).groupby("node")["v"].transform(lambda x: x.cumsum().shift(fill_value=0))
    np.testing.assert_allclose(got["ahead_v"].to_numpy(), want.to_numpy(), atol=1e-8)
    spots = positions(df, [], ["key"]).toPandas().sort_values("key")
    assert spots["_pos"].tolist() == list(range(len(table)))
