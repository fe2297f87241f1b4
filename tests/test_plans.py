"""Shapes of the physical plans: exchanges, pruning, pushdown; and what executors need."""

import os
import re
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wattline import session as sessions
from wattline.operators import clients as K
from wattline.operators import features as P
from wattline.operators import splits as D
from wattline.operators import windows as W
from wattline.plans import fitting


def plan(df, mode="simple"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def exchanges(df):
    return len(re.findall(r"Exchange (hash|range|Single|Round)", plan(df)))


@pytest.fixture(scope="module")
def readings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "r.parquet")
    spark.range(4000).select(
        (F.col("id") % 20).alias("node"), F.timestamp_micros(F.col("id") * 3_600_000_000).alias("ts"),
        F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("meter_reading"),
        (F.col("id") % 9 == 0).cast("int").alias("y"), F.lit("unused").alias("other"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_features_and_windows_share_one_exchange(readings):
    wide = P.meter_features(readings, "node", ["ts", "key"]).dropna()
    out = W.stride_windows(wide, ["node"], ["ts", "key"], ["meter_reading", "meter_lag24"], "y", 6, 3, hot=None)
    assert exchanges(out) == 1


def test_unused_columns_are_not_read(readings):
    narrow = W.stride_windows(readings, ["node"], ["ts", "key"], ["meter_reading"], "y", 6, 3, hot=None)
    read = re.findall(r"ReadSchema: (.*)", plan(narrow, "formatted"))[0]
    assert "other" not in read and "meter_reading" in read
    keys = re.findall(r"ReadSchema: (.*)", plan(narrow.select("node", "start", "y"), "formatted"))[0]
    assert "meter_reading" not in keys


def test_split_bounds_reach_the_scan(readings):
    text = plan(D.temporal_split(readings, "ts", 0.8, 5), "formatted")
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(ts,.*GreaterThan\(ts,", text)


@pytest.mark.parametrize("make", [
    lambda df: K.assign_nodes_random(df, "node", 4),
    lambda df: K.assign_rows_random(df, "key", 4),
    lambda df: D.random_split(df, "key", 0.2, by=["node"]),
    lambda df: D.temporal_split(df, "ts", 0.8, 5),
])
def test_rows_are_not_shuffled(readings, make):
    assert exchanges(make(readings)) == 0


def test_bucketed_readings_need_no_exchange(spark, readings):
    spark.sql("DROP TABLE IF EXISTS bucketed_readings")
    readings.write.bucketBy(4, "node").sortBy("node", "ts", "key").saveAsTable("bucketed_readings")
    table = spark.table("bucketed_readings")
    out = W.stride_windows(table, ["node"], ["ts", "key"], ["meter_reading"], "y", 6, 3, hot=None)
    assert exchanges(out) == 0
    assert out.count() == W.stride_windows(readings, ["node"], ["ts", "key"], ["meter_reading"], "y", 6, 3).count()
    spark.sql("DROP TABLE bucketed_readings")


def test_executors_need_no_installed_package(tmp_path):
    """Task functions are pickled whole: another interpreter without the package on its path can run them."""
    file = tmp_path / "f.pkl"
    file.write_bytes(cloudpickle.dumps(fitting._gradient))
    code = (
        f"import pickle, numpy as np; f = pickle.load(open({str(file)!r}, 'rb'));"
        "print(f([np.zeros((2, 1)), np.zeros(1)], np.ones((3, 2)), np.array([1., 0., 0.]), 1.0)[0].tolist())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "[0.5, 0.5, 0.5]", done.stderr


def test_stored_tables_can_be_cleared(spark):
    sessions.clear_stored(spark)
    back = sessions.stored(spark.range(5))
    assert back.count() == 5 and sessions.clear_stored(spark) == 1 and sessions.clear_stored(spark) == 0


def test_shared_folder_is_the_named_one(spark):
    assert sessions.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
