"""CSV and Parquet readings, client files, trial and checkpoint tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.operators.clients import assign_nodes_random
from wattline.plans.preparation import BUILDING_FEATURES, building_test_windows, building_windows
from wattline.sources import readings as S
from wattline.sources import stores as ST

SCHEMA = "building_id bigint, timestamp timestamp, meter_reading double, anomaly int"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_by_header_name(spark, tmp_path):
    path = write(tmp_path / "a.csv", "timestamp, anomaly,extra,building_id,meter_reading\n2016-01-01 01:00:00,1,zz,7,\n")
    got = S.read_readings(spark, path, SCHEMA, "anomaly").first()
    assert (got["building_id"], got["timestamp"].hour, got["meter_reading"], got["anomaly"]) == (7, 1, None, 1)
    with pytest.raises(ValueError, match="target"):
        S.read_readings(spark, path, SCHEMA, "target")


def test_client_files(spark, tmp_path):
    for n in (1, 2, 10):
        write(tmp_path / f"data{n}.csv", f"building_id,timestamp,meter_reading,anomaly\n{n},2016-01-01 00:00:00,1.5,0\n")
    got = S.read_client_files(spark, str(tmp_path), SCHEMA)
    assert {(r["building_id"], r["client_id"]) for r in got.collect()} == {(1, 0), (2, 1), (10, 9)}
    two = S.read_client_files(spark, str(tmp_path), SCHEMA, clients=2)
    assert {(r["building_id"], r["client_id"]) for r in two.collect()} == {(1, 0), (2, 1)}
    with pytest.raises(FileNotFoundError, match="data3.csv"):
        S.read_client_files(spark, str(tmp_path), SCHEMA, clients=3)
    with pytest.raises(ValueError):
        S.read_client_files(spark, str(tmp_path), SCHEMA, clients=-1)
    single = S.read_client_files(spark, str(tmp_path / "data2.csv"), SCHEMA, pattern=None)
    assert single.first()["client_id"] == 0
    with pytest.raises(ValueError, match="mode"):
        S.load_clients(spark, str(tmp_path), SCHEMA, "else", "anomaly", 2)


def test_parts_are_replaced_and_read_back(spark, tmp_path):
    folder = str(tmp_path / "parts")
    df = spark.range(60).select(
        (F.col("id") % 6).alias("building_id"), F.timestamp_micros(F.col("id") * 1_000_001).alias("timestamp"),
        F.col("id").cast("double").alias("meter_reading"), F.lit(0).alias("anomaly"),
    )
    S.write_client_parts(df.withColumn("client_id", F.lit(8)), folder, ["timestamp"])
    write(tmp_path / "parts" / "notes.txt", "mine")
    write(tmp_path / "parts" / "data2.csv", "old")
    S.write_client_parts(assign_nodes_random(df, "building_id", 3), folder, ["timestamp"])
    assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == [*[f"file=data{n}.csv" for n in (1, 2, 3)], "notes.txt"]
    back = S.load_clients(spark, folder, SCHEMA, "local", "anomaly", 3)
    assert sorted(r[0] for r in back.select("client_id").distinct().collect()) == [0, 1, 2]
    assert back.select(df.columns).exceptAll(df).count() == 0 and back.count() == 60
    shared = str(tmp_path / "one.parquet")
    df.write.parquet(shared)
    by_node = S.load_clients(spark, shared, SCHEMA, "shared", "anomaly", 3, node="building_id")
    assert by_node.select(back.columns).exceptAll(back).count() == 0
    by_row = S.load_clients(spark, shared, SCHEMA, "shared", "anomaly", 4, key="meter_reading")
    assert by_row.groupBy("client_id").count().where("count <> 15").count() == 0


def test_trials(spark, tmp_path):
    path = str(tmp_path / "trials")
    assert ST.trial_store(spark, path, "s").count() == 0
    row = ("s", 0, 1, 0.4, {"lr": "0.1"}, 0.2)
    ST.append_trials(spark.createDataFrame([row], ST.TRIALS), path)
    ST.append_trials(spark.createDataFrame([("t", *row[1:]), ("s", 1, *row[2:])], ST.TRIALS), path)
    assert ST.trial_store(spark, path, "s").count() == 2 and ST.trial_store(spark, path).count() == 3


def test_checkpoint(spark, tmp_path):
    path, rng = str(tmp_path / "ck"), np.random.default_rng(0)
    for r in (1, 2):
        weights = [rng.normal(size=s) for s in ((3, 2), (2,), (2, 1), (1,))]
        ST.save_checkpoint(spark, path, "a", r, weights, {"hidden": [2]}, 0.4, {"f1": 0.5})
    ST.save_checkpoint(spark, path, "b", 9, [np.zeros(1)])
    back = ST.load_checkpoint(spark, path, "a")
    for got, want in zip(back["weights"], weights, strict=True):
        np.testing.assert_array_equal(got, want)
    assert (back["round"], back["threshold"], back["config"], back["metrics"]) == (2, 0.4, {"hidden": [2]}, {"f1": 0.5})
    ST.save_checkpoint(spark, path, "a", 1, [w + 1 for w in weights])
    again = ST.load_checkpoint(spark, path, "a")
    assert again["round"] == 1 and len(again["weights"]) == 4
    np.testing.assert_array_equal(again["weights"][0], weights[0] + 1)
    bare = ST.load_checkpoint(spark, path, "b")
    assert (bare["threshold"], bare["metrics"]) == (0.5, {})
    with pytest.raises(FileNotFoundError):
        ST.load_checkpoint(spark, path, "none")


def test_building_preparation_end_to_end(spark):
    """All 46 features from the full reading schema, per-client cutoffs, held-out windows."""
    schema = S.building_schema()
    known = {"building_id": "id % 4", "timestamp": "timestamp'2016-01-01' + make_interval(0,0,0,0,cast(id div 4 as int))",
             "anomaly": "cast(id % 11 = 0 as int)", "primary_use": "'Office'"}
    cols = [c.strip().split(" ") for c in schema.split(",")]
    df = spark.range(4 * 130).selectExpr(*[f"cast({known.get(n, 'id % 17')} as {t}) as {n}" for n, t in cols])
    out = building_windows(assign_nodes_random(df, "building_id", 2), ratio=0.6, gap_hours=5, window=12, stride=6)
    first = out.where("split = 'train'").first()
    assert len(first["x"]) == 12 and len(first["x"][0]) == len(BUILDING_FEATURES) == 46
    rows, cut = 130 - 24, int((130 - 24) * 0.6)
    per = {r[0]: r[1] for r in out.groupBy("split").count().collect()}
    assert per["train"] == 4 * len(range(0, cut + 1 - 12, 6))
    assert per["val"] == 4 * len(range(0, rows - (cut + 1) - 5 - 12, 6))
    assert building_test_windows(df, 12, 6).count() == 4 * len(range(0, rows - 12, 6))
