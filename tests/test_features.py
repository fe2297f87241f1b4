"""Encodings, cleaning and narrowing on hand-sized tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wattline.functions import columns as C
from wattline.functions.fixed_values import BASE_FEATURES, PRIMARY_USES
from wattline.operators import features as P
from wattline.operators.scaling import standardize_global
from wattline.plans.preparation import BUILDING_FEATURES, prepare_grid_log


def test_feature_count():
    assert (len(BASE_FEATURES), len(PRIMARY_USES), len(BUILDING_FEATURES)) == (34, 12, 46)


def test_unknown_category_keeps_its_row(spark):
    df = spark.createDataFrame([(1, "Office"), (2, "Castle"), (3, None)], "id int, primary_use string")
    got = P.one_hot_fixed(df, "primary_use")
    assert len(got.columns) == 13
    sums = got.select("id", sum(F.col(f"`primary_use_{u}`") for u in PRIMARY_USES).alias("s"))
    assert {r["id"]: r["s"] for r in sums.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_codes_and_data_categories(spark, monkeypatch):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "v string")
    want = [("a", 0), ("a", 0), ("b", 1), ("c", 2), (None, None)]
    key = lambda r: str(r[0] or "z")
    assert sorted((tuple(r) for r in P.label_encode(df, "v").collect()), key=key) == want
    monkeypatch.setattr(P, "MAX_CODES", 1)
    monkeypatch.setattr(P, "known_values", lambda d, c, n: None)
    assert sorted((tuple(r) for r in P.label_encode(df, "v").collect()), key=key) == want
    with pytest.raises(ValueError):
        P.one_hot_data(df, "v", limit=1)


def test_first_category_is_dropped(spark):
    got = P.one_hot_data(spark.createDataFrame([("b",), ("a",)], "v string"), "v")
    assert got.columns == ["v_b"] and sorted(r[0] for r in got.collect()) == [0.0, 1.0]


def test_nonfinite(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, float("nan"), float("inf"), float("-inf"), None)], "v double")
    assert [r[0] for r in P.zero_nonfinite(df, ["v"]).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert P.drop_null_rows(df).count() == 3


def test_labels(spark):
    df = spark.createDataFrame([(" Natural",), ("Attack ",), ("Other",)], "marker string")
    codes = {"Natural": 0, "Attack": 1}
    assert [r["y"] for r in P.map_labels(df, "marker", codes, "y", strict=False).collect()] == [0, 1, None]
    with pytest.raises(PySparkException):
        P.map_labels(df, "marker", codes, "y").collect()
    assert [r[0] for r in P.unknown_labels(df, "marker", list(codes)).collect()] == ["Other"]


def test_constant_column(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "a double, b double")
    got = standardize_global(df, ["a", "b"]).collect()
    assert [r["a"] for r in got] == [0.0, 0.0, 0.0]
    assert [round(r["b"], 6) for r in got] == [-1.224745, 0.0, 1.224745]
    fitted = standardize_global(df, ["b"], fit_on=df.where("b < 3")).collect()
    assert [r["b"] for r in fitted] == [-1.0, 1.0, 3.0]


def test_narrowing(spark):
    df = spark.createDataFrame([(1, 2.5, True, "x")], "a bigint, b double, c boolean, d string")
    out = P.bool_to_float(P.narrow_numeric(df))
    assert [t for _, t in out.dtypes] == ["int", "float", "float", "string"]
    with pytest.raises(PySparkException):
        P.narrow_numeric(spark.createDataFrame([(2**40,)], "a bigint")).collect()


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1.5", "x"), ("bad", "2")], "a string, b string")
    assert [tuple(r) for r in P.coerce_numeric(df).collect()] == [(1.5, None), (None, 2.0)]


def test_vector_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "id int, a double, b int")
    out = P.assemble_features(df, ["b", "a"], ["id"])
    assert out.first()["x"] == [3.0, 2.0] and out.dtypes[1][1] == "array<float>"
    with pytest.raises(ValueError, match="zz"):
        P.assemble_features(df, ["zz"], ["id"])


def test_row_slice_near_and_far(spark):
    df = spark.range(150_000).repartition(7)
    near = P.row_slice(df, ["id"], 1, 100, ["id"])
    assert sorted(r[0] for r in near.collect()) == list(range(1, 100))
    far = P.row_slice(df, ["id"], 120_000, 120_010, ["id"])
    assert sorted(r[0] for r in far.collect()) == list(range(120_000, 120_010))


def test_small_columns(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7], 0.0)], "s array<double>, z double")
    got = df.select(
        C.argmax_class("s").alias("a"), C.sigmoid("z").alias("p"), C.decide(F.lit(0.5), 0.5).alias("d"),
        F.size(C.patches(F.array_repeat(F.lit(0.0), 168))).alias("n"), F.size(C.patches("s")).alias("none"),
        C.parse_time(F.lit("2016-01-01 05:00:00")).alias("t"), C.nan_to_null(F.lit(float("nan"))).alias("q"),
    ).first()
    assert (got["a"], got["p"], got["d"], got["n"], got["none"], got["t"].hour, got["q"]) == (1, 0.5, 1.0, 20, 0, 5, None)


def test_grid_log(spark):
    rows = [(1.0, float("inf"), " Natural"), (3.0, 2.0, "Attack "), (9.0, 9.0, None)]
    got = prepare_grid_log(spark.createDataFrame(rows, "f1 double, f2 double, marker string")).collect()
    assert [(r["f1"], r["f2"], r["y"]) for r in got] == [(-1.0, -1.0, 0), (1.0, 1.0, 1)]


def test_one_hot_has_a_bound_of_its_own(spark, monkeypatch):
    df = spark.range(30).withColumn("v", F.col("id"))
    with pytest.raises(ValueError, match="more than 20"):
        P.one_hot_data(df, "v", limit=20)
    assert P.one_hot_data.__defaults__ == (True, P.MAX_COLUMNS)
    assert len(P.one_hot_data(df, "v", limit=None).columns) == 30
