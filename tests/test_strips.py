"""Strips of windows against the windows themselves, and fits on both."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.operators import clients as K
from wattline.operators.windows import stride_windows, window_strips
from wattline.plans import fitting as T
from wattline.plans import rounds as R
from wattline.plans.preparation import as_strips, as_vectors

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for node, n in ((1, 200), (2, 61), (None, 35), (4, 12), (5, 13), (6, 1)):
        rows += [(node, i, float(v), float(w), int(z)) for i, (v, w, z) in enumerate(zip(*rng.normal(size=(2, n)), rng.integers(0, 2, n)))]
    return spark.createDataFrame(rows, "node int, t int, a double, b double, y int").repartition(4).cache()


def windows_by_hand(series, window, stride):
    rows, out = {}, {}
    for r in series.collect():
        rows.setdefault(r["node"], []).append((r["t"], r["a"], r["b"], r["y"]))
    for node, found in rows.items():
        found.sort()
        for start in range(0, len(found) - window, stride):
            cut = found[start : start + window]
            out[node, start] = (cut[0][0], found[start + window][0], found[start + window][3], np.float32([c[1:3] for c in cut]))
    return out


@pytest.mark.parametrize("max_rows", [2_000_000, 100])
@pytest.mark.parametrize("window,stride", [(12, 5), (12, 8), (5, 12), (7, 3), (10, 4)])
def test_odd_strides(series, window, stride, max_rows):
    got = {(r["node"], r["start"]): (r["start_ts"], r["label_ts"], r["y"], np.float32(r["x"])) for r in
           stride_windows(series, ["node"], ["t"], FEATURES, "y", window, stride, max_rows).collect()}
    want = windows_by_hand(series, window, stride)
    assert got.keys() == want.keys() and len(got) > 20
    for k in want:
        assert got[k][:3] == want[k][:3] and np.array_equal(got[k][3], want[k][3])


@pytest.mark.parametrize("max_rows", [2_000_000, 100])
@pytest.mark.parametrize("window,stride,span", [(12, 4, 8), (12, 5, 1), (12, 12, 2), (4, 9, 3)])
def test_strips_hold_the_windows(series, window, stride, span, max_rows):
    got = {}
    for r in window_strips(series, ["node"], ["t"], FEATURES, "y", window, stride, max_rows, span=span).collect():
        assert (r["window"], r["stride"]) == (window, stride)
        x = T.cut_windows(np.float32(r["x"]), len(r["y"]), window, stride, False)
        for i, (v, y) in enumerate(zip(x, r["y"])):
            key = (r["node"], r["start"] + i * stride)
            assert key not in got
            got[key] = (y, v)
    want = windows_by_hand(series, window, stride)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][2] and np.array_equal(got[k][1], want[k][3].ravel()) for k in want)


def test_no_windows(series):
    assert stride_windows(series, ["node"], ["t"], FEATURES, "y", 300, 7).count() == 0
    assert window_strips(series, ["node"], ["t"], FEATURES, "y", 300, 7).count() == 0
    with pytest.raises(ValueError, match="longer than the window"):
        stride_windows(series, ["node"], ["t"], FEATURES, "y", 300, 7, strict=True)
    with pytest.raises(ValueError, match="positive"):
        window_strips(series, ["node"], ["t"], FEATURES, "y", 0, 7)


@pytest.fixture(scope="module")
def both_forms(series):
    rows = series.withColumn("client_id", F.coalesce("node", F.lit(0)) % 3)
    by = ["client_id", "node"]

    def forms(normalize):
        windows = stride_windows(rows, by, ["t"], FEATURES, "y", 6, 3)
        strips = window_strips(rows, by, ["t"], FEATURES, "y", 6, 3)
        return as_vectors(windows, ["client_id"], normalize).cache(), as_strips(strips, ["client_id"], normalize).cache()

    return forms


@pytest.mark.parametrize("normalize", [False, True])
def test_gradients_and_scores_are_those_of_the_windows(both_forms, normalize):
    flat, strips = both_forms(normalize)
    assert T.input_width(flat) == T.input_width(strips) == 12 and T.labels(strips).count() == flat.count()
    weights = T.init_weights(12, (3,), 2)
    models, heavy = {0: weights, 1: weights, 2: weights}, {0: 2.0, 1: 1.0, 2: 3.0}
    for shared in (False, True):
        a, b = T.gradient_pass(flat, models, heavy, shared), T.gradient_pass(strips, models, heavy, shared)
        assert a.keys() == b.keys()
        for m in a:
            np.testing.assert_allclose(a[m][0], b[m][0], atol=1e-6 if normalize else 1e-12)
            assert a[m][2] == b[m][2] and np.isclose(a[m][1], b[m][1], atol=1e-6 if normalize else 1e-12)
    scores = [sorted((r["client_id"], r["y"], round(r["logit"], 5)) for r in T.score(x, models, ["client_id", "y"], shared=False).collect()) for x in (flat, strips)]
    assert scores[0] == scores[1]


def test_rounds_on_strips(both_forms, monkeypatch):
    flat, strips = both_forms(False)
    want = R.federated_rounds(flat, flat, 2, 2, 0.3, hidden=(3,))
    got = R.federated_rounds(strips, strips, 2, 2, 0.3, hidden=(3,))
    np.testing.assert_allclose(T.flat(got.weights), T.flat(want.weights), atol=1e-10)
    monkeypatch.setattr(R, "SENT_BYTES", 0)
    tables = R.federated_rounds(strips, strips, 2, 2, 0.3, hidden=(3,))
    np.testing.assert_allclose(T.flat(tables.weights), T.flat(want.weights), atol=1e-10)
    assert {(r["round"], r["client_id"]): r["num_examples"] for r in tables.fit_results.collect()} == {
        (r["round"], r["client_id"]): r["num_examples"] for r in want.fit_results.collect()}


def test_a_null_feature_is_an_error(series):
    rows = series.withColumn("client_id", F.lit(0)).withColumn("a", F.when(F.col("t") != 30, F.col("a")))
    strips = as_strips(window_strips(rows, ["client_id", "node"], ["t"], FEATURES, "y", 6, 3), ["client_id"])
    with pytest.raises(Exception, match="null"):
        T.gradient_pass(strips, {0: T.init_weights(12)}, {}, shared=False)


def test_strips_take_about_the_room_of_the_rows(spark):
    rows = spark.range(30_000).select(
        (F.col("id") % 3).cast("int").alias("node"), F.col("id").alias("t"), F.lit(0).alias("client_id"), F.lit(1).alias("y"),
        *[F.rand(i).cast("float").alias(f) for i, f in enumerate("abcdefgh")],
    )
    by, features = ["client_id", "node"], list("abcdefgh")
    numbers = [
        df.agg(F.sum(F.size("x"))).first()[0] for df in (
            as_strips(window_strips(rows, by, ["t"], features, "y", 168, 24), ["client_id"]),
            as_vectors(stride_windows(rows, by, ["t"], features, "y", 168, 24), ["client_id"]),
        )
    ]
    assert numbers[0] < 1.15 * 8 * 30_000 and numbers[1] > 6 * numbers[0]


def test_client_rows_keep_a_null_node(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "node string, v int")
    nodes = K.assign_nodes_balanced(df, "node", 2)
    assert sorted(r["v"] for r in K.client_rows(df, nodes, "node").collect()) == [1, 2, 3, 4, 5]
    parts = [sorted(r["v"] for r in K.client_rows(df, nodes, "node", i).collect()) for i in (0, 1)]
    assert sorted(parts[0] + parts[1]) == [1, 2, 3, 4, 5] and K.client_rows(df, nodes, "node", 0).columns == ["node", "v"]


def test_examples_of_many_strips_meet_in_one_product(both_forms, monkeypatch):
    """Strips of a few windows are put together before a model sees them, up to a bound, and none is lost or moved."""
    _, strips = both_forms(False)
    batches = strips.select(*T.example_columns(strips, "client_id")).toArrow().to_batches(max_chunksize=2)
    single = [(batch.column("client_id").take(T.pa.array(at)).to_pylist(), x, y) for batch in batches for at, x, y in T.examples(batch)]
    for block, most in ((4096, 1), (7, len(single))):
        monkeypatch.setattr(T, "BLOCK", block)
        found = list(T.example_blocks(iter(batches), "client_id"))
        assert 1 <= len(found) <= most and len(single) > 3
        assert sum((k[0].to_pylist() for k, _, _ in found), []) == sum((k for k, _, _ in single), [])
        assert np.array_equal(np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, x, _ in single]))
        assert np.array_equal(np.concatenate([y for _, _, y in found]), np.concatenate([y for _, _, y in single]))
        assert all(len(x) <= max(block, max(len(s[1]) for s in single)) for _, x, _ in found)
    assert list(T.example_blocks(iter([]), "client_id")) == []
