"""Fits whose client weights are tables, and vector sums, against the broadcast form and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.operators import vectors as V
from wattline.plans import fitting as T
from wattline.plans import rounds as R
from wattline.plans import states as S
from wattline.session import clear_stored, discard, stored


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n, d = 260, 5
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[::4] = x[0]  # equal rows
    y = (x @ rng.normal(size=d) + rng.normal(size=n) > 0.5).astype(int)
    client = rng.choice([0, 1, 2], n, p=[0.7, 0.2, 0.1])
    table = [(int(k), [float(v) for v in a], int(b)) for a, b, k in zip(x, y, client)]
    return spark.createDataFrame(table, "client_id int, x array<float>, y int").repartition(6).cache()


def told(df, *keys):
    out = {}
    for r in df.collect():
        d = r.asDict()
        out[tuple(d.pop(k) for k in keys)] = d
    return out


@pytest.mark.parametrize("hidden,mu,patience", [((), 0.3, 10), ((4,), 0.0, 1)])
def test_tables_give_what_broadcasts_give(rows, monkeypatch, hidden, mu, patience):
    settings = dict(rounds=2, epochs=3, lr=0.6, decay=0.01, mu=mu, cap=4.0, hidden=hidden, patience=patience)
    want = R.federated_rounds(rows, rows, **settings)
    monkeypatch.setattr(R, "SENT_BYTES", 0)
    monkeypatch.setattr(S, "SLICE_NUMBERS", 100)  # 20 rows a slice
    monkeypatch.setattr(S, "FAN", 2)
    got = R.federated_rounds(rows, rows, **settings)
    np.testing.assert_allclose(T.flat(got.weights), T.flat(want.weights), atol=1e-10)
    for a, b, keys in ((got.fit_results, want.fit_results, ("round", "client_id")), (got.eval_results, want.eval_results, ("round", "client_id"))):
        a, b = told(a, *keys), told(b, *keys)
        assert a.keys() == b.keys()
        for k in a:
            assert a[k]["num_examples"] == b[k]["num_examples"] and a[k]["metrics"].keys() == b[k]["metrics"].keys()
            assert all(np.isclose(a[k]["metrics"][m], b[k]["metrics"][m], atol=1e-9) for m in a[k]["metrics"])
    a, b = told(got.epochs, "round", "client_id", "epoch"), told(want.epochs, "round", "client_id", "epoch")
    assert a.keys() == b.keys() and all(np.allclose(list(a[k].values()), list(b[k].values()), atol=1e-9) for k in a)
    assert got.threshold == want.threshold and got.metrics.keys() == want.metrics.keys()
    assert all(np.isclose(got.metrics[k], want.metrics[k]) for k in got.metrics)


def test_some_clients_take_part(rows, monkeypatch):
    settings = dict(rounds=3, epochs=1, lr=0.3, fraction=0.5, fraction_evaluate=0.1, min_clients=2, cap=None)
    want = R.federated_rounds(rows, rows, **settings)
    monkeypatch.setattr(R, "SENT_BYTES", 0)
    got = R.federated_rounds(rows, rows, **settings)
    for a, b in ((got.fit_results, want.fit_results), (got.eval_results, want.eval_results)):
        assert told(a, "round", "client_id").keys() == told(b, "round", "client_id").keys()
    np.testing.assert_allclose(T.flat(got.weights), T.flat(want.weights), atol=1e-10)


def test_gradients_of_slices(rows, monkeypatch):
    monkeypatch.setattr(S, "SLICE_NUMBERS", 10)
    monkeypatch.setattr(S, "FAN", 4)
    weights = T.init_weights(5, (3,), 1)
    want = T.gradient_pass(rows, {k: weights for k in (0, 1, 2)}, {0: 2.0, 1: 2.0, 2: 2.0}, shared=False)
    layout = S.Layout(rows)
    assert layout.table.count() == rows.count() and layout.most > 64
    plan = layout.rows.groupBy(*S.KEYS).cogroup(layout.counts.withColumn("slice", F.lit(0)).groupBy(*S.KEYS)).applyInArrow(lambda k, a, b: a, layout.rows.schema)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("InMemoryTableScan") == 1 and "rows travel" not in text
    states = spark_states(rows.sparkSession, [0, 1, 2])
    pieces = {}
    for r in S.gradient_sums(layout, states, weights).collect():
        pieces.setdefault(r["client_id"], {})[r["chunk"]] = r["values"]
    for k, (grad, loss, n) in want.items():
        got = np.concatenate([pieces[k][c] for c in sorted(pieces[k])])
        np.testing.assert_allclose(got[:-2] / got[-1], grad, atol=1e-12)
        assert got[-1] == n and np.isclose(got[-2] / n, loss)
    layout.close()


def spark_states(spark, clients):
    return spark.createDataFrame([(c, 2.0, None) for c in clients], "client_id int, pos_weight double, w array<double>")


def test_many_pieces(spark, monkeypatch):
    """Vectors of several pieces, groups with null keys, weights and vectors that are null."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 9000))
    n = rng.integers(1, 50, 40)
    group = [None if i % 5 == 0 else i % 3 for i in range(40)]
    rows = [(g, int(k), w.tolist()) for g, k, w in zip(group, n, v)] + [(1, None, v[0].tolist()), (2, 7, None)]
    df = spark.createDataFrame(rows, "g int, num_examples bigint, w array<double>").repartition(7)
    for held in (1 << 20, 1):
        monkeypatch.setattr(V, "HELD", held)
        np.testing.assert_allclose(V.mean_vector(df, "num_examples", "w"), np.average(v, axis=0, weights=n), atol=1e-12)
        got = {(r["g"], r["pos"]): r["value"] for r in T.average_weights(df, ["g"]).collect()}
        for g in (None, 0, 1, 2):
            mine = np.array([x == g for x in group])
            want = np.average(v[mine], axis=0, weights=n[mine])
            np.testing.assert_allclose([got[g, p] for p in range(9000)], want, atol=1e-12)
    assert len(V.mean_vector(df.limit(0), "num_examples", "w")) == 0
    ragged = spark.createDataFrame([(0, 1, [1.0]), (0, 1, [1.0, 2.0])], "g int, num_examples bigint, w array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        T.average_weights(ragged).collect()


def test_summed_pieces_hold_one_key(spark):
    parts = spark.range(3000).select((F.col("id") % 7).cast("int").alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("values"))
    got = {r["k"]: r["values"] for r in V.summed_pieces(parts, ["k"]).collect()}
    assert got == {k: [float(sum(range(k, 3000, 7))), float(len(range(k, 3000, 7)))] for k in range(7)}


def test_discarded_tables_are_gone(spark):
    kept, gone = stored(spark.range(5)), stored(spark.range(6))
    path = gone.inputFiles()[0]
    discard(gone)
    discard(gone)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()
    assert kept.count() == 5 and clear_stored(spark) >= 1
