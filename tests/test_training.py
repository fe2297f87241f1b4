"""Gradient passes, rounds, scoring and search against NumPy on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.operators import history as H
from wattline.plans import fitting as T
from wattline.plans import rounds as R
from wattline.plans.search import draw_trials, fit_trials, search
from wattline.sources.stores import load_checkpoint, trial_store


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    n, d = 240, 5
    x = rng.normal(size=(n, d)).astype(np.float32)
    y = (x @ rng.normal(size=d) + rng.normal(size=n) > 0.8).astype(int)
    client = rng.choice([0, 1, 2], n, p=[0.7, 0.2, 0.1])  # one client holds most rows
    return x.astype(float), y, client


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, c = data
    table = [(int(k), [float(v) for v in a], int(b)) for a, b, k in zip(x, y, c)]
    return spark.createDataFrame(table, "client_id int, x array<float>, y int").repartition(6).cache()


def loss(weights, x, y, pw):
    h = x
    for i in range(0, len(weights), 2):
        h = h @ weights[i] + weights[i + 1]
        if i + 2 < len(weights):
            h = np.maximum(h, 0)
    q = 1 / (1 + np.exp(-h[:, 0]))
    return -(pw * y * np.log(q) + (1 - y) * np.log(1 - q)).mean()


@pytest.mark.parametrize("hidden", [(), (4,), (4, 3)])
def test_gradient_is_the_slope_of_the_loss(rows, data, hidden):
    x, y, c = data
    weights = T.init_weights(5, hidden, 1)
    if not hidden:
        weights = [w + 0.1 for w in weights]
    got = T.gradient_pass(rows, {k: weights for k in (0, 1, 2)}, {0: 2.0, 1: 3.0, 2: 1.0}, shared=False)
    for k, pw in ((0, 2.0), (1, 3.0), (2, 1.0)):
        grad, value, n = got[k]
        mine = c == k
        assert n == mine.sum() and np.isclose(value, loss(weights, x[mine], y[mine], pw))
        v, eps = T.flat(weights), 1e-6
        for j in range(len(v)):
            up, down = v.copy(), v.copy()
            up[j] += eps
            down[j] -= eps
            slope = (loss(T.unflat(up, weights), x[mine], y[mine], pw) - loss(T.unflat(down, weights), x[mine], y[mine], pw)) / (2 * eps)
            assert np.isclose(grad[j], slope, atol=1e-5)


def best_f1(y, p):
    best = 0.0
    for t in np.arange(0.01, 0.5, 0.01):
        tp = ((p >= t) & (y == 1)).sum()
        best = max(best, 2 * tp / ((p >= t).sum() + y.sum()))
    return best


def fit_alone(x, y, w, epochs, lr, decay, mu, pw, patience):
    """Weights of the pass with the best F1, F1 of the last pass, number of passes."""
    anchor, xb, best, kept, stale = w.copy(), np.hstack([x, np.ones((len(x), 1))]), -1.0, None, 0
    for done in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-xb @ w))
        g = (xb * ((1 - y) * p - pw * y * (1 - p))[:, None]).mean(axis=0)
        w = w * (1 - lr * decay) - lr * (g + mu * (w - anchor))
        f1 = best_f1(y, 1 / (1 + np.exp(-xb @ w)))
        if f1 > best:
            best, kept, stale = f1, w, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return kept, f1, done


@pytest.mark.parametrize("mu,patience", [(0.0, 10), (0.5, 10), (0.0, 1)])
def test_rounds_equal_clients_fitted_alone(spark, rows, data, mu, patience, tmp_path):
    x, y, c = data
    path = str(tmp_path / "ck")
    done = R.federated_rounds(
        rows, rows, 2, 4, 0.7, 0.01, mu, 4.0, patience=patience, run="r", checkpoint=path, config={"mu": mu}
    )
    w, passes = np.zeros(6), {}
    for r in (1, 2):
        parts = []
        for k in (0, 1, 2):
            mine = c == k
            pw = min((y[mine] == 0).sum() / y[mine].sum(), 4.0)
            kept, f1, passes[r, k] = fit_alone(x[mine], y[mine], w, 4, 0.7, 0.01, mu, pw, patience)
            parts.append((mine.sum(), kept))
        w = sum(n * v for n, v in parts) / sum(n for n, _ in parts)
    np.testing.assert_allclose(T.flat(done.weights), w, atol=1e-10)
    told = {(r["round"], r["client_id"]): r["count"] for r in done.epochs.groupBy("round", "client_id").count().collect()}
    assert told == passes
    last = done.fit_results.where("round = 2 and client_id = 2").first()["metrics"]
    assert last["val_f1"] == pytest.approx(f1)
    saved = load_checkpoint(spark, path, "r")
    np.testing.assert_array_equal(T.flat(saved["weights"]), T.flat(done.weights))
    assert saved["threshold"] == 0.5 and saved["metrics"].keys() == {"train_loss", "val_f1", "num_examples", "input_dim"}
    assert saved["metrics"]["input_dim"] == pytest.approx(5.0)
    assert [(r["metric"], r["round"]) for r in done.history.collect()] == [("f1", 1), ("f1", 2), ("pr_auc", 1), ("pr_auc", 2)]
    means = {r["metric"]: r["value"] for r in H.weighted_eval_metrics(done.eval_results.where("round = 2")).collect()}
    told = [r["metrics"]["f1"] for r in done.eval_results.where("round = 2").collect()]
    assert min(told) <= means["f1"] <= max(told)


def test_some_clients_take_part(rows):
    done = R.federated_rounds(rows, rows, 3, 1, 0.3, fraction=0.5, fraction_evaluate=0.1, min_clients=2, cap=None)
    per_round = done.fit_results.groupBy("round").count().collect()
    assert {r[0]: r[1] for r in per_round} == {1: 2, 2: 2, 3: 2}
    assert done.eval_results.count() == 6


def test_average_weights(spark):
    df = spark.createDataFrame([(0, 10, [1.0, 2.0]), (1, 30, [5.0, 2.0])], "client_id int, num_examples bigint, w array<double>")
    assert {r["pos"]: r["value"] for r in T.average_weights(df).collect()} == {0: 4.0, 1: 2.0}


def test_score_and_final_evaluation(rows, data):
    x, y, c = data
    weights = [w + 0.2 for w in T.init_weights(5)]
    scores = T.score(rows, weights, ["client_id", "y"])
    got = scores.toPandas()
    want = x.sum(axis=1) * 0.2 + 0.2
    np.testing.assert_allclose(np.sort(got["logit"]), np.sort(want), atol=1e-9)
    final = R.evaluate_final(scores, threshold=0.55)
    assert final["threshold"] == 0.55
    cells = {(r["y"], r["pred"]): r["n"] for r in final["matrix"].collect()}
    called = 1 / (1 + np.exp(-want)) >= 0.55
    assert cells == {(a, b): int(((y == a) & (called == b)).sum()) for a in (0, 1) for b in (0, 1)}
    assert R.evaluate_final(scores)["f1"] == final["f1"]
    many = T.score(rows, {0: weights, 7: T.init_weights(5)}, ["y"])
    assert many.groupBy("model").count().where(F.col("count") == len(y)).count() == 2


def test_search(spark, rows, tmp_path):
    path = str(tmp_path / "trials")
    out = search(rows, rows, trials=4, epochs=3, study="s", store=path, hidden=[4], layers=(0, 2))
    assert out.groupBy("trial").count().where("count = 3").count() == 4
    best = H.best_trial(trial_store(spark, path, "s")).first()
    assert best["value"] == out.agg(F.max("value")).first()[0] and "lr" in best["params"]
    assert draw_trials(5, 1) == draw_trials(5, 1) != draw_trials(5, 2)


def test_search_stops_stale_and_weak_trials(rows):
    still = {"lr": 0.0, "weight_decay": 0.0, "pos_weight_cap": 5.0, "hidden_size": 0, "num_layers": 0}
    good = {**still, "lr": 0.5}
    out = fit_trials(rows, rows, [still, good, good], epochs=5, patience=2, warmup=10)
    assert out.where("trial = 0").count() == 3  # one gain from zero, then two passes without
    pruned = fit_trials(rows, rows, [still, good, good], epochs=4, patience=9, warmup=2, startup=2)
    assert pruned.where("trial = 0").count() == 2 and pruned.where("trial = 1").count() == 4
