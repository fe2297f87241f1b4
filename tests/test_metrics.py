"""Losses, reports, sweeps and areas against NumPy, overall and per group, with ties."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wattline.functions import columns as C
from wattline.operators import metrics as M

THRESHOLDS = np.arange(0.01, 0.5, 0.01)


def f1(y, called):
    tp, fp, fn = ((y == 1) & called).sum(), ((y == 0) & called).sum(), ((y == 1) & ~called).sum()
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def sweep(y, p):
    best = (0.0, 0.5)
    for t in THRESHOLDS:
        s = f1(y, p >= t)
        if s > best[0]:
            best = (s, t)
    return best


def ap(y, p):
    total, out, before = y.sum(), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        at = p >= t
        recall = y[at].sum() / total
        out += (recall - before) * y[at].mean()
        before = recall
    return out


def auc(y, p):
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


def bce(logit, y, w):
    q = 1 / (1 + np.exp(-logit))
    return -(w * y * np.log(q) + (1 - y) * np.log(1 - q)).mean()


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(11)
    n = 900
    y = (rng.random(n) < 0.3).astype(int)
    logit = np.round(rng.normal(-1, 1, n) + y * 0.7, 1)  # rounding makes ties
    group = rng.integers(0, 3, n)
    return y, logit, 1 / (1 + np.exp(-logit)), group


@pytest.fixture(scope="module")
def df(spark, scores):
    y, logit, p, g = scores
    rows = [(int(a), float(b), float(c), int(d)) for a, b, c, d in zip(y, logit, p, g)]
    return spark.createDataFrame(rows, "y int, logit double, prob double, g int").repartition(4).cache()


def test_evaluate_scores_per_group(df, scores):
    y, logit, p, g = scores
    for r in M.evaluate_scores(df, by=["g"], cap=2.0).collect():
        own = g == r["g"]
        w = min((y[own] == 0).sum() / y[own].sum(), 2.0)
        best = sweep(y[own], p[own])
        want = [own.sum(), w, bce(logit[own], y[own], w), *best, ap(y[own], p[own]), auc(y[own], p[own])]
        got = [r[c] for c in ("n", "pos_weight", "loss", "best_f1", "best_threshold", "pr_auc", "roc_auc")]
        np.testing.assert_allclose(got, want, rtol=1e-9)


def test_single_operators_agree(df, scores):
    y, logit, p, _ = scores
    assert np.isclose(M.average_precision(df).first()[0], ap(y, p))
    assert np.isclose(M.roc_auc(df).first()[0], auc(y, p))
    got = M.threshold_sweep(df).first()
    np.testing.assert_allclose([got["best_f1"], got["best_threshold"]], sweep(y, p))
    w = (y == 0).sum() / y.sum()
    assert np.isclose(M.bce_loss(df).first()["loss"], bce(logit, y, w))
    curve = M.threshold_curve(df).orderBy("threshold").collect()
    assert [r["threshold"] for r in curve] == THRESHOLDS.tolist()
    np.testing.assert_allclose([r["f1"] for r in curve], [f1(y, p >= t) for t in THRESHOLDS])


def test_scores_on_thresholds(spark):
    """Scores equal to a threshold, or one float step beside it, fall on the right side."""
    values = [v for t in THRESHOLDS for v in (t, np.nextafter(t, 0), np.nextafter(t, 1))] + [0.0, 1.0, 0.5, 0.499999]
    df = spark.createDataFrame([(float(v),) for v in values], "p double").select("p", C.sweep_bucket("p").alias("b"))
    for r in df.collect():
        assert r["b"] == (THRESHOLDS <= r["p"]).sum(), r


def test_score_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.4, 1), (0.1, 0)], "prob double, y int")
    assert np.isclose(M.average_precision(df).first()[0], 0.5 * (1 / 2) + 0.5 * (2 / 3))


def test_no_positive(spark):
    df = spark.createDataFrame([(0.3, 0, -1.0), (0.7, 0, 1.0)], "prob double, y int, logit double")
    with pytest.raises(PySparkException):
        M.pos_weight(df).collect()
    assert M.pos_weight(df, on_missing="skip").first()["pos_weight"] is None
    assert tuple(M.threshold_sweep(df).first()) == (0.0, 0.5)
    got = M.evaluate_scores(df).first()
    assert (got["best_f1"], got["best_threshold"], got["pr_auc"], got["roc_auc"]) == (0.0, 0.5, 0.0, None)
    assert got["loss"] == M.bce_loss(df).first()["loss"]


def test_matrix_values(spark):
    cells = [(0, 0, 24), (0, 1, 176), (1, 0, 7), (1, 1, 786)]
    df = spark.createDataFrame([(y, p) for y, p, n in cells for _ in range(n)], "y int, pred int")
    r = M.binary_scores(df).first()
    np.testing.assert_allclose(
        [r["precision"], r["recall"], r["accuracy"], r["f1"]], [0.81705, 0.99117, 0.81571, 0.89573], atol=5e-6
    )
    assert sorted(tuple(r) for r in M.confusion_matrix(df).collect()) == cells
    empty = M.binary_scores(df.where("y = 0 and pred = 0")).first()
    assert empty["precision"] is None and empty["recall"] is None and empty["accuracy"] == 1.0
    filled = M.confusion_matrix(df.where("y = 0 and pred = 0")).collect()
    assert sorted(tuple(r) for r in filled) == [(0, 0, 24), (0, 1, 0), (1, 0, 0), (1, 1, 0)]


def test_class_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0), (2, 2), (2, 2)], "y int, pred int")
    got = {r["name"]: r for r in M.class_report(df, names={}).collect()}
    np.testing.assert_allclose(
        [(got[n]["precision"], got[n]["recall"], got[n]["f1"], got[n]["support"]) for n in ("0", "1", "2")],
        [(0.5, 0.5, 0.5, 2), (0.5, 1.0, 2 / 3, 1), (1.0, 2 / 3, 0.8, 3)],
    )
    assert np.isclose(got["accuracy"]["f1"], 4 / 6) and got["macro avg"]["support"] == 6
    assert np.isclose(got["weighted avg"]["precision"], (2 * 0.5 + 0.5 + 3) / 6)


def test_cross_entropy(spark):
    s = np.array([[1.0, 2.0, 2.0], [800.0, 1.0, 0.0], [0.1, 0.2, 0.3]])
    y = np.array([1, 0, 0])
    df = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(s, y)], "scores array<double>, y int")
    top = s.max(axis=1)
    loss = (top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(3), y]).mean()
    got = M.cross_entropy(df).first()
    assert np.isclose(got["loss"], loss) and (got["correct"], got["total"]) == (2, 3)


def test_extreme_logits_stay_finite(spark):
    df = spark.createDataFrame([(1000.0, 1), (-1000.0, 0), (1000.0, 0)], "logit double, y int")
    got = df.select(C.bce_row("logit", "y", F.lit(3.0)).alias("l")).collect()
    assert [r["l"] for r in got] == [0.0, 0.0, 1000.0]
