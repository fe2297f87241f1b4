"""Client metrics, early stopping, pruning, best trial, quality checks."""

import numpy as np
import pytest

from wattline.functions.fixed_values import METADATA_KEYS
from wattline.operators import history as H

RESULTS = "round int, client_id int, num_examples bigint, metrics map<string,double>"


def test_denominator_counts_all_clients(spark):
    df = spark.createDataFrame([(1, 0, 10, {"f1": 0.5}), (1, 1, 30, {"pr_auc": 0.2})], RESULTS)
    got = {r["metric"]: r["value"] for r in H.weighted_eval_metrics(df).collect()}
    assert got == {"f1": 0.125, "pr_auc": pytest.approx(0.15)}
    assert sorted(r[0] for r in H.metric_keys(df).collect()) == ["f1", "pr_auc"]
    assert H.weighted_fit_metrics(df).count() == 0


def test_no_rows_no_metrics(spark):
    assert H.weighted_eval_metrics(spark.createDataFrame([(1, 0, 0, {"f1": 0.5})], RESULTS)).count() == 0


def test_last_round_in_one_row(spark):
    rows = [(1, 0, 5, {"train_loss": 9.0}), (2, 0, 1, {"train_loss": 1.0, "threshold": 0.2}), (2, 1, 3, {"train_loss": 3.0})]
    got = H.weighted_all_metrics(spark.createDataFrame(rows, RESULTS)).first()
    assert got["threshold"] == pytest.approx(0.05) and got["metrics"] == {"train_loss": pytest.approx(2.5)}
    bare = H.weighted_all_metrics(spark.createDataFrame(rows[:1], RESULTS)).first()
    assert bare["threshold"] == 0.5


def test_metric_history(spark):
    rows = [(r, c, 10, {"f1": r / 10 + c / 100, "loss": 1.0}) for r in (2, 1) for c in (0, 1)]
    got = H.metric_history(spark.createDataFrame(rows, RESULTS)).collect()
    assert [(r["round"], r["metric"]) for r in got] == [(1, "f1"), (2, "f1")]
    np.testing.assert_allclose([r["value"] for r in got], [0.105, 0.205])


def stop(values, patience):
    best, at, stale = -1.0, None, 0
    for i, v in enumerate(values, 1):
        if v > best:
            best, at, stale = v, i, 0
        else:
            stale += 1
            if stale >= patience:
                return at, best, i, v, True
    return at, best, len(values), values[-1], False


@pytest.mark.parametrize("patience", [1, 2, 3])
def test_early_stop(spark, patience):
    rng = np.random.default_rng(patience)
    runs = {0: [0.1, 0.3, 0.3, 0.2, 0.1], 1: [0.0], **{k: rng.integers(0, 5, 12).astype(float).tolist() for k in range(2, 12)}}
    df = spark.createDataFrame([(k, i, v) for k, vs in runs.items() for i, v in enumerate(vs, 1)], "run int, epoch int, val_f1 double")
    for r in H.early_stop(df, patience, ["run"]).collect():
        assert tuple(r)[1:] == stop(runs[r["run"]], patience)


def prune(values, warmup, startup):
    """values: trial -> list by step 1…; first step where best so far < median of the others there."""
    out = {}
    for t, vs in values.items():
        for s in range(warmup, len(vs) + 1):
            others = [o[s - 1] for u, o in values.items() if u != t and len(o) >= s]
            if len(others) >= startup and max(vs[:s]) < np.median(others):
                out[t] = s
                break
    return out


@pytest.mark.parametrize("trials,warmup,startup", [(8, 3, 5), (7, 2, 2), (3, 1, 1), (2, 1, 1), (6, 2, 6)])
def test_median_prune(spark, trials, warmup, startup):
    rng = np.random.default_rng(trials)
    values = {t: rng.integers(0, 9, int(rng.integers(2, 7))).astype(float).tolist() for t in range(trials)}
    rows = [("s", t, i, v) for t, vs in values.items() for i, v in enumerate(vs, 1)]
    got = H.median_prune(spark.createDataFrame(rows, "study string, trial int, step int, value double"), warmup, startup)
    assert {r["trial"]: r["pruned_at"] for r in got.collect()} == prune(values, warmup, startup)


def test_best_trial_keeps_its_record(spark):
    rows = [("s", 0, 0.5, "a"), ("s", 1, 0.7, "b"), ("s", 2, 0.7, "c"), ("t", 5, 0.1, "d")]
    got = H.best_trial(spark.createDataFrame(rows, "study string, trial int, value double, note string")).collect()
    assert sorted(tuple(r) for r in got) == [("s", 1, 0.7, "b"), ("t", 5, 0.1, "d")]


def test_quality(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 0.1, 0), (nan, 0.2, 0), (inf, None, 0)]
    df = spark.createDataFrame(rows, "a double, score double, y int")
    checks = H.quality_checks(df, ["a"], "y", "score", ["input_dim"]).collect()
    assert [(r["check"], r["status"], r["n"]) for r in checks] == [
        ("dataset:inf_input", "WARNING", 1),
        ("dataset:metadata", "WARNING", 4),
        ("dataset:nan_input", "WARNING", 1),
        ("model:batch_mismatch", "WARNING", 1),
        ("train:two_classes", "WARNING", 1),
    ]
    unscored = H.quality_checks(df, ["a"], "y", meta=METADATA_KEYS)
    assert unscored.collect()[-1]["status"] == "SKIPPED"
    verdict = H.quality_report(unscored).first()
    assert (verdict["total"], verdict["warnings"], verdict["skipped"], verdict["overall"]) == (5, 3, 1, "MOSTLY HEALTHY")
    mixed = spark.createDataFrame([("b", "OK"), ("a", "SKIPPED"), ("c", "FAIL"), ("d", "WARNING")], "check string, status string")
    assert [r["status"] for r in H.order_checks(mixed).collect()] == ["FAIL", "WARNING", "OK", "SKIPPED"]
    assert H.quality_report(mixed).first()["overall"] == "FAILING"
    fine = spark.createDataFrame([(1.0, 0.1, 0), (2.0, 0.3, 1)], "a double, score double, y int")
    assert H.quality_report(H.quality_checks(fine, ["a"], "y", "score")).first()["overall"] == "HEALTHY"
