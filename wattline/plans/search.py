"""Search over training settings: all trials share each pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.fixed_values import DEFAULT_THRESHOLD
from wattline.operators import metrics as M
from wattline.operators.history import median_prune
from wattline.plans.fitting import example_columns, gradient_pass, init_weights, input_width, labels, score, step
from wattline.sources.stores import TRIALS, append_trials, take_trials

# Ranges of the settings tried.
SPACE = {
    "lr": (1e-4, 1e-2),
    "weight_decay": (1e-4, 1e-1),
    "pos_weight_cap": (5.0, 20.0),
    "hidden_size": [64, 128, 256, 512],
    "num_layers": (1, 5),
}


def draw_trials(
    trials: int, seed: int = 42, hidden: Sequence[int] | None = None, layers: tuple[int, int] | None = None, first: int = 0,
) -> list[dict]:
    """Seeded draws number ``first`` and on: log-uniform rates, uniform cap, width and depth of the hidden layers."""
    rng = np.random.default_rng(seed)

    def log_uniform(name: str) -> float:
        low, high = SPACE[name]
        return float(np.exp(rng.uniform(np.log(low), np.log(high))))

    widths, depth = list(hidden or SPACE["hidden_size"]), layers or SPACE["num_layers"]
    return [
        {
            "lr": log_uniform("lr"),
            "weight_decay": log_uniform("weight_decay"),
            "pos_weight_cap": float(rng.uniform(*SPACE["pos_weight_cap"])),
            "hidden_size": int(rng.choice(widths)),
            "num_layers": int(rng.integers(depth[0], depth[1] + 1)),
        }
        for _ in range(first + trials)
    ][first:]


def fit_trials(
    train: DataFrame, val: DataFrame, settings: Sequence[dict], epochs: int = 10, patience: int = 10,
    study: str = "study", seed: int = 42, warmup: int = 10, startup: int = 5, first: int = 0,
) -> DataFrame:
    """Fit one model per setting, numbered from ``first``; report (trial, step, pr_auc, best threshold) after every pass.

    One job computes the gradients of all running trials, one scores the validation rows with all of
    them.  A trial ends after ``patience`` passes without gain, or when :func:`median_prune`
    says so of the reports so far.
    """
    spark = train.sparkSession
    train = train.select(*example_columns(train)).persist(StorageLevel.MEMORY_AND_DISK)
    val = val.select(*example_columns(val)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        raw = M.pos_weight(labels(train)).first()["pos_weight"]
        width = input_width(train)
        models = {
            i: init_weights(width, [s["hidden_size"]] * s["num_layers"] if s["hidden_size"] else [], seed + i)
            for i, s in enumerate(settings, first)
        }
        settings = dict(enumerate(settings, first))
        caps = {i: min(raw, s["pos_weight_cap"]) for i, s in settings.items()}
        best = {i: (0.0, DEFAULT_THRESHOLD, 0) for i in models}
        reports: list[tuple] = []
        running, val_rows = set(models), labels(val).count()
        for epoch in range(1, epochs + 1):
            live = {i: models[i] for i in sorted(running)}
            for i, (grad, _, _) in gradient_pass(train, live, caps, shared=True).items():
                models[i] = step(models[i], grad, settings[i]["lr"], settings[i]["weight_decay"])
            scores = score(val, {i: models[i] for i in sorted(running)}, ["y"])
            found = M.evaluate_scores(scores, by=["model"], rows=val_rows * len(running)).collect()
            areas = {r["model"]: r["pr_auc"] for r in found}
            cuts = {r["model"]: r["best_threshold"] for r in found}
            for i in sorted(running):
                value, cut, stale = best[i]
                best[i] = (areas[i], cuts[i], 0) if areas[i] > value else (value, cut, stale + 1)
                told = {k: str(v) for k, v in settings[i].items()}
                reports.append((study, i, epoch, float(areas[i]), told, float(best[i][1])))
            if epoch >= warmup and len(running) > startup:
                pruned = median_prune(spark.createDataFrame(reports, TRIALS), warmup, startup)
                running -= {r["trial"] for r in pruned.where(F.col("pruned_at") == epoch).collect()}
            running = {i for i in running if best[i][2] < patience}
            if not running:
                break
        return spark.createDataFrame(reports, TRIALS)
    finally:
        train.unpersist()
        val.unpersist()


def search(
    train: DataFrame, val: DataFrame, trials: int = 50, epochs: int = 10, patience: int = 10, study: str = "study",
    seed: int = 42, store: str | None = None, hidden: Sequence[int] | None = None,
    layers: tuple[int, int] | None = None,
) -> DataFrame:
    """Draw settings, fit them all, append the reports to the trial table if one is named.

    A study that the table already knows is continued: numbers and draws go on after its last trial.  Searches that
    run at once in one study share its numbers, and the reports of one are added once, also when adding is tried again.
    """
    numbers = take_trials(train.sparkSession, store, study, trials) if store else list(range(trials))
    drawn = draw_trials(max(numbers, default=-1) + 1, seed, hidden, layers)
    # numbers follow each other unless another search took some in between; each run of them is fitted together
    starts = [n for n in numbers if n - 1 not in numbers]
    ends = [n + 1 for n in numbers if n + 1 not in numbers]
    reports = reduce(DataFrame.unionAll, [
        fit_trials(train, val, drawn[a:b], epochs, patience, study, seed, first=a) for a, b in zip(starts, ends)
    ] or [train.sparkSession.createDataFrame([], TRIALS)])
    if store and numbers:
        append_trials(reports, store, f"{study.encode().hex()}-{numbers[0]}")
    return reports
