"""Tables of trials, checkpoints and metric histories."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.fixed_values import DEFAULT_THRESHOLD
from wattline.sources.commits import append_part, read_parts, take_numbers

TRIALS = (
    "study string, trial int, step int, value double, params map<string,string>, best_threshold double"
)
CHECKPOINT = (
    "run string, round int, tensor int, shape array<int>, values array<double>, config string, "
    "threshold double, metrics map<string,double>, saved bigint"
)
HISTORY = "run string, round int, metric string, value double"


def append_trials(trials: DataFrame, path: str, token: str | None = None) -> bool:
    """Add reports of trials; with a ``token`` an append that is tried again adds nothing."""
    return append_part(trials, path, "study", token)


def take_trials(spark: SparkSession, path: str, study: str, count: int) -> list[int]:
    """Numbers of new trials of a study, after those that the table knows; no two searches get the same."""
    last = trial_store(spark, path, study).agg(F.max("trial")).first()[0]
    return take_numbers(spark, path, study, count, 0 if last is None else last + 1)


def trial_store(spark: SparkSession, path: str, study: str | None = None) -> DataFrame:
    """Reported values of a study; created by the first append, reread by everyone after it."""
    trials = read_parts(spark, path, TRIALS)
    return trials if study is None else trials.where(F.col("study") == study)


def append_history(history: DataFrame, path: str, run: str, token: str | None = None) -> bool:
    """Add the metrics of a run's rounds (round, metric, value) to the table of histories."""
    return append_part(history.select(F.lit(run).alias("run"), F.col("round").cast("int"), "metric", "value"), path, "run", token)


def history_store(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Stored rows (run, round, metric, value), as often as they were told; empty before the first."""
    history = read_parts(spark, path, HISTORY)
    return history if run is None else history.where(F.col("run") == run)


def save_checkpoint(
    spark: SparkSession, path: str, run: str, round_no: int, weights: Sequence[np.ndarray],
    config: Mapping | None = None, threshold: float = DEFAULT_THRESHOLD, metrics: Mapping[str, float] | None = None,
) -> None:
    """One row per weight tensor, with settings, threshold and metrics.

    Saves of a run are numbered, and a number is given out once: what was saved last counts, also when a round is saved
    again.  A save that stops on the way leaves the one before it.
    """
    saved = take_numbers(spark, path, run, 1)[0]
    rows = [
        (run, round_no, i, list(map(int, w.shape)), [float(v) for v in w.ravel()], json.dumps(dict(config or {})),
         float(threshold), {k: float(v) for k, v in (metrics or {}).items()}, saved)
        for i, w in enumerate(weights)
    ]
    append_part(spark.createDataFrame(rows, CHECKPOINT), path, "run")


def load_checkpoint(spark: SparkSession, path: str, run: str) -> dict:
    """Weights in tensor order of the last save of a run, its round, settings, threshold (0.5) and metrics ({})."""
    table = read_parts(spark, path, CHECKPOINT).where(F.col("run") == run)
    last = table.agg(F.max("saved").alias("s")).scalar()
    rows = table.where(F.col("saved") == last).orderBy("tensor").collect()
    if not rows:
        raise FileNotFoundError(f"no checkpoint of run {run!r} in {path}")
    first = rows[0]
    return {
        "round": first["round"],
        "weights": [np.array(r["values"]).reshape(r["shape"]) for r in rows],
        "config": json.loads(first["config"] or "{}"),
        "threshold": DEFAULT_THRESHOLD if first["threshold"] is None else first["threshold"],
        "metrics": first["metrics"] or {},
    }
