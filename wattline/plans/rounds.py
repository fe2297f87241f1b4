"""Rounds of local fits and weight averaging, and evaluation per round and at the end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import columns as C
from wattline.functions.fixed_values import DEFAULT_THRESHOLD
from wattline.operators import metrics as M
from wattline.operators.history import metric_history, weighted_all_metrics
from wattline.operators.ordering import hash_token, mark_lowest
from wattline.operators.vectors import mean_vector
from wattline.plans import states
from wattline.plans.fitting import (
    Weights, example_columns, flat, init_weights, input_width, labels, local_fit, score, unflat, weight_rows,
)
from wattline.session import stored
from wattline.sources.stores import save_checkpoint

RESULTS = "round int, client_id int, num_examples bigint, metrics map<string,double>"
# weights of all clients that may travel through the driver and a broadcast
SENT_BYTES = 64 << 20
EPOCHS = (
    "round int, client_id int, epoch int, train_loss double, val_loss double, val_f1 double, best_thresh double, "
    "pr_auc double"
)


@dataclass
class Federated:
    weights: Weights
    fit_results: DataFrame
    eval_results: DataFrame
    history: DataFrame
    epochs: DataFrame
    threshold: float
    metrics: dict[str, float] = field(default_factory=dict)


def evaluate_round(scores: DataFrame, cap: float | None = None, rows: int | None = None) -> DataFrame:
    """Client results of one evaluation, named as they are averaged."""
    return M.evaluate_scores(scores, by=["client_id"], cap=cap, rows=rows).select(
        "client_id", F.col("n").alias("num_examples"), "loss",
        F.create_map(
            F.lit("f1"), F.col("best_f1"), F.lit("pr_auc"), F.col("pr_auc"), F.lit("threshold"), F.col("best_threshold")
        ).alias("metrics"),
    )


def evaluate_final(scores: DataFrame, threshold: float | None = None, cap: float | None = None) -> dict:
    """Held-out evaluation: summary row, class report, confusion matrix.

    F1 in the summary is the one at the best threshold; report and matrix use ``threshold`` if given.  The scores are
    stored first, so each row is scored once for all three.
    """
    scores = stored(scores.select("y", "logit", "prob"))
    summary = M.evaluate_scores(scores, cap=cap).first()
    used = summary["best_threshold"] if threshold is None else threshold
    called = scores.select("y", C.decide("prob", used).alias("pred"))
    return {
        "loss": summary["loss"], "f1": summary["best_f1"], "pr_auc": summary["pr_auc"],
        "roc_auc": summary["roc_auc"], "threshold": used,
        "report": M.class_report(called), "matrix": M.confusion_matrix(called),
    }


def client_weights(rows: DataFrame, cap: float | None) -> dict[int, float]:
    """Class weight of each client; a client without positives weighs its (absent) positives by 1."""
    found = M.pos_weight(labels(rows, "client_id"), "y", cap, ["client_id"], "skip").collect()
    return {r["client_id"]: r["pos_weight"] if r["pos_weight"] is not None else 1.0 for r in found}


def chosen_clients(spark, clients: Sequence[int], fraction: float, least: int, round_no: int, seed: int) -> list[int]:
    if fraction >= 1.0 or least >= len(clients):
        return list(clients)
    take = min(len(clients), max(int(len(clients) * fraction), least))
    table = spark.createDataFrame([(c,) for c in clients], "client_id int")
    marked = mark_lowest(
        table, hash_token(seed, F.concat_ws(":", F.lit(round_no), "client_id")), lambda n: F.lit(take), (), "_in"
    )
    return sorted(r["client_id"] for r in marked.where("_in").collect())


def federated_rounds(
    train: DataFrame, val: DataFrame, rounds: int = 2, epochs: int = 2, lr: float = 1e-4, decay: float = 1e-4,
    mu: float = 0.0, cap: float | None = 10.0, hidden: Sequence[int] = (), start: Weights | None = None,
    fraction: float = 1.0, fraction_evaluate: float = 1.0, min_clients: int | None = None, seed: int = 42, patience: int = 10, run: str = "run",
    checkpoint: str | None = None, config: Mapping | None = None,
) -> Federated:
    """``rounds`` times: local fits with early stopping, average, evaluation of the average on each client's
    validation rows.

    ``train`` and ``val`` have client_id, x, y, or are strips of windows (:func:`wattline.plans.preparation.as_strips`).  They are kept in memory and on disk, since each pass reads
    them again; a lost executor only costs its share of the recomputation.  As long as the weights of all clients
    take at most ``SENT_BYTES`` they travel as broadcast arrays and as sums; beyond, they stay a table beside the
    rows (:mod:`wattline.plans.states`) and the driver sees the averaged model only.
    """
    spark = train.sparkSession
    # rows of a client lie together, so a task adds up few vectors; a big client still spreads over tasks
    train = train.select(*example_columns(train, "client_id")).repartitionByRange("client_id", F.xxhash64("x"))
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    val = val.select(*example_columns(val, "client_id")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if start is None:
            start = init_weights(input_width(train), hidden, seed)
        total = train.select("client_id").distinct().count()
        if total * flat(start).nbytes > SENT_BYTES:
            return _rounds_by_tables(
                train, val, total, start, rounds, epochs, lr, decay, mu, cap, fraction, fraction_evaluate, min_clients, seed,
                patience, run, checkpoint, config,
            )
        weights_of = client_weights(train, cap)
        clients = sorted(weights_of)
        least = len(clients) if min_clients is None else min_clients
        val_rows = labels(val).count()
        weights, fit_rows, eval_rows, epoch_rows = start, [], [], []
        for r in range(1, rounds + 1):
            taking = chosen_clients(spark, clients, fraction, least, r, seed)
            rows = train if len(taking) == len(clients) else train.where(F.col("client_id").isin(taking))
            fits = local_fit(
                rows, weights, taking, epochs, lr, decay, mu, weights_of, val, val_rows, cap, patience
            )
            weights = unflat(mean_vector(weight_rows(spark, fits, r), "num_examples", "w"), start)
            asked = chosen_clients(spark, clients, fraction_evaluate, least, r, seed + 1)
            shown = val if len(asked) == len(clients) else val.where(F.col("client_id").isin(asked))
            found = evaluate_round(score(shown, weights, ["client_id", "y"]), cap, val_rows).collect()
            for c, f in sorted(fits.items()):
                told = {"train_loss": f.train_loss, "num_examples": float(f.rows), "input_dim": float(start[0].shape[0])}
                if f.val_f1 is not None:
                    told["val_f1"] = f.val_f1
                fit_rows.append((r, c, f.rows, told))
                epoch_rows += [(r, c, *h.values()) for h in f.history]
            eval_rows += [(r, e["client_id"], e["num_examples"], e["metrics"]) for e in found]
        fit_results = spark.createDataFrame(fit_rows, RESULTS)
        eval_results = spark.createDataFrame(eval_rows, RESULTS)
        return _finished(
            spark, weights, fit_results, eval_results, spark.createDataFrame(epoch_rows, EPOCHS), rounds, run, checkpoint, config
        )
    finally:
        train.unpersist()
        val.unpersist()


def _finished(spark, weights, fit_results, eval_results, epochs, rounds, run, checkpoint, config) -> Federated:
    last = weighted_all_metrics(fit_results).first()
    threshold, means = last["threshold"] or DEFAULT_THRESHOLD, last["metrics"] or {}
    if checkpoint:
        save_checkpoint(spark, checkpoint, run, rounds, weights, config, threshold, means)
    return Federated(weights, fit_results, eval_results, metric_history(eval_results), epochs, threshold, means)


def _rounds_by_tables(
    train: DataFrame, val: DataFrame, total: int, start: Weights, rounds: int, epochs: int, lr: float, decay: float, mu: float,
    cap: float | None, fraction: float, fraction_evaluate: float, min_clients: int | None, seed: int, patience: int, run: str,
    checkpoint: str | None, config: Mapping | None,
) -> Federated:
    """:func:`federated_rounds` with client weights, results and epochs as tables."""
    spark, width = train.sparkSession, start[0].shape[0]
    least = total if min_clients is None else min_clients
    fits, shown = states.Layout(train), states.Layout(val)
    try:
        clients = states.client_table(train, cap)
        val_rows = labels(val).count()
        weights, fit_parts, eval_parts, epoch_parts = start, [], [], []
        for r in range(1, rounds + 1):
            taking = states.drawn_clients(clients, total, fraction, least, r, seed)
            done, told = states.fit_states(fits, taking, weights, epochs, lr, decay, mu, shown, val_rows, cap, patience)
            averaged = unflat(mean_vector(done.where("num_examples > 0"), "num_examples", "w"), start)
            fit_parts.append(stored(states.told_results(done, r, width)))
            if told is not None:
                epoch_parts.append(told.select(F.lit(r).alias("round"), *told.columns))
            weights = averaged
            asked = states.drawn_clients(clients, total, fraction_evaluate, least, r, seed + 1)
            if asked is clients:
                asked = shown.counts  # clients that only validate as well
            given = asked.select("client_id", F.lit(None).cast("array<double>").alias("w"))
            found = evaluate_round(states.scored(shown, given, weights), cap, val_rows)
            eval_parts.append(stored(found.select(F.lit(r).alias("round"), "client_id", "num_examples", "metrics")))
        fit_results, eval_results = (reduce(DataFrame.union, p) for p in (fit_parts, eval_parts))
        epoch_rows = reduce(DataFrame.union, epoch_parts) if epoch_parts else spark.createDataFrame([], EPOCHS)
        return _finished(spark, weights, fit_results, eval_results, epoch_rows, rounds, run, checkpoint, config)
    finally:
        fits.close()
        shown.close()
