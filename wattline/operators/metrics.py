"""Losses, classification metrics, threshold sweep and score curves, for all rows or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import columns as C
from wattline.functions.fixed_values import CLASS_NAMES, DEFAULT_THRESHOLD, SWEEP_COUNT
from wattline.operators.ordering import running_totals


def positive_weight(label: str, cap: float | None, on_missing: str = "error") -> Column:
    """Negatives per positive, capped; without positives an error, or null with ``on_missing='skip'``."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    ratio = neg.cast("double") / pos
    value = F.least(ratio, F.lit(float(cap))) if cap else ratio
    if on_missing == "skip":
        return F.when(pos > 0, value)
    return F.when(pos > 0, value).otherwise(F.raise_error(F.lit("no positive labels")).cast("double"))


def pos_weight(
    df: DataFrame, label: str = "y", cap: float | None = None, by: Sequence[str] = (), on_missing: str = "error"
) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
        positive_weight(label, cap, on_missing).alias("pos_weight"),
    )


def bce_loss(
    df: DataFrame, logit: str = "logit", label: str = "y", cap: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Mean weighted loss, class weight from the same rows.

    The loss is linear in the weight, so the sums over positives and negatives and the weight itself come
    from one pass.  A group without positives has no weight to apply and keeps its plain loss.
    """
    positive, row = F.col(label) == 1, C.bce_row(logit, label)
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(positive, row).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(~positive, row).otherwise(0.0)).alias("_neg"),
        F.coalesce(positive_weight(label, cap, "skip"), F.lit(1.0)).alias("pos_weight"),
    )
    loss = (F.col("_pos") * F.col("pos_weight") + F.col("_neg")) / F.col("n")
    return sums.select(*by, "n", "pos_weight", loss.alias("loss"))


def cross_entropy(df: DataFrame, scores: str = "scores", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Mean multi-class loss, and how many rows have their label as the largest score."""
    return df.groupBy(*by).agg(
        F.avg(C.cross_entropy_row(scores, label)).alias("loss"),
        F.count_if(C.argmax_class(scores) == F.col(label)).alias("correct"),
        F.count(F.lit(1)).alias("total"),
    )


def _cells(df: DataFrame, label: str, pred: str, by: Sequence[str]) -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
    )


def confusion_matrix(df: DataFrame, label: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Rows (y, pred, n) for all four cells, zeros included."""
    cells = F.inline(
        F.array(
            *[
                F.struct(F.lit(y).alias("y"), F.lit(p).alias("pred"), F.col(c).alias("n"))
                for y, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
            ]
        )
    )
    return _cells(df, label, pred, by).select(*by, cells)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def binary_scores(df: DataFrame, label: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, accuracy, F1 of class 1; null where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return _cells(df, label, pred, by).select(
        *by, "tn", "fp", "fn", "tp",
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        F.try_divide(2.0 * precision * recall, precision + recall).alias("f1"),
    )


def class_report(
    df: DataFrame, label: str = "y", pred: str = "pred", names: dict[int, str] | None = None
) -> DataFrame:
    """Precision, recall, F1, support per class, then accuracy, macro and weighted averages; 0 where undefined.

    Everything after the first count works on at most classes² rows.
    """
    pairs = df.groupBy(F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    sides = F.inline(
        F.array(
            F.struct(F.col("y").alias("class"), F.col("n").alias("support"), zero.alias("called"), hit.alias("tp")),
            F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("n").alias("called"), zero.alias("tp")),
        )
    )
    per = pairs.select(sides).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp")
    )

    def rate(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    name = F.col("class").cast("string")
    for code, text in (CLASS_NAMES if names is None else names).items():
        name = F.when(F.col("class") == code, F.lit(text)).otherwise(name)
    scored = per.select(
        name.alias("name"),
        rate(F.col("tp"), F.col("called")).alias("precision"),
        rate(F.col("tp"), F.col("support")).alias("recall"),
        rate(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"),
        "support", "tp",
    )
    measures = ("precision", "recall", "f1")
    totals = scored.agg(
        F.collect_list(F.struct("name", *measures, "support")).alias("classes"),
        F.sum("support").alias("support"),
        rate(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[rate(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
    )

    def line(title: str, cols: Sequence[str]) -> Column:
        return F.struct(
            F.lit(title).alias("name"), *[F.col(c).alias(m) for c, m in zip(cols, measures)], F.col("support")
        )

    summary = F.array(
        line("accuracy", ["accuracy"] * 3),
        line("macro avg", [f"macro_{m}" for m in measures]),
        line("weighted avg", [f"weighted_{m}" for m in measures]),
    )
    return totals.select(F.inline(F.concat("classes", summary)))


def sweep_counts(buckets: DataFrame, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """From rows and positives per bucket ``i`` (0…49) to those at or above each threshold 1…49.

    The sums run over at most 50 lines per group.  Totals of the ``extra`` columns go along.
    """
    filled = buckets.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("i", F.struct("n", "pos")))).alias("_at"),
        F.sum("n").alias("total"),
        F.sum("pos").alias("positives"),
        *[F.sum(e).alias(e) for e in extra],
    )
    every = filled.select("*", F.explode(F.sequence(F.lit(0), F.lit(SWEEP_COUNT))).alias("i"))
    got = F.element_at("_at", F.col("i"))
    from_top = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    return every.select(
        *by, "i", "total", "positives", *extra,
        F.sum(F.coalesce(got["n"], F.lit(0))).over(from_top).alias("called"),
        F.sum(F.coalesce(got["pos"], F.lit(0))).over(from_top).alias("tp"),
    ).where("i > 0").withColumn("threshold", C.sweep_threshold(F.col("i"))).withColumn(
        "f1", f1_of(F.col("tp"), F.col("called") - F.col("tp"), F.col("positives") - F.col("tp"))
    )


def best_threshold(counts: DataFrame, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    best = counts.groupBy(*by).agg(
        F.min(F.struct((-F.col("f1")).alias("loss"), "threshold")).alias("b"),
        *[F.max(e).alias(e) for e in extra],
    )
    some = F.col("b.loss") < 0
    return best.select(
        *by,
        F.when(some, -F.col("b.loss")).otherwise(0.0).alias("best_f1"),
        F.when(some, F.col("b.threshold")).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("best_threshold"),
        *extra,
    )


def _buckets(df: DataFrame, prob: str, label: str, by: Sequence[str]) -> DataFrame:
    """Each score is put in its bucket once, whatever the number of thresholds."""
    return df.groupBy(*by, C.sweep_bucket(prob).alias("i")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )


def threshold_curve(df: DataFrame, prob: str = "prob", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """F1 at each of the 49 thresholds."""
    return sweep_counts(_buckets(df, prob, label, by), by).select(*by, "threshold", "f1")


def threshold_sweep(df: DataFrame, prob: str = "prob", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Best F1 and its threshold, the lowest one on ties; (0, 0.5) if no threshold scores above 0."""
    return best_threshold(sweep_counts(_buckets(df, prob, label, by), by), by)


def _curve(
    df: DataFrame, prob: str, label: str, by: Sequence[str], sums: Sequence[Column] = (), rows: int | None = None
) -> DataFrame:
    """One line per distinct score with rows and positives at it and ahead of it, and its share of both areas.

    Rows collapse to distinct scores before any ordering; the running counts are exact totals over range
    slices, so neither a popular score nor a large group ends up in one task.
    """
    distinct = df.groupBy(*by, prob).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"), *sums
    )
    lines = running_totals(distinct, by, [F.desc(prob)], ["n", "pos"], rows)
    n, pos, ahead_n, ahead_pos = (F.col(c) for c in ("n", "pos", "ahead_n", "ahead_pos"))
    return lines.withColumn("_ap", pos * ((ahead_pos + pos) / (ahead_n + n))).withColumn(
        "_auc", (n - pos) * (ahead_pos + pos / F.lit(2.0))
    )


def _areas(n: Column, n_pos: Column) -> list[Column]:
    return [
        F.coalesce(F.try_divide(F.col("_ap"), n_pos), F.lit(0.0)).alias("pr_auc"),
        F.try_divide(F.col("_auc"), (n_pos * (n - n_pos)).cast("double")).alias("roc_auc"),
    ]


def score_areas(df: DataFrame, prob: str = "prob", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Average precision (steps over distinct scores) and ROC area (ties count half), exactly."""
    sums = _curve(df, prob, label, by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum("_ap").alias("_ap"), F.sum("_auc").alias("_auc")
    )
    return sums.select(*by, "n", "n_pos", *_areas(F.col("n"), F.col("n_pos")))


def evaluate_scores(
    df: DataFrame, logit: str = "logit", prob: str = "prob", label: str = "y", by: Sequence[str] = (),
    cap: float | None = None, rows: int | None = None,
) -> DataFrame:
    """Loss, best F1 and threshold, both areas and counts per group, from one pass over the scores.

    Everything after the distinct scores is sums over buckets of them.  ``rows`` is the number of scored
    rows, where the caller knows it.
    """
    by = list(by)
    positive, row = F.col(label) == 1, C.bce_row(logit, label)
    lines = _curve(df, prob, label, by, [
        F.sum(F.when(positive, row).otherwise(0.0)).alias("_loss1"),
        F.sum(F.when(~positive, row).otherwise(0.0)).alias("_loss0"),
    ], rows)
    extra = ["_ap", "_auc", "_loss1", "_loss0"]
    buckets = lines.groupBy(*by, C.sweep_bucket(prob).alias("i")).agg(*[F.sum(c).alias(c) for c in ("n", "pos", *extra)])
    out = best_threshold(sweep_counts(buckets, by, extra), by, ["total", "positives", *extra])
    n, n_pos = F.col("total"), F.col("positives")
    ratio = F.try_divide((n - n_pos).cast("double"), n_pos)
    weight = F.coalesce(F.least(ratio, F.lit(float(cap))) if cap else ratio, F.lit(1.0))
    return out.select(
        *by, n.alias("n"), weight.alias("pos_weight"),
        ((F.col("_loss1") * weight + F.col("_loss0")) / n).alias("loss"),
        "best_f1", "best_threshold", *_areas(n, n_pos),
    )


def average_precision(df: DataFrame, prob: str = "prob", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return score_areas(df, prob, label, by).select(*by, "pr_auc")


def roc_auc(df: DataFrame, prob: str = "prob", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return score_areas(df, prob, label, by).select(*by, "roc_auc")
