"""Client metrics, round and epoch histories, trials, data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.fixed_values import DEFAULT_THRESHOLD, EVAL_METRICS, FIT_METRICS, METADATA_KEYS
from wattline.operators.ordering import POS, join_groups, positions

PRIOR = (Window.unboundedPreceding, -1)


def metric_keys(results: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Union of metric names over all clients."""
    return results.select(F.explode(F.map_keys(metrics)).alias("metric")).distinct()


def weighted_metrics(
    results: DataFrame, keys: Sequence[str] | None = None, by: Sequence[str] = (), count: str = "num_examples",
    metrics: str = "metrics",
) -> DataFrame:
    """Mean of each metric weighted by client rows, over the rows of **all** clients, reporting or not.

    The total travels as one more entry of the exploded map, so one aggregation does it; no rows, no result.
    """
    size = F.col(count).cast("double")
    kept = F.col(metrics) if keys is None else F.map_filter(metrics, lambda k, v: k.isin(list(keys)))
    parts = results.select(*by, size.alias("_n"), F.explode(kept).alias("metric", "value"))
    sums = parts.groupBy(*by, "metric").agg(F.sum(F.col("_n") * F.col("value")).alias("_s"))
    totals = results.groupBy(*by).agg(F.sum(size).alias("_total")).where("_total > 0")
    if by:
        joined = join_groups(sums, totals, list(by))
        total = F.col("_total")
    else:
        joined, total = sums, totals.scalar()
    value = F.col("_s") / total
    return joined.select(*by, "metric", value.alias("value")).where(F.col("value").isNotNull())


def weighted_fit_metrics(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return weighted_metrics(results, FIT_METRICS, by)


def weighted_eval_metrics(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return weighted_metrics(results, EVAL_METRICS, by)


def weighted_all_metrics(results: DataFrame) -> DataFrame:
    """All metrics of the last round in one row: threshold apart (default 0.5), the others as a map."""
    last = results.where(F.col("round") == results.agg(F.max("round").alias("r")).scalar())
    means = weighted_metrics(last)
    is_threshold = F.col("metric") == "threshold"
    return means.agg(
        F.coalesce(F.max(F.when(is_threshold, F.col("value"))), F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(~is_threshold, F.struct("metric", "value"))))
        ).alias("metrics"),
    )


def metric_history(results: DataFrame, keys: Sequence[str] = ("f1", "pr_auc")) -> DataFrame:
    """One row per round and metric, ready for a line chart."""
    return weighted_metrics(results, keys, ["round"]).orderBy("metric", "round")


def early_stop(
    history: DataFrame, patience: int, by: Sequence[str] = (), step: str = "epoch", value: str = "val_f1"
) -> DataFrame:
    """Per run: best epoch (first one strictly above all before), where training stops, the last value seen.

    Training stops at the first epoch ``patience`` epochs after the latest gain, or at the last epoch.
    """
    series = Window.partitionBy(*by).orderBy(step)
    before = F.coalesce(F.max(value).over(series.rowsBetween(*PRIOR)), F.lit(-1.0))
    marked = history.select(
        *by, step, value, F.row_number().over(series).alias("_i"), (F.col(value) > before).alias("_gain")
    )
    latest = F.max(F.when(F.col("_gain"), F.col("_i"))).over(series.rowsBetween(Window.unboundedPreceding, 0))
    stale = marked.withColumn("_stale", F.col("_i") - F.coalesce(latest, F.lit(0)))
    full = F.min(F.when(F.col("_stale") >= patience, F.col("_i"))).over(Window.partitionBy(*by))
    lived = stale.withColumn("_full", full).where(F.col("_full").isNull() | (F.col("_i") <= F.col("_full")))
    gain = F.when(F.col("_gain"), F.col("_i"))
    return lived.groupBy(*by).agg(
        F.max_by(step, gain).alias("best_epoch"),
        F.max_by(value, gain).alias("best_value"),
        F.max(step).alias("stop_epoch"),
        F.max_by(value, "_i").alias("last_value"),
        F.max(F.col("_full").isNotNull()).alias("stopped_early"),
    )


def median_prune(
    trials: DataFrame, warmup: int = 10, startup: int = 5, by: Sequence[str] = ("study",), trial: str = "trial",
    step: str = "step", value: str = "value",
) -> DataFrame:
    """First step at which a trial's best value so far is below the median of the other trials' values there.

    Steps before ``warmup`` and steps with fewer than ``startup`` other trials never prune.  The median of
    the others follows from the trial's own place in the sorted values and the three middle ones, so no
    group of trials is gathered.
    """
    run = Window.partitionBy(*by, trial).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    best = trials.select(*by, trial, step, value, F.max(value).over(run).alias("best")).where(F.col(step) >= warmup)
    keys = [*by, step]
    placed = positions(best, keys, [value, trial])
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = join_groups(placed, sizes.where(F.col("_n") > startup), keys)
    middle = F.col(POS) - F.expr("_n div 2")
    near = ranked.where(middle.between(-1, 1)).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(POS, value))).alias("_at")
    )
    # 0-based places of the two middle values among the n - 1 others, then among all n
    low, high = F.expr("(_n - 2) div 2"), F.expr("(_n - 1) div 2")
    at = [F.element_at("_at", p + (p >= F.col(POS)).cast("bigint")) for p in (low, high)]
    judged = join_groups(ranked, near, keys).withColumn("median_others", (at[0] + at[1]) / 2.0)
    return judged.where(F.col("best") < F.col("median_others")).groupBy(*by, trial).agg(
        F.min(step).alias("pruned_at")
    )


def best_trial(trials: DataFrame, by: Sequence[str] = ("study",), value: str = "value", trial: str = "trial") -> DataFrame:
    """Whole record of the trial with the highest value, the earliest trial on ties."""
    rest = [c for c in trials.columns if c not in by]
    top = F.max_by(F.struct(*rest), F.struct(F.col(value), -F.col(trial)))
    return trials.groupBy(*by).agg(top.alias("t")).select(*by, *[F.col(f"t.{c}").alias(c) for c in rest])


STATUS_RANK = {"FAIL": 0, "WARNING": 1, "OK": 2, "SKIPPED": 3}


def quality_checks(
    df: DataFrame, features: Sequence[str], label: str, score: str | None = None, meta: Sequence[str] | None = None
) -> DataFrame:
    """Rows (check, status, n): one aggregate over the table, turned into lines, worst first.

    ``meta`` names the metadata at hand, such as the columns of :func:`wattline.operators.scaling.metadata`;
    without it that check is skipped.

    ``n`` counts the offending rows (or missing keys, or classes found).
    """
    nan, inf = [], []
    for f in features:
        c = F.col(f).cast("double")
        nan.append(c.isNull() | F.isnan(c))
        inf.append(F.abs(c) == F.lit(float("inf")))
    any_nan, any_inf = nan[0], inf[0]
    for a, b in zip(nan[1:], inf[1:]):
        any_nan, any_inf = any_nan | a, any_inf | b
    missing = None if meta is None else sum(k not in meta for k in METADATA_KEYS)
    y = F.col(label)
    unscored = F.count_if(y.isNotNull()) - F.count(score) if score else F.lit(None).cast("bigint")
    sums = df.agg(
        F.lit(missing).cast("bigint").alias("meta"),
        F.count_if(any_nan).alias("nan"),
        F.count_if(any_inf).alias("inf"),
        F.abs(unscored).alias("unscored"),
        (F.max((y == 0).cast("bigint")) + F.max((y == 1).cast("bigint"))).alias("classes"),
    )

    def line(name: str, status, n: str):
        return F.struct(F.lit(name).alias("check"), status.alias("status"), F.col(n).alias("n"))

    def warn_if(c: str, bad: str = "WARNING"):
        return F.when(F.col(c).isNull(), "SKIPPED").when(F.col(c) > 0, bad).otherwise("OK")

    lines = F.array(
        line("dataset:metadata", warn_if("meta"), "meta"),
        line("dataset:nan_input", warn_if("nan"), "nan"),
        line("dataset:inf_input", warn_if("inf"), "inf"),
        line("model:batch_mismatch", warn_if("unscored"), "unscored"),
        line("train:two_classes", F.when(F.col("classes") >= 2, "OK").otherwise("WARNING"), "classes"),
    )
    return order_checks(sums.select(F.inline(lines)))


def order_checks(checks: DataFrame) -> DataFrame:
    rank = F.lit(9)
    for status, place in STATUS_RANK.items():
        rank = F.when(F.col("status") == status, F.lit(place)).otherwise(rank)
    return checks.orderBy(rank, "check")


def quality_report(checks: DataFrame) -> DataFrame:
    """Totals per status and the overall verdict."""
    totals = checks.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in
          (("OK", "ok"), ("WARNING", "warnings"), ("FAIL", "failures"), ("SKIPPED", "skipped"))],
    )
    overall = (
        F.when(F.col("failures") > 0, "FAILING").when(F.col("warnings") > 0, "MOSTLY HEALTHY").otherwise("HEALTHY")
    )
    return totals.withColumn("overall", overall)
