"""Standardisation over all rows or per node, and summaries of splits and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.ordering import MAX_GROUP_ROWS, POS, hot_groups, join_groups, over_series
from wattline.operators.windows import window_weight


def standardize_global(
    df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None
) -> DataFrame:
    """``(x - mean) / std`` with population std, 0 → 1; fitted on all rows unless ``fit_on`` is given."""
    source = df if fit_on is None else fit_on
    stats = source.agg(
        F.struct(*[m for c in cols for m in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).alias("s")
    ).scalar()

    def scaled(c: str) -> Column:
        std = stats[f"s_{c}"]
        return ((F.col(c) - stats[f"m_{c}"]) / F.when(std == 0, F.lit(1.0)).otherwise(std)).alias(c)

    chosen = set(cols)
    return df.select(*[scaled(c) if c in chosen else F.col(c) for c in df.columns])


def node_window_stats(
    df: DataFrame, node: str, order: Sequence[str], cols: Sequence[str], window: int, stride: int,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Mean and population std of each column over all windows of each (split, node).

    Rows in several windows count several times.  Instead of copying them, rows are first grouped by how
    often they count (at most ``window / stride + 1`` values) and those moments are merged with that weight.
    """
    keys = ["split", node]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = hot_groups(df, keys, max_rows)
    if hot is None:
        rows = df.select(
            *keys, *cols,
            (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).alias(POS),
            F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_rows"),
        )
    else:
        rows = join_groups(over_series(df, keys, order, 0, lambda r, parts: r, max_rows, hot=hot), sizes, keys)
    weighed = rows.withColumn("_w", window_weight(F.col(POS), F.col("_rows"), window, stride)).where("_w > 0")
    parts = weighed.groupBy(*keys, "_w").agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            m
            for c in cols
            for m in (
                F.avg(c).alias(f"_m_{c}"), F.var_pop(c).alias(f"_v_{c}"),
                F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"),
            )
        ],
    )
    weight = F.col("_w") * F.col("_n")
    means = parts.groupBy(*keys).agg(
        F.sum(weight).alias("n_values"),
        *[(F.sum(weight * F.col(f"_m_{c}")) / F.sum(weight)).alias(f"mean_{c}") for c in cols],
        F.collect_list(F.struct(weight.alias("w"), *[F.col(f"{p}_{c}") for c in cols for p in ("_m", "_v", "_lo", "_hi")])).alias("_parts"),
    )

    def std(c: str) -> Column:
        mean = F.col(f"mean_{c}")
        spread = F.aggregate(
            "_parts", F.lit(0.0),
            lambda acc, p: acc + p["w"] * (p[f"_v_{c}"] + (p[f"_m_{c}"] - mean) * (p[f"_m_{c}"] - mean)),
        )
        flat = F.array_min(F.transform("_parts", lambda p: p[f"_lo_{c}"])) == F.array_max(
            F.transform("_parts", lambda p: p[f"_hi_{c}"])
        )
        return F.when(flat, F.lit(1.0)).otherwise(F.sqrt(spread / F.col("n_values"))).alias(f"std_{c}")

    return means.select(*keys, "n_values", *[f"mean_{c}" for c in cols], *[std(c) for c in cols])


def scaler_lookup(stats: DataFrame, node: str, cols: Sequence[str]) -> DataFrame:
    """Statistics to use per (split, node): the node's train ones, else its own; ``fallback`` says which.

    One aggregate over the two rows a node may have, no join.
    """
    names = [f"{p}_{c}" for c in cols for p in ("mean", "std")]
    train = F.col("split") == "train"
    picked = stats.groupBy(node).agg(
        F.collect_set("split").alias("_splits"),
        F.count_if(train).alias("_trained"),
        *[F.coalesce(F.max(F.when(train, F.col(c))), F.max(c)).alias(c) for c in names],
    )
    return picked.select(
        F.explode("_splits").alias("split"), node, *names, (F.col("_trained") == 0).alias("fallback")
    )


def standardize_per_node(
    df: DataFrame, node: str, order: Sequence[str], cols: Sequence[str], window: int, stride: int,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rows of a split table scaled by their node's train-window statistics (own statistics if it has none).

    Only nodes with at least one window on a side have statistics; other rows are in no window and drop out.
    """
    stats = node_window_stats(df, node, order, cols, window, stride, max_rows)
    used = scaler_lookup(stats, node, cols)
    chosen = set(cols)
    return join_groups(df, used, ["split", node]).select(
        *[((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(c) if c in chosen else F.col(c)
          for c in df.columns],
        "fallback",
    )


def split_summary(windows: DataFrame, node: str, label: str = "y", split: str = "split") -> DataFrame:
    """Windows, nodes, positive rate per split, and nodes of the other splits that have no train window."""
    per_node = windows.groupBy(split, node).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    trained = F.max((F.col(split) == "train").cast("int")).over(Window.partitionBy(node))
    marked = per_node.withColumn("_trained", trained)
    return marked.groupBy(split).agg(
        F.sum("n").alias("n_windows"),
        F.count(node).alias("n_nodes"),
        F.count_if(F.col("_trained") == 0).alias("n_fallback"),
        (F.sum("pos") / F.sum("n")).alias("positive_rate"),
    )


def metadata(
    df: DataFrame, features: Sequence[str], label: str, task: str = "binary_classification",
    num_classes: int | None = None, mapping: dict[str, int] | None = None,
) -> DataFrame:
    """One row: feature count, class count, rows, task, format, label mapping."""
    classes = F.lit(num_classes).cast("bigint") if num_classes else F.count_distinct(label)
    codes = F.create_map(*[F.lit(v) for kv in (mapping or {}).items() for v in kv])
    return df.agg(
        F.lit(len(features)).cast("bigint").alias("input_dim"),
        classes.alias("num_classes"),
        F.count(F.lit(1)).alias("num_samples"),
        F.lit(task).alias("task_type"),
        F.lit("tabular").alias("data_format"),
        *([codes.alias("label_mapping")] if mapping else []),
    )
