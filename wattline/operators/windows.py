"""Stride windows over series of readings, with the label of the next row.

Rows are first grouped in panes of ``gcd(window, stride)`` rows; a window is a run of whole panes and its
label belongs to the first row of the pane after it.  So a window exists exactly when that label row does,
no row is copied into several windows before the arrays are built, and one exchange by series serves
numbering, panes and windows alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import columns as C
from wattline.operators.ordering import CHECK, MAX_GROUP_ROWS, POS, over_series

PANE, STRIP = "_pane", "_strip"


def _over_panes(df, by, order, window, stride, label, pane_cols, window_cols, max_rows, hot) -> DataFrame:
    """One row per window: keys, start position and time, label, label time and ``window_cols(frame)``."""
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be positive")
    by, unit = list(by), gcd(window, stride)
    time = order[0]

    def build(rows: DataFrame, parts: list[str]) -> DataFrame:
        first = F.col(POS) % unit == 0
        panes = (
            rows.withColumn(PANE, F.expr(f"{POS} div {unit}"))
            .groupBy(*parts, PANE)
            .agg(
                F.max(F.when(first, F.col(label))).alias("y"),
                F.min(time).alias("_ts"),
                *pane_cols,
            )
        )
        series = Window.partitionBy(*parts).orderBy(PANE)
        frame = series.rowsBetween(-(window // unit), -1)
        start = F.col(PANE) * unit - window
        return (
            panes.select(
                *parts,
                (F.col(PANE) * unit).alias(POS),
                start.alias("start"),
                F.lag("_ts", window // unit).over(series).alias("start_ts"),
                F.col("_ts").alias("label_ts"),
                "y",
                *window_cols(frame),
            )
            .where((F.col("start") >= 0) & (F.col("start") % stride == 0))
        )

    return over_series(df, by, order, window, build, max_rows, unit, hot).drop(POS)


def stride_windows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    label: str,
    window: int = 168,
    stride: int = 24,
    max_rows: int = MAX_GROUP_ROWS,
    strict: bool = False,
    hot: DataFrame | None | str = CHECK,
) -> DataFrame:
    """Windows at 0, stride, … while ``start + window < rows``: ``x`` holds the feature rows in order as
    32-bit floats, ``y`` the label of the row right after the window.

    Every row keeps its place even if some feature is null.  ``strict`` fails when there is no window.  Where neither of
    window and stride divides the other, panes would be tiny, so windows are sliced from strips of rows instead.
    """
    if window > 0 and stride > 0 and gcd(window, stride) < min(window, stride):
        out = _sliced_windows(df, by, order, features, label, window, stride, max_rows, hot)
        if strict and out.isEmpty():
            raise ValueError("no series is longer than the window")
        return out
    row = F.struct(F.col(POS), C.assemble(features).alias("v"))
    pane = F.transform(F.sort_array(F.collect_list(row)), lambda r: r["v"]).alias("_rows")
    out = _over_panes(
        df, by, order, window, stride, label, [pane],
        lambda frame: [F.flatten(F.collect_list("_rows").over(frame)).alias("x")],
        max_rows, hot,
    )
    if strict and out.isEmpty():
        raise ValueError("no series is longer than the window")
    return out


def window_strips(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    label: str,
    window: int = 168,
    stride: int = 24,
    max_rows: int = MAX_GROUP_ROWS,
    hot: DataFrame | None | str = CHECK,
    span: int = 8,
) -> DataFrame:
    """The windows of :func:`stride_windows` as strips: the rows that neighbouring windows share are there once.

    A strip has its keys, ``start`` (position of its first window), ``x`` (feature rows one after the other, 32-bit
    floats), ``y`` (the label after each of its windows), ``window`` and ``stride``; the i-th window is the
    ``window`` rows from ``i * stride`` on.  It covers the labels of about ``span`` windows' worth of rows, so a row is stored
    1 + 1 / span times, whatever the stride.
    """
    if window < 1 or stride < 1 or span < 1:
        raise ValueError("window, stride and span must be positive")
    start = F.element_at("_labels", 1)[POS] - window
    count = (F.size("_labels") - 1) * stride + window
    inside = F.slice("_rows", (start - F.element_at("_rows", 1)[POS] + 1).cast("int"), count)
    columns = [
        start.alias("start"), F.flatten(F.transform(inside, lambda r: r["v"])).alias("x"),
        F.transform("_labels", lambda r: r["y"].cast("int")).alias("y"), F.lit(window).alias("window"), F.lit(stride).alias("stride"),
    ]
    row = F.struct(F.col(POS), C.assemble(features).alias("v"), F.col(label).alias("y"))
    return _over_strips(df, by, order, window, stride, span, row, columns, max_rows, hot)


def _over_strips(df, by, order, window, stride, span, row, columns, max_rows, hot) -> DataFrame:
    """One row per strip with at least one window: keys and ``columns``, made of ``_rows`` (the strip's ``row`` structs in
    order of position) and ``_labels`` (those of them that follow a window)."""
    by, unit = list(by), -(-span * window // stride) * stride

    def build(rows: DataFrame, parts: list[str]) -> DataFrame:
        # a strip owns the labels at unit * strip and on, and also takes the window of rows before them
        own = F.expr(f"{POS} div {unit}")
        spread = rows.withColumn(STRIP, F.explode(F.sequence(own, F.expr(f"({POS} + {window}) div {unit}"))))
        strips = spread.groupBy(*parts, STRIP).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
        first = F.col(STRIP) * unit

        def ends_window(r: Column) -> Column:
            return (r[POS] >= first) & (r[POS] >= window) & ((r[POS] - window) % stride == 0)

        found = strips.withColumn("_labels", F.filter("_rows", ends_window)).where(F.size("_labels") > 0)
        return found.select(*parts, first.alias(POS), *columns)

    return over_series(df, by, order, window, build, max_rows, unit, hot).drop(POS)


def _sliced_windows(df, by, order, features, label, window, stride, max_rows, hot, span: int = 8) -> DataFrame:
    row = F.struct(F.col(POS), F.col(order[0]).alias("t"), C.assemble(features).alias("v"), F.col(label).alias("y"))

    def cut(told: Column) -> Column:
        at = told[POS] - window - F.element_at("_rows", 1)[POS] + 1
        rows = F.slice("_rows", at.cast("int"), window)
        return F.struct(
            (told[POS] - window).alias("start"), F.element_at(rows, 1)["t"].alias("start_ts"), told["t"].alias("label_ts"),
            told["y"].alias("y"), F.transform(rows, lambda r: r["v"]).alias("x"),
        )

    return _over_strips(df, by, order, window, stride, span, row, [F.inline(F.transform("_labels", cut))], max_rows, hot)


def window_stats(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    label: str,
    window: int = 168,
    stride: int = 24,
    max_rows: int = MAX_GROUP_ROWS,
    hot: DataFrame | None | str = CHECK,
) -> DataFrame:
    """Count, sum, mean and population variance of each feature per window, without building arrays.

    Counts and sums of panes add up; the variance is the mean of the pane variances and squared distances of
    the pane means from the window's mean, both weighted by the values present.
    """
    pane_cols: list[Column] = []
    for f in features:
        pane_cols += [
            F.count(f).alias(f"_n_{f}"),
            F.sum(f).alias(f"_s_{f}"),
            F.var_pop(f).alias(f"_v_{f}"),
        ]

    def window_cols(frame) -> list[Column]:
        cols = []
        for f in features:
            n, s, v = F.col(f"_n_{f}"), F.col(f"_s_{f}"), F.col(f"_v_{f}")
            size, total = F.sum(n).over(frame), F.sum(s).over(frame)
            cols += [
                size.alias(f"n_{f}"),
                total.alias(f"sum_{f}"),
                F.try_divide(total, size).alias(f"mean_{f}"),
                F.collect_list(F.struct(n.alias("n"), F.try_divide(s, n).alias("m"), v.alias("v"))).over(frame).alias(f"_p_{f}"),
            ]
        return cols

    raw = _over_panes(df, by, order, window, stride, label, pane_cols, window_cols, max_rows, hot)
    kept = [c for c in raw.columns if not c.startswith("_p_")]
    return raw.select(*kept, *[_merged_variance(f"_p_{f}", F.col(f"mean_{f}"), F.col(f"n_{f}")).alias(f"var_{f}") for f in features])


def _merged_variance(panes: str, mean: Column, size: Column) -> Column:
    """Population variance of a window from its panes' counts ``n``, means ``m`` and variances ``v``."""
    def add(acc: Column, p: Column) -> Column:
        return acc + F.when(p["n"] > 0, p["n"] * (p["v"] + (p["m"] - mean) * (p["m"] - mean))).otherwise(F.lit(0.0))

    return F.try_divide(F.aggregate(panes, F.lit(0.0), add), size)


def instance_norm(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    label: str,
    window: int = 168,
    stride: int = 24,
    max_rows: int = MAX_GROUP_ROWS,
    hot: DataFrame | None | str = CHECK,
) -> DataFrame:
    """Windows whose features ``x_<f>`` are normalised by the window's own mean and population variance.

    Missing values (null) count in neither and stay null in their place.
    """
    pane_cols = [
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(POS), F.col(f).cast("double").alias("v")))),
            lambda r: r["v"],
        ).alias(f"_a_{f}")
        for f in features
    ]
    for f in features:
        pane_cols += [F.count(f).alias(f"_n_{f}"), F.avg(f).alias(f"_m_{f}"), F.var_pop(f).alias(f"_v_{f}")]

    def window_cols(frame) -> list[Column]:
        cols = []
        for f in features:
            n, m, v = F.col(f"_n_{f}"), F.col(f"_m_{f}"), F.col(f"_v_{f}")
            size = F.sum(n).over(frame)
            cols += [
                F.flatten(F.collect_list(f"_a_{f}").over(frame)).alias(f"_x_{f}"),
                size.alias(f"_size_{f}"),
                F.try_divide(F.sum(n * m).over(frame), size).alias(f"_mean_{f}"),
                F.collect_list(F.struct(n.alias("n"), m.alias("m"), v.alias("v"))).over(frame).alias(f"_p_{f}"),
            ]
        return cols

    raw = _over_panes(df, by, order, window, stride, label, pane_cols, window_cols, max_rows, hot)

    def normed(f: str) -> Column:
        mean = F.col(f"_mean_{f}")
        var = _merged_variance(f"_p_{f}", mean, F.col(f"_size_{f}"))
        return F.transform(f"_x_{f}", lambda v: C.instance_norm(v, mean, var)).alias(f"x_{f}")

    return raw.select(*by, "start", "start_ts", "label_ts", "y", *[normed(f) for f in features])


def window_weight(pos: Column, rows: Column, window: int, stride: int) -> Column:
    """In how many windows of its series a row at ``pos`` takes part (``rows`` rows in the series)."""
    last = F.floor(F.least(pos, rows - window - 1) / F.lit(stride))
    first = F.ceil(F.greatest(pos - window + 1, F.lit(0)) / F.lit(stride))
    return F.when(rows > window, F.greatest(last - first + 1, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
