"""Column functions: all built in, none leaves code generation for Python."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline.functions.fixed_values import NORM_EPSILON, SWEEP_COUNT, SWEEP_STEP, ZSCORE_EPSILON


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_time(col: str | Column, fmt: str | None = None) -> Column:
    return F.to_timestamp(_c(col), fmt) if fmt else F.to_timestamp(_c(col))


def rolling_zscore(value: str | Column, mean: str | Column, std: str | Column) -> Column:
    return (_c(value) - _c(mean)) / (_c(std) + F.lit(ZSCORE_EPSILON))


def zero_nonfinite(col: str | Column) -> Column:
    c = _c(col).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def nan_to_null(col: str | Column) -> Column:
    return F.nullif(_c(col), F.lit(float("nan")))


def normalize_window(x: str | Column) -> Column:
    """Rows of features, each feature less its mean over the rows and divided by its deviation there."""
    x = _c(x)
    n = F.size(x).cast("double")

    def total(rows: Column) -> Column:
        zeros = F.transform(F.element_at(x, 1), lambda v: F.lit(0.0))
        return F.aggregate(rows, zeros, lambda acc, row: F.zip_with(acc, row, lambda a, v: a + v.cast("double")))

    mean = F.transform(total(x), lambda s: s / n)
    centred = F.transform(x, lambda row: F.zip_with(row, mean, lambda v, m: v.cast("double") - m))
    squares = total(F.transform(centred, lambda row: F.transform(row, lambda v: v * v)))
    scale = F.transform(squares, lambda s: F.sqrt(s / n + F.lit(NORM_EPSILON)))
    return F.transform(centred, lambda row: F.zip_with(row, scale, lambda v, s: (v / s).cast("float")))


def sigmoid(logit: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(logit)))


def decide(prob: str | Column, threshold: float | Column) -> Column:
    """1.0 where the probability reaches the threshold (inclusive), else 0.0."""
    return (_c(prob) >= threshold).cast("double")


def argmax_class(scores: str | Column) -> Column:
    """Index of the largest score; the first one on ties."""
    return (F.array_position(_c(scores), F.array_max(_c(scores))) - 1).cast("int")


def map_labels(col: str | Column, codes: Mapping[str, int]) -> Column:
    """Code of the trimmed text, null if it is not in ``codes``."""
    text = F.trim(_c(col).cast("string"))
    out = F.lit(None).cast("int")
    for name, code in codes.items():
        out = F.when(text == name, F.lit(code)).otherwise(out)
    return out


def one_hot(col: str | Column, values: Sequence[str], prefix: str) -> list[Column]:
    """One 0/1 column per value; null and values outside the list give zeros everywhere."""
    hit = [F.coalesce((_c(col) == v).cast("double"), F.lit(0.0)) for v in values]
    return [h.alias(f"{prefix}_{v}") for h, v in zip(hit, values)]


def assemble(cols: Sequence[str], kind: str = "float") -> Column:
    """Feature array in the given order."""
    return F.array(*[F.col(f"`{c}`").cast(kind) for c in cols])


def coerce_number(col: str) -> Column:
    """Number or null; text that is no number does not fail in ANSI mode."""
    return F.col(f"`{col}`").try_cast("double")


def narrow_int(col: str) -> Column:
    """32-bit integer; a value out of range raises an error instead of wrapping."""
    c = F.col(f"`{col}`")
    fits = c.isNull() | c.between(-(2**31), 2**31 - 1)
    return F.when(fits, c.try_cast("int")).otherwise(
        F.raise_error(F.concat(F.lit(f"{col} does not fit 32 bits: "), c.cast("string"))).cast("int")
    )


def bce_row(logit: str | Column, y: str | Column, weight: float | Column = 1.0) -> Column:
    """Weighted binary cross-entropy of one row from its logit, in the form that never overflows."""
    x, label = _c(logit), _c(y)
    tail = F.log1p(F.exp(-F.abs(x)))
    positive = weight * label * (F.greatest(-x, F.lit(0.0)) + tail)
    negative = (1 - label) * (F.greatest(x, F.lit(0.0)) + tail)
    return positive + negative


def cross_entropy_row(scores: str | Column, label: str | Column) -> Column:
    """log-sum-exp of the scores minus the score of the true class."""
    s = _c(scores)
    top = F.array_max(s)
    total = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return top + F.log(total) - F.element_at(s, _c(label).cast("int") + 1)


def sweep_threshold(i: Column) -> Column:
    """The i-th threshold, i = 1, 2, …"""
    return F.lit(SWEEP_STEP) + (i - 1) * F.lit(SWEEP_STEP)


def sweep_bucket(prob: str | Column) -> Column:
    """How many of the sweep thresholds the probability reaches (0…49).

    The guess may be one off because thresholds are sums of floats; comparing with its two neighbours
    makes it exact.
    """
    p = _c(prob)
    guess = F.floor(p / F.lit(SWEEP_STEP))
    exact = (
        guess
        + (p >= sweep_threshold(guess + 1)).cast("bigint")
        - (p < sweep_threshold(guess)).cast("bigint")
    )
    return F.least(F.greatest(exact, F.lit(0)), F.lit(SWEEP_COUNT)).cast("int")


def patches(values: str | Column, length: int = 16, stride: int = 8) -> Column:
    """Overlapping pieces of an array: all full pieces that start at multiples of ``stride``."""
    v = _c(values)
    last = F.floor((F.size(v) - length) / F.lit(stride)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * stride + 1, length))
    return F.when(F.size(v) >= length, cut).otherwise(F.slice(F.array(v), 1, 0))


def instance_norm(value: Column, mean: Column, var_pop: Column) -> Column:
    return (value - mean) / F.sqrt(var_pop + F.lit(NORM_EPSILON))
