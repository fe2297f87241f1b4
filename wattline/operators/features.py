"""Per-series features and encodings of readings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattline.functions import columns as C
from wattline.functions.fixed_values import PRIMARY_USES, ROLL_ROWS
from wattline.operators.ordering import CHECK, MAX_GROUP_ROWS, POS, over_series, positions

MAX_CODES = 1000
MAX_COLUMNS = 10_000


def lag_rows(value: Column, n: int, series: WindowSpec) -> Column:
    """Value ``n`` rows (not hours) earlier in the series."""
    return F.lag(value, n).over(series)


def diff(value: Column, n: int, series: WindowSpec) -> Column:
    return value - lag_rows(value, n, series)


def rolling_mean(value: Column, n: int, series: WindowSpec) -> Column:
    """Mean of the values present among this row and the ``n - 1`` rows before it."""
    return F.avg(value).over(series.rowsBetween(1 - n, 0))


def rolling_std(value: Column, n: int, series: WindowSpec) -> Column:
    """Sample standard deviation over the same rows; null for a single value."""
    return F.stddev_samp(value).over(series.rowsBetween(1 - n, 0))


def series_columns(
    df: DataFrame,
    node: str,
    order: Sequence[str],
    history: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    max_rows: int = MAX_GROUP_ROWS,
    hot: DataFrame | None | str = CHECK,
) -> DataFrame:
    """Add columns that look back up to ``history`` rows of the node.

    All of them share one window specification: one exchange, one sort, one window operator.
    """

    def build(rows: DataFrame, parts: list[str]) -> DataFrame:
        added = columns(Window.partitionBy(*parts).orderBy(*order))
        return rows.select("*", *[c.alias(name) for name, c in added.items()])

    return over_series(df, [node], order, history, build, max_rows, hot=hot).drop(POS)


def meter_features(
    df: DataFrame,
    node: str = "building_id",
    order: Sequence[str] = ("timestamp",),
    value: str = "meter_reading",
    max_rows: int = MAX_GROUP_ROWS,
    hot: DataFrame | None | str = CHECK,
) -> DataFrame:
    """Seven lag and rolling features of ``value``; NaN in it is a missing value."""
    if df.schema[value].dataType.typeName() in ("double", "float"):
        df = df.withColumn(value, C.nan_to_null(value))
    v, n = F.col(value), ROLL_ROWS

    def columns(series: WindowSpec) -> dict[str, Column]:
        return {
            "meter_lag1": lag_rows(v, 1, series),
            f"meter_lag{n}": lag_rows(v, n, series),
            f"meter_roll_mean_{n}": rolling_mean(v, n, series),
            f"meter_roll_std_{n}": rolling_std(v, n, series),
        }

    wide = series_columns(df, node, order, n, columns, max_rows, hot)
    return wide.select(
        "*",
        (v - F.col("meter_lag1")).alias("meter_diff_1"),
        (v - F.col(f"meter_lag{n}")).alias(f"meter_diff_{n}"),
        C.rolling_zscore(v, f"meter_roll_mean_{n}", f"meter_roll_std_{n}").alias(f"meter_zscore_{n}"),
    )


def one_hot_fixed(df: DataFrame, col: str, values: Sequence[str] = tuple(PRIMARY_USES)) -> DataFrame:
    """Replace ``col`` by one column per listed value; no row is lost."""
    return df.select("*", *C.one_hot(col, values, col)).drop(col)


def known_values(df: DataFrame, col: str, limit: int | None) -> list | None:
    """Sorted distinct values, or None when there are more than ``limit``."""
    distinct = df.where(F.col(col).isNotNull()).select(col).distinct()
    found = distinct.collect() if limit is None else distinct.take(limit + 1)
    return None if limit is not None and len(found) > limit else sorted(r[0] for r in found)


def one_hot_data(df: DataFrame, col: str, drop_first: bool = True, limit: int | None = MAX_COLUMNS) -> DataFrame:
    """One-hot with the values found in the data, sorted; the first one may be left out.

    Every value becomes a column, so the driver must know them all: more than ``limit`` are an error, and the driver takes
    no more than one beyond it.  None is a choice to take any number.
    """
    values = known_values(df, col, limit)
    if values is None:
        raise ValueError(f"{col} has more than {limit} values")
    return df.select("*", *C.one_hot(col, values[1:] if drop_first else values, col)).drop(col)


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Codes 0…k−1 in sorted order of the distinct values.

    A short value list (seen to be short) is broadcast; a long one is ranked by range slices and joined.
    """
    out = out or f"{col}_code"
    values = known_values(df, col, MAX_CODES)
    if values is None:
        distinct = df.where(F.col(col).isNotNull()).select(col).distinct()
        codes = positions(distinct, [], [col]).select(col, F.col(POS).alias(out))
    else:
        kind = df.schema[col].dataType.simpleString()
        rows = [(v, i) for i, v in enumerate(values)]
        codes = F.broadcast(df.sparkSession.createDataFrame(rows, f"`{col}` {kind}, `{out}` bigint"))
    return df.join(codes, col, "left").select(*df.columns, out)


def narrow_numeric(df: DataFrame) -> DataFrame:
    """Every double to float and every bigint to int (checked)."""
    cast = {"double": lambda c: F.col(f"`{c}`").cast("float"), "bigint": C.narrow_int}
    return df.select(*[cast[t](c).alias(c) if t in cast else F.col(f"`{c}`") for c, t in df.dtypes])


def bool_to_float(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f"`{c}`").cast("float").alias(c) if t == "boolean" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def coerce_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every (listed) column to a number; bad values become null."""
    chosen = set(cols or df.columns)
    return df.select(*[C.coerce_number(c).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop a row with a null or NaN in any column."""
    return df.dropna("any")


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna("any", subset=[target])


def zero_nonfinite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    chosen = set(cols)
    return df.select(*[C.zero_nonfinite(c).alias(c) if c in chosen else F.col(c) for c in df.columns])


def map_labels(df: DataFrame, col: str, codes: Mapping[str, int], out: str, strict: bool = True) -> DataFrame:
    """Text labels to codes; with ``strict`` a text that is not in ``codes`` fails the job that meets it."""
    code = C.map_labels(col, codes)
    if strict:
        bad = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(col).cast("string"), F.lit("null"))))
        code = F.when(code.isNull(), bad.cast("int")).otherwise(code)
    return df.withColumn(out, code)


def unknown_labels(df: DataFrame, col: str, known: Sequence[str]) -> DataFrame:
    """Distinct trimmed labels that are not in ``known``."""
    text = F.trim(F.col(col).cast("string")).alias("label")
    return df.select(text).where(~F.col("label").isin(list(known))).distinct()


def assemble_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str], out: str = "x") -> DataFrame:
    """Fixed-order array of 32-bit features next to the kept columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*keep, C.assemble(cols).alias(out))


def row_slice(df: DataFrame, order: Sequence[str], lo: int, hi: int, cols: Sequence[str]) -> DataFrame:
    """Rows ``lo`` to ``hi - 1`` by position in ``order``, some columns.

    Near the start each task keeps its first ``hi`` rows only; further on, rows are numbered in slices.
    """
    if hi <= 100_000:
        return df.select(*cols, *[o for o in order if o not in cols]).orderBy(*order).offset(lo).limit(
            max(hi - lo, 0)
        ).select(*cols)
    return positions(df, [], order).where((F.col(POS) >= lo) & (F.col(POS) < hi)).select(*cols)
