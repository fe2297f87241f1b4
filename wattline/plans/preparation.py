"""From raw readings to windows, for training (clients and split) and for held-out files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import columns as C
from wattline.functions.fixed_values import BASE_FEATURES, GRID_LABELS, PRIMARY_USES
from wattline.operators import features as P
from wattline.operators.ordering import CHECK, MAX_GROUP_ROWS, hot_groups
from wattline.operators.scaling import standardize_global
from wattline.operators.splits import split_strips, split_windows
from wattline.operators.windows import stride_windows
from wattline.session import stored

BUILDING_FEATURES = [*BASE_FEATURES, *[f"primary_use_{u}" for u in PRIMARY_USES]]


def prepare_readings(
    df: DataFrame, node: str = "building_id", order: Sequence[str] = ("timestamp",), value: str = "meter_reading",
    category: str | None = "primary_use", categories: Sequence[str] = tuple(PRIMARY_USES), narrow: bool = False,
    max_rows: int = MAX_GROUP_ROWS, hot: DataFrame | None | str = CHECK,
) -> DataFrame:
    """Features first, then one-hot, then rows with any null dropped (lags must see the dropped rows)."""
    if narrow:
        df = P.narrow_numeric(df)
    wide = P.meter_features(df, node, order, value, max_rows, hot)
    if category:
        wide = P.one_hot_fixed(wide, category, categories)
    return P.drop_null_rows(P.bool_to_float(wide))


def building_windows(
    df: DataFrame, client: str = "client_id", ratio: float = 1.0 - 0.2, gap_hours: float = 73, window: int = 168,
    stride: int = 24, max_rows: int = MAX_GROUP_ROWS, node: str = "building_id", time: str = "timestamp",
    narrow: bool = False,
) -> DataFrame:
    """Train and validation windows of building readings that already carry their client.

    The prepared rows are stored once: the cutoff passes then read only their time column.
    """
    hot = hot_groups(df, [node], max_rows)
    ready = stored(prepare_readings(df, node, [time], narrow=narrow, max_rows=max_rows, hot=hot))
    return split_windows(
        ready, node, [time], BUILDING_FEATURES, "anomaly", ratio, gap_hours, window, stride,
        client, max_rows, hot,
    )


def building_strips(
    df: DataFrame, client: str = "client_id", ratio: float = 1.0 - 0.2, gap_hours: float = 73, window: int = 168,
    stride: int = 24, max_rows: int = MAX_GROUP_ROWS, node: str = "building_id", time: str = "timestamp",
    narrow: bool = False, normalize: bool = False,
) -> DataFrame:
    """The windows of :func:`building_windows` as training examples in strips; ``normalize`` scales each feature within
    each window when the window is cut."""
    hot = hot_groups(df, [node], max_rows)
    ready = stored(prepare_readings(df, node, [time], narrow=narrow, max_rows=max_rows, hot=hot))
    strips = split_strips(
        ready, node, [time], BUILDING_FEATURES, "anomaly", ratio, gap_hours, window, stride, client, max_rows, hot
    )
    return as_strips(strips, [client, "split"], normalize)


def building_test_windows(
    df: DataFrame, window: int = 168, stride: int = 24, max_rows: int = MAX_GROUP_ROWS, node: str = "building_id",
    time: str = "timestamp", narrow: bool = False,
) -> DataFrame:
    """Windows of a held-out table: the same preparation, no split, one lazy plan."""
    hot = hot_groups(df, [node], max_rows)
    ready = prepare_readings(df, node, [time], narrow=narrow, max_rows=max_rows, hot=hot)
    return stride_windows(
        ready, [node], [time], BUILDING_FEATURES, "anomaly", window, stride, max_rows, hot=hot
    )


def prepare_grid_log(df: DataFrame, label: str = "marker", normalize: bool = True) -> DataFrame:
    """Numeric log columns cleaned and standardised over all rows, label text to 0/1 as ``y``."""
    features = [c for c in df.columns if c != label]
    coded = P.map_labels(P.drop_missing_target(df, label), label, GRID_LABELS, "y").drop(label)
    clean = P.zero_nonfinite(coded, features)
    return standardize_global(clean, features) if normalize else clean


def as_strips(strips: DataFrame, keep: Sequence[str], normalize: bool = False) -> DataFrame:
    """Strips as training examples: keys, x, y and how to cut the windows (window, stride, scaled)."""
    return strips.select(*keep, "x", "y", "window", "stride", F.lit(normalize).alias("scaled"))


def as_vectors(windows: DataFrame, keep: Sequence[str], normalize: bool = False) -> DataFrame:
    """Windows as flat vectors with their keys and label; ``normalize`` scales each feature within each window."""
    x = C.normalize_window("x") if normalize else F.col("x")
    return windows.select(*keep, F.flatten(x).alias("x"), F.col("y").cast("int").alias("y"))
