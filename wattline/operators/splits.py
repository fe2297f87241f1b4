"""Time cutoffs with a gap, exact random splits, balanced samples, choice of clients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.ordering import (
    AHEAD, CHECK, MAX_BROADCAST_ROWS, MAX_GROUP_ROWS, hash_token, join_groups, mark_lowest,
)
from wattline.session import frozen
from wattline.operators.windows import stride_windows, window_strips

# widths of the histograms that narrow down a timestamp: hour, second, microsecond
HOUR_US, SECOND_US, MICRO_US = 3_600_000_000, 1_000_000, 1
FEW_ROWS = 1_000_000


def time_cutoffs(df: DataFrame, ts: str, ratio: float, by: Sequence[str] = ()) -> DataFrame:
    """Per group: the timestamp at 0-based place ``int(rows * ratio)`` of the group's rows in time order.

    Counting passes, each over the bucket the pass before has found: by hour, by second if that hour is
    crowded, by microsecond.  Exact without sorting rows; later passes carry their time bounds to the scan.
    """
    by = list(by)
    narrow = df.select(*by, ts)
    rows, width, carried = narrow, HOUR_US, False
    while True:
        micros = F.unix_micros(ts)
        low = (micros - F.pmod(micros, F.lit(width))).alias("low")
        counts = rows.where(F.col(ts).isNotNull()).groupBy(*by, low).agg(
            F.count(F.lit(1)).alias("n"), *([F.max("place").alias("place")] if carried else [])
        )
        series = Window.partitionBy(*by)
        ahead = F.coalesce(F.sum("n").over(series.orderBy("low").rowsBetween(*AHEAD)), F.lit(0))
        at = F.col("place") if carried else F.floor(F.sum("n").over(series) * F.lit(ratio))
        hits = (
            counts.select(*by, "low", "n", ahead.alias("ahead"), at.alias("at"))
            .where((F.col("at") >= F.col("ahead")) & (F.col("at") < F.col("ahead") + F.col("n")))
            .select(*by, "low", (F.col("at") - F.col("ahead")).alias("place"), "n")
        )
        found = hits.take(MAX_BROADCAST_ROWS + 1) if by else hits.collect()  # one row without groups
        if not found:
            raise ValueError("no row at that ratio: the table is empty or the ratio is not below 1")
        if len(found) <= MAX_BROADCAST_ROWS:
            first, last, crowd = (f(r[c] for r in found) for f, c in ((min, "low"), (max, "low"), (max, "n")))
            hits = F.broadcast(df.sparkSession.createDataFrame(found, hits.schema))
        else:
            hits = frozen(hits)  # the next pass reads it, not the passes before it
            first, last, crowd = hits.agg(F.min("low"), F.max("low"), F.max("n")).first()
        if width == MICRO_US:
            return hits.select(*by, F.timestamp_micros("low").alias("cutoff"))
        inside = narrow.where(
            (F.col(ts) >= F.timestamp_micros(F.lit(first))) & (F.col(ts) < F.timestamp_micros(F.lit(last + width)))
        )
        if by:
            start, end = F.timestamp_micros("low"), F.timestamp_micros(F.col("low") + width)
            rows = join_groups(inside, hits.drop("n"), by).where((F.col(ts) >= start) & (F.col(ts) < end)).drop("low")
        else:
            rows = inside.withColumn("place", F.lit(found[0]["place"]))
        width, carried = SECOND_US if width == HOUR_US and crowd > FEW_ROWS else MICRO_US, True


def temporal_split(
    df: DataFrame, ts: str, ratio: float = 0.8, gap_hours: float = 0, by: Sequence[str] = (),
    cutoffs: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: train up to and including the cutoff (of the group), val strictly after cutoff + gap.

    Rows inside the gap belong to neither side and are dropped.  A single cutoff is a literal that reaches
    the file scan; cutoffs of groups are joined.
    """
    cut = time_cutoffs(df, ts, ratio, by) if cutoffs is None else cutoffs
    gap = int(gap_hours * 3_600_000_000)
    if by:
        rows, micros = join_groups(df, cut, list(by)), F.unix_micros("cutoff")
    else:
        rows, micros = df, F.lit(cut.select(F.unix_micros("cutoff")).first()[0])
    end, begin = F.timestamp_micros(micros), F.timestamp_micros(micros + F.lit(gap))
    side = F.when(F.col(ts) <= end, "train").otherwise("val").alias("split")
    return rows.where((F.col(ts) <= end) | (F.col(ts) > begin)).select(*[F.col(f"`{c}`") for c in df.columns], side)


def split_windows(
    df: DataFrame,
    node: str,
    order: Sequence[str],
    features: Sequence[str],
    label: str,
    ratio: float = 0.8,
    gap_hours: float = 0,
    window: int = 168,
    stride: int = 24,
    client: str | None = None,
    max_rows: int = MAX_GROUP_ROWS,
    hot: DataFrame | None | str = CHECK,
) -> DataFrame:
    """Temporal split, then windows on each side of each node separately.

    With ``client`` every client has its own cutoff, as it sees no rows but its own.
    """
    by = [client] if client else []
    sides = temporal_split(df, order[0], ratio, gap_hours, by)
    return stride_windows(
        sides, [*by, "split", node], order, features, label, window, stride, max_rows, hot=hot
    )


def split_strips(
    df: DataFrame, node: str, order: Sequence[str], features: Sequence[str], label: str, ratio: float = 0.8, gap_hours: float = 0,
    window: int = 168, stride: int = 24, client: str | None = None, max_rows: int = MAX_GROUP_ROWS, hot: DataFrame | None | str = CHECK,
) -> DataFrame:
    """The windows of :func:`split_windows` as strips that hold each row about once: what a fit stores."""
    by = [client] if client else []
    sides = temporal_split(df, order[0], ratio, gap_hours, by)
    return window_strips(sides, [*by, "split", node], order, features, label, window, stride, max_rows, hot)


def random_split(
    df: DataFrame, key: str, ratio: float, seed: int = 42, by: Sequence[str] = (), strict: bool = True
) -> DataFrame:
    """Add ``split``: exactly ``int(rows * ratio)`` test rows per group, all others train.

    With ``strict`` an empty side (or table) is an error, checked on the counts.  Rows that share a key are
    told apart by their other columns; a null group is a group.
    """
    if strict:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.floor(F.col("n") * F.lit(ratio)))
        bad = sizes.where((F.col("t") < 1) | (F.col("t") >= F.col("n"))).first()
        if bad is not None:
            raise ValueError(f"a side of the split is empty: {bad.asDict()}")
    chosen = mark_lowest(df, hash_token(seed, key), lambda n: F.floor(n * F.lit(ratio)), by, "_test")
    return chosen.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def balanced_sample(df: DataFrame, label: str, order: Sequence[str], n: int) -> DataFrame:
    """Up to ``n`` rows, one per class in turn, from the shortest prefix with two classes and ``n`` rows.

    Only bounded tops are gathered: the first ``n`` rows, the first row of each class, and the first
    ``n`` rows of each class within the prefix (Spark limits the groups before its exchange).
    """
    place = F.struct(*order)
    firsts = df.groupBy(label).agg(F.min(place).alias("p"))
    second = firsts.agg(F.element_at(F.sort_array(F.collect_list("p")), F.lit(2)).alias("p"))
    if firsts.limit(2).count() < 2:
        raise ValueError("a balanced sample needs two classes")
    nth = df.select(*order).orderBy(*order).limit(n).agg(F.max(place).alias("p"))
    end = nth.unionAll(second).agg(F.max("p").alias("p")).first()["p"]
    prefix = df.where(place <= F.struct(*[F.lit(end[o]).cast(df.schema[o].dataType).alias(o) for o in order]))
    turn = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return (
        prefix.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", label).limit(n)
    )


def select_clients(
    clients: DataFrame, client: str, fraction: float, min_clients: int, seed: int = 42, by: Sequence[str] = ("round",)
) -> DataFrame:
    """Clients taking part in each round: ``max(int(k * fraction), min_clients)`` lowest in hash order."""

    def take(k: Column) -> Column:
        return F.greatest(F.floor(k * F.lit(fraction)), F.lit(min_clients))

    at = [F.concat(F.col(c).cast("string"), F.lit(":")) for c in by]
    token = hash_token(seed, F.concat(*at, F.col(client).cast("string")))
    return mark_lowest(clients, token, lambda k: F.least(take(k), k), by, "_in").where("_in").drop("_in")
