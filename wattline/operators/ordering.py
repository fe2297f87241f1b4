"""Exact order-based work (positions, running totals, ranks) that survives very large groups.

A plain ``Window.partitionBy(key)`` sends all rows of one key to one task.  The helpers here keep that
plan while every group is small, and otherwise work on bounded slices of a group plus the few rows
of history that a slice needs from the ones before it.  Results are the same either way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.session import frozen

POS = "_pos"
SLICE = "_slice"
MAX_GROUP_ROWS = 2_000_000
MAX_BROADCAST_ROWS = 100_000
CHECK = "check"

AHEAD = (Window.unboundedPreceding, -1)


def _asc(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys where null is a group like any other; columns of ``left`` first, then those of ``right``."""
    named = {k: f"_key_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(named)
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    return left.join(other, on, how).drop(*named.values())


# ---------------------------------------------------------------- running totals over any number of rows


def range_slices(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range partition by ``order`` and number the partitions; the order of slices is the order of rows.

    Range bounds are sampled per plan, hence the result is frozen before anything reads it twice.
    """
    ranged = df.repartitionByRange(*_asc(order))
    return frozen(ranged.withColumn(SLICE, F.spark_partition_id()))


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Add ``ahead_<v>``: exact total of ``v`` over the rows of the same ``by`` group that come first.

    Totals per (group, slice) are a handful of rows; only those are scanned in sequence.  If the caller
    knows that there are at most ``rows`` rows and that is few, a plain window does.  A null key is a group too.
    """
    by = list(by)
    if rows is not None and rows <= MAX_GROUP_ROWS:
        ahead = Window.partitionBy(*by).orderBy(*_asc(order)).rowsBetween(*AHEAD)
        return df.select("*", *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"ahead_{v}") for v in values])
    sliced = range_slices(df, [*by, *order])
    sums = sliced.groupBy(*by, SLICE).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(*AHEAD)
    offsets = sums.select(
        *by, SLICE, *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    inside = Window.partitionBy(*by, SLICE).orderBy(*_asc(order)).rowsBetween(*AHEAD)
    joined = join_groups(sliced, offsets, [*by, SLICE])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"ahead_{v}")
            for v in values
        ],
    )


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """0-based position of every row in its group, by running totals of ones."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), by, order, ["_one"])
    return counted.withColumnRenamed("ahead__one", POS).drop("_one")


# ---------------------------------------------------------------- per-group series with bounded history


def bounded(df: DataFrame) -> DataFrame:
    """A small result as a broadcast table, if it was seen to have at most MAX_BROADCAST_ROWS rows; else ``df``."""
    found = df.take(MAX_BROADCAST_ROWS + 1)
    if len(found) > MAX_BROADCAST_ROWS:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def hot_groups(df: DataFrame, by: Sequence[str], max_rows: int = MAX_GROUP_ROWS) -> DataFrame | None:
    """Keys of groups above ``max_rows`` rows, or None.  There are at most rows/max_rows of them.

    One scan of the key columns with map-side counts decides.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0]
    if largest is None or largest <= max_rows:
        return None
    return bounded(counts.where(F.col("_n") > max_rows).select(*by))


def over_series(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    history: int,
    build: Callable[[DataFrame, list[str]], DataFrame],
    max_rows: int = MAX_GROUP_ROWS,
    unit: int = 1,
    hot: DataFrame | None | str = CHECK,
) -> DataFrame:
    """Run ``build`` on each ordered series of ``df``; every result row may look back ``history`` rows.

    ``build(rows, parts)`` gets rows with a 0-based position ``POS`` and must partition its windows and
    groups by ``parts``; its output keeps ``parts`` and the ``POS`` of the row that owns the result.
    Series of up to ``max_rows`` rows take one exchange by key.  Longer ones are cut by position in
    slices of an eighth of that (a multiple of ``unit``); a slice also gets the ``history`` rows before
    it, whose own results belong to the slice before.

    ``hot`` may name the long series (by some or all columns of ``by``), as found by :func:`hot_groups` on a
    table that holds at least these rows; otherwise the rows are counted here.
    """
    by = list(by)
    if isinstance(hot, str):
        hot = hot_groups(df, by, max_rows)
    cold = df if hot is None else join_groups(df, hot, hot.columns, "left_anti")
    first = Window.partitionBy(*by).orderBy(*_asc(order))
    plain = build(cold.withColumn(POS, (F.row_number().over(first) - 1).cast("bigint")), by)
    if hot is None:
        return plain
    size = max(unit, max_rows // 8 // unit * unit)
    placed = positions(join_groups(df, hot, hot.columns, "left_semi"), by, order)
    own = F.expr(f"{POS} div {size}")
    spread = placed.withColumn(SLICE, F.explode(F.sequence(own, F.expr(f"({POS} + {history}) div {size}"))))
    sliced = build(spread, [*by, SLICE]).where(own == F.col(SLICE)).drop(SLICE)
    return plain.unionByName(sliced)


# ---------------------------------------------------------------- exact ranks in md5 order without a sort

TOKEN = "_token"
BUCKET_DIGITS = 4


def hash_token(seed: Column | int | str, key: str | Column) -> Column:
    """Pseudo-random sort key that every engine computes alike; ``key`` must be unique per ranked row.

    A null key counts as one more key, so that its rows are not lost.
    """
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))))


def _bucket_totals(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Rows per (group, token prefix) with the rows ahead of it and the group size.

    md5 spreads evenly, so a prefix of four hex digits holds 1/65536 of a group, however large.
    """
    counts = tokens.groupBy(*by, F.substring(TOKEN, 1, BUCKET_DIGITS).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ahead = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(*AHEAD)
    return counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).withColumn(
        "_size", F.sum("_n").over(Window.partitionBy(*by))
    )


def _cutoffs(tokens: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """Tokens at the ranks ``_needs`` inside each wanted (group, bucket): only those buckets are read and sorted.

    ``_ties``: how many rows with that very token lie up to the rank, ``_same``: how many there are (1 and 1 where
    tokens are unique).
    """
    keys = [*by, "_bucket"]
    inside = join_groups(
        tokens.withColumn("_bucket", F.substring(TOKEN, 1, BUCKET_DIGITS)), wanted.select(*keys, "_needs"), keys
    )
    sorted_ = Window.partitionBy(*keys).orderBy(TOKEN)
    ranked = inside.select(
        "*", F.row_number().over(sorted_).alias("_rank"), F.rank().over(sorted_).alias("_first"),
        F.count(F.lit(1)).over(sorted_.rangeBetween(Window.currentRow, Window.currentRow)).alias("_same"),
    )
    hits = ranked.where(F.array_contains("_needs", F.col("_rank").cast("bigint")))
    cut = F.sort_array(F.collect_list(F.struct(TOKEN, (F.col("_rank") - F.col("_first") + 1).alias("tie"), "_same")))
    at = F.col("_at")
    return hits.groupBy(*keys).agg(cut.alias("_at")).select(
        *keys, at[TOKEN].alias("_cuts"), at["tie"].alias("_ties"), at["_same"].alias("_same")
    )


def mark_lowest(
    df: DataFrame,
    token: Column,
    take: Callable[[Column], Column],
    by: Sequence[str] = (),
    flag: str = "chosen",
) -> DataFrame:
    """Flag exactly ``take(group size)`` rows per group: those lowest in token order.

    Rows are counted per token prefix, one prefix per group is ranked exactly, and the rows themselves
    are only compared with their group's cutoff token.  Rows that share that very token (repeated keys) are
    taken in the order of all their columns, so the number is exact.
    """
    by = list(by)
    rows = df.withColumn(TOKEN, token)
    tokens = rows.select(*by, TOKEN)
    totals = _bucket_totals(tokens, by).withColumn("_take", take(F.col("_size")).cast("bigint"))
    border = totals.where(
        (F.col("_take") > F.col("_ahead")) & (F.col("_take") <= F.col("_ahead") + F.col("_n"))
    ).withColumn("_needs", F.array(F.col("_take") - F.col("_ahead")))
    cut = _cutoffs(tokens, by, border)
    if by:
        cut = bounded(cut.select(*by, *[F.element_at(c, 1).alias(a) for c, a in (("_cuts", "_cut"), ("_ties", "_tie"), ("_same", "_same"))]))
        most = cut.agg(F.max("_same")).first()[0]
        marked = join_groups(rows, cut, by, "left")
    else:
        found = cut.select(*[F.element_at(c, 1) for c in ("_cuts", "_ties", "_same")]).first()  # one line at most
        value, tie, most = found if found else (None, None, None)
        marked = rows.withColumn("_cut", F.lit(value).cast("string")).withColumn("_tie", F.lit(tie).cast("int"))
    if most is None or most == 1:
        return marked.withColumn(flag, F.coalesce(F.col(TOKEN) <= F.col("_cut"), F.lit(False))).select(*df.columns, flag)
    below = F.coalesce(F.col(TOKEN) < F.col("_cut"), F.lit(False))
    equal = F.coalesce(F.col(TOKEN) == F.col("_cut"), F.lit(False))
    clear = marked.where(~equal).select(*df.columns, below.alias(flag))
    place = F.row_number().over(Window.partitionBy(*by, TOKEN).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    tied = marked.where(equal).withColumn("_place", place).select(*df.columns, (F.col("_place") <= F.col("_tie")).alias(flag))
    return clear.unionAll(tied)


def run_ends(rows: int, parts: int) -> list[int]:
    """Rank of the last row of each part but the last: near-equal runs, the first ``rows mod parts`` one longer."""
    each, extra = divmod(rows, parts)
    return [j * each + min(j, extra) for j in range(1, parts)]


def hash_parts(df: DataFrame, keys: DataFrame, token: Column, parts: int, part: str) -> DataFrame:
    """Add the 0-based part of ``token``: the distinct ``keys`` in token order, cut in ``parts`` runs.

    One narrow pass counts the keys per token prefix (at most 65536 lines), a second one ranks the keys of
    the few prefixes that hold a boundary.  The rows of ``df`` are never shuffled: each meets a table of
    prefixes with the parts passed before it and the boundaries inside it.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    if parts == 1:
        return df.withColumn(part, F.lit(0))
    spark = df.sparkSession
    tokens = keys.select(token.alias(TOKEN))
    prefix = F.substring(TOKEN, 1, BUCKET_DIGITS).alias("_bucket")
    counts = sorted((r[0], r[1]) for r in tokens.groupBy(prefix).count().collect())
    ends = run_ends(sum(n for _, n in counts), parts)
    ahead, passed, needs = 0, 0, []
    lines = []
    for bucket, n in counts:
        first = passed
        while passed < parts - 1 and ends[passed] <= ahead + n:
            passed += 1
        inside = [e - ahead for e in ends[first:passed]]
        lines.append((bucket, first))
        needs += [(bucket, inside)] if inside else []
        ahead += n
    wanted = F.broadcast(spark.createDataFrame(needs, "_bucket string, _needs array<bigint>"))
    cuts = {r["_bucket"]: r["_cuts"] for r in _cutoffs(tokens, [], wanted).collect()}
    table = spark.createDataFrame(
        [(b, first, cuts.get(b, [])) for b, first in lines], "_bucket string, _passed int, _cuts array<string>"
    )
    rows = df.withColumn(TOKEN, token).withColumn("_bucket", F.substring(TOKEN, 1, BUCKET_DIGITS))
    crossed = F.size(F.filter("_cuts", lambda c: c < F.col(TOKEN)))
    return rows.join(F.broadcast(table), "_bucket").select(*df.columns, (F.col("_passed") + crossed).alias(part))
