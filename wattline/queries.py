"""Registered queries: every operator over the whole given tables, with the SQL that must give the same rows.

``events`` serve as readings (node = user_id), ``embeddings`` as flat training rows, ``customer`` as clients
that report metrics, ``lineitem`` as long series per supplier.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.config import ModelSettings
from wattline.functions import columns as C
from wattline.operators import clients as K
from wattline.operators import features as P
from wattline.operators import history as H
from wattline.operators import metrics as M
from wattline.operators import scaling as Z
from wattline.operators import splits as D
from wattline.operators import windows as W
from wattline.plans import fitting as T
from wattline.plans import rounds as R
from wattline.plans.preparation import as_strips, prepare_readings
from wattline.plans.search import fit_trials, search
from wattline.operators.ordering import CHECK, hot_groups
from wattline.session import shared_folder, stored, tune
from wattline.sources import readings as S
from wattline.sources import stores as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---------------------------------------------------------------- inputs

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
NODE, ORDER = "node_id", ["ts", "row_key"]
USES = ["click", "error", "purchase", "view"]
VALUES = ["meter_reading", "prob"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    tune(spark)
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return S.read_readings(spark, f"{sf}/events.parquet", EVENTS, "value").select(
        F.col("user_id").alias("node_id"),
        "ts",
        F.col("event_id").alias("row_key"),
        F.col("value").alias("meter_reading"),
        F.col("event_type").alias("primary_use"),
        (number >= 90).cast("int").alias("anomaly"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("prob"),
    )


R_SQL = """r AS (
  SELECT user_id AS node_id, ts, event_id AS row_key, value AS meter_reading, event_type AS primary_use,
    CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) >= 90 THEN 1 ELSE 0 END AS anomaly,
    least(value / 500e0, 1e0) AS prob
  FROM events)"""


def r6(col: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison between engines; adding 0 turns -0.0 into 0.0."""
    return F.round(col, digits) + F.lit(0.0)


def q6(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


def us(col: str) -> Column:
    return F.unix_micros(col)


# ---------------------------------------------------------------- features and encodings

METER = [
    "meter_lag1", "meter_lag24", "meter_roll_mean_24", "meter_roll_std_24", "meter_diff_1", "meter_diff_24",
    "meter_zscore_24",
]

FEATURES_SQL = f"""{R_SQL}, f AS (
  SELECT *, lag(meter_reading, 1) OVER s AS meter_lag1, lag(meter_reading, 24) OVER s AS meter_lag24,
    avg(meter_reading) OVER (s ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS meter_roll_mean_24,
    stddev_samp(meter_reading) OVER (s ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS meter_roll_std_24
  FROM r WINDOW s AS (PARTITION BY node_id ORDER BY ts, row_key)), ff AS (
  SELECT *, meter_reading - meter_lag1 AS meter_diff_1, meter_reading - meter_lag24 AS meter_diff_24,
    (meter_reading - meter_roll_mean_24) / (meter_roll_std_24 + 1e-6) AS meter_zscore_24,
    {", ".join(f"CASE WHEN primary_use = '{u}' THEN 1e0 ELSE 0e0 END AS primary_use_{u}" for u in USES)}
  FROM f WHERE meter_lag24 IS NOT NULL AND meter_roll_std_24 IS NOT NULL AND meter_reading IS NOT NULL)"""


def prepared(spark: SparkSession, sf: str, hot=CHECK) -> DataFrame:
    return prepare_readings(readings(spark, sf), NODE, ORDER, "meter_reading", "primary_use", USES, hot=hot)


def prepared_windows(spark: SparkSession, sf: str, features: list[str]) -> DataFrame:
    """Windows of prepared readings; long series are looked for once, in the raw rows."""
    hot = hot_groups(readings(spark, sf), [NODE])
    return W.stride_windows(prepared(spark, sf, hot), [NODE], ORDER, features, "anomaly", 6, 3, hot=hot)


GAPS_SQL = FEATURES_SQL.replace("value AS meter_reading", "CASE WHEN event_id % 50 <> 7 THEN value END AS meter_reading")


@query(f"""WITH {GAPS_SQL} SELECT node_id, row_key, {", ".join(f"{q6(c)} AS {c}" for c in METER)} FROM ff
  WHERE meter_lag1 IS NOT NULL""")
def meter_features_gaps(spark, sf):
    """NaN readings are missing readings."""
    value = F.when(F.col("row_key") % 50 != 7, F.col("meter_reading")).otherwise(F.lit(float("nan")))
    rows = readings(spark, sf).withColumn("meter_reading", value)
    out = prepare_readings(rows, NODE, ORDER, "meter_reading", "primary_use", USES)
    return out.select(NODE, "row_key", *[r6(c).alias(c) for c in METER])


@query(
    f"""WITH {FEATURES_SQL} SELECT node_id, row_key, {", ".join(f"{q6(c)} AS {c}" for c in METER)},
    {", ".join(f"primary_use_{u}" for u in USES)} FROM ff"""
)
def meter_features(spark, sf):
    out = prepared(spark, sf)
    return out.select(NODE, "row_key", *[r6(c).alias(c) for c in METER], *[f"primary_use_{u}" for u in USES])


@query(
    f"""WITH {R_SQL} SELECT row_key,
    {", ".join(f"CASE WHEN primary_use = '{u}' THEN 1e0 ELSE 0e0 END AS primary_use_{u}" for u in USES)} FROM r"""
)
def one_hot_fixed(spark, sf):
    return P.one_hot_fixed(readings(spark, sf).select("row_key", "primary_use"), "primary_use", USES)


@query(
    f"""WITH {R_SQL} SELECT row_key,
    {", ".join(f"CASE WHEN primary_use = '{u}' THEN 1e0 ELSE 0e0 END AS primary_use_{u}"
               for u in ["error", "purchase", "signup", "view"])} FROM r"""
)
def one_hot_data(spark, sf):
    return P.one_hot_data(readings(spark, sf).select("row_key", "primary_use"), "primary_use")


@query(f"WITH {R_SQL} SELECT row_key, dense_rank() OVER (ORDER BY primary_use) - 1 AS code FROM r")
def label_encode(spark, sf):
    return P.label_encode(readings(spark, sf).select("row_key", "primary_use"), "primary_use", "code").drop(
        "primary_use"
    )


@query("SELECT doc_id, dense_rank() OVER (ORDER BY md5(text)) - 1 AS code FROM documents")
def label_encode_many(spark, sf):
    """Encoding with more values than fit a column list: codes by exact ranks."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    return P.label_encode(docs, "digest", "code").select("doc_id", "code")


NARROWED = ["coerced", "finite", "flag"]


@query(
    f"""WITH {R_SQL}, d AS (SELECT row_key, node_id, anomaly AS y,
      CASE WHEN primary_use = 'error' THEN NULL ELSE meter_reading END AS coerced,
      CASE WHEN primary_use IN ('click', 'view') THEN 0e0 ELSE meter_reading END AS finite,
      CASE WHEN meter_reading > 100 THEN 1e0 ELSE 0e0 END AS flag
    FROM r WHERE NOT (primary_use = 'signup' AND anomaly = 1))
    SELECT CAST(row_key AS INTEGER) AS row_key, CAST(node_id AS INTEGER) AS node_id, y,
    {", ".join(f"{q6(f'CAST(CAST({c} AS FLOAT) AS DOUBLE)', 4)} AS {c}" for c in NARROWED)} FROM d"""
)
def clean_values(spark, sf):
    """Bad numbers, non-finite values, padded labels, missing targets, flags and wide types in one table."""
    use, v = F.col("primary_use"), F.col("meter_reading")
    label = F.when(F.col("anomaly") == 0, " Natural").when(use != "signup", "Attack ")
    raw = readings(spark, sf).select(
        "row_key",
        NODE,
        label.alias("marker"),
        F.when(use == "error", "n/a").otherwise(v.cast("string")).alias("coerced"),
        F.when(use == "click", float("nan")).when(use == "view", float("inf")).otherwise(v).alias("finite"),
        (v > 100).alias("flag"),
    )
    whole = P.drop_missing_target(P.coerce_numeric(raw, ["coerced"]), "marker")
    coded = P.map_labels(whole, "marker", {"Natural": 0, "Attack": 1}, "y").drop("marker")
    small = P.narrow_numeric(P.zero_nonfinite(P.bool_to_float(coded), ["finite"]))
    return small.select("row_key", NODE, "y", *[r6(F.col(c).cast("double"), 4).alias(c) for c in NARROWED])


VECTOR = ["prob", "anomaly", "meter_reading", "row_key"]


@query(f"""WITH {R_SQL} SELECT row_key, 4 AS n, {q6(" + ".join(f"{i + 1} * CAST(CAST({c} AS FLOAT) AS DOUBLE)" for i, c in enumerate(VECTOR)), 4)} AS ordered
  FROM r WHERE prob IS NOT NULL AND meter_reading IS NOT NULL""")
def assemble_features(spark, sf):
    """Rows without nulls as feature arrays in a fixed order."""
    whole = P.drop_null_rows(readings(spark, sf).withColumn("row", F.col("row_key")))
    out = P.assemble_features(whole, VECTOR, ["row"])
    placed = F.aggregate(F.transform("x", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return out.select(F.col("row").alias("row_key"), F.size("x").alias("n"), r6(placed, 4).alias("ordered"))


@query(f"WITH {R_SQL} SELECT row_key, node_id, meter_reading FROM r ORDER BY row_key LIMIT 4900 OFFSET 100")
def row_slice(spark, sf):
    return P.row_slice(readings(spark, sf), ["row_key"], 100, 5000, ["row_key", NODE, "meter_reading"])


@query("SELECT DISTINCT trim(event_type) AS label FROM events WHERE trim(event_type) NOT IN ('click', 'view')")
def unknown_labels(spark, sf):
    return P.unknown_labels(readings(spark, sf), "primary_use", ["click", "view"])


# ---------------------------------------------------------------- splits and windows

RATIO, GAP_HOURS = 1.0 - 0.2, 12

CUT_SQL = f"""{R_SQL}, cut AS (
  SELECT ts AS cutoff FROM (
    SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM r)
  WHERE i = CAST(floor(n * 0.8e0) AS BIGINT)), sp AS (
  SELECT r.*, CASE WHEN ts <= cutoff THEN 'train' ELSE 'val' END AS split FROM r, cut
  WHERE ts <= cutoff OR ts > cutoff + INTERVAL 12 HOUR)"""


@query(f"WITH {CUT_SQL} SELECT epoch_us(cutoff) AS cutoff_us FROM cut")
def time_cutoff(spark, sf):
    return D.time_cutoffs(readings(spark, sf), "ts", RATIO).select(us("cutoff").alias("cutoff_us"))


@query(f"""WITH {R_SQL}, k AS (
  SELECT primary_use, ts, row_number() OVER (PARTITION BY primary_use ORDER BY ts) - 1 AS i,
    count(*) OVER (PARTITION BY primary_use) AS n FROM r)
  SELECT primary_use, epoch_us(ts) AS cutoff_us FROM k WHERE i = CAST(floor(n * 0.8e0) AS BIGINT)""")
def time_cutoff_groups(spark, sf):
    """One cutoff per group, as each client has its own."""
    cuts = D.time_cutoffs(readings(spark, sf), "ts", RATIO, ["primary_use"])
    return cuts.select("primary_use", us("cutoff").alias("cutoff_us"))


def null_use(df: DataFrame) -> DataFrame:
    """Readings whose uses have a group without a name."""
    return df.withColumn("primary_use", F.nullif("primary_use", F.lit("error")))


def null_sql(sql: str) -> str:
    return sql.replace("event_type AS primary_use", "nullif(event_type, 'error') AS primary_use")


@query(null_sql(SQL["time_cutoff_groups"]))
def time_cutoff_null_group(spark, sf):
    cuts = D.time_cutoffs(null_use(readings(spark, sf)), "ts", RATIO, ["primary_use"])
    return cuts.select("primary_use", us("cutoff").alias("cutoff_us"))


@query("SELECT event_id AS row_key, epoch_us(ts) AS ts_us FROM events")
def parse_time(spark, sf):
    """Times written as text and read back."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return readings(spark, sf).select("row_key", us(C.parse_time(text, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts_us"))


@query(f"WITH {CUT_SQL} SELECT row_key, split FROM sp")
def temporal_split(spark, sf):
    return D.temporal_split(readings(spark, sf), "ts", RATIO, GAP_HOURS).select("row_key", "split")


def windows_sql(source: str, keys: str, order: str, label: str, window: int, stride: int, columns: str) -> str:
    """CTEs n (numbered rows), w (window starts with label), g (aggregates of the rows in each window)."""
    same = " AND ".join(f"n.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    return f"""n AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS rn,
    count(*) OVER (PARTITION BY {keys}) AS cnt FROM {source}), w AS (
  SELECT {keys}, rn AS start, {order.split(",")[0]} AS start_ts,
    lead({label}, {window}) OVER s AS y, lead({order.split(",")[0]}, {window}) OVER s AS label_ts, cnt
  FROM n WINDOW s AS (PARTITION BY {keys} ORDER BY rn)), g AS (
  SELECT {", ".join(f"w.{k.strip()}" for k in keys.split(","))}, start, start_ts, label_ts, y, {columns}
  FROM w JOIN n ON {same} AND n.rn BETWEEN w.start AND w.start + {window - 1}
  WHERE w.start % {stride} = 0 AND w.start + {window} < w.cnt GROUP BY ALL)"""


def f32(c: str) -> str:
    return f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"


def window_sums(cols: list[str]) -> str:
    total = " + ".join(f32(c) for c in cols)
    return f"""CAST(count(*) AS INTEGER) AS n_rows, sum({total}) AS total,
    sum((n.rn - w.start + 1) * {f32(cols[0])}) AS ordered"""


WINDOW_OUT = f"""start, epoch_us(start_ts) AS start_us, epoch_us(label_ts) AS label_us, y, n_rows,
  {q6("total", 5)} AS total, {q6("ordered", 4)} AS ordered FROM g"""


def window_summary(out: DataFrame, keys: list[str]) -> DataFrame:
    """Length, plain sum and place-weighted sum of each window: differs if any value or its place does."""
    total = F.aggregate(
        F.flatten("x"), F.lit(0.0), lambda acc, v: acc + v.cast("double")
    )
    placed = F.aggregate(
        F.transform("x", lambda row, i: row[0].cast("double") * (i + 1)), F.lit(0.0), lambda acc, v: acc + v
    )
    return out.select(
        *keys, "start", us("start_ts").alias("start_us"), us("label_ts").alias("label_us"), "y",
        F.size("x").alias("n_rows"), r6(total, 5).alias("total"), r6(placed, 4).alias("ordered"),
    )


@query(f"""WITH {R_SQL}, {windows_sql("r", "node_id", "ts, row_key", "anomaly", 24, 8, window_sums(VALUES))}
  SELECT node_id, {WINDOW_OUT}""")
def stride_windows(spark, sf):
    out = W.stride_windows(readings(spark, sf), [NODE], ORDER, VALUES, "anomaly", 24, 8)
    return window_summary(out, [NODE])


@query(f"""WITH {R_SQL}, {windows_sql("r", "node_id", "ts, row_key", "anomaly", 24, 7, window_sums(VALUES))}
  SELECT node_id, {WINDOW_OUT}""")
def stride_windows_odd(spark, sf):
    """A stride that does not divide the window."""
    out = W.stride_windows(readings(spark, sf), [NODE], ORDER, VALUES, "anomaly", 24, 7)
    return window_summary(out, [NODE])


@query(f"""WITH {CUT_SQL}, {windows_sql("sp", "split, node_id", "ts, row_key", "anomaly", 6, 3, window_sums(VALUES))}
  SELECT split, node_id, start, y, n_rows, total FROM (SELECT split, node_id, {WINDOW_OUT})""")
def split_strips(spark, sf):
    """The windows of both sides, cut again from strips that hold each row about once."""
    strips = D.split_strips(readings(spark, sf), NODE, ORDER, VALUES, "anomaly", RATIO, GAP_HOURS, 6, 3)
    windows = strips.select(
        "split", NODE, F.posexplode("y").alias("i", "y"), "start", "stride", "window", F.lit(len(VALUES)).alias("width"), "x",
    )
    values = F.expr("slice(x, CAST(i * stride * width AS INT) + 1, window * width)")
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return windows.select(
        "split", NODE, (F.col("start") + F.col("i") * F.col("stride")).alias("start"), "y",
        (F.size(values) / F.col("width")).cast("int").alias("n_rows"), r6(total, 5).alias("total"),
    )


@query(f"""WITH {CUT_SQL}, {windows_sql("sp", "split, node_id", "ts, row_key", "anomaly", 6, 3, window_sums(VALUES))}
  SELECT split, node_id, {WINDOW_OUT}""")
def split_windows(spark, sf):
    out = D.split_windows(readings(spark, sf), NODE, ORDER, VALUES, "anomaly", RATIO, GAP_HOURS, 6, 3)
    return window_summary(out, ["split", NODE])


LAGS = ["meter_reading", "meter_lag1", "meter_lag24", "meter_diff_1", "meter_diff_24"]


@query(f"""WITH {FEATURES_SQL}, {windows_sql("ff", "node_id", "ts, row_key", "anomaly", 6, 3, window_sums(LAGS))}
  SELECT node_id, {WINDOW_OUT}""")
def test_windows(spark, sf):
    """Held-out table: features, null rows dropped, windows, no split."""
    out = prepared_windows(spark, sf, LAGS)
    return window_summary(out, [NODE])


LINES = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def supplier_lines(spark, sf):
    tune(spark)
    schema = (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    )
    lines = S.read_readings(spark, f"{sf}/lineitem.parquet", schema, "l_quantity")
    return lines.withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))


LINES_SQL = "li AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem)"


@query(f"""WITH {LINES_SQL}, {windows_sql("li", "l_suppkey", ", ".join(LINES), "returned", 168, 24,
  window_sums(["l_quantity", "l_discount", "l_tax"]))} SELECT l_suppkey, {WINDOW_OUT}""")
def weekly_windows(spark, sf):
    """Windows of 168 rows, stride 24, over the long series of suppliers."""
    out = W.stride_windows(
        supplier_lines(spark, sf), ["l_suppkey"], LINES, ["l_quantity", "l_discount", "l_tax"], "returned", 168, 24
    )
    return window_summary(out, ["l_suppkey"])


@query(f"""WITH {R_SQL}, {windows_sql("r", "node_id", "ts, row_key", "anomaly", 24, 8,
  "count(*) AS n, sum(meter_reading) AS s, avg(meter_reading) AS m, var_pop(meter_reading) AS v")}
  SELECT node_id, start, y, n, {q6("s")} AS total, {q6("m")} AS mean, {q6("sqrt(v)")} AS std FROM g""")
def window_long_stats(spark, sf):
    out = W.window_stats(readings(spark, sf), [NODE], ORDER, ["meter_reading"], "anomaly", 24, 8)
    return out.select(
        NODE, "start", "y", F.col("n_meter_reading").alias("n"), r6("sum_meter_reading").alias("total"),
        r6("mean_meter_reading").alias("mean"), r6(F.sqrt("var_meter_reading")).alias("std"),
    )


@query(f"""WITH {R_SQL}, {windows_sql("r", "node_id", "ts, row_key", "anomaly", 24, 8,
  "avg(meter_reading) AS m, var_pop(meter_reading) AS v")}, x AS (
  SELECT g.node_id, g.start, g.y, n.rn - g.start + 1 AS i, (n.meter_reading - g.m) / sqrt(g.v + 1e-5) AS z
  FROM g JOIN n ON n.node_id = g.node_id AND n.rn BETWEEN g.start AND g.start + 23)
  SELECT node_id, start, y, {q6("sum(z * i)", 4)} AS ordered, {q6("sum(z * z)", 5)} AS squares
  FROM x GROUP BY node_id, start, y""")
def instance_norm(spark, sf):
    out = W.instance_norm(readings(spark, sf), [NODE], ORDER, ["meter_reading"], "anomaly", 24, 8)
    x = F.col("x_meter_reading")
    placed = F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    squares = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)
    return out.select(NODE, "start", "y", r6(placed, 4).alias("ordered"), r6(squares, 5).alias("squares"))


@query(f"""WITH p AS (SELECT vec_id, embedding, unnest(range(0, (len(embedding) - 16) // 8 + 1)) AS i FROM embeddings)
  SELECT vec_id, i AS patch, CAST(len(embedding[i * 8 + 1 : i * 8 + 16]) AS INTEGER) AS n_values,
  {q6("list_sum(list_transform(embedding[i * 8 + 1 : i * 8 + 16], lambda v: CAST(v AS DOUBLE)))", 5)} AS total FROM p""")
def patches(spark, sf):
    cut = table(spark, sf, "embeddings").select("vec_id", F.posexplode(C.patches("embedding")).alias("patch", "p"))
    total = F.aggregate("p", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return cut.select(
        "vec_id", F.col("patch").cast("bigint").alias("patch"), F.size("p").alias("n_values"), r6(total, 5).alias("total")
    )


# ---------------------------------------------------------------- clients

NODES_SQL = f"""{R_SQL}, a AS (
  SELECT node_id, ntile(4) OVER (ORDER BY md5('42:' || node_id), node_id) - 1 AS client_id
  FROM (SELECT DISTINCT node_id FROM r))"""
ROWS_SQL = f"""{R_SQL}, ar AS (
  SELECT *, ntile(5) OVER (ORDER BY md5('42:' || row_key), row_key) - 1 AS client_id FROM r)"""


@query(f"WITH {NODES_SQL} SELECT row_key, node_id, CAST(client_id AS INTEGER) AS client_id FROM r JOIN a USING (node_id)")
def assign_nodes(spark, sf):
    return K.assign_nodes_random(readings(spark, sf), NODE, 4).select("row_key", NODE, "client_id")


@query(f"WITH {ROWS_SQL} SELECT row_key, CAST(client_id AS INTEGER) AS client_id FROM ar")
def assign_rows(spark, sf):
    return K.assign_rows_random(readings(spark, sf), "row_key", 5).select("row_key", "client_id")


@query(f"WITH {NODES_SQL} SELECT row_key, node_id, meter_reading FROM r JOIN a USING (node_id) WHERE client_id = 2")
def client_rows(spark, sf):
    rows = readings(spark, sf)
    nodes = K.assign_nodes_random(rows.select(NODE).distinct(), NODE, 4)
    return K.client_rows(rows, nodes, NODE, 2).select("row_key", NODE, "meter_reading")


@query(f"""WITH {R_SQL}, u AS (SELECT row_key, CASE WHEN primary_use <> 'error' THEN primary_use END AS node FROM r), c AS (
  SELECT node, ntile(3) OVER (ORDER BY md5('42:' || coalesce(node, 'null'))) - 1 AS client_id FROM (SELECT DISTINCT node FROM u))
  SELECT row_key, u.node, CAST(client_id AS INTEGER) AS client_id FROM u JOIN c ON c.node IS NOT DISTINCT FROM u.node""")
def client_rows_null_node(spark, sf):
    """Every row with its node's client, one of the nodes being null."""
    node = F.when(F.col("primary_use") != "error", F.col("primary_use"))
    rows = readings(spark, sf).select("row_key", node.alias("node"))
    return K.client_rows(rows, K.assign_nodes_random(rows.select("node").distinct(), "node", 3), "node")


@query(f"""WITH {R_SQL}, h AS (
  SELECT row_key, primary_use, row_number() OVER (PARTITION BY primary_use ORDER BY md5('42:' || row_key)) AS i,
    count(*) OVER (PARTITION BY primary_use) AS n FROM r)
  SELECT row_key, primary_use, CASE WHEN i <= floor(n * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM h""")
def split_exact(spark, sf):
    return D.random_split(readings(spark, sf), "row_key", 0.2, 42, ["primary_use"]).select(
        "row_key", "primary_use", "split"
    )


@query(null_sql(SQL["split_exact"]))
def split_exact_null_group(spark, sf):
    return D.random_split(null_use(readings(spark, sf)), "row_key", 0.2, 42, ["primary_use"]).select(
        "row_key", "primary_use", "split"
    )


@query(f"""WITH {R_SQL} SELECT primary_use, count(*) AS n, CAST(floor(count(*) * 0.25e0) AS BIGINT) AS n_test FROM r GROUP BY primary_use""")
def split_exact_repeated_keys(spark, sf):
    """Nodes as keys: many rows share one, and still the number of test rows is exact."""
    out = D.random_split(readings(spark, sf), NODE, 0.25, 42, ["primary_use"])
    return out.groupBy("primary_use").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("n_test"))


@query(f"""WITH RECURSIVE {R_SQL}, c AS (
  SELECT node_id, count(*) AS n_rows FROM r GROUP BY node_id), o AS (
  SELECT *, row_number() OVER (ORDER BY n_rows DESC, node_id) AS i FROM c), step AS (
  SELECT 0 AS i, [0, 0, 0, 0]::BIGINT[] AS loads, 0 AS part, 0 AS size
  UNION ALL
  SELECT o.i, list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + o.n_rows ELSE v END),
    list_position(loads, list_min(loads)) - 1, o.n_rows
  FROM step JOIN o ON o.i = step.i + 1), took AS (
  SELECT size, part, count(*) AS items FROM step WHERE i > 0 GROUP BY size, part), ends AS (
  SELECT size, part, items, sum(items) OVER (PARTITION BY size ORDER BY part) AS top FROM took), rk AS (
  SELECT *, row_number() OVER (PARTITION BY n_rows ORDER BY md5('node:' || node_id)) AS k FROM c)
  SELECT node_id, n_rows, CAST(part AS INTEGER) AS client_id FROM rk JOIN ends
  ON size = n_rows AND k <= top AND k > top - items""")
def assign_balanced(spark, sf):
    return K.assign_nodes_balanced(readings(spark, sf), NODE, 4)


@query(f"""WITH {NODES_SQL} SELECT CAST(client_id AS INTEGER) AS client_id, count(*) AS n_rows,
  count(DISTINCT node_id) AS n_nodes FROM r JOIN a USING (node_id) GROUP BY client_id""")
def partition_stats(spark, sf):
    return K.partition_stats(K.assign_nodes_random(readings(spark, sf), NODE, 4), NODE)


@query(f"""WITH {ROWS_SQL} SELECT node_id, CAST(min(client_id) AS INTEGER) AS first_client,
  CAST(max(client_id) AS INTEGER) AS last_client FROM ar GROUP BY node_id HAVING min(client_id) <> max(client_id)""")
def node_overlap(spark, sf):
    """Nodes that a split by rows tears apart."""
    return K.node_overlap(K.assign_rows_random(readings(spark, sf), "row_key", 5), NODE)


@query(f"WITH {R_SQL} SELECT node_id, count(*) AS n_rows FROM r GROUP BY node_id")
def node_counts(spark, sf):
    return K.node_counts(readings(spark, sf), NODE)


@query(f"""WITH {NODES_SQL} SELECT CAST(client_id AS INTEGER) AS client_id, count(*) AS n_rows,
  count(DISTINCT node_id) AS n_nodes, {q6("sum(meter_reading)", 3)} AS total,
  max(epoch_us(ts)) AS last_us FROM r JOIN a USING (node_id) GROUP BY client_id""")
def client_files(spark, sf):
    """Client files written as CSV and read back, one scan for all clients."""
    folder = f"{shared_folder(spark)}/clients-{uuid.uuid4().hex}"
    rows = K.assign_nodes_random(readings(spark, sf), NODE, 4).select("client_id", NODE, "ts", "row_key", "meter_reading")
    S.write_client_parts(rows, folder, [NODE, "ts"])
    back = S.load_clients(
        spark, folder, "node_id bigint, ts timestamp, meter_reading double", "local", "meter_reading", 4
    )
    per_node = back.groupBy("client_id", NODE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("meter_reading").alias("s"), F.max("ts").alias("t")
    )
    return per_node.groupBy("client_id").agg(
        F.sum("n").alias("n_rows"), F.count(NODE).alias("n_nodes"), r6(F.sum("s"), 3).alias("total"),
        us(F.max("t")).alias("last_us"),
    )


@query(f"""WITH {R_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY row_key) AS pos FROM r), p AS (
  SELECT greatest(64, max(first)) AS top FROM (
    SELECT min(pos) AS first FROM o GROUP BY anomaly ORDER BY first LIMIT 2)), t AS (
  SELECT row_key, anomaly, row_number() OVER (PARTITION BY anomaly ORDER BY pos) AS turn FROM o, p WHERE pos <= top)
  SELECT row_key, anomaly, CAST(turn AS INTEGER) AS turn FROM t ORDER BY turn, anomaly LIMIT 64""")
def balanced_sample(spark, sf):
    return D.balanced_sample(readings(spark, sf), "anomaly", ["row_key"], 64).select("row_key", "anomaly", "turn")


@query("""WITH c AS (SELECT c_nationkey AS round, c_custkey AS client_id, count(*) OVER (PARTITION BY c_nationkey) AS k,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('42:' || c_nationkey || ':' || c_custkey)) AS i FROM customer)
  SELECT round, client_id FROM c WHERE i <= least(k, greatest(floor(k * 0.3e0), 5))""")
def select_clients(spark, sf):
    clients = table(spark, sf, "customer").select(F.col("c_nationkey").alias("round"), F.col("c_custkey").alias("client_id"))
    return D.select_clients(clients, "client_id", 0.3, 5)


# ---------------------------------------------------------------- losses and metrics

LOGIT_SQL = "(meter_reading / 50e0 - 2e0)"
TAIL = f"ln(1e0 + exp(-abs({LOGIT_SQL})))"


def scored(spark, sf):
    return readings(spark, sf).select(
        "primary_use", "prob", F.col("anomaly").alias("y"), (F.col("meter_reading") / 50.0 - 2.0).alias("logit"),
        C.decide("prob", 0.2).alias("pred"),
    )


S_SQL = f"{R_SQL}, s AS (SELECT primary_use, prob, anomaly AS y, CASE WHEN prob >= 0.2e0 THEN 1 ELSE 0 END AS pred FROM r)"


@query(f"""WITH {R_SQL} SELECT primary_use, sum(anomaly)::BIGINT AS n_pos, sum(1 - anomaly)::BIGINT AS n_neg,
  {q6("least(sum(1 - anomaly)::DOUBLE / sum(anomaly), 8e0)")} AS pos_weight FROM r GROUP BY primary_use""")
def pos_weight(spark, sf):
    out = M.pos_weight(scored(spark, sf), "y", 8.0, ["primary_use"])
    return out.withColumn("pos_weight", r6("pos_weight"))


@query(f"""WITH {R_SQL}, w AS (
  SELECT primary_use, least(sum(1 - anomaly)::DOUBLE / sum(anomaly), 10e0) AS w FROM r GROUP BY primary_use)
  SELECT primary_use, count(*) AS n, {q6("max(w)")} AS pos_weight,
  {q6(f"avg(w * anomaly * (greatest(-{LOGIT_SQL}, 0e0) + {TAIL}) + (1 - anomaly) * (greatest({LOGIT_SQL}, 0e0) + {TAIL}))")} AS loss
  FROM r JOIN w USING (primary_use) GROUP BY primary_use""")
def bce_loss(spark, sf):
    out = M.bce_loss(scored(spark, sf), "logit", "y", 10.0, ["primary_use"])
    return out.withColumn("loss", r6("loss")).withColumn("pos_weight", r6("pos_weight"))


@query(f"""WITH e AS (
  SELECT vec_id, label, list_transform(range(0, 10), lambda i: list_sum(list_transform(range(i, len(embedding), 10),
    lambda j: CAST(embedding[j + 1] AS DOUBLE)))) AS s FROM embeddings), l AS (
  SELECT *, list_max(s) AS top, list_sum(list_transform(s, lambda v: exp(v))) AS z FROM e)
  SELECT {q6("avg(ln(z) - s[label + 1])")} AS loss,
  count(*) FILTER (list_position(s, top) - 1 = label) AS correct, count(*) AS total FROM l""")
def cross_entropy(spark, sf):
    """Ten scores of each vector: the sums of its components by position modulo ten."""
    def at(i: int) -> Column:
        mine = F.filter("embedding", lambda v, j: j % 10 == i)
        return F.aggregate(mine, F.lit(0.0), lambda acc, v: acc + v.cast("double"))

    scores = F.array(*[at(i) for i in range(10)])
    rows = table(spark, sf, "embeddings").select(scores.alias("scores"), F.col("label").alias("y"))
    return M.cross_entropy(rows).withColumn("loss", r6("loss"))


@query(f"""WITH {S_SQL}, grid AS (SELECT y, pred FROM (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(pred))
  SELECT grid.y, grid.pred, count(s.y) AS n FROM grid LEFT JOIN s ON s.y = grid.y AND s.pred = grid.pred GROUP BY ALL""")
def confusion(spark, sf):
    return M.confusion_matrix(scored(spark, sf))


@query(f"""WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
  count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 1 AND toxic = 1) AS tp FROM labels), p AS (
  SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r FROM c)
  SELECT tn, fp, fn, tp, {q6("p")} AS precision, {q6("r")} AS recall,
  {q6("(tp + tn) / nullif(tn + fp + fn + tp, 0)::DOUBLE")} AS accuracy, {q6("2e0 * p * r / nullif(p + r, 0)")} AS f1 FROM p""")
def binary_scores(spark, sf):
    out = M.binary_scores(table(spark, sf, "labels"), "quality", "toxic")
    return out.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in ("precision", "recall", "accuracy", "f1")])


# class report of the rows s (y, pred)
REPORT_SQL = f"""k AS (SELECT unnest([0, 1]) AS c), per AS (
  SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (pred = c) AS called,
    count(*) FILTER (y = c AND pred = c) AS tp FROM s, k GROUP BY c), sc AS (
  SELECT CASE c WHEN 0 THEN 'Normal' ELSE 'Anomaly' END AS name, coalesce(tp / nullif(called, 0)::DOUBLE, 0e0) AS precision,
    coalesce(tp / nullif(support, 0)::DOUBLE, 0e0) AS recall,
    coalesce(2e0 * tp / nullif(called + support, 0), 0e0) AS f1, support, tp FROM per), al AS (
  SELECT name, precision, recall, f1, support FROM sc
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(support)::BIGINT FROM sc
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM sc
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support)::BIGINT FROM sc)
  SELECT name, {q6("precision")} AS precision, {q6("recall")} AS recall, {q6("f1")} AS f1, support FROM al"""


@query(f"WITH {S_SQL}, {REPORT_SQL}")
def class_report(spark, sf):
    out = M.class_report(scored(spark, sf))
    return out.select("name", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


CURVE_SQL = f"""{S_SQL}, t AS (SELECT i, 0.01::DOUBLE + (i - 1) * 0.01::DOUBLE AS threshold FROM range(1, 50) g(i)), cv AS (
  SELECT primary_use, threshold, count(*) FILTER (prob >= threshold AND y = 1) AS tp,
    count(*) FILTER (prob >= threshold AND y = 0) AS fp, count(*) FILTER (prob < threshold AND y = 1) AS fn
  FROM s, t GROUP BY primary_use, threshold), fc AS (
  SELECT *, coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0e0) AS f1 FROM cv)"""


@query(f"WITH {CURVE_SQL} SELECT primary_use, {q6('threshold')} AS threshold, {q6('f1')} AS f1 FROM fc")
def threshold_curve(spark, sf):
    out = M.threshold_curve(scored(spark, sf), by=["primary_use"])
    return out.select("primary_use", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query(f"""WITH {CURVE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY primary_use ORDER BY f1 DESC, threshold) AS i FROM fc)
  SELECT primary_use, {q6("f1")} AS best_f1, {q6("CASE WHEN f1 > 0 THEN threshold ELSE 0.5e0 END")} AS best_threshold FROM o WHERE i = 1""")
def threshold_sweep(spark, sf):
    out = M.threshold_sweep(scored(spark, sf), by=["primary_use"])
    return out.select("primary_use", r6("best_f1").alias("best_f1"), r6("best_threshold").alias("best_threshold"))


AP_SQL = """dist AS (SELECT primary_use, prob, count(*) AS n, sum(y) AS pos FROM s GROUP BY primary_use, prob), cum AS (
  SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY primary_use) AS p
  FROM dist WINDOW w AS (PARTITION BY primary_use ORDER BY prob DESC))"""


@query(f"""WITH {S_SQL}, {AP_SQL} SELECT primary_use, {q6("sum((pos / p::DOUBLE) * (cp / cn::DOUBLE))")} AS pr_auc
  FROM cum GROUP BY primary_use""")
def avg_precision(spark, sf):
    return M.average_precision(scored(spark, sf), by=["primary_use"]).withColumn("pr_auc", r6("pr_auc"))


@query(null_sql(SQL["avg_precision"]))
def avg_precision_null_group(spark, sf):
    return M.average_precision(null_use(scored(spark, sf)), by=["primary_use"]).withColumn("pr_auc", r6("pr_auc"))


@query(f"""WITH {S_SQL}, k AS (
  SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2e0 AS rk FROM s)
  SELECT {q6("(sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y)::DOUBLE * (count(*) - sum(y)))")} AS roc_auc FROM k""")
def roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf)).select(r6("roc_auc").alias("roc_auc"))


# ---------------------------------------------------------------- scaling and summaries

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""WITH m AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MEASURES)} FROM lineitem)
  SELECT l_orderkey, l_linenumber, {", ".join(
      f"{q6(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1e0 ELSE s_{c} END')} AS {c}" for c in MEASURES)} FROM lineitem, m""")
def standardize(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *MEASURES)
    out = Z.standardize_global(lines, MEASURES)
    return out.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in MEASURES])


@query(f"""WITH {CUT_SQL}, {windows_sql("sp", "split, node_id", "ts, row_key", "anomaly", 6, 3,
    "sum(meter_reading) AS s1, sum(meter_reading * meter_reading) AS s2, count(*) AS n_rows")}, st AS (
  SELECT split, node_id, sum(s1) / sum(n_rows) AS m, sqrt(sum(s2) / sum(n_rows) - (sum(s1) / sum(n_rows)) ** 2) AS sd
  FROM g GROUP BY split, node_id), us AS (
  SELECT a.split, a.node_id, coalesce(t.m, a.m) AS m, coalesce(t.sd, a.sd) AS sd, t.m IS NULL AS fallback
  FROM st a LEFT JOIN st t ON t.node_id = a.node_id AND t.split = 'train')
  SELECT sp.split, sp.node_id, row_key, {q6("(meter_reading - m) / CASE WHEN sd = 0 THEN 1e0 ELSE sd END", 5)} AS meter_reading, fallback
  FROM sp JOIN us ON sp.split = us.split AND sp.node_id = us.node_id""")
def standardize_nodes(spark, sf):
    sides = D.temporal_split(readings(spark, sf), "ts", RATIO, GAP_HOURS).select("split", NODE, *ORDER, "meter_reading")
    out = Z.standardize_per_node(sides, NODE, ORDER, ["meter_reading"], 6, 3)
    return out.select("split", NODE, "row_key", r6("meter_reading", 5).alias("meter_reading"), "fallback")


@query(f"""WITH {CUT_SQL}, {windows_sql("sp", "split, node_id", "ts, row_key", "anomaly", 6, 3, "count(*) AS n_rows")}
  SELECT split, count(*) AS n_windows, count(DISTINCT node_id) AS n_nodes,
  count(DISTINCT node_id) FILTER (node_id NOT IN (SELECT node_id FROM g WHERE split = 'train')) AS n_fallback,
  {q6("avg(y)")} AS positive_rate FROM g GROUP BY split""")
def split_summary(spark, sf):
    # only keys and labels of the windows are read; the arrays are pruned from the plan
    out = D.split_windows(readings(spark, sf), NODE, ORDER, VALUES, "anomaly", RATIO, GAP_HOURS, 6, 3)
    return Z.split_summary(out, NODE).withColumn("positive_rate", r6("positive_rate"))


@query(f"""WITH {FEATURES_SQL} SELECT 12::BIGINT AS input_dim, count(DISTINCT anomaly) AS num_classes, count(*) AS num_samples,
  'binary_classification' AS task_type, 'tabular' AS data_format FROM ff""")
def metadata(spark, sf):
    features = ["meter_reading", *METER, *[f"primary_use_{u}" for u in USES]]
    return Z.metadata(prepared(spark, sf), features, "anomaly")


DIRTY_SQL = f"""{R_SQL}, d AS (SELECT *, primary_use = 'click' AND anomaly = 1 AS bad_nan,
  primary_use = 'view' AND anomaly = 1 AS bad_inf FROM r)"""


def checked(spark, sf, without=()):
    """Readings with missing and infinite values put in, so that each check has something to find."""
    use, y = F.col("primary_use"), F.col("anomaly")
    rows = readings(spark, sf)
    value = F.when((use == "click") & (y == 1), float("nan")).when((use == "view") & (y == 1), float("inf"))
    dirty = rows.withColumn("meter_reading", value.otherwise(F.col("meter_reading")))
    made = Z.metadata(dirty, ["meter_reading", "prob"], "anomaly").columns
    return H.quality_checks(dirty, ["meter_reading", "prob"], "anomaly", "prob", [c for c in made if c not in without])


@query(f"""WITH {DIRTY_SQL}, c AS (SELECT count(*) FILTER (bad_nan) AS nn, count(*) FILTER (bad_inf) AS ni,
    count(anomaly) - count(prob) AS nu, count(DISTINCT anomaly) AS nc FROM d)
  SELECT 'dataset:metadata' AS "check", 'OK' AS status, 0::BIGINT AS n
  UNION ALL SELECT 'dataset:nan_input', CASE WHEN nn > 0 THEN 'WARNING' ELSE 'OK' END, nn FROM c
  UNION ALL SELECT 'dataset:inf_input', CASE WHEN ni > 0 THEN 'WARNING' ELSE 'OK' END, ni FROM c
  UNION ALL SELECT 'model:batch_mismatch', CASE WHEN nu <> 0 THEN 'WARNING' ELSE 'OK' END, abs(nu) FROM c
  UNION ALL SELECT 'train:two_classes', CASE WHEN nc >= 2 THEN 'OK' ELSE 'WARNING' END, nc FROM c""")
def quality_checks(spark, sf):
    return checked(spark, sf)


@query(SQL["quality_checks"].replace("'OK' AS status, 0::BIGINT AS n", "'WARNING' AS status, 1::BIGINT AS n"))
def quality_missing_key(spark, sf):
    """The same table, whose metadata lacks the task."""
    return checked(spark, sf, ["task_type"])


@query(f"""WITH {DIRTY_SQL}, w AS (SELECT CAST(max(bad_nan::INT) + max(bad_inf::INT) AS BIGINT) AS w FROM d)
  SELECT 5::BIGINT AS total, 5 - w AS ok, w AS warnings, 0::BIGINT AS failures, 0::BIGINT AS skipped,
  CASE WHEN w > 0 THEN 'MOSTLY HEALTHY' ELSE 'HEALTHY' END AS overall FROM w""")
def quality_report(spark, sf):
    return H.quality_report(checked(spark, sf))


# ---------------------------------------------------------------- client metrics, histories, trials

SHARE = {"f1": 1.0, "train_loss": 2.0, "pr_auc": 3.0, "val_f1": 4.0, "threshold": 5.0}
SKIPS = {"pr_auc": "BUILDING", "val_f1": "MACHINERY", "threshold": "AUTOMOBILE"}


def client_results(spark, sf):
    """Customers as clients: rounds by nation, some segments do not report some metrics."""
    score = F.abs(F.col("c_acctbal")) / 10000.0
    entries = [
        F.when(F.col("c_mktsegment") != SKIPS.get(k, ""), F.struct(F.lit(k).alias("k"), (score / d).alias("v")))
        for k, d in SHARE.items()
    ]
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("round"), F.col("c_custkey").alias("client_id"),
        F.floor(F.abs("c_acctbal")).alias("num_examples"),
        F.map_from_entries(F.array_compact(F.array(*entries))).alias("metrics"),
    )


CLIENTS_SQL = "c AS (SELECT c_nationkey AS round, c_mktsegment AS seg, floor(abs(c_acctbal)) AS n, abs(c_acctbal) / 10000e0 AS s FROM customer), m AS (" + (
    " UNION ALL ".join(
        f"SELECT round, n, '{k}' AS metric, s / {d}e0 AS v FROM c WHERE seg <> '{SKIPS.get(k, '')}'" for k, d in SHARE.items()
    )
) + ")"


def means_sql(keys: str) -> str:
    return f"""WITH {CLIENTS_SQL} SELECT metric, {q6("sum(n * v) / (SELECT sum(n) FROM c)")} AS value FROM m
  WHERE metric IN ({keys}) GROUP BY metric"""


@query(f"WITH {CLIENTS_SQL} SELECT DISTINCT metric FROM m")
def metric_keys(spark, sf):
    return H.metric_keys(client_results(spark, sf))


@query(means_sql("'train_loss', 'val_f1'"))
def client_metrics_fit(spark, sf):
    return H.weighted_fit_metrics(client_results(spark, sf)).withColumn("value", r6("value"))


@query(means_sql("'f1', 'pr_auc', 'threshold'"))
def client_metrics_eval(spark, sf):
    return H.weighted_eval_metrics(client_results(spark, sf)).withColumn("value", r6("value"))


@query(f"""WITH {CLIENTS_SQL}, l AS (SELECT max(round) AS round FROM c), v AS (
  SELECT metric, sum(n * v) / (SELECT sum(n) FROM c WHERE round = (SELECT round FROM l)) AS value FROM m
  WHERE round = (SELECT round FROM l) GROUP BY metric)
  SELECT metric, {q6("value")} AS value, {q6("(SELECT value FROM v WHERE metric = 'threshold')")} AS threshold
  FROM v WHERE metric <> 'threshold'""")
def client_metrics_all(spark, sf):
    one = H.weighted_all_metrics(client_results(spark, sf))
    return one.select(F.explode("metrics").alias("metric", "value"), "threshold").select(
        "metric", r6("value").alias("value"), r6("threshold").alias("threshold")
    )


@query(f"""WITH {CLIENTS_SQL}, t AS (SELECT round, sum(n) AS total FROM c GROUP BY round)
  SELECT round, metric, {q6("sum(n * v) / max(total)")} AS value FROM m JOIN t USING (round)
  WHERE metric IN ('f1', 'pr_auc') GROUP BY round, metric""")
def metric_history(spark, sf):
    return H.metric_history(client_results(spark, sf)).select("round", "metric", r6("value").alias("value"))


@query(SQL["metric_history"])
def history_store(spark, sf):
    """Histories of two runs told to one table; the rows of one of them."""
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    told = H.metric_history(client_results(spark, sf))
    ST.append_history(told, path, "other")
    ST.append_history(told, path, "mine")
    return ST.history_store(spark, path, "mine").select(F.col("round").alias("round"), "metric", r6("value").alias("value"))


@query(
    SQL["metric_history"].replace("c_nationkey AS round", "nullif(c_nationkey, 3) AS round")
    .replace("JOIN t USING (round)", "JOIN t ON m.round IS NOT DISTINCT FROM t.round").replace("SELECT round, metric", "SELECT CAST(m.round AS VARCHAR) AS round, metric")
    .replace("GROUP BY round, metric", "GROUP BY m.round, metric")
)
def metric_history_null_round(spark, sf):
    told = client_results(spark, sf).withColumn("round", F.nullif("round", F.lit(3)))
    return H.metric_history(told).select(F.col("round").cast("string").alias("round"), "metric", r6("value").alias("value"))


def epoch_history(spark, sf):
    """Suppliers as runs, order months as epochs, mean discount as the score of the epoch."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    lines = supplier_lines(spark, sf).groupBy("l_suppkey", month.alias("epoch"))
    percent = F.sum(F.round(F.col("l_discount") * 100).cast("bigint"))  # whole numbers: the mean is exact
    return lines.agg((percent / F.count(F.lit(1))).alias("val_f1"))


EPOCH_SQL = """e AS (SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS epoch,
  sum(CAST(round(l_discount * 100) AS BIGINT))::DOUBLE / count(*) AS val_f1 FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {EPOCH_SQL}, i AS (
  SELECT *, row_number() OVER s AS i, val_f1 > coalesce(max(val_f1) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS gain
  FROM e WINDOW s AS (PARTITION BY l_suppkey ORDER BY epoch)), st AS (
  SELECT *, i - coalesce(max(CASE WHEN gain THEN i END) OVER (PARTITION BY l_suppkey ORDER BY i), 0) AS stale FROM i), en AS (
  SELECT l_suppkey, min(i) FILTER (stale >= 10) AS full_at FROM st GROUP BY l_suppkey), lv AS (
  SELECT st.*, full_at FROM st JOIN en USING (l_suppkey) WHERE full_at IS NULL OR i <= full_at)
  SELECT l_suppkey, max_by(epoch, CASE WHEN gain THEN i END) AS best_epoch, max_by(val_f1, CASE WHEN gain THEN i END) AS best_value,
  max(epoch) AS stop_epoch, max_by(val_f1, i) AS last_value, max(full_at) IS NOT NULL AS stopped_early FROM lv GROUP BY l_suppkey""")
def early_stop(spark, sf):
    return H.early_stop(epoch_history(spark, sf), 10, ["l_suppkey"])


def trial_reports(spark, sf):
    """Event types as studies, nodes as trials, the place of a reading in its node's days as the step."""
    day = F.datediff(F.to_date("ts"), F.lit("2023-12-31").cast("date"))
    return readings(spark, sf).groupBy(
        F.col("primary_use").alias("study"), F.col(NODE).cast("int").alias("trial"), day.alias("step")
    ).agg(F.round(F.max("prob"), 4).alias("value"), F.max("row_key").alias("seed"))


TRIAL_SQL = f"""{R_SQL}, t AS (SELECT primary_use AS study, CAST(node_id AS INTEGER) AS trial,
  CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS INTEGER) AS step, round(max(prob), 4) AS value,
  max(row_key) AS seed FROM r GROUP BY ALL)"""


@query(f"""WITH {TRIAL_SQL}, b AS (SELECT *, max(value) OVER (PARTITION BY study, trial ORDER BY step) AS best FROM t), j AS (
  SELECT b.study, b.trial, b.step, max(b.best) AS best, median(o.value) AS med, count(*) AS n
  FROM b JOIN b o ON o.study = b.study AND o.step = b.step AND o.trial <> b.trial WHERE b.step >= 10 GROUP BY ALL)
  SELECT study, trial, min(step) AS pruned_at FROM j WHERE n >= 5 AND best < med GROUP BY study, trial""")
def median_prune(spark, sf):
    return H.median_prune(trial_reports(spark, sf))


@query(f"""WITH {TRIAL_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value DESC, trial, step) AS i FROM t)
  SELECT study, trial, step, value, seed FROM o WHERE i = 1""")
def best_trial(spark, sf):
    return H.best_trial(trial_reports(spark, sf))


@query(f"""WITH {TRIAL_SQL} SELECT study, count(*) AS n_reports, {q6("max(value)")} AS top, max(step) AS steps FROM t GROUP BY study""")
def trial_store(spark, sf):
    """Trials appended to the shared table in two writes and read back."""
    path = f"{shared_folder(spark)}/trials-{uuid.uuid4().hex}"
    told = trial_reports(spark, sf).select(
        "study", "trial", "step", "value", F.create_map(F.lit("seed"), F.col("seed").cast("string")).alias("params"),
        F.lit(0.5).alias("best_threshold"),
    )
    ST.append_trials(told.where("step <= 15"), path)
    ST.trial_store(spark, path).count()
    ST.append_trials(told.where("step > 15"), path)
    return ST.trial_store(spark, path).groupBy("study").agg(
        F.count(F.lit(1)).alias("n_reports"), r6(F.max("value")).alias("top"), F.max("step").alias("steps")
    )


# ---------------------------------------------------------------- fitting, rounds, evaluation

VEC_CLIENTS, LR = 4, 0.5


def vectors(spark, sf):
    """Embeddings as flat training rows: label above 4 is positive, rows dealt to four clients."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"), (F.col("label") > 4).cast("int").alias("y"))
    return stored(K.assign_rows_random(rows, "vec_id", VEC_CLIENTS))


VEC_SQL = """v AS (SELECT vec_id, CASE WHEN label > 4 THEN 1e0 ELSE 0e0 END AS y,
  ntile(4) OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS c, embedding FROM embeddings), pw AS (
  SELECT c, least(sum(1 - y) / sum(y), 10e0) AS pw, count(*) AS n FROM v GROUP BY c), x AS (
  SELECT vec_id, c, y, unnest(range(0, 65)) AS pos, unnest(list_concat(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), [1e0])) AS e FROM v),
  w0 AS (SELECT c, unnest(range(0, 65)) AS pos, 0e0 AS w FROM pw)"""


def pass_sql(before: str, after: str, mu: float = 0.0) -> str:
    """One gradient pass of every client from zero start weights: CTE ``after`` from CTE ``before`` (c, pos, w)."""
    return f"""z_{after} AS (SELECT vec_id, x.c, y, 1 / (1 + exp(-sum(w * e))) AS p FROM x JOIN {before} USING (c, pos) GROUP BY vec_id, x.c, y),
  b_{after} AS (SELECT vec_id, (1 - y) * p - pw * y * (1 - p) AS b FROM z_{after} JOIN pw USING (c)),
  {after} AS (SELECT c, pos, max(w) - {LR}e0 * (avg(b * e) + {mu}e0 * max(w)) AS w FROM x JOIN b_{after} USING (vec_id) JOIN {before} USING (c, pos) GROUP BY c, pos)"""


def mean_sql(before: str, after: str) -> str:
    return f"""m_{after} AS (SELECT pos, sum(n * w) / sum(n) AS w FROM {before} JOIN pw USING (c) GROUP BY pos),
  {after} AS (SELECT c, pos, w FROM m_{after}, pw)"""


@query(f"WITH {VEC_SQL}, {pass_sql('w0', 'w1')}, {pass_sql('w1', 'w2')} SELECT CAST(c AS INTEGER) AS client_id, n AS num_examples, CAST(pos AS INTEGER) AS pos, {q6('w')} AS w FROM w2 JOIN pw USING (c)")
def local_fit(spark, sf):
    """Two passes of every client over its own rows, from zero weights."""
    rows = vectors(spark, sf)
    weight_of = R.client_weights(rows, 10.0)
    fits = T.local_fit(rows, T.init_weights(64), sorted(weight_of), 2, LR, 0.0, 0.0, weight_of)
    out = T.weight_rows(spark, fits, 1).select("client_id", "num_examples", F.posexplode("w").alias("pos", "w"))
    return out.withColumn("w", r6("w"))


@query(f"""WITH {VEC_SQL}, {pass_sql("w0", "w1")}, {pass_sql("w1", "w2", 0.4)}, {pass_sql("w2", "w3", 0.4)}, {mean_sql("w3", "wa")}
  SELECT CAST(pos AS INTEGER) AS pos, {q6("w")} AS w FROM m_wa""")
def proximal_fit(spark, sf):
    """Average after three passes with a pull towards the common start weights (zero)."""
    rows = vectors(spark, sf)
    weight_of = R.client_weights(rows, 10.0)
    fits = T.local_fit(rows, T.init_weights(64), sorted(weight_of), 3, LR, 0.0, 0.4, weight_of)
    return T.average_weights(T.weight_rows(spark, fits, 1)).select("pos", r6("value").alias("w"))


@query(f"""WITH {VEC_SQL}, {pass_sql("w0", "w1")}, {mean_sql("w1", "a1")}, {pass_sql("a1", "w2")}, {mean_sql("w2", "a2")}
  SELECT CAST(pos AS INTEGER) AS pos, {q6("w")} AS w FROM m_a2""")
def federated_rounds(spark, sf):
    """Two rounds of one local pass and an average; the weights after the last round."""
    rows = vectors(spark, sf)
    done = R.federated_rounds(rows, rows, 2, 1, LR, 0.0, 0.0, 10.0)
    flat = [(i, float(v)) for i, v in enumerate(T.flat(done.weights))]
    return spark.createDataFrame(flat, "pos int, w double").withColumn("w", r6("w"))


@query(f"""WITH e AS (SELECT label, unnest(range(0, 64)) AS pos, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS v FROM embeddings), w AS (
  SELECT label, pos, avg(v) AS w, count(*) AS n FROM e GROUP BY label, pos)
  SELECT CAST(pos AS INTEGER) AS pos, {q6("sum(n * w) / sum(n)")} AS value FROM w GROUP BY pos""")
def average_weights(spark, sf):
    """Labels as clients whose weights are their mean vectors."""
    long = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = long.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("w"), F.count(F.lit(1)).alias("n"))
    updates = means.groupBy("label").agg(
        F.max("n").alias("num_examples"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]).alias("w"),
    )
    return T.average_weights(updates).withColumn("value", r6("value"))


@query(f"""WITH {VEC_SQL}, {pass_sql("w0", "w1")}, {mean_sql("w1", "a1")}
  SELECT vec_id, CAST(y AS INTEGER) AS y, {q6("sum(w * e)", 5)} AS logit, {q6("1 / (1 + exp(-sum(w * e)))", 5)} AS prob
  FROM x JOIN m_a1 USING (pos) GROUP BY vec_id, y""")
def score_windows(spark, sf):
    """Logit and probability of every row under the averaged model of one round."""
    rows = vectors(spark, sf)
    weights = R.federated_rounds(rows, rows, 1, 1, LR, 0.0, 0.0, 10.0).weights
    out = T.score(rows, weights, ["vec_id", "y"])
    return out.select("vec_id", "y", r6("logit", 5).alias("logit"), r6("prob", 5).alias("prob"))


def evaluation_sql(source: str, key: str) -> str:
    """CTE ev: loss, best F1 and threshold, average precision per ``key`` of ``source`` (key, y, logit, prob)."""
    tail = "ln(1e0 + exp(-abs(logit)))"
    return f"""cn_{key} AS (SELECT {key}, count(*) AS n, sum(y) AS p, coalesce(least(sum(1 - y) / nullif(sum(y), 0), 10e0), 1e0) AS w FROM {source} GROUP BY {key}),
  ls AS (SELECT {key}, avg(w * y * (greatest(-logit, 0e0) + {tail}) + (1 - y) * (greatest(logit, 0e0) + {tail})) AS loss
    FROM {source} JOIN cn_{key} USING ({key}) GROUP BY {key}),
  dq AS (SELECT {key}, prob, count(*) AS n, sum(y) AS pos FROM {source} GROUP BY {key}, prob),
  cq AS (SELECT {key}, pos, sum(n) OVER q AS cn, sum(pos) OVER q AS cp FROM dq WINDOW q AS (PARTITION BY {key} ORDER BY prob DESC)),
  ap AS (SELECT {key}, coalesce(sum(pos / nullif(p, 0) * cp / cn), 0e0) AS pr_auc FROM cq JOIN cn_{key} USING ({key}) GROUP BY {key}),
  tq AS (SELECT {key}, 0.01::DOUBLE + (i - 1) * 0.01::DOUBLE AS t FROM range(1, 50) g(i), cn_{key}),
  fq AS (SELECT {key}, t, coalesce(2e0 * count(*) FILTER (prob >= t AND y = 1)
      / nullif(count(*) FILTER (prob >= t) + count(*) FILTER (y = 1), 0), 0e0) AS f FROM {source} JOIN tq USING ({key}) GROUP BY {key}, t),
  bq AS (SELECT {key}, f, t, row_number() OVER (PARTITION BY {key} ORDER BY f DESC, t) AS i FROM fq),
  ev AS (SELECT {key}, cn_{key}.n AS n, loss, pr_auc, f AS best_f1, CASE WHEN f > 0 THEN t ELSE 0.5e0 END AS best_threshold
    FROM cn_{key} JOIN ls USING ({key}) JOIN ap USING ({key}) JOIN bq USING ({key}) WHERE i = 1)"""


@query(f"""WITH {VEC_SQL}, {pass_sql("w0", "w1")}, {mean_sql("w1", "a1")}, {pass_sql("a1", "w2")}, {mean_sql("w2", "a2")},
  al AS (SELECT 1 AS r, * FROM m_a1 UNION ALL SELECT 2, * FROM m_a2),
  sv AS (SELECT r * 10 + c AS rc, vec_id, y, sum(w * e) AS logit, 1 / (1 + exp(-sum(w * e))) AS prob FROM x JOIN al USING (pos) GROUP BY r, c, vec_id, y),
  {evaluation_sql("sv", "rc")}, long AS (
  SELECT rc, n, unnest(['f1', 'pr_auc', 'threshold']) AS metric, unnest([best_f1, pr_auc, best_threshold]) AS value FROM ev)
  SELECT CAST(rc // 10 AS INTEGER) AS round, CAST(rc % 10 AS INTEGER) AS client_id, n AS num_examples, metric, {q6("value", 5)} AS value FROM long""")
def round_metrics(spark, sf):
    """What every client reports on the averaged model of each round, over the vectors."""
    rows = vectors(spark, sf)
    done = R.federated_rounds(rows, rows, 2, 1, LR, 0.0, 0.0, 10.0)
    out = done.eval_results.select("round", "client_id", "num_examples", F.explode("metrics").alias("metric", "value"))
    return out.withColumn("value", r6("value", 5))


@query(f"""WITH {VEC_SQL}, {pass_sql("w0", "w1")}, {mean_sql("w1", "a1")},
  sv AS (SELECT 1 AS one, vec_id, y, sum(w * e) AS logit, 1 / (1 + exp(-sum(w * e))) AS prob FROM x JOIN m_a1 USING (pos) GROUP BY vec_id, y),
  {evaluation_sql("sv", "one")}, au AS (
  SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2e0 AS rk FROM sv)
  SELECT n, {q6("loss", 5)} AS loss, {q6("best_f1", 5)} AS f1, {q6("best_threshold")} AS threshold, {q6("pr_auc", 5)} AS pr_auc,
  {q6("(SELECT (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))) FROM au)", 5)} AS roc_auc FROM ev""")
def final_scores(spark, sf):
    """Summary of a final evaluation over the vectors."""
    rows = vectors(spark, sf)
    weights = R.federated_rounds(rows, rows, 1, 1, LR, 0.0, 0.0, 10.0).weights
    out = M.evaluate_scores(T.score(rows, weights, ["y"]), cap=10.0)
    return out.select("n", r6("loss", 5).alias("loss"), r6("best_f1", 5).alias("f1"), r6("best_threshold").alias("threshold"),
                      r6("pr_auc", 5).alias("pr_auc"), r6("roc_auc", 5).alias("roc_auc"))


@query(f"""WITH {VEC_SQL}, {pass_sql("w0", "w1")}, {mean_sql("w1", "a1")}, s AS (
  SELECT vec_id, y, CASE WHEN 1 / (1 + exp(-sum(w * e))) >= 0.45e0 THEN 1 ELSE 0 END AS pred
  FROM x JOIN m_a1 USING (pos) GROUP BY vec_id, y), {REPORT_SQL}""")
def final_report(spark, sf):
    """Class report of a final evaluation over the vectors at a threshold of its own."""
    rows = vectors(spark, sf)
    weights = R.federated_rounds(rows, rows, 1, 1, LR, 0.0, 0.0, 10.0).weights
    out = R.evaluate_final(T.score(rows, weights, ["y"]), 0.45, 10.0)["report"]
    return out.select("name", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


HIDDEN = 8


def mlp_pass_sql(before: str, after: str) -> str:
    """One gradient pass with one hidden layer; weights (c, pos, w) laid out as W1 by rows, b1, W2, b2."""
    b1, w2, b2 = 64 * HIDDEN, 65 * HIDDEN, 66 * HIDDEN
    return f"""l1_{after} AS (SELECT c, CASE WHEN pos < {b1} THEN pos // {HIDDEN} ELSE 64 END AS pos, pos % {HIDDEN} AS j, w FROM {before} WHERE pos < {w2}),
  h_{after} AS (SELECT vec_id, x.c, y, j, sum(w * e) AS z FROM x JOIN l1_{after} USING (c, pos) GROUP BY vec_id, x.c, y, j),
  l2_{after} AS (SELECT c, pos - {w2} AS j, w FROM {before} WHERE pos >= {w2} AND pos < {b2}),
  o_{after} AS (SELECT vec_id, h.c, y, 1 / (1 + exp(-(sum(greatest(z, 0e0) * l.w) + max(b.w)))) AS p FROM h_{after} h
    JOIN l2_{after} l ON l.c = h.c AND l.j = h.j JOIN {before} b ON b.c = h.c AND b.pos = {b2} GROUP BY vec_id, h.c, y),
  k_{after} AS (SELECT vec_id, o.c, (1 - y) * p - pw * y * (1 - p) AS b FROM o_{after} o JOIN pw ON pw.c = o.c),
  d_{after} AS (SELECT h.vec_id, h.c, h.j, greatest(z, 0e0) * b AS g2, CASE WHEN z > 0 THEN b * w ELSE 0e0 END AS d
    FROM h_{after} h JOIN k_{after} USING (vec_id) JOIN l2_{after} l ON l.c = h.c AND l.j = h.j),
  g_{after} AS (SELECT x.c, CASE WHEN x.pos < 64 THEN x.pos * {HIDDEN} + j ELSE {b1} + j END AS pos, avg(e * d) AS g
      FROM x JOIN d_{after} USING (vec_id) GROUP BY x.c, x.pos, j
    UNION ALL SELECT c, {w2} + j, avg(g2) FROM d_{after} GROUP BY c, j
    UNION ALL SELECT c, {b2}, avg(b) FROM k_{after} GROUP BY c),
  {after} AS (SELECT c, pos, w - {LR}e0 * g AS w FROM {before} JOIN g_{after} USING (c, pos))"""


@query(f"""WITH {VEC_SQL}, s0 AS (SELECT c, unnest(range(0, {66 * HIDDEN + 1})) AS pos, 0e0 AS z FROM pw),
  q0 AS (SELECT c, pos, 0.3e0 * sin(pos + 1e0) AS w FROM s0), {mlp_pass_sql("q0", "q1")}, {mlp_pass_sql("q1", "q2")}, {mean_sql("q2", "qa")}
  SELECT CAST(pos AS INTEGER) AS pos, {q6("w")} AS w FROM m_qa""")
def mlp_rounds(spark, sf):
    """One round of two local passes with a hidden layer, from fixed start weights."""
    rows = vectors(spark, sf)
    like = T.init_weights(64, [HIDDEN])
    start = T.unflat(0.3 * np.sin(np.arange(T.flat(like).size) + 1.0), like)
    weight_of = R.client_weights(rows, 10.0)
    fits = T.local_fit(rows, start, sorted(weight_of), 2, LR, 0.0, 0.0, weight_of)
    return T.average_weights(T.weight_rows(spark, fits, 1)).select("pos", r6("value").alias("w"))


SETTINGS = [
    {"lr": lr, "weight_decay": decay, "pos_weight_cap": cap, "hidden_size": 0, "num_layers": 0}
    for lr, decay, cap in ((0.5, 0.0, 10.0), (0.1, 0.1, 0.5), (2.0, 0.01, 10.0))
]


def trial_pass_sql(before: str, after: str) -> str:
    return f"""z_{after} AS (SELECT vec_id, t, y, sum(w * e) AS logit, 1 / (1 + exp(-sum(w * e))) AS prob FROM x JOIN {before} USING (pos) GROUP BY vec_id, t, y),
  b_{after} AS (SELECT vec_id, t, (1 - y) * prob - least(cap, raw) * y * (1 - prob) AS b FROM z_{after} JOIN tr USING (t), rawpw),
  {after} AS (SELECT t, pos, max(w) * (1 - max(lr) * max(decay)) - max(lr) * avg(b * e) AS w FROM x JOIN b_{after} USING (vec_id)
    JOIN {before} USING (t, pos) JOIN tr USING (t) GROUP BY t, pos)"""


@query(f"""WITH {VEC_SQL}, tr AS (SELECT * FROM (VALUES {", ".join(
      f"({i}, {s['lr']}e0, {s['weight_decay']}e0, {s['pos_weight_cap']}e0)" for i, s in enumerate(SETTINGS))}) v(t, lr, decay, cap)),
  rawpw AS (SELECT sum(1 - y) / sum(y) AS raw FROM v), t0 AS (SELECT t, unnest(range(0, 65)) AS pos, 0e0 AS w FROM tr),
  {trial_pass_sql("t0", "t1")}, {trial_pass_sql("t1", "t2")}, al AS (SELECT 1 AS s, * FROM t1 UNION ALL SELECT 2, * FROM t2),
  sv AS (SELECT s * 10 + t AS rc, vec_id, y, sum(w * e) AS logit, 1 / (1 + exp(-sum(w * e))) AS prob FROM x JOIN al USING (pos) GROUP BY s, t, vec_id, y),
  {evaluation_sql("sv", "rc")}, st AS (SELECT rc % 10 AS trial, rc // 10 AS step, pr_auc, best_threshold FROM ev), ru AS (
  SELECT *, pr_auc > coalesce(max(pr_auc) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gain FROM st)
  SELECT CAST(trial AS INTEGER) AS trial, CAST(step AS INTEGER) AS step, {q6("pr_auc", 5)} AS value,
  {q6("coalesce(arg_max(best_threshold, CASE WHEN gain THEN step END) OVER (PARTITION BY trial ORDER BY step), 0.5e0)")} AS best_threshold FROM ru""")
def trial_reports_fitted(spark, sf):
    """Three given settings fitted together for two passes; what each reports after every pass."""
    rows = vectors(spark, sf)
    out = fit_trials(rows, rows, SETTINGS, epochs=2)
    return out.select("trial", "step", r6("value", 5).alias("value"), r6("best_threshold").alias("best_threshold"))


FINAL_SCALED = ["meter_reading", *METER]


def training_windows(spark, sf):
    """Readings to strips of windows with client and split: the whole preparation of a training run."""
    rows = readings(spark, sf)
    hot = hot_groups(rows, [NODE])
    clean = prepare_readings(rows, NODE, ORDER, "meter_reading", "primary_use", USES, hot=hot)
    # several passes follow (scaling, cutoffs, windows), each over other columns
    ready = Z.standardize_global(stored(K.assign_nodes_random(clean, NODE, 3)), FINAL_SCALED)
    features = [*FINAL_SCALED, *[f"primary_use_{u}" for u in USES]]
    out = D.split_strips(ready, NODE, ORDER, features, "anomaly", RATIO, GAP_HOURS, 6, 3, "client_id", hot=hot)
    return stored(as_strips(out, ["client_id", "split"]))


def two_rounds(spark, sf, hidden=(), **more):
    rows = training_windows(spark, sf)
    done = R.federated_rounds(
        rows.where("split = 'train'"), rows.where("split = 'val'"), 2, 2, 0.2, 1e-4, 0.0, 10.0, hidden, **more
    )
    return rows, done


@query()
def evaluate_rounds(spark, sf):
    """Client metrics of every round of a run on reading windows."""
    _, done = two_rounds(spark, sf)
    return done.eval_results.select("round", "client_id", "num_examples", F.explode("metrics").alias("metric", "value")).withColumn(
        "value", r6("value", 4)
    )


@query()
def evaluate_final(spark, sf):
    """Report of the averaged model on the validation windows."""
    rows, done = two_rounds(spark, sf)
    scores = T.score(rows.where("split = 'val'"), done.weights, ["y"])
    return R.evaluate_final(scores, cap=10.0)["report"]


def saved_fit(spark, sf):
    """One round on the vectors, saved and loaded again."""
    path = f"{shared_folder(spark)}/checkpoint-{uuid.uuid4().hex}"
    rows = vectors(spark, sf)
    # a longer run of the same name came first: its rounds must not come back
    R.federated_rounds(rows, rows, 2, 1, LR / 2, 0.0, 0.0, 10.0, run="vectors", checkpoint=path, config={"lr": LR / 2})
    R.federated_rounds(rows, rows, 1, 1, LR, 0.0, 0.0, 10.0, run="vectors", checkpoint=path, config={"lr": LR})
    return ST.load_checkpoint(spark, path, "vectors")


@query(f"""WITH {VEC_SQL}, {pass_sql("w0", "w1")}, {mean_sql("w1", "a1")}
  SELECT CAST(pos AS INTEGER) AS pos, {q6("w")} AS w, 0.5e0 AS threshold FROM m_a1""")
def checkpoint(spark, sf):
    back = saved_fit(spark, sf)
    flat = [(i, float(v), back["threshold"]) for i, v in enumerate(T.flat(back["weights"]))]
    return spark.createDataFrame(flat, "pos int, w double, threshold double").withColumn("w", r6("w"))


@query()
def mlp_fit(spark, sf):
    """Rounds with the hidden layers of the settings: metric history of the run."""
    model = ModelSettings()
    _, done = two_rounds(spark, sf, hidden=(model.hidden_size,) * model.num_layers)
    return done.history.withColumn("value", r6("value", 4))


@query()
def search_trials(spark, sf):
    """Six settings of the whole space fitted together over the reading windows; all their reports."""
    rows = training_windows(spark, sf)
    out = search(rows.where("split = 'train'"), rows.where("split = 'val'"), 6, 3)
    return out.select("study", "trial", "step", r6("value", 4).alias("value"), "best_threshold")


@query()
def search_pruned(spark, sf):
    """Eight small settings fitted together for twelve passes, weak ones stopped on the way: last step of each, and the
    step at which the rule alone, applied to the reports, stops it."""
    rows = vectors(spark, sf)
    out = stored(search(rows, rows, 8, 12, hidden=[4], layers=(0, 1)))
    pruned = H.median_prune(out).select("trial", "pruned_at")
    last = out.groupBy("trial").agg(F.max("step").alias("last_step"), F.max("value").alias("best"))
    return last.join(pruned, "trial", "left").select("trial", "last_step", "pruned_at", r6("best", 4).alias("best"))


LINE = """CASE event_id % 50 WHEN 7 THEN concat(event_id, ',abc,', event_type) WHEN 9 THEN concat(event_id, ',', user_id)
  WHEN 11 THEN concat(event_id, ',', user_id, ',', event_type, ',more') ELSE concat(event_id, ',', user_id, ',', event_type) END"""


@query(f"""SELECT event_id % 50 NOT IN (7, 9, 11) AS good, {LINE} AS line FROM events""")
def rejected_lines(spark, sf):
    """Events as lines of a file, some of them malformed: what is read, and what is refused."""
    place = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select(F.expr(LINE).alias("value"))

    def headed(batches):  # every task writes a file of its own
        yield pa.RecordBatch.from_arrays([pa.array(["event_id,user_id,event_type"])], ["value"])
        yield from batches

    events.mapInArrow(headed, "value string").write.text(f"{place}/in")
    good = S.read_readings(spark, f"{place}/in", "event_id bigint, user_id bigint, event_type string", rejects=f"{place}/rejects", most=0.1)
    refused = S.rejected_lines(spark, f"{place}/rejects")
    return good.select(F.lit(True).alias("good"), F.concat_ws(",", "event_id", "user_id", "event_type").alias("line")).unionAll(
        refused.select(F.lit(False), "line")
    )


@query(f"WITH {NODES_SQL} SELECT row_key, node_id, CAST(client_id AS INTEGER) AS client_id FROM r JOIN a USING (node_id) WHERE client_id % 2 = 1")
def client_rows_stored(spark, sf):
    """Rows of the odd clients from a table partitioned by client."""
    rows = readings(spark, sf)
    nodes = K.assign_nodes_random(rows.select(NODE).distinct(), NODE, 4)
    path = f"{shared_folder(spark)}/clients-{uuid.uuid4().hex}"
    K.save_client_rows(rows, nodes, NODE, path)
    odd = nodes.select("client_id").distinct().where("client_id % 2 = 1")
    return K.stored_client_rows(spark, path, odd).select("row_key", NODE, "client_id")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Features, windows and next-step labels: class counts per node."""
    out = prepared_windows(spark, sf, METER)
    return out.groupBy(NODE).agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("y").alias("n_anomalies")
    )
