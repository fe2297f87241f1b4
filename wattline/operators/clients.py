"""Assignment of nodes and rows to clients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.operators.ordering import AHEAD, BUCKET_DIGITS, TOKEN, hash_parts, hash_token, join_groups


def node_counts(df: DataFrame, node: str) -> DataFrame:
    """Rows per node, most first."""
    return df.groupBy(node).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), node)


def assign_nodes_random(df: DataFrame, node: str, k: int, seed: int = 42, client: str = "client_id") -> DataFrame:
    """Give every row the client of its node: distinct nodes in hash order, cut in ``k`` near-equal runs.

    The client follows from the node's own hash and ``k - 1`` boundaries, so rows stay where they are.
    """
    return hash_parts(df, df.select(node).distinct(), hash_token(seed, node), k, client)


def assign_rows_random(
    df: DataFrame, key: str, k: int, seed: int = 42, mode: str = "shared", client: str = "client_id"
) -> DataFrame:
    """Cut all rows in hash order of ``key`` in ``k`` near-equal runs; mode ``local`` keeps one part."""
    if mode == "local":
        return df.withColumn(client, F.lit(0))
    if mode != "shared":
        raise ValueError(f"unknown mode {mode!r}: expected 'shared' or 'local'")
    return hash_parts(df, df.select(key), hash_token(seed, key), k, client)


def place_equal_items(loads: np.ndarray, size: int, items: int) -> np.ndarray:
    """How many of ``items`` equal items each part gets when every item goes to the smallest part
    (lowest index on ties).

    Part i takes its j-th item at level ``loads[i] + j * size``; items fill levels from the lowest up.
    """
    if size <= 0:
        out = np.zeros(len(loads), dtype=np.int64)
        out[int(np.argmin(loads))] = items
        return out
    low, high = int(loads.min()) - 1, int(loads.min()) + size * items
    while high - low > 1:  # highest level up to which all slots are used
        mid = (low + high) // 2
        used = int(np.where(loads <= mid, (mid - loads) // size + 1, 0).sum())
        low, high = (mid, high) if used <= items else (low, mid)
    took = np.where(loads <= low, (low - loads) // size + 1, 0).astype(np.int64)
    rest = items - int(took.sum())
    open_slots = np.flatnonzero(loads + took * size == low + 1)
    took[open_slots[:rest]] += 1
    return took


def balanced_plan(histogram: list[tuple[int, int]], k: int) -> list[tuple[int, list[int]]]:
    """For each row count, largest first: cumulative number of nodes of that count up to each part."""
    loads, plan = np.zeros(k, dtype=np.int64), []
    for size, items in sorted(histogram, reverse=True):
        took = place_equal_items(loads, size, items)
        loads = loads + took * size
        plan.append((size, [int(v) for v in np.cumsum(took)]))
    return plan


def assign_nodes_balanced(df: DataFrame, node: str, k: int, client: str = "client_id") -> DataFrame:
    """Node table (node, n_rows, client): largest node first, each to the currently smallest part.

    The driver sees how many nodes have each row count (one line per distinct count), never the nodes;
    nodes of equal count are interchangeable and are dealt out in hash order.
    """
    if k < 1:
        raise ValueError("the number of parts must be at least 1")
    counts = df.groupBy(node).agg(F.count(F.lit(1)).alias("n_rows"))
    histogram = [(r[0], r[1]) for r in counts.groupBy("n_rows").count().collect()]
    plan = df.sparkSession.createDataFrame(balanced_plan(histogram, k), "n_rows bigint, _ends array<bigint>")
    ranked = _rank_in_count(counts, node)
    passed = F.size(F.filter("_ends", lambda e: e < F.col("_rank")))
    return ranked.join(plan, "n_rows").select(node, "n_rows", passed.alias(client))


def _rank_in_count(counts: DataFrame, node: str) -> DataFrame:
    """1-based hash rank among the nodes of the same row count, by counts per hash prefix."""
    rows = counts.withColumn(TOKEN, hash_token("node", node)).withColumn(
        "_bucket", F.substring(TOKEN, 1, BUCKET_DIGITS)
    )
    ahead = Window.partitionBy("n_rows").orderBy("_bucket").rowsBetween(*AHEAD)
    offsets = rows.groupBy("n_rows", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "n_rows", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")
    )
    inside = F.row_number().over(Window.partitionBy("n_rows", "_bucket").orderBy(TOKEN))
    return rows.join(offsets, ["n_rows", "_bucket"]).select(
        node, "n_rows", (F.col("_ahead") + inside).alias("_rank")
    )


def client_rows(
    df: DataFrame, assignment: DataFrame, node: str, number: int | None = None, client: str = "client_id"
) -> DataFrame:
    """Rows with their node's client, or only those of one client; a null node is a node like any other.

    No broadcast is forced: the node table grows with the data, so its measured size decides the join.
    """
    if number is None:
        return join_groups(df, assignment.select(node, client), [node])
    if number < 0:
        raise ValueError(f"invalid client number {number}")
    return join_groups(df, assignment.where(F.col(client) == number).select(node), [node], "left_semi")


def save_client_rows(
    df: DataFrame, assignment: DataFrame, node: str, path: str, client: str = "client_id", rows_per_file: int = 5_000_000,
) -> None:
    """Write the rows as a table partitioned by their node's client, so that a reader of some clients opens their files only.

    Range partitioning keeps a client's rows in few files and spreads a big client over many tasks.
    """
    rows = client_rows(df, assignment, node, client=client).repartitionByRange(client, node)
    rows.write.partitionBy(client).option("maxRecordsPerFile", rows_per_file).parquet(path)


def stored_client_rows(spark: SparkSession, path: str, clients: int | DataFrame, client: str = "client_id") -> DataFrame:
    """Rows of one client, or of all in a table of clients, from a table of :func:`save_client_rows`.

    A number prunes files while planning; a table of clients does when the join runs.
    """
    rows = spark.read.parquet(path)
    if isinstance(clients, int):
        if clients < 0:
            raise ValueError(f"invalid client number {clients}")
        return rows.where(F.col(client) == clients)
    return rows.join(clients.select(client), client, "left_semi")


def partition_stats(df: DataFrame, node: str, client: str = "client_id") -> DataFrame:
    """Rows and distinct nodes per client; counted per node first, so one big client costs no more."""
    per_node = df.groupBy(client, node).agg(F.count(F.lit(1)).alias("n"))
    return per_node.groupBy(client).agg(F.sum("n").alias("n_rows"), F.count(node).alias("n_nodes"))


def node_overlap(df: DataFrame, node: str, client: str = "client_id") -> DataFrame:
    """Nodes found in more than one client, with the lowest and highest of them; must be empty."""
    ends = df.groupBy(node).agg(F.min(client).alias("first_client"), F.max(client).alias("last_client"))
    return ends.where(F.col("first_client") != F.col("last_client"))


def check_no_overlap(df: DataFrame, node: str, client: str = "client_id") -> None:
    bad = node_overlap(df, node, client).first()
    if bad is not None:
        raise ValueError(f"node {bad[0]} is in parts {bad[1]} and {bad[2]}")

