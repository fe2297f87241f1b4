"""Fits whose client weights stay a table, for more clients and weights than a broadcast may carry.

A state is a row for each client with its weights.  Rows of readings are laid out once by (client, slice), slices
having few rows; a pass copies each state to its client's slices and cogroups both, so a task sees the weights
of one client beside some of its rows.  Gradients are added over slices in levels, and a second cogroup takes the
step.  The driver sees counts, and the one vector that all clients start from.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import columns as C
from wattline.operators import metrics as M
from wattline.operators.ordering import hash_token, join_groups, mark_lowest
from wattline.operators.vectors import pieces_of, rows_of, summed_pieces, vector_array
from wattline.plans.fitting import Weights, _activations, _gradient, example_columns, examples_of, flat, labels, step, unflat
from wattline.session import discard, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_NUMBERS = 1 << 20  # numbers of the feature vectors in a slice
FAN = 64  # slices whose gradients meet in one sum
STATE = (
    "client_id int, pos_weight double, num_examples bigint, train_loss double, val_f1 double, "
    "best_f1 double, best_epoch int, running boolean, w array<double>, best_w array<double>"
)
KEYS = ["client_id", "slice"]


class Layout:
    """Rows (client_id, x, y) in slices, kept by (client, slice) so that passes exchange weights, never rows."""

    def __init__(self, rows: DataFrame):
        columns = example_columns(rows)
        rows = rows.select(F.col("client_id").cast("int").alias("client_id"), *columns)
        counts = rows.groupBy("client_id").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("x")) / SLICE_NUMBERS)).cast("int").alias("slices"))
        self.counts = stored(counts)
        self.most = self.counts.agg(F.max("slices")).first()[0] or 0
        # slices are drawn by the place of a row, so equal rows spread as well; written down, they stay what they are
        drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("slices")).cast("int")
        self.table = stored(join_groups(rows, self.counts, ["client_id"]).select("client_id", drawn.alias("slice"), *columns))
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = self.table.repartition(parts, *KEYS).sortWithinPartitions(*KEYS).persist(StorageLevel.MEMORY_AND_DISK)

    def copies(self, states: DataFrame) -> DataFrame:
        """Each state once for every slice of its client."""
        with_count = join_groups(states, self.counts, ["client_id"])
        return with_count.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def close(self) -> None:
        self.rows.unpersist()
        discard(self.table)
        discard(self.counts)


def gradient_sums(layout: Layout, states: DataFrame, start: Weights) -> DataFrame:
    """(client_id, chunk, values) for every client in ``states`` (client_id, pos_weight, w; null: the start weights):
    pieces of its gradient sum, with the sum of losses and the number of rows behind the last weight."""
    sent = layout.rows.sparkSession.sparkContext.broadcast(start)

    def partial(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        values = []
        if rows.num_rows and state.num_rows:
            w = state.column("w").combine_chunks()
            weights = sent.value if w[0].as_py() is None else unflat(rows_of(w)[0], sent.value)
            total = np.zeros(flat(weights).size + 2)
            for _, x, y in examples_of(rows):
                grad, loss = _gradient(weights, x, y, state.column("pos_weight")[0].as_py())
                total += np.concatenate([grad, [loss, len(y)]])
            values = pieces_of(total)
        keys = [pa.array([k.as_py()] * len(values), pa.int32()) for k in key]
        return pa.table([*keys, pa.array(np.arange(len(values), dtype=np.int32)), vector_array(values)], names=[*KEYS, "chunk", "values"])

    copies = layout.copies(states.select("client_id", "pos_weight", "w"))
    sums = layout.rows.groupBy(*KEYS).cogroup(copies.groupBy(*KEYS)).applyInArrow(
        partial, "client_id int, slice int, chunk int, values array<double>"
    )
    left = layout.most
    while left > 1:  # at most FAN gradients meet in a sum, whatever the number of slices
        left = -(-left // FAN)
        sums = summed_pieces(sums.withColumn("slice", F.expr(f"slice div {FAN}").cast("int")), [*KEYS, "chunk"])
    return sums.select("client_id", "chunk", "values")


def stepped(states: DataFrame, sums: DataFrame, start: Weights, lr: float, decay: float, mu: float) -> DataFrame:
    """States after a gradient step; those without a gradient stay as they are."""
    sent = states.sparkSession.sparkContext.broadcast(start)
    schema = states.schema

    def move(key: tuple, state: pa.Table, pieces: pa.Table) -> pa.Table:
        if not state.num_rows or not pieces.num_rows:
            return state
        order = np.argsort(pieces.column("chunk").to_numpy())
        found = rows_of(pieces.column("values").combine_chunks())
        total = np.concatenate([found[i] for i in order])
        w = state.column("w").combine_chunks()
        now = sent.value if w[0].as_py() is None else unflat(rows_of(w)[0], sent.value)
        moved = flat(step(now, total[:-2] / total[-1], lr, decay, mu, sent.value))
        for name, value in (
            ("num_examples", pa.array([int(total[-1])], pa.int64())), ("train_loss", pa.array([total[-2] / total[-1]])), ("w", vector_array([moved])),
        ):
            state = state.set_column(state.schema.get_field_index(name), name, value)
        return state

    return states.groupBy("client_id").cogroup(sums.groupBy("client_id")).applyInArrow(move, schema)


def scored(layout: Layout, states: DataFrame, start: Weights) -> DataFrame:
    """(client_id, y, logit, prob) of the rows of every client in ``states``, by its own weights."""
    sent = layout.rows.sparkSession.sparkContext.broadcast(start)

    def judge(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        logit, told = [np.zeros(0)], [np.zeros(0)]
        if rows.num_rows and state.num_rows:
            w = state.column("w").combine_chunks()
            weights = sent.value if w[0].as_py() is None else unflat(rows_of(w)[0], sent.value)
            for _, x, y in examples_of(rows):
                logit.append(_activations(weights, x)[-1][:, 0])
                told.append(y)
        found = np.concatenate(logit)
        owner = pa.array([key[0].as_py()] * len(found), pa.int32())
        return pa.table([owner, pa.array(np.concatenate(told).astype(np.int32)), pa.array(found)], names=["client_id", "y", "logit"])

    copies = layout.copies(states.select("client_id", "w"))
    made = layout.rows.groupBy(*KEYS).cogroup(copies.groupBy(*KEYS)).applyInArrow(judge, "client_id int, y int, logit double")
    return made.withColumn("prob", C.sigmoid("logit"))


def fit_states(
    train: Layout, clients: DataFrame, start: Weights, epochs: int = 2, lr: float = 1e-4, decay: float = 1e-4, mu: float = 0.0,
    val: Layout | None = None, val_rows: int | None = None, cap: float | None = None, patience: int = 10,
) -> tuple[DataFrame, DataFrame | None]:
    """The states of ``clients`` (client_id, pos_weight) after up to ``epochs`` passes from the same weights, and their
    epochs: the same rules and numbers as :func:`wattline.plans.fitting.local_fit`, all as tables.

    ``w`` of the result holds the weights to return: those of the best pass, or the last ones where a client has
    nothing to validate on.  Two copies of the states are on disk at a time.
    """
    blank = {"num_examples": F.lit(0), "best_f1": F.lit(-1.0), "best_epoch": F.lit(0), "running": F.lit(True)}
    fields = [f.split() for f in STATE.split(", ")]
    states = stored(clients.select(*[
        (F.col(n) if n in ("client_id", "pos_weight") else blank.get(n, F.lit(None))).cast(kind).alias(n) for n, kind in fields
    ]))
    told = []
    for epoch in range(1, epochs + 1):
        live = states.where("running")
        moved = stored(stepped(states, gradient_sums(train, live, start), start, lr, decay, mu))
        discard(states)
        states = moved
        if val is None:
            continue
        found = stored(M.evaluate_scores(scored(val, states.where("running"), start), by=["client_id"], cap=cap, rows=val_rows))
        seen = states.join(found.select(F.col("client_id").alias("_c"), F.col("best_f1").alias("_f1")), F.col("client_id").eqNullSafe(F.col("_c")), "left")
        gain = F.coalesce(F.col("_f1") > F.col("best_f1"), F.lit(False))
        best_epoch = F.when(gain, epoch).otherwise(F.col("best_epoch"))
        judged = F.col("val_f1").isNotNull() | F.col("_f1").isNotNull()
        told.append(
            join_groups(states.select("client_id", "train_loss"), found, ["client_id"]).select(
                "client_id", F.lit(epoch).alias("epoch"), "train_loss", F.col("loss").alias("val_loss"), F.col("best_f1").alias("val_f1"),
                F.col("best_threshold").alias("best_thresh"), "pr_auc",
            )
        )
        told[-1] = stored(told[-1])
        fresh = stored(seen.select(
            "client_id", "pos_weight", "num_examples", "train_loss", F.coalesce("_f1", "val_f1").alias("val_f1"),
            F.when(gain, F.col("_f1")).otherwise(F.col("best_f1")).alias("best_f1"), best_epoch.cast("int").alias("best_epoch"),
            (F.col("running") & (~judged | (F.lit(epoch) - best_epoch < patience))).alias("running"),
            "w", F.when(gain, F.col("w")).otherwise(F.col("best_w")).alias("best_w"),
        ))
        discard(found)
        discard(states)
        states = fresh
        if states.where("running").isEmpty():
            break
    kept = states.withColumn("w", F.coalesce("best_w", "w"))
    epochs_told = None
    for part in told:
        epochs_told = part if epochs_told is None else epochs_told.union(part)
    return kept, epochs_told


def client_table(rows: DataFrame, cap: float | None) -> DataFrame:
    """(client_id, pos_weight) of every client; 1 where there are no positives."""
    found = M.pos_weight(labels(rows, "client_id"), "y", cap, ["client_id"], "skip")
    return stored(found.select(F.col("client_id").cast("int").alias("client_id"), F.coalesce("pos_weight", F.lit(1.0)).alias("pos_weight")))


def drawn_clients(clients: DataFrame, total: int, fraction: float, least: int, round_no: int, seed: int) -> DataFrame:
    """The clients that take part in a round, as :func:`wattline.plans.rounds.chosen_clients` draws them."""
    if fraction >= 1.0 or least >= total:
        return clients
    take = min(total, max(int(total * fraction), least))
    token = hash_token(seed, F.concat_ws(":", F.lit(round_no), "client_id"))
    return mark_lowest(clients, token, lambda n: F.lit(take), (), "_in").where("_in").drop("_in")


def told_results(states: DataFrame, round_no: int, width: int) -> DataFrame:
    """Fit results (round, client_id, num_examples, metrics) of the clients that had rows."""
    every = F.create_map(
        F.lit("train_loss"), "train_loss", F.lit("num_examples"), F.col("num_examples").cast("double"),
        F.lit("input_dim"), F.lit(float(width)), F.lit("val_f1"), "val_f1",
    )
    said = F.map_filter(every, lambda k, v: v.isNotNull())
    return states.where("num_examples > 0").select(F.lit(round_no).alias("round"), "client_id", "num_examples", said.alias("metrics"))

