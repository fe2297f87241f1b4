"""Distributed gradient passes, local fits, averaging and scoring of small dense models.

A model is a list of tensors ``[W1, b1, W2, b2, …]``: linear layers with ReLU between them and one logit at
the end; a single layer is logistic regression.  Rows carry their flat feature vector ``x`` (array of float
or double), a label ``y`` and, for local fits, a ``client_id``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions import columns as C
from wattline.functions.fixed_values import NORM_EPSILON
from wattline.operators import metrics as M
from wattline.operators.vectors import CHUNK, weighted_pieces

# the functions below travel inside the tasks, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Weights = list[np.ndarray]


def init_weights(input_dim: int, hidden: Sequence[int] = (), seed: int = 42) -> Weights:
    """Zeros for logistic regression; scaled uniform draws where hidden layers need to differ."""
    sizes, rng, out = [input_dim, *hidden, 1], np.random.default_rng(seed), []
    for a, b in pairwise(sizes):
        bound = 1.0 / np.sqrt(a) if hidden else 0.0
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    return out


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def unflat(vector: np.ndarray, like: Weights) -> Weights:
    ends = np.cumsum([w.size for w in like])[:-1]
    return [p.reshape(w.shape) for p, w in zip(np.split(np.asarray(vector), ends), like)]


def _activations(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    out = [x]
    for i in range(0, len(weights), 2):
        z = out[-1] @ weights[i] + weights[i + 1]
        out.append(np.maximum(z, 0.0) if i + 2 < len(weights) else z)
    return out


def _gradient(weights: Weights, x: np.ndarray, y: np.ndarray, pos_weight: float) -> tuple[np.ndarray, float]:
    """Sums over the rows of the weighted cross-entropy gradient and of the loss."""
    acts = _activations(weights, x)
    z = acts[-1][:, 0]
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
    tail = np.log1p(np.exp(-np.abs(z)))
    loss = (pos_weight * y * (np.maximum(-z, 0) + tail) + (1 - y) * (np.maximum(z, 0) + tail)).sum()
    back = ((1 - y) * p - pos_weight * y * (1 - p))[:, None]
    grads: list[np.ndarray] = []
    for i in range(len(weights) - 2, -1, -2):
        grads = [acts[i // 2].T @ back, back.sum(axis=0), *grads]
        if i:
            back = (back @ weights[i].T) * (acts[i // 2] > 0)
    return flat(grads), float(loss)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat_values = column.flatten()
    if flat_values.null_count or column.null_count:
        raise ValueError("a feature of a training row is null: drop or fill rows with nulls before a fit")
    values = flat_values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1)


# ---------------------------------------------------------------- examples: flat rows, or windows in strips

GEOMETRY = ("window", "stride", "scaled")


def in_strips(rows: DataFrame) -> bool:
    return isinstance(rows.schema["y"].dataType, T.ArrayType)


def example_columns(rows: DataFrame, *keys: str) -> list[str]:
    return [*keys, "x", "y", *(GEOMETRY if in_strips(rows) else ())]


def labels(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per example: keys and its label ``y``."""
    return rows.select(*keys, F.explode("y").alias("y") if in_strips(rows) else F.col("y"))


def input_width(rows: DataFrame) -> int:
    """Features of an example."""
    if not in_strips(rows):
        return rows.select(F.size("x")).first()[0]
    r = rows.select(F.size("x").alias("x"), F.size("y").alias("n"), "window", "stride").first()
    return r["x"] // ((r["n"] - 1) * r["stride"] + r["window"]) * r["window"]


def cut_windows(values: np.ndarray, count: int, window: int, stride: int, scaled: bool) -> np.ndarray:
    """The ``count`` windows of a strip as flat rows; ``scaled``: each feature by its own mean and deviation in the window."""
    rows = values.astype(np.float64).reshape((count - 1) * stride + window, -1)
    cut = np.lib.stride_tricks.sliding_window_view(rows, window, axis=0)[::stride].transpose(0, 2, 1)
    if scaled:
        cut = (cut - cut.mean(axis=1, keepdims=True)) / np.sqrt(cut.var(axis=1, keepdims=True) + NORM_EPSILON)
        cut = cut.astype(np.float32).astype(np.float64)  # as wide as stored windows are
    return cut.reshape(count, -1)


def examples(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, features and labels of the examples of a batch; of strips one after the other."""
    if not batch.num_rows:
        return
    y = batch.column("y")
    if not pa.types.is_list(y.type):
        yield np.arange(batch.num_rows), _matrix(batch.column("x")), y.to_numpy(zero_copy_only=False).astype(np.float64)
        return
    x, geometry = batch.column("x"), zip(*(batch.column(c).to_pylist() for c in GEOMETRY))
    if x.flatten().null_count:
        raise ValueError("a feature of a training row is null: drop or fill rows with nulls before a fit")
    for i, (window, stride, scaled) in enumerate(geometry):
        told = y[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
        yield np.full(len(told), i), cut_windows(x[i].values.to_numpy(zero_copy_only=False), len(told), window, stride, scaled), told


BLOCK = 4096  # examples of a matrix product, and at most about BLOCK_VALUES of their features
BLOCK_VALUES = 1 << 22


def example_blocks(
    batches: Iterator[pa.RecordBatch], *keys: str
) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Key columns, features and labels of the examples of many rows and batches together.

    A strip holds few windows, and a product of few rows with large weights spends its time on reading the weights.
    """
    held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]] = []
    rows = values = 0

    def together() -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        columns = [pa.concat_arrays([h[0][i] for h in held]) for i in range(len(keys))]
        return columns, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

    for batch in batches:
        for at, x, y in examples(batch):
            take = pa.array(at)
            if held and (rows + len(x) > BLOCK or values + x.size > BLOCK_VALUES or x.shape[1] != held[0][1].shape[1]):
                yield together()
                held, rows, values = [], 0, 0
            held.append(([batch.column(k).take(take) for k in keys], x, y))
            rows, values = rows + len(x), values + x.size
    if held:
        yield together()


def examples_of(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in table.to_batches():
        yield from examples(batch)


SUMS = "model int, chunk int, values array<double>"


def _chunk_batch(rows: Sequence[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(v) for _, _, v in rows])])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([m for m, _, _ in rows], pa.int32()),
            pa.array([k for _, k, _ in rows], pa.int32()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([v for _, _, v in rows]))),
        ],
        names=["model", "chunk", "values"],
    )


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sum of the pieces with the same (model, chunk); holds one piece per key, not the rows."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        ends = batch.column("values").offsets.to_numpy()
        values = batch.column("values").values.to_numpy()
        keys = zip(batch.column("model").to_pylist(), batch.column("chunk").to_pylist())
        for key, i, j in zip(keys, ends[:-1], ends[1:]):
            if key in sums:
                sums[key] += values[i:j]
            else:
                sums[key] = values[i:j].copy()
    for (m, k), v in sums.items():
        yield _chunk_batch([(m, k, v)])


def gradient_pass(
    rows: DataFrame, models: Mapping[int, Weights], pos_weight: Mapping[int, float], shared: bool
) -> dict[int, tuple[np.ndarray, float, int]]:
    """One job over all rows: per model (mean gradient, mean loss, rows).

    ``shared``: every model sees every row (search); otherwise a row belongs to the model of its
    ``client_id`` (local fits).  Each task adds up its rows per model and emits that vector in pieces, which
    are exchanged by (model, piece) and added up as they stream in.  So clients may have any number of rows,
    and the driver gets as many numbers as the models have weights.
    """
    sent = rows.sparkSession.sparkContext.broadcast((dict(models), dict(pos_weight)))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = sent.value
        sums: dict[int, np.ndarray] = {}
        for keys, x, y in example_blocks(batches, *([] if shared else ["client_id"])):
            owner = None if shared else keys[0].to_numpy(zero_copy_only=False)
            for m in known if shared else np.unique(owner).tolist():
                mine = slice(None) if shared else owner == m
                grad, loss = _gradient(known[m], x[mine], y[mine], weight.get(m, 1.0))
                # loss and row count ride along behind the gradient
                vector = np.concatenate([grad, [loss, len(y[mine])]])
                if m in sums:
                    sums[m] += vector
                else:
                    sums[m] = vector
        for m, v in sums.items():
            yield _chunk_batch([(m, k, v[i : i + CHUNK]) for k, i in enumerate(range(0, len(v), CHUNK))])

    parts = rows.select(*example_columns(rows, *([] if shared else ["client_id"]))).mapInArrow(partials, SUMS)
    found = parts.repartition("model", "chunk").mapInArrow(_add_up, SUMS).toArrow()
    sent.unpersist()
    vectors: dict[int, np.ndarray] = {}
    for m, k, v in zip(*(found.column(c).to_pylist() for c in ("model", "chunk")), found.column("values")):
        whole = vectors.setdefault(m, np.zeros(flat(models[m]).size + 2))
        whole[k * CHUNK : k * CHUNK + len(v)] = v.values.to_numpy()
    return {m: (v[:-2] / v[-1], float(v[-2] / v[-1]), int(v[-1])) for m, v in vectors.items()}


def step(
    weights: Weights, grad: np.ndarray, lr: float, decay: float = 0.0, mu: float = 0.0, anchor: Weights | None = None
) -> Weights:
    """Gradient step with decoupled weight decay and the pull ``mu * (w - anchor)`` (none with mu = 0)."""
    w = flat(weights)
    if mu and anchor is not None:
        grad = grad + mu * (w - flat(anchor))
    return unflat(w * (1.0 - lr * decay) - lr * grad, weights)


@dataclass
class Fit:
    """What a client returns: weights, its rows, and the results of its passes."""

    weights: Weights
    rows: int = 0
    train_loss: float = float("nan")
    val_f1: float | None = None
    history: list[dict] = field(default_factory=list)


def local_fit(
    rows: DataFrame, start: Weights, clients: Sequence[int], epochs: int = 2, lr: float = 1e-4, decay: float = 1e-4,
    mu: float = 0.0, pos_weight: Mapping[int, float] | None = None, val: DataFrame | None = None,
    val_rows: int | None = None, cap: float | None = None, patience: int = 10,
) -> dict[int, Fit]:
    """All clients start from the same weights and make up to ``epochs`` passes over their own rows.

    One Spark job per pass serves all clients.  With ``val`` a second one scores each client's validation
    rows with its own weights: a client stops after ``patience`` passes without a better F1 and returns the
    weights of its best pass, while loss and F1 told are those of its last one.
    """
    weights = {int(c): start for c in clients}
    out = {c: Fit(start) for c in weights}
    running, best = set(weights), dict.fromkeys(weights, (-1.0, 0))
    for epoch in range(1, epochs + 1):
        own = {c: weights[c] for c in sorted(running)}
        mine = rows if len(own) == len(clients) else rows.where(F.col("client_id").isin(list(own)))
        for c, (grad, loss, n) in gradient_pass(mine, own, pos_weight or {}, shared=False).items():
            weights[c] = step(weights[c], grad, lr, decay, mu, start)
            out[c].rows, out[c].train_loss = n, loss
            if val is None:
                out[c].weights = weights[c]
        if val is None:
            continue
        own = {c: weights[c] for c in sorted(running)}
        shown = val.where(F.col("client_id").isin(list(own)))
        scores = score(shown, own, ["client_id", "y"], shared=False)
        for r in M.evaluate_scores(scores, by=["client_id"], cap=cap, rows=val_rows).collect():
            c = r["client_id"]
            out[c].val_f1 = r["best_f1"]
            out[c].history.append(
                {"epoch": epoch, "train_loss": out[c].train_loss, "val_loss": r["loss"], "val_f1": r["best_f1"],
                 "best_thresh": r["best_threshold"], "pr_auc": r["pr_auc"]}
            )
            if r["best_f1"] > best[c][0]:
                best[c], out[c].weights = (r["best_f1"], epoch), weights[c]
        for c in own:
            if not out[c].history:  # nothing to validate on: the last weights stand
                out[c].weights = weights[c]
            elif epoch - best[c][1] >= patience:
                running.discard(c)
        if not running:
            break
    return out


def weight_rows(spark, fits: Mapping[int, Fit], round_no: int) -> DataFrame:
    """Client results as a table (round, client_id, num_examples, w)."""
    told = [(c, f.rows, flat(f.weights)) for c, f in sorted(fits.items()) if f.rows]
    return spark.createDataFrame(
        pa.table(
            {
                "round": pa.array([round_no] * len(told), pa.int32()),
                "client_id": pa.array([c for c, _, _ in told], pa.int32()),
                "num_examples": pa.array([n for _, n, _ in told], pa.int64()),
                "w": pa.array([w for _, _, w in told], pa.list_(pa.float64())),
            }
        )
    )


def average_weights(updates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of every weight position over the clients, weighted by their rows.

    Vectors are added in pieces, first inside tasks, then per (group, piece); no position is a row before the end.
    """
    sums = weighted_pieces(updates, "num_examples", "w", by)
    total = F.element_at("values", -1)
    long = sums.select(*by, "chunk", total.alias("_n"), F.posexplode(F.expr("slice(values, 1, size(values) - 1)")).alias("_at", "_sum"))
    return long.select(*by, (F.col("chunk") * CHUNK + F.col("_at")).alias("pos"), (F.col("_sum") / F.col("_n")).alias("value"))


def score(
    rows: DataFrame, weights: Weights | Mapping[int, Weights], keep: Sequence[str], shared: bool = True
) -> DataFrame:
    """Add ``logit`` and ``prob``.

    With several models every row is scored by each, named in ``model``; or, not ``shared``, only by the
    model of its ``client_id``.
    """
    many, flat_rows = isinstance(weights, Mapping), not in_strips(rows) if "y" in rows.columns else True
    sent = rows.sparkSession.sparkContext.broadcast(dict(weights) if many else {0: weights})
    kept = labels(rows, *(k for k in keep if k != "y")).select(*keep).schema
    extra = [T.StructField("model", T.IntegerType()), T.StructField("logit", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, "model", "logit"]
        carried = [k for k in keep if k != "y" or flat_rows]
        for keys, x, y in example_blocks(batches, *carried, *([] if shared else ["client_id"])):
            found = dict(zip(carried, keys))
            columns = [found[k] if k in found else pa.array(y.astype(np.int32)) for k in keep]
            if shared:
                for m, w in sent.value.items():
                    logit = _activations(w, x)[-1][:, 0]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(np.full(len(x), m), pa.int32()), pa.array(logit)], names=names
                    )
                continue
            owner = keys[-1].to_numpy(zero_copy_only=False)
            logit = np.empty(len(x))
            for m in np.unique(owner).tolist():
                mine = owner == m
                logit[mine] = _activations(sent.value[m], x[mine])[-1][:, 0]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(owner, pa.int32()), pa.array(logit)], names=names
            )

    cols = example_columns(rows, *([] if shared else ["client_id"]))
    if flat_rows and "y" not in keep:
        rows = rows.withColumn("y", F.lit(0))  # rows to score need no label
    out = rows.select(*[k for k in keep if k not in cols], *cols).mapInArrow(run, T.StructType([*kept.fields, *extra]))
    out = out.withColumn("prob", C.sigmoid("logit"))
    return out if many and shared else out.drop("model")
