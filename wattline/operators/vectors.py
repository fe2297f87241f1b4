"""Element-wise sums of long vectors, kept as tables of pieces."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the functions below travel inside the tasks, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 4096
HELD = 1 << 20  # numbers that a task gathers before it hands pieces on


def pieces_of(vector: np.ndarray) -> list[np.ndarray]:
    return [vector[i : i + CHUNK] for i in range(0, len(vector), CHUNK)]


def vector_array(values: Sequence[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    flat = np.concatenate(values) if len(values) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float64()))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column as NumPy arrays."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:])]


def summed_pieces(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per ``keys`` of ``parts`` (keys, values array<double>): the element-wise sum of its vectors.

    Pieces of a key lie together after one exchange and a sort, and are added as they stream in: a task holds the
    sum of one key, however many vectors there are.  A null key is a key like any other.
    """
    keys = list(keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, total, size = None, None, 0

        def gathered() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], kinds[i]) for i in range(len(keys))]
            out = pa.RecordBatch.from_arrays([*columns, vector_array([v for _, v in done])], names=[*keys, "values"])
            done.clear()
            return out

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            for k, v in zip(zip(*(batch.column(k).to_pylist() for k in keys)), rows_of(batch.column("values"))):
                if total is not None and k == key:
                    if len(v) != len(total):
                        raise ValueError("vectors of different lengths have no common sum")
                    total += v
                    continue
                if total is not None:
                    done.append((key, total))
                    size += len(total)
                key, total = k, v.copy()
                if size > HELD:
                    yield gathered()
                    size = 0
        if total is not None:
            done.append((key, total))
            yield gathered()

    rows = parts.select(*keys, "values")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, rows.schema)


def weighted_pieces(rows: DataFrame, weight: str, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by, chunk, values): weighted sums of pieces of the vectors, the sum of weights behind each piece.

    A task adds up its own rows first, then the pieces of all tasks are added per (group, chunk), so a vector that
    millions of rows share in is one piece a task.  Rows without a weight or a vector do not count.
    """
    by = list(by)
    kept = rows.where(F.col(weight).isNotNull() & F.col(vector).isNotNull()).select(
        *by, F.col(weight).cast("double").alias("_weight"), F.col(vector).cast("array<double>").alias("_vector")
    )
    schema = T.StructType([*kept.select(*by).schema.fields, T.StructField("chunk", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def gathered() -> Iterator[pa.RecordBatch]:
            for key, total in sums.items():
                values = [np.append(v, total[-1]) for v in pieces_of(total[:-1])]
                columns = [pa.array([k] * len(values), kind) for k, kind in zip(key, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.arange(len(values), dtype=np.int32)), vector_array(values)], names=[*by, "chunk", "values"]
                )
            sums.clear()

        for batch in batches:
            if batch.column("_vector").values.null_count:
                raise ValueError("a vector holds a null")
            kinds = [batch.column(k).type for k in by]
            keys = zip(*(batch.column(k).to_pylist() for k in by)) if by else [()] * batch.num_rows
            for key, n, v in zip(keys, batch.column("_weight").to_pylist(), rows_of(batch.column("_vector"))):
                add = np.append(n * v, n)
                if key in sums:
                    if len(sums[key]) != len(add):
                        raise ValueError("vectors of different lengths have no common mean")
                    sums[key] += add
                else:
                    sums[key] = add
                    if len(sums) * len(add) > HELD:
                        yield from gathered()
        yield from gathered()

    return summed_pieces(kept.mapInArrow(partial, schema), [*by, "chunk"])


def mean_vector(rows: DataFrame, weight: str, vector: str) -> np.ndarray:
    """The weighted mean of all vectors as one array on the driver, whose size does not depend on the rows."""
    found = weighted_pieces(rows, weight, vector).toArrow()
    pieces = dict(zip(found.column("chunk").to_pylist(), (np.asarray(v.values) for v in found.column("values"))))
    return np.concatenate([np.zeros(0), *(pieces[c][:-1] / pieces[c][-1] for c in sorted(pieces))])
