"""Helpers that several operators share: carrying a caller's columns, sizes, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.session import stored


def carried(df: DataFrame, **columns: Column) -> DataFrame:
    """The named columns and one struct ``row`` with all of the caller's, so that no name can clash."""
    return df.select(*[c.alias(name) for name, c in columns.items()], F.struct("*").alias("row"))


def spread(df: DataFrame, names: Sequence[str], results: Sequence[str]) -> DataFrame:
    """Undo :func:`carried`: the caller's columns, then the results; a result replaces a column of its name."""
    lower = {r.lower() for r in results}
    return df.select(*[F.col("row").getField(c).alias(c) for c in names if c.lower() not in lower], *results)


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component) for each node that has an edge to
    another; the component is its smallest node.

    Every pass takes the smallest label among the neighbours and then the label's own label, so a path of n
    nodes needs about log n passes.  The driver only sees a count of changes.
    """
    both = stored(
        edges.where("a != b").select("a", "b").union(edges.where("a != b").select(F.col("b"), F.col("a"))).distinct()
    )
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("other")), "b")
        low = seen.groupBy("a").agg(F.min("other").alias("low"))
        near = labels.join(low, "a").select("a", F.least("label", "low").alias("next"), "label")
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        fresh = stored(
            near.join(jump, "next").select("a", F.least("next", "far").alias("label"), F.col("label").alias("old"))
        )
        labels = fresh.select("a", "label")
        if fresh.where("label != old").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def runs(batches: Iterable[pa.RecordBatch], slot: str) -> Iterator[pa.Table]:
    """Groups of rows with one ``slot`` (a long) from batches that are sorted by it, also across batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(slot)).to_numpy()
        table = pa.Table.from_batches([batch])
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        if held and held[-1].column(slot)[-1].as_py() != values[0]:
            yield pa.concat_tables(held)
            held = []
        for at, stop in zip(cuts[:-2], cuts[1:-1]):
            yield pa.concat_tables([*held, table.slice(at, stop - at)])
            held = []
        held.append(table.slice(cuts[-2]))
    if held:
        yield pa.concat_tables(held)


def with_text(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches of one struct ``row``, with its field ``text`` as a second column."""
    for batch in batches:
        row = batch.column(0)
        yield pa.RecordBatch.from_arrays([row, pc.struct_field(row, [text]).cast(pa.string())], ["row", "text"])


class Joined:
    """Links that connect what was not yet connected: as few as connect the same."""

    def __init__(self):
        self.root: dict = {}
        self.links: list[tuple] = []

    def top(self, x):
        while self.root.get(x, x) != x:
            self.root[x] = x = self.root.get(self.root[x], self.root[x])
        return x

    def add(self, a, b) -> None:
        p, q = self.top(a), self.top(b)
        if p != q:
            self.root[p] = q
            self.links.append((a, b))
