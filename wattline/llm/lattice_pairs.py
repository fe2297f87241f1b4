"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points (operator 8)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.rows import Joined, components, runs
from wattline.llm.vectors import by_dimension, stacked, usable
from wattline.llm.words import mix
from wattline.session import stored

BLOCK = 256


def shortest_points() -> np.ndarray:
    """The 240 shortest points of E8: two entries of one, or eight halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


SHORTEST = shortest_points()


def even_point(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: where the sum is odd, the worst entry is rounded the other way."""
    z = np.rint(x)
    rest = x - z
    worst = np.abs(rest).argmax(axis=1)
    row = np.arange(len(x))
    z[row, worst] += np.where(z.sum(axis=1) % 2 != 0, np.where(rest[row, worst] >= 0, 1.0, -1.0), 0.0)
    return z


def lattice_point(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the even points and the even points moved by a half."""
    a, b = even_point(x), even_point(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(x: np.ndarray, label: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Slots of each vector: its own cell and the ``probes`` neighbouring ones it lies nearest to, in every table."""
    d = x.shape[1]
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = []
    for t in range(tables):
        rng = np.random.default_rng((8, d, t))
        turn = np.linalg.qr(rng.standard_normal((max(d, 8), 8)))[0][:d]
        # a projection to 8 of d dimensions shortens distances by sqrt(8 / d): ``scale`` is meant for 64
        at = unit @ turn * np.sqrt(max(d, 8) / 64) / scale + rng.random(8) * 2
        point = lattice_point(at)
        weights = rng.integers(1, 1 << 62, 8, dtype=np.int64) | 1
        near = np.argsort(-((at - point) @ SHORTEST.T), axis=1, kind="stable")[:, :probes]
        for z in (point, *(point + SHORTEST[near[:, p]] for p in range(near.shape[1]))):
            code = ((2 * z).astype(np.int64) * weights).sum(axis=1).astype(np.uint64)
            out.append(mix(code ^ mix(label.astype(np.uint64), 50 + t), d))
    return np.stack(out, axis=1).astype(np.int64)


def _post(batches: Iterable[pa.RecordBatch], tables: int, probes: int, scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        label = batch.column(1).to_numpy()
        slots = [None] * batch.num_rows
        for rows, x in by_dimension(batch.column(2)):
            for i, s in zip(rows.tolist(), cells(x, label[rows], tables, probes, scale)):
                slots[i] = np.unique(s)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots, pa.list_(pa.int64()))], ["node", "label", "vector", "copies", "slots"])


def met_before(slots: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Which pairs of members share a slot below the one they are compared in (``at``, the same for all)."""
    n = len(slots)
    member = np.repeat(np.arange(n), [len(s) for s in slots])
    value = np.concatenate(slots)
    low = value < at
    member, value = member[low], value[low]
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    often = count[column] > 1
    member, column = member[often], column[often]
    if not len(column):
        return np.zeros((n, n), dtype=bool)
    column = np.unique(column, return_inverse=True)[1]
    out = np.zeros((n, n), dtype=np.float32)
    for s in range(0, column.max() + 1, 4096):
        part = (column >= s) & (column < s + 4096)
        grid = np.zeros((n, min(4096, column.max() + 1 - s)), dtype=np.float32)
        grid[member[part], column[part] - s] = 1
        out += grid @ grid.T
    return out > 0


def _compare(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of each block pair of a slot: link counts of nodes (b null) and links enough to connect them (n null)."""
    for table in runs(batches, "run"):
        if table.num_rows < 2:
            continue
        node, copies, slot, block, low, high = (table.column(c).to_numpy() for c in ("node", "copies", "slot", "block", "low", "high"))
        slots = [np.asarray(s) for s in table.column("slots").to_pylist()]
        counts: dict[int, int] = {}
        joined = Joined()
        for s in np.unique(slot):  # two slots in one run: only if their hashes collide
            of_slot = np.flatnonzero(slot == s)
            for rows, x in by_dimension(stacked(table.column("vector")).take(pa.array(of_slot))):
                if len(rows) < 2:
                    continue
                rows = of_slot[rows]
                norm = np.sqrt((x * x).sum(axis=1))
                linked = np.triu((x @ x.T) / (norm[:, None] * norm[None, :]) >= least, 1)
                linked &= (low[rows] == high[rows])[:, None] | (block[rows][:, None] != block[rows][None, :])
                if linked.any():
                    linked &= ~met_before([slots[i] for i in rows], s)
                    a, b = np.nonzero(linked)
                    both = linked | linked.T
                    n = both @ copies[rows]
                    for i in np.flatnonzero(n):
                        counts[int(node[rows[i]])] = counts.get(int(node[rows[i]]), 0) + int(n[i])
                    for x, y in zip(node[rows[a]].tolist(), node[rows[b]].tolist()):
                        joined.add(x, y)
        links = joined.links
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([*counts, *(a for a, _ in links)], pa.int64()),
                 pa.array([*[None] * len(counts), *(b for _, b in links)], pa.int64()),
                 pa.array([*counts.values(), *[None] * len(links)], pa.int64())],
                ["a", "b", "n"],
            )


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93,
    tables: int = 10, probes: int = 2, scale: float = 0.15,
) -> DataFrame:
    """One row per row: ``key``, n_links, component_id, kept.  Links join vectors of one label with a cosine of at
    least ``least``.

    In each table a random projection to eight dimensions is decoded to its nearest E8 point; a vector is posted
    in that cell and in the ``probes`` neighbouring cells it lies nearest to, so near vectors across a border
    meet.  Members of a cell are verified in double precision.  A pair counts in its smallest common slot only,
    so no pair is counted twice and none is emitted: a cell gives a count a vector and the links of a spanning
    forest.  Equal vectors of a label are one node with a number of copies; larger cells are cut in blocks of 256,
    every pair of blocks being one small piece of work, so a dense group is spread over many tasks.
    With the default settings, at a cosine of 0.935 in 64 dimensions, over 99.9 % of pairs meet.

    A vector that is null, empty, zero or holds null or non-finite components, or has no label, links with nothing.
    Vectors of different dimensions never link.  Rows that share a key are separate rows.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    takes_part = usable("vector") & F.col("label").isNotNull()
    rows = rows.withColumn("node", F.when(takes_part, F.xxhash64("label", "vector")))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first(F.xxhash64("label")).alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies")
    )
    kind = rows.schema["vector"].dataType.simpleString()
    posts = stored(nodes.mapInArrow(
        lambda b: _post(b, tables, probes, scale), f"node long, label long, vector {kind}, copies long, slots array<long>"
    ))
    narrow = posts.select("node", F.explode("slots").alias("slot"))
    crowded = narrow.groupBy("slot").agg(F.count("*").alias("members")).where("members > 1")
    dealt = (
        narrow.join(crowded, "slot").join(posts.select("node", "vector", "copies", "slots"), "node")
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        .withColumn("run", F.xxhash64("slot", "low", "high"))
        .select("run", "slot", "node", "vector", "copies", "slots", "block", "low", "high")
    )
    compared = stored(
        dealt.repartition("run").sortWithinPartitions("run").mapInArrow(lambda b: _compare(b, least), "a long, b long, n long")
    )
    counts = compared.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    found = components(compared.where("b IS NOT NULL").select("a", "b"))
    per_node = (
        nodes.select("node", "copies").join(counts, "node", "left").join(found, "node", "left")
        .select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    named = rows.select(F.col("id").alias(key), "node").join(per_node, "node", "left")
    smallest = named.where("node IS NOT NULL").groupBy("component").agg(F.min(key).alias("component_id"))
    out = named.join(smallest, "component", "left")
    component = F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col(key).eqNullSafe(component).alias("kept"),
    )
