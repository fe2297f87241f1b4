"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 6)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product
from math import ceil, erf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattline.llm.vectors import by_dimension, stacked, usable
from wattline.llm.words import mix
from wattline.session import stored

# vectors of a slot, and slots of a table, however few vectors there are
BLOCK, BLOCKS = 50_000, 8
SAMPLE = 4_000
# least share of a sample query's neighbours at the LOW quantile, and least estimated share of a query that is not searched exactly
LEAST = 0.9
LOW = 0.05
# blocks of an exact pass, however few vectors there are, and vectors of one where there are many
EXACT_BLOCKS, EXACT_BLOCK = 32, 200_000
# queries packed in a row, vectors packed in a row, vectors gathered before they are dealt out
CHUNK, ROWS, GATHERED = 256, 1_000, 20_000
# vectors of a matrix product, and those of them of which only the largest inner product is looked at first
TILE, RUN = 2048, 32
# queries of a matrix product in a block of cells, which is taken where they hold more than one in PART of its vectors
ASKED, PART = 64, 16
# pairs that are compared in double precision at once
PAIRS = 1 << 16
# nanoseconds of a pair in a matrix product, a gathered pair, a vector in a table, a query in a table, and a neighbour
# that a block of the exact pass returns; only the choice of hashes depends on them
PAIR, GATHER, HELD, PROBED, RETURNED = 3.0, 60.0, 15_000.0, 400_000.0, 300.0
# sample queries of the choice by work, and nanoseconds of all queries together up to which it is not made
TRIED, LITTLE = 100, 30e9
_erf = np.frompyfunc(erf, 1, 1)
WIDTHS = tuple(0.4 * 1.1**i for i in range(21))


def moves(size: int) -> np.ndarray:
    """Steps to neighbouring cells: all of them, or those over three borders at most where there are very many."""
    if size <= 6:
        return np.array(list(product((0, -1, 1), repeat=size)), dtype=np.int64)
    out = [np.zeros((1, size), dtype=np.int64)]
    for _ in range(3):
        more = np.repeat(out[-1], 2 * size, axis=0)
        more[np.arange(len(more)), np.arange(len(more)) // 2 % size] += np.where(np.arange(len(more)) % 2, 1, -1)
        out.append(more)
    every = np.unique(np.concatenate(out), axis=0)
    return every[np.abs(every).max(axis=1) <= 1]


class Hashes:
    """Floors of random Gaussian projections divided by a width, several to a code and several codes (tables).

    Vectors are scaled to at most length one and get one more coordinate that makes them exactly so; queries are
    scaled to one with that coordinate zero.  The nearest in distance then has the largest inner product.
    """

    def __init__(self, tables: int, size: int, probes: int, width: float, longest: float):
        self.tables, self.size, self.probes, self.width, self.longest = tables, size, probes, width, longest
        self.steps = moves(size)
        self.down, self.up = (self.steps == -1).astype(float), (self.steps == 1).astype(float)

    def _places(self, x: np.ndarray, extra: np.ndarray, t: int) -> np.ndarray:
        rng = np.random.default_rng((6, x.shape[1], t))
        return (np.column_stack([x, extra]) @ rng.standard_normal((x.shape[1] + 1, self.size))) / self.width + rng.random(self.size)

    def code(self, cell: np.ndarray, d: int, t: int) -> np.ndarray:
        weights = np.random.default_rng((66, d, t)).integers(1, 1 << 62, self.size, dtype=np.int64) | 1
        return mix((cell * weights).sum(axis=-1).astype(np.uint64), t).astype(np.int64)

    def slot(self, cell: np.ndarray, d: int, t: int, blocks: int) -> np.ndarray:
        """Slot of each cell: by as few of its coordinates as make enough groups, so that neighbours share slots."""
        lead = min(self.size, ceil(log(2 * blocks) / log(max(2.0, 4 / self.width)))) if blocks > 1 else 0
        weights = np.random.default_rng((666, d, t)).integers(1, 1 << 62, lead, dtype=np.int64) | 1
        group = mix((cell[..., :lead] * weights).sum(axis=-1).astype(np.uint64), 99)
        return t * blocks + (group % np.uint64(blocks)).astype(np.int64)

    def cells(self, x: np.ndarray, t: int) -> np.ndarray:
        """Cell of each vector in table t."""
        y = x / self.longest
        extra = np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1)))
        return np.floor(self._places(y, extra, t)).astype(np.int64)

    def data(self, x: np.ndarray) -> np.ndarray:
        """Code of each vector in each table."""
        return np.stack([self.code(self.cells(x, t), x.shape[1], t) for t in range(self.tables)], axis=1)

    def _probed(self, q: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own cell of each query, its place in the cell, and the numbers of the steps to probe."""
        y = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
        at = self._places(y, np.zeros(len(q)), t)
        cell = np.floor(at)
        f = at - cell
        cost = f**2 @ self.down.T + (1 - f) ** 2 @ self.up.T
        return cell.astype(np.int64), f, np.argsort(cost, axis=1, kind="stable")[:, : self.probes]

    def query_cells(self, q: np.ndarray, t: int) -> np.ndarray:
        """The ``probes`` cells of table t a query most likely has its neighbours in, likeliest first.

        A step over a cell's border costs the squared distance to it; the set of steps with the least sum comes first.
        """
        cell, _, order = self._probed(q, t)
        return cell[:, None, :] + self.steps[order]

    def query(self, q: np.ndarray, t: int) -> np.ndarray:
        """Codes of those cells."""
        return self.code(self.query_cells(q, t), q.shape[1], t)

    def missed(self, q: np.ndarray, scores: np.ndarray, t: int) -> np.ndarray:
        """Chance that a vector with an inner product in ``scores`` (a row for each query) lies in no probed cell of table t.

        A Gaussian projection of the difference is normal with the distance as its deviation.
        """
        cosine = scores / (np.sqrt((q * q).sum(axis=1)) * self.longest)[:, None]
        scales = self.width / np.sqrt(2 * np.maximum(2 - 2 * cosine, 1e-12))
        _, f, order = self._probed(q, t)
        out = np.empty(scores.shape)
        for j, scale in enumerate(scales.T):
            below = [_erf(scale[:, None] * (k - f)).astype(float) for k in (-1, 0, 1, 2)]
            chance = np.stack([(b - a) / 2 for a, b in zip(below, below[1:])], axis=2)  # cell before, own, after
            part = np.ones(order.shape)
            for c in range(self.size):
                part *= np.take_along_axis(chance[:, c], self.steps[order, c] + 1, axis=1)
            out[:, j] = 1 - np.minimum(part.sum(axis=1), 1.0)
        return out

    def met(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Chance that a vector with inner product ``score`` to a query lies in one of its probed cells."""
        return 1 - np.prod([self.missed(q, score[:, None], t)[:, 0] for t in range(self.tables)], axis=0)


def fit_width(x: np.ndarray, total: int, nearest: int, tables: int, size: int, probes: int, aim: float, longest: float) -> float:
    """Smallest width at which a sample's queries find the share ``aim`` of their neighbours, and all but the share
    ``LOW`` of them at least ``LEAST`` of their own.

    In a sample of m of N vectors, as many as ``nearest * m / N`` neighbours lie as far as the ``nearest`` of all do.
    """
    ask = x[: min(len(x), 200)]
    k = max(1, min(len(x) - 1, round(nearest * len(x) / max(total, 1))))
    if len(x) < 2:
        return WIDTHS[-1]
    scores = ask @ x.T
    scores[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :k]
    for width in WIDTHS:
        h = Hashes(tables, size, probes, width, longest)
        codes = h.data(x)
        met = np.zeros(best.shape, dtype=bool)
        for t in range(tables):
            for i, probed in enumerate(h.query(ask, t)):
                met[i] |= np.isin(codes[best[i], t], probed)
        if met.mean() >= aim and np.quantile(met.mean(axis=1), LOW, method="lower") >= LEAST:
            return width
    return WIDTHS[-1]


def work_of(h: Hashes, q: np.ndarray, x: np.ndarray, total: int, asked: int) -> float:
    """Nanoseconds that a query makes with one table of the hashes, its share of the indexing included."""
    codes, held = np.unique(h.code(h.cells(x, 0), x.shape[1], 0), return_counts=True)
    asks = h.query(q, 0)
    at = np.minimum(np.searchsorted(codes, asks), len(codes) - 1)
    share = (held[at] * (codes[at] == asks)).sum() / (len(q) * len(x))
    return HELD * total / asked + PROBED * len(h.steps) / 729 + GATHER * share * total


def fit_hashes(
    q: np.ndarray, near: np.ndarray, x: np.ndarray, total: int, asked: int, tables: int, size: int, probes: int, aim: float,
    longest: float,
) -> Hashes:
    """Tables (``tables`` at most), projections (``size`` at least) and width with which the work per query is least.

    ``q`` are sample queries, ``near`` the inner products of their nearest of all vectors (the largest first), ``x``
    sample vectors.  More projections and narrower cells hold fewer candidates, but leave more queries for the exact
    pass; how much both cost depends on the number of vectors.  The neighbours of the sample must be found to the
    share ``aim``, where a query that goes to the exact pass counts as one that found all.
    """
    tops = near[:, [0, near.shape[1] // 2, -1]]
    best = None
    for s in (size, size + 3, size + 6):
        for width in WIDTHS[::2]:
            h = Hashes(tables, s, probes, width, longest)
            one = work_of(h, q, x, total, asked)
            missed = np.ones(tops.shape)
            for t in range(tables):
                work = (t + 1) * one
                if best is not None and (False, work) >= best[0]:
                    break  # more work than the best, before anything of it goes to the exact pass
                missed *= h.missed(q, tops, t)
                sure = 1 - missed[:, 2] >= LEAST
                found = np.where(sure, (1 - missed) @ (0.25, 0.5, 0.25), 1.0).mean()
                work += (~sure).mean() * (PAIR * total + RETURNED * EXACT_BLOCKS * near.shape[1])
                rank = (found < aim, work if found >= aim else -found)
                if best is None or rank < best[0]:
                    best = rank, Hashes(t + 1, s, probes, width, longest)
    return best[1]


# What is shuffled are rows that each hold many vectors, as bytes.  A block's vectors are kind 0 of a slot: the vectors,
# how many keys each has, those keys, and the code of each.  The queries that visit it are kind 1: the vectors, their
# nodes, how many cells each probes there and their codes; in an exact pass what their results have to reach.  A chunk
# of queries with what they found so far is kind 0 of a chunk, with marks of those that are unsure; what a block found
# for some of them is kind 1.
PACK = "slot long, kind int, chunk long, size int, vectors binary, nodes binary, many binary, ids binary, codes binary, less binary, unsure binary"
FIELDS = [f.split()[0] for f in PACK.split(", ")]
KINDS = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in PACK.split(", ")])
NOTHING = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
TYPES = {"nodes": np.int64, "many": np.int32, "ids": np.int64, "codes": np.int64, "less": np.float64, "unsure": np.bool_}


def packed(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in KINDS]
    return pa.RecordBatch.from_arrays(columns, schema=KINDS)


def unpacked(row: dict) -> dict:
    out = {k: np.frombuffer(row[k], kind) if row[k] is not None else None for k, kind in TYPES.items()}
    if row["vectors"] is not None:
        count = len(out["many" if out["nodes"] is None else "nodes"])
        wide = len(row["vectors"]) // max(1, count * row["size"])
        out["x"] = np.frombuffer(row["vectors"], np.float32 if wide == 4 else np.float64).reshape(count, row["size"])
    return out | {"slot": row["slot"], "kind": row["kind"], "chunk": row["chunk"], "size": row["size"]}


def unpacked_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name, column in zip(FIELDS, batch.columns):
                value = column[i]
                row[name] = None if not value.is_valid else value.as_buffer() if pa.types.is_binary(column.type) else value.as_py()
            yield unpacked(row)


def together(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def plain(column: pa.Array) -> type:
    """Type in which vectors keep their values."""
    return np.float32 if pa.types.is_float32(column.type.value_type) else np.float64


def _dealt(slots: np.ndarray, x: np.ndarray, ids: pa.ListArray, codes: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Packed vectors of each slot."""
    order = np.argsort(slots, kind="stable")
    slots, x, ids = slots[order], x[order], ids.take(pa.array(order))
    codes = codes[order] if codes is not None else None
    many = np.diff(ids.offsets.to_numpy())
    stops = np.concatenate([[0], np.cumsum(many)])
    keys = ids.flatten().to_numpy()
    cuts = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), len(slots)]
    out = []
    for low, high in zip(cuts, cuts[1:]):
        for a in range(low, high, ROWS):
            b = min(high, a + ROWS)
            out.append({
                "slot": int(slots[a]), "kind": 0, "size": x.shape[1], "vectors": x[a:b].tobytes(), "many": many[a:b].astype(np.int32).tobytes(),
                "ids": keys[stops[a] : stops[b]].tobytes(), "codes": None if codes is None else codes[a:b].tobytes(),
            })
    yield packed(out)


class Cut:
    """Slots that hold more than a block's vectors, cut into parts: where the parts of a slot begin, and how many."""

    def __init__(self, counts: dict[int, int], slots: int):
        self.parts = np.maximum(1, -(-np.array([counts.get(s, 0) for s in range(slots)], dtype=np.int64) // BLOCK))
        self.first = np.cumsum(self.parts) - self.parts


def _counted(batches: Iterable[pa.RecordBatch], h: Hashes, blocks: int) -> Iterator[pa.RecordBatch]:
    """How many vectors each slot holds."""
    for table in together(batches, GATHERED):
        for _, x in by_dimension(stacked(table.column(0))):
            for t in range(h.tables):
                slots, held = np.unique(h.slot(h.cells(x, t), x.shape[1], t, blocks), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(held)], ["slot", "held"])


def _data(batches: Iterable[pa.RecordBatch], h: Hashes, blocks: int, cut: Cut) -> Iterator[pa.RecordBatch]:
    """Vectors (node, vector, ids) of the slots, once for each table."""
    for table in together(batches, GATHERED):
        column, ids, nodes = stacked(table.column(1)), stacked(table.column(2)), table.column(0).to_numpy()
        for rows, x in by_dimension(column):
            for t in range(h.tables):
                cells = h.cells(x, t)
                slot = h.slot(cells, x.shape[1], t, blocks)
                part = (mix(nodes[rows].astype(np.uint64), 98) % cut.parts[slot].astype(np.uint64)).astype(np.int64)
                yield from _dealt(cut.first[slot] + part, x.astype(plain(column)), ids.take(pa.array(rows)), h.code(cells, x.shape[1], t))


def _queries(batches: Iterable[pa.RecordBatch], h: Hashes, blocks: int, cut: Cut) -> Iterator[pa.RecordBatch]:
    """Queries of a chunk for each slot with cells they probe."""
    for row in unpacked_rows(batches):
        q, d = row["x"].astype(np.float64), row["size"]
        for t in range(h.tables):
            cells = h.query_cells(q, t)
            slots, codes = h.slot(cells, d, t, blocks).ravel(), h.code(cells, d, t).ravel()
            of = np.repeat(np.arange(len(q)), cells.shape[1])
            order = np.argsort(slots, kind="stable")
            slots, codes, of = slots[order], codes[order], of[order]
            cuts = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), len(slots)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                who, many = np.unique(of[a:b], return_counts=True)
                one = {
                    "kind": 1, "chunk": row["chunk"], "size": d, "vectors": row["x"][who].tobytes(), "nodes": row["nodes"][who].tobytes(),
                    "many": many.astype(np.int32).tobytes(), "codes": codes[a:b].tobytes(),
                }
                out += [one | {"slot": int(cut.first[slots[a]] + part)} for part in range(cut.parts[slots[a]])]
            yield packed(out)


def ranked(of: np.ndarray, less: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n first (less, id) of each query, each pair once."""
    order = np.lexsort((ids, less, of))
    of, less, ids = of[order], less[order], ids[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (less[1:] != less[:-1]) | (ids[1:] != ids[:-1])
    of, less, ids = of[new], less[new], ids[new]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    return of[rank < n], less[rank < n], ids[rank < n]


def lengths(x: np.ndarray) -> np.ndarray:
    most = np.maximum(np.abs(x).max(axis=1).astype(np.float64), 1e-300)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


class Group:
    """Vectors of one dimension in a block, sorted by code; in single precision for what need only be about right."""

    def __init__(self, codes: np.ndarray | None, rows: np.ndarray, x: np.ndarray):
        self.rows, self.x = rows, x
        if codes is not None:
            order = np.argsort(codes, kind="stable")
            self.rows, self.x = rows[order], x[order]
            self.codes, self.start, self.held = np.unique(codes[order], return_index=True, return_counts=True)
        self.longest = max((float(lengths(x[a : a + ROWS]).max()) for a in range(0, len(x), ROWS)), default=1.0)
        self.rough = np.empty(x.shape, np.float32)
        for a in range(0, len(x), ROWS):
            self.rough[a : a + ROWS] = self.x[a : a + ROWS] / self.longest
        # twice what the sum of products of single precision can be wrong by, where both lengths are at most one
        self.margin = np.float32((x.shape[1] + 4) * 1.2e-7)


class Block:
    """Vectors of one slot."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        lists = stacked(table.column("ids"))
        vectors, codes = stacked(table.column("vector")), None
        if "codes" in table.column_names:
            codes = stacked(table.column("codes")).flatten().to_numpy()
        many = np.diff(lists.offsets.to_numpy())
        self._keys(many, lists.flatten().to_numpy())
        self.groups = {x.shape[1]: Group(None if codes is None else codes[rows], rows, x) for rows, x in by_dimension(vectors)}

    def _keys(self, many: np.ndarray, ids: np.ndarray) -> None:
        self.many, self.ids = many, ids
        self.first = np.cumsum(many) - many

    @classmethod
    def of_packed(cls, parts: list[dict]) -> Block:
        block = cls.__new__(cls)
        block._keys(np.concatenate([p["many"] for p in parts]), np.concatenate([p["ids"] for p in parts]))
        size = np.repeat([p["size"] for p in parts], [len(p["many"]) for p in parts])
        block.groups = {}
        for d in np.unique(size).tolist():
            own = [p for p in parts if p["size"] == d]
            codes = np.concatenate([p["codes"] for p in own]) if own[0]["codes"] is not None else None
            block.groups[d] = Group(codes, np.flatnonzero(size == d), np.concatenate([p["x"] for p in own]))
        return block

    def _ranked(self, g: Group, q: np.ndarray, of: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n best keys of each query among pairs of a query and a place, by the inner product in double precision."""
        less = np.empty(len(of))
        for a in range(0, len(of), PAIRS):
            less[a : a + PAIRS] = -(g.x[at[a : a + PAIRS]].astype(np.float64) * q[of[a : a + PAIRS]]).sum(axis=1)
        many, first = self.many[g.rows[at]], self.first[g.rows[at]]
        keys = self.ids[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        return ranked(np.repeat(of, many), np.repeat(less, many), keys, n)

    def probed(self, q: np.ndarray, many: np.ndarray, cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, negative inner product and key: the n best of each query in the cells it probes (``many`` of the codes
        ``cells``, query by query).

        The cells alone say what is compared.  Where queries probe a large part of the block, their inner products are
        one matrix product, of which each takes what lies in its cells; otherwise the vectors of its cells are gathered.
        """
        g = self.groups.get(q.shape[1])
        if g is None or not len(cells):
            return NOTHING
        near = (q / lengths(q)[:, None]).astype(np.float32)
        cell = np.minimum(np.searchsorted(g.codes, cells), len(g.codes) - 1)
        hit = g.codes[cell] == cells
        of, cell = np.repeat(np.arange(len(q)), many)[hit], cell[hit]
        held = g.held[cell]
        count = np.bincount(of, held, len(q)).astype(np.int64)
        kept_of, kept_at = [], []
        for first in range(0, len(q), ASKED):
            own = slice(*np.searchsorted(of, [first, first + ASKED]))
            size, part = held[own], count[first : first + ASKED]
            places = np.repeat(g.start[cell[own]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            product = near[first : first + ASKED] @ g.rough.T if len(places) * PART > len(g.x) * len(part) else None
            stops = np.cumsum(part)
            for i in np.flatnonzero(part).tolist():
                at = places[stops[i] - part[i] : stops[i]]
                if len(at) > n:
                    rough = g.rough.take(at, axis=0) @ near[first + i] if product is None else product[i].take(at)
                    at = at[rough >= np.partition(rough, len(at) - n)[len(at) - n] - 2 * g.margin]
                kept_of.append(np.full(len(at), first + i))
                kept_at.append(at)
        if not kept_of:
            return NOTHING
        return self._ranked(g, q, np.concatenate(kept_of), np.concatenate(kept_at), n)

    def scanned(self, q: np.ndarray, least: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of all the block's vectors, of those with an inner product of ``least`` or more (-inf: any).

        Inner products are made in single precision, a tile of vectors at a time, and only runs whose largest may reach
        the n best so far are looked at.  What comes near them is compared in double precision.
        """
        g = self.groups.get(q.shape[1])
        if g is None:
            return NOTHING
        long = lengths(q)
        near = np.ascontiguousarray((q / long[:, None]).astype(np.float32).T)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            low = least / (long * g.longest) - g.margin
        low = np.where(np.isfinite(low) & np.isfinite(long * g.longest), low, -np.inf).astype(np.float32)
        tops, out = np.full((len(q), n), -np.inf, dtype=np.float32), np.empty((TILE, len(q)), dtype=np.float32)
        met = []
        for a in range(0, len(g.x), TILE):
            p = np.matmul(g.rough[a : a + TILE], near, out=out[: len(g.x) - a])
            whole = len(p) // RUN * RUN
            runs = p[:whole].reshape(-1, RUN, len(q))
            high = runs.max(axis=1)
            # the largest of a run is one vector's: no fewer than n vectors reach the n-th of them
            tops = np.partition(np.concatenate([tops, high.T], axis=1), -n, axis=1)[:, -n:]
            low = np.maximum(low, tops[:, 0] - 2 * g.margin)
            r, i = np.nonzero(high >= low)
            some = runs[r, :, i]
            k, j = np.nonzero(some >= low[i][:, None])
            rest, who = np.nonzero(p[whole:] >= low)
            met.append((i[k], a + r[k] * RUN + j, some[k, j]))
            met.append((who, a + whole + rest, p[whole:][rest, who]))
        of, at, rough = (np.concatenate(part) for part in zip(*met))
        keep = rough >= low[of]
        of, at = of[keep], at[keep]
        return self._ranked(g, q, of, at, n)

    def nearest(self, own: list[int], q: np.ndarray, probed: list[list[int]], n: int) -> list[list[dict]]:
        """What :meth:`probed` finds as a list for each query, without the query's own key."""
        many = np.array([len(cells) for cells in probed], dtype=np.int64)
        out: list[list[dict]] = [[] for _ in own]
        for i, less, key in zip(*(a.tolist() for a in self.probed(q, many, np.concatenate(probed).astype(np.int64), n + 1))):
            if key != own[i] and len(out[i]) < n:
                out[i].append({"less": less, "id": key})
        return out


def _search(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Sorted by slot and kind, a slot's vectors come first; its queries are answered as they arrive."""
    now, parts, block = None, [], None
    for row in unpacked_rows(batches):
        if row["slot"] != now:
            now, parts, block = row["slot"], [], None
        if not row["kind"]:
            # copied, so that the rest of the rows that came with it can go
            parts.append(row | {k: row[k].copy() for k in ("x", "many", "ids", "codes") if row[k] is not None})
            continue
        if parts:
            block, parts = Block.of_packed(parts), []
        if block is None:
            continue
        q = row["x"].astype(np.float64)
        if row["codes"] is None:
            of, less, ids = block.scanned(q, row["less"], n)
        else:
            of, less, ids = block.probed(q, row["many"], row["codes"], n)
        if len(of):
            yield packed([{
                "kind": 1, "chunk": row["chunk"], "size": row["size"], "nodes": row["nodes"].tobytes(),
                "many": np.bincount(of, minlength=len(q)).astype(np.int32).tobytes(), "ids": ids.tobytes(), "less": less.tobytes(),
            }])


def _merged(batches: Iterable[pa.RecordBatch], n: int, h: Hashes | None) -> Iterator[pa.RecordBatch]:
    """A chunk's queries with the n best of all they found; with ``h`` those are marked that may have missed more than
    1 - ``LEAST``, or found fewer than n."""

    def done() -> pa.RecordBatch:
        nodes, count = chunk["nodes"], len(chunk["nodes"])
        of, less, ids = ranked(*(np.concatenate(a) for a in zip(NOTHING, *found)), n)
        many = np.bincount(of, minlength=count)
        out = {"kind": 0, "chunk": chunk["chunk"], "size": chunk["size"], "nodes": nodes.tobytes(), "many": many.astype(np.int32).tobytes(), "ids": ids.tobytes(), "less": less.tobytes()}
        if h is not None:
            unsure = many < n
            sure = np.flatnonzero(~unsure)
            last = (np.cumsum(many) - 1)[sure]
            if len(sure):
                unsure[sure] = h.met(chunk["x"][sure].astype(np.float64), -less[last]) < LEAST
            out |= {"vectors": chunk["x"].tobytes(), "unsure": unsure.tobytes()}
        return packed([out])

    chunk, found = None, []
    for row in unpacked_rows(batches):
        if not row["kind"]:
            if chunk is not None:
                yield done()
            chunk, found = row, []
            order = np.argsort(row["nodes"])
        if row["many"] is not None:
            place = order[np.searchsorted(chunk["nodes"][order], row["nodes"])]
            found.append((np.repeat(place, row["many"]), row["less"], row["ids"]))
    if chunk is not None:
        yield done()


def _again(batches: Iterable[pa.RecordBatch], slots: int, n: int) -> Iterator[pa.RecordBatch]:
    """The unsure queries of a chunk for every slot, with the inner product of the last of n they found."""
    for row in unpacked_rows(batches):
        some, many = row["unsure"], row["many"].astype(np.int64)
        if some.any():
            full = many >= n
            least = np.full(len(some), -np.inf)
            least[full] = -row["less"][(np.cumsum(many) - 1)[full]]
            one = {"kind": 1, "chunk": row["chunk"], "size": row["size"], "vectors": row["x"][some].tobytes(), "nodes": row["nodes"][some].tobytes(), "less": least[some].tobytes()}
            yield packed([one | {"slot": slot} for slot in range(slots)])


def _scattered(batches: Iterable[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """All vectors (node, vector, ids), each in one slot of the exact pass."""
    for table in together(batches, GATHERED):
        column, ids, nodes = stacked(table.column(1)), stacked(table.column(2)), table.column(0).to_numpy()
        for rows, x in by_dimension(column):
            slot = (mix(nodes[rows].astype(np.uint64), 97) % np.uint64(slots)).astype(np.int64)
            yield from _dealt(slot, x.astype(plain(column)), ids.take(pa.array(rows)), None)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (node, vector) packed into chunks, which are known by their first node."""
    for table in together(batches, GATHERED):
        column, nodes = stacked(table.column(1)), table.column(0).to_numpy()
        for rows, q in by_dimension(column):
            q, own = q.astype(plain(column)), nodes[rows]
            yield packed([
                {"kind": 0, "chunk": int(own[a]), "size": q.shape[1], "vectors": q[a : a + CHUNK].tobytes(), "nodes": own[a : a + CHUNK].tobytes()}
                for a in range(0, len(q), CHUNK)
            ])


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, found: a row for each query of a chunk."""
    for row in unpacked_rows(batches):
        stops = np.concatenate([[0], np.cumsum(row["many"])]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(row["less"]), pa.array(row["ids"])], ["less", "id"])
        yield pa.RecordBatch.from_arrays([pa.array(row["nodes"]), pa.ListArray.from_arrays(pa.array(stops), pairs)], ["node", "found"])


def _tops(batches: Iterable[pa.RecordBatch], q: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """The n largest inner products of each sample query among the vectors of a task, as one row of bytes."""
    best = np.full((len(q), n), -np.inf)
    for table in together(batches, GATHERED):
        for _, x in by_dimension(stacked(table.column(0))):
            if x.shape[1] == q.shape[1]:
                best = largest([best, q @ x.T], n)
    yield pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary())], ["best"])


def largest(scores: list[np.ndarray], n: int) -> np.ndarray:
    every = np.concatenate(scores, axis=1)
    return np.partition(every, every.shape[1] - n, axis=1)[:, every.shape[1] - n :]


def _fitted(
    entries: DataFrame, chunks: DataFrame, total: int, asked: int, longest: float, n: int, tables: int, size: int, probes: int,
    aim: float, sample: int,
) -> Hashes:
    """Hashes for these vectors and queries.

    All tables and the narrowest cells that reach the aim in a sample of the vectors, while that makes little work;
    otherwise those that make least, by a sample of both and by all neighbours of the sample's queries.
    """
    taken = entries.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toArrow().column(0)
    found = {x.shape[1]: x for _, x in by_dimension(stacked(taken))} if total else {}
    x = max(found.values(), key=len) if found else np.zeros((0, 0))
    width = fit_width(x, total, n, tables, size, probes, aim, longest) if found else WIDTHS[-1]
    h = Hashes(tables, size, probes, width, longest)
    some = chunks.orderBy("chunk").limit(8).toArrow().to_batches()
    q = [row["x"].astype(np.float64) for row in unpacked_rows(some) if row["size"] == x.shape[1]]
    if not q or asked * tables * work_of(h, np.concatenate(q)[:TRIED], x, total, asked) <= LITTLE:
        return h
    q = np.concatenate(q)[:TRIED]
    rows = entries.select("vector").mapInArrow(lambda b: _tops(b, q, n + 1), "best binary").toArrow().column(0).to_pylist()
    near = -np.sort(-largest([np.frombuffer(r).reshape(len(q), n + 1) for r in rows], n + 1), axis=1)
    own = near[:, 0] >= (q * q).sum(axis=1) * (1 - 1e-9)  # the query's own vector
    near = np.where(own[:, None], near[:, 1:], near[:, :-1])
    return fit_hashes(q, near, x, total, asked, tables, size, probes, aim, longest)


def _answers(held: DataFrame, sent: DataFrame, slots: int, known: DataFrame, n: int) -> DataFrame:
    """Chunks, sorted, each before what its queries found in the slots they were sent to."""
    # as many tasks as there is work for, which is more than the bytes make believe
    found = held.unionByName(sent).repartition(2 * slots, "slot").sortWithinPartitions("slot", "kind").mapInArrow(lambda b: _search(b, n), PACK)
    return known.unionByName(found).repartition("chunk").sortWithinPartitions("chunk", "kind")


def nearest_vectors(
    vectors: DataFrame, queries: DataFrame, n: int = 20, key: str = "vec_id", vector: str = "embedding",
    tables: int = 4, size: int = 6, probes: int = 200, aim: float = 0.98, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``n`` vectors found with the largest inner product for each row of ``queries``
    (the same columns as ``vectors``; whole-number keys), without those of the query's own key; ties to the smaller key.

    Every vector is in one cell of each table.  A query visits the ``probes`` cells of each table in the order of
    their estimated success; what the tables find is merged and ranked by the exact inner product in double
    precision.  The cells' width is fitted on at most ``sample`` vectors (first by a hash), so that a sample of
    the corpus reaches ``aim`` at the distance its n-th neighbours have in the whole; everything is indexed.  Where that
    makes much work, ``tables`` is the most and ``size`` the least: how many tables and projections there are and how
    wide a cell is then follow from the work of a query at the same aim (:func:`fit_hashes`).

    A query that found fewer than ``n``, or whose n-th found is so far away that a vector there lies in its probed
    cells with a chance below ``LEAST``, is compared with all vectors, block by block.  What it found already bounds
    what a block has to return.  So each query has ``n`` rows, or as many as it has candidates.

    Equal vectors are one entry that holds its n + 1 smallest keys, which is all a result can need, and equal queries
    are asked once.  Neighbouring cells share a slot; one that holds over ``BLOCK`` vectors is cut into parts, and queries
    go to each part.  A task holds one slot's vectors, and its queries stream past, ``CHUNK`` in a row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a key, take no part;
    vectors of another dimension than the query's are no candidates.  Equal rows are one candidate; other vectors
    under one key are several.
    """
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).distinct()
    place = Window.partitionBy("node").orderBy("id")
    smallest = rows.withColumn("node", F.xxhash64("vector")).withColumn("n", F.row_number().over(place)).where(F.col("n") <= n + 1)
    entries = stored(smallest.groupBy("node").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids")))
    asked = queries.where(usable(vector) & F.col(key).isNotNull())
    asked = asked.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).withColumn("node", F.xxhash64("vector"))
    chunks = stored(asked.groupBy("node").agg(F.first("vector").alias("vector")).mapInArrow(_chunks, PACK))
    asked = stored(asked.select("id", "node").distinct())

    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    total, longest = entries.agg(F.count("*"), F.max(F.sqrt(square))).first()
    longest = float(longest or 1.0)
    packs, ask = chunks.agg(F.count("*"), F.sum(F.octet_length("nodes")) / 8).first()
    # a query's own key may have several vectors, all of which are left out in the end
    own = entries.select(F.explode("ids").alias("id")).join(asked.select("id").distinct(), "id", "left_semi")
    most = n + (own.groupBy("id").count().agg(F.max("count")).first()[0] or 1)
    h = _fitted(entries, chunks, total, int(ask or 0), longest, n, tables, size, probes, aim, sample)

    blocks = max(BLOCKS, -(-total // BLOCK))
    held = entries.select("vector").mapInArrow(lambda b: _counted(b, h, blocks), "slot long, held long").groupBy("slot").agg(F.sum("held"))
    cut = Cut(dict(map(tuple, held.collect())), h.tables * blocks)
    held = entries.select("node", "vector", "ids").mapInArrow(lambda b: _data(b, h, blocks, cut), PACK)
    sent = chunks.repartition(max(EXACT_BLOCKS, packs // 32), "chunk").mapInArrow(lambda b: _queries(b, h, blocks, cut), PACK)
    best = stored(_answers(held, sent, int(cut.parts.sum()), chunks, most).mapInArrow(lambda b: _merged(b, most, h), PACK))
    told = "node long, found array<struct<less:double,id:long>>"
    if best.where(F.contains(F.col("unsure"), F.lit(bytearray(b"\x01")))).isEmpty():
        done = best.mapInArrow(_told, told)
    else:
        slots = max(EXACT_BLOCKS, -(-total // EXACT_BLOCK))
        held = entries.select("node", "vector", "ids").mapInArrow(lambda b: _scattered(b, slots), PACK)
        sent = best.mapInArrow(lambda b: _again(b, slots, most), PACK)
        done = _answers(held, sent, slots, best, most).mapInArrow(lambda b: _told(_merged(b, most, None)), told)
    mine = asked.join(done, "node").select("id", F.filter("found", lambda x: x["id"] != F.col("id")).alias("found"))
    best = mine.groupBy("id").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))), 1, n).alias("found"))
    return best.select(F.col("id").alias("query_id"), F.posexplode("found").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score")
    )
