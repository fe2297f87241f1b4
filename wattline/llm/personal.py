"""Personal data in texts: fixed patterns, and a skip-chain conditional random field over the rest (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.quality import logistic
from wattline.llm.rows import spread, with_text
from wattline.llm.words import pieces
from wattline.session import stored

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # the last one: no personal data
NONE = len(KINDS)
HASHES = 256
SAMPLE = 20_000
# sweeps over all edges at once; what they leave unsettled is passed from node to node, PASSES times at most where loops
# keep it from settling, damped after PASSES_FREE
SWEEPS = 24
SETTLED = 1e-3
PASSES, PASSES_FREE = 100, 10

# fixed values: the patterns of the four base kinds
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"[^\x20\t-\r]+")
EDGE = ".,;:!?()[]{}<>\"'`"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest local part before each @, and a domain with a dot after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; a match that fails its test is dropped and not retried."""
    out = [(0, s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def shape(token: str) -> str:
    """Letters as a, digits as 9, runs cut to three: 'x12@ab.com' gives 'a99@aa.aaa'."""
    out = []
    for c in token:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if len(out) < 3 or out[-3:] != [k] * 3:
            out.append(k)
    return "".join(out)


def same_key(token: str) -> str | None:
    """What repeated or similar tokens share: the digits of a number, the letters of an address."""
    core = token.strip(EDGE)
    if "@" in core:
        return core.lower()
    digits = "".join(c for c in core if "0" <= c <= "9").lstrip("0")
    return digits if len(digits) >= 5 else None


def span_keys(span: str, kind: int) -> set[str]:
    """Keys under which a base match of one or more tokens is met again: its digits, of a phone number also those
    without a country's one to three."""
    if kind == 0:
        return {span.lower()}
    digits = "".join(c for c in span if "0" <= c <= "9")
    found = [digits, *(digits[n:] for n in (1, 2, 3) if KINDS[kind] == "phone")]
    return {k for d in found if len(k := d.lstrip("0")) >= 5}


@dataclass
class Graph:
    """The uncertain tokens of one text: spans, hashed features, base labels (-1: none), chain and skip edges."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    base: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph_of(text: str, base: list[tuple[int, int, int]]) -> Graph:
    """Tokens with a digit or an @ are nodes; any other token is surely no personal data, which cuts the chain
    exactly there.  Neighbouring nodes share a chain edge, a node and the next one with its key a skip edge; the
    last token of a base match also stands for the whole match, under all of its keys."""
    g = Graph([], [], [], [], [])
    if not base and not any(c in text for c in "@0123456789"):
        return g
    marks = sorted((s, e, k) for k, s, e in base)
    at, before, last_end = 0, "", -1
    seen: dict[str, int] = {}
    for m in TOKEN.finditer(text):
        token = m[0]
        if not ("@" in token or any("0" <= c <= "9" for c in token)):
            before = token
            continue
        start, end = m.span()
        while start < end and text[start] in EDGE:
            start += 1
        while end > start and text[end - 1] in EDGE:
            end -= 1
        while at < len(marks) and marks[at][1] <= start:
            at += 1
        label, look, keys = -1, at, set()
        while look < len(marks) and marks[look][0] < end:
            label = marks[look][2]
            if marks[look][1] <= m.end():
                keys |= span_keys(text[marks[look][0] : marks[look][1]], label)
            look += 1
        core = text[start:end]
        digits = sum("0" <= c <= "9" for c in core)
        n = len(g.spans)
        g.spans.append((start, end))
        g.features.append([
            crc32(x.encode()) % HASHES
            for x in (f"s{shape(core)}", f"w{before.strip(EDGE + '=').lower()}", f"d{min(digits, 20)}", f"p{core[:1]}", f"l{min(len(core), 30)}")
        ])
        g.base.append(label)
        if n and m.start() - last_end == 1:
            g.chain.append((n - 1, n))
        last_end = m.end()
        key = same_key(core)
        if key is not None:
            keys.add(key)
        for other in sorted({seen[k] for k in keys if k in seen}):
            g.skip.append((other, n))
        seen.update(dict.fromkeys(keys, n))
        before = token
    return g


@dataclass(frozen=True)
class Field:
    """Log potentials: of a node for each hashed feature, of a chain edge, of a skip edge."""

    weights: np.ndarray  # HASHES + 1 x LABELS
    chain: np.ndarray
    skip: np.ndarray


def posteriors(g: Graph, field: Field) -> np.ndarray:
    """Label chances of each node by loopy message passing; nodes with a base label are observed."""
    n = len(g.spans)
    unary = field.weights[np.array(g.features)].sum(axis=1) + field.weights[HASHES]
    known = np.array(g.base)
    unary[known >= 0] = -30.0
    unary[known >= 0, known[known >= 0]] = 30.0
    edges = np.array(g.chain + g.skip, dtype=np.int64).reshape(-1, 2)
    belief = unary
    if len(edges):
        pair = np.concatenate([np.repeat(field.chain[None], len(g.chain), 0), np.repeat(field.skip[None], len(g.skip), 0)])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), LABELS))
        change = np.inf
        for _ in range(SWEEPS):
            belief = unary.copy()
            np.add.at(belief, target, message)
            sent = (belief[source] - message[back])[:, :, None] + pair
            top = sent.max(axis=1)
            fresh = top + np.log(np.exp(sent - top[:, None, :]).sum(axis=1))
            fresh -= fresh.max(axis=1, keepdims=True)
            change = np.abs(fresh - message).max()
            message = 0.5 * message + 0.5 * fresh
            if change < SETTLED:
                break
        if change >= SETTLED:
            message = _passed(unary, pair, source, target, back, message)
        belief = unary.copy()
        np.add.at(belief, target, message)
    belief = belief - belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(axis=1, keepdims=True)


def _passed(
    unary: np.ndarray, pair: np.ndarray, source: np.ndarray, target: np.ndarray, back: np.ndarray, message: np.ndarray
) -> np.ndarray:
    """Messages sent in the order of the nodes and back again, each with all before it, until none changes.

    One pass takes a label as far as edges go.
    """
    belief = unary.copy()
    np.add.at(belief, target, message)
    up = source < target
    order = np.concatenate([np.flatnonzero(up)[np.argsort(source[up], kind="stable")], np.flatnonzero(~up)[np.argsort(-source[~up], kind="stable")]])
    steps = [(int(e), int(source[e]), int(target[e]), int(back[e])) for e in order]
    message = message.copy()
    for number in range(PASSES):
        share = 1.0 if number < PASSES_FREE else 0.5
        most = 0.0
        for e, a, b, r in steps:
            sent = (belief[a] - message[r])[:, None] + pair[e]
            top = sent.max(axis=0)
            fresh = top + np.log(np.exp(sent - top).sum(axis=0))
            change = share * (fresh - fresh.max() - message[e])
            message[e] += change
            belief[b] += change
            most = max(most, float(np.abs(change).max()))
        if most < SETTLED * share:
            break
    return message


def all_spans(text: str, field: Field, least: float) -> list[tuple[int, int, int, bool]]:
    """Base spans and those the field adds: a token at ``least`` chance of a kind that no base span touches."""
    found = base_spans(text)
    base = [(*x, True) for x in found]
    g = graph_of(text, found)
    if g.skip or g.chain or any(b < 0 for b in g.base):
        p = posteriors(g, field)
        for (start, end), known, chances in zip(g.spans, g.base, p):
            best = int(chances[:NONE].argmax())
            if known < 0 and end > start and chances[best] >= least:
                base.append((best, start, end, False))
    return sorted(base)


def _scan(batches: Iterable[pa.RecordBatch], text: str, field: Field, least: float) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    for batch in pieces(with_text(batches, text), "text"):
        found = []
        for value in batch.column(1).to_pylist():
            spans = all_spans(value, field, least) if value else []
            found.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["row", "spans"])


def _learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node: rank, features, label, label of the chain and of the skip neighbour before it (-1: none).

    The patterns know nothing of a node that only repeats what they found, so such nodes are not learnt from.
    """
    for batch in pieces(batches, "text"):
        rows = []
        for text in batch.column(0).to_pylist():
            g = graph_of(text, base_spans(text)) if text else Graph([], [], [], [], [])
            unsure = {i for e in g.skip for i in e if g.base[e[0]] >= 0 or g.base[e[1]] >= 0}
            labels = [b if b >= 0 else -1 if i in unsure else NONE for i, b in enumerate(g.base)]
            chain, skip = dict((b, labels[a]) for a, b in g.chain), dict((b, labels[a]) for a, b in g.skip)
            seed = crc32(text.encode()) if g.spans else 0
            rows += [
                (crc32(b"%d %d" % (seed, i)), f, labels[i], chain.get(i, -1), skip.get(i, -1))
                for i, f in enumerate(g.features) if labels[i] >= 0
            ]
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int32())), *[pa.array(c, pa.int32()) for c in columns[2:]]],
            ["rank", "features", "label", "chain", "skip"],
        )


def fit_field(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field:
    """Potentials learnt from the nodes of ``docs``, labelled by the base patterns: at most ``sample`` nodes of every
    kind and as many of none, first by a hash.

    Node weights: logistic regressions of each kind on hashed shape, size, first character and the word before.
    Edge potentials: smoothed log ratios of seen and expected label pairs.
    """
    source = docs.select(F.col(text).cast("string").alias("text"))
    nodes = source.mapInArrow(_learn, "rank long, features array<int>, label int, chain int, skip int")
    share = max(1, sample // LABELS)
    nodes = stored(nodes)
    found = [
        nodes.where(F.col("label") == k).orderBy("rank", "features", "chain", "skip").limit(share).toArrow() for k in range(LABELS)
    ]
    rows = pa.concat_tables(found).to_pydict()
    return field_of(rows["features"], rows["label"], rows["chain"], rows["skip"])


def field_of(features: list[list[int]], labels: list[int], chain: list[int], skip: list[int]) -> Field:
    weights = np.zeros((HASHES + 1, LABELS))
    weights[HASHES, NONE] = 3.0  # without any sample: nothing is personal
    y = np.array(labels, dtype=np.int64)
    if len(y):
        x = np.zeros((len(y), HASHES + 1))
        for i, f in enumerate(features):
            np.add.at(x[i], f, 1.0)
        x[:, HASHES] = 1.0
        for k in range(NONE):
            if (y == k).any():
                weights[:, k] = logistic(x, (y == k).astype(float), ridge=1.0, steps=12)
            else:
                weights[HASHES, k] = -6.0
        weights[HASHES, NONE] = 0.0

    def ratios(neighbour: list[int], prior: float, most: float) -> np.ndarray:
        """log p(a, b) / (p(a) p(b)) with ``prior`` pseudo-counts for equal labels, at most ``most`` either way."""
        table = np.full((LABELS, LABELS), 0.1) + np.eye(LABELS) * prior
        for a, b in zip(neighbour, labels):
            if a >= 0:
                table[a, b] += 1
        p = table / table.sum()
        return np.clip(np.log(p) - np.log(p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)), -most, most)

    return Field(weights, ratios(chain, 0.5, 2.0), ratios(skip, 5.0, 5.0))


def find_personal(docs: DataFrame, field: Field, text: str = "text", least: float = 0.95) -> DataFrame:
    """``docs`` with spans (kind, start, end in code points, base): all base matches, and tokens that the skip-chain
    field gives a kind with a chance of at least ``least``, by kind, then start.

    Base matches are observed labels; message passing carries them to repeated tokens ("+49 30 1234567" and
    later "301234567") and to neighbours.  Null and empty texts have no spans; equal rows have equal ones.  Whole texts are
    scanned, however long, in time proportional to their tokens and edges.  Columns of ``docs`` stay, but one named spans is replaced.  No shuffle.
    """
    kind = T.StructType([T.StructField("row", docs.schema)]).add("spans", T.DataType.fromDDL("array<struct<kind:string,start:long,end:long,base:boolean>>"))
    done = docs.select(F.struct("*").alias("row")).mapInArrow(lambda b: _scan(b, text, field, least), kind)
    return spread(done, docs.columns, ["spans"])
