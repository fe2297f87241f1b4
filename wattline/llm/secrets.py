"""Secrets in texts: fixed patterns, and guess cost of values that stand where a credential stands (operator 1)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.rows import spread, with_text
from wattline.llm.words import pieces

# fixed values: the patterns of the three base kinds
ASSIGN = re.compile(
    r"(?:(?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?(?P<value>[A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
LEAST = {"assign": 12}

# words before a value that make it a credential
CONTEXT = re.compile(
    r"(?ai:password|passwd|passphrase|passcode|pwd|secret|token|api_?key|private_?key|access_?key|auth|credentials?)"
    r"[\"']?\x20*[:=]\x20*(?P<open>[\"'`]?)"
)
QUOTED = {q: re.compile(rf"[^{q}\r\n]+") for q in "\"'`"}
BARE = re.compile(r"[^\x20\t-\r\"'`,;<>(){}\[\]]+")

# fixed values: common words of passwords, most common first
COMMON = (
    "password pass secret admin root login welcome letmein qwerty dragon monkey master shadow sunshine princess "
    "football baseball superman batman trustno love hello freedom whatever michael jordan summer winter spring autumn "
    "access test guest user default changeme example sample token key demo temp public private system server"
).split()
RANK = {w: i + 2 for i, w in enumerate(COMMON)}
LONGEST = max(map(len, COMMON))
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d(?P<s>[-/.]?)(?:0[1-9]|1[0-2])(?P=s)(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?P<t>[-/.]?)(?:0[1-9]|1[0-2])(?P=t)(?:19|20)\d\d|(?:19|20)\d\d")


def _next_keys() -> set[str]:
    """Ordered pairs of neighbouring keys of one row, both ways, and of one column, downwards."""
    pairs = {row[i : i + 2] for row in ROWS for i in range(len(row) - 1)}
    pairs |= {p[::-1] for p in pairs}
    return pairs | {a + b for up, down in zip(ROWS, ROWS[1:]) for a, b in zip(up, down)}


NEXT = _next_keys()


def alphabet(c: str) -> int:
    """How many characters a guesser tries for one like this."""
    return 10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33 if c.isascii() else 100


def spans_of(value: str) -> Iterator[tuple[int, int, float, str]]:
    """Guessable spans (start, end, log10 of guesses, sort); at most about twenty for each place."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            for form, leet in ((low[i:j], 0.0), (plain[i:j], 0.6)):
                rank = RANK.get(form)
                if rank:
                    case = 0.0 if value[i:j] == low[i:j] else 0.3 if value[i:j].istitle() or value[i:j].isupper() else 1.0
                    yield i, j, log10(rank) + leet + case, "word"
                    break
        found = DATE.match(value, i)
        if found:
            yield i, found.end(), log10(120 * 365) if found.end() - i > 4 else log10(120), "date"
    i = 0
    while i < n:  # maximal runs of one block of one to four characters
        best = None
        for width in (1, 2, 3, 4):
            j = i + width
            while value[j : j + width] == value[i : i + width] and j + width <= n:
                j += width
            times = (j - i) // width
            if times >= (3 if width == 1 else 2) and (best is None or j > best[0]):
                best = (j, sum(log10(alphabet(c)) for c in value[i : i + width]) + log10(times))
        if best:
            yield i, best[0], best[1], "repeat"
        i = best[0] if best else i + 1
    i = 0
    while i < n - 1:  # maximal keyboard walks
        j = i + 1
        while j < n and low[j - 1 : j + 1] in NEXT:
            j += 1
        if j - i >= 3:
            yield i, j, log10(47) + log10(4) + 0.3 * (j - i - 1), "walk"
        i = j if j - i > 1 else i + 1


def guess_cost(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """Least log10 of guesses over all segmentations of the whole value, and that segmentation.

    ``best[i]`` is the least cost of the first i characters: a span adds its cost, a character by brute force
    adds the log of its alphabet.  Every further segment costs log10(2), for the order of trials.
    """
    ends: dict[int, list[tuple[int, float, str]]] = {}
    for start, end, cost, sort in spans_of(value):
        ends.setdefault(end, []).append((start, cost, sort))
    best, back = [0.0], [(0, "")]
    for i in range(1, len(value) + 1):
        joined = 0.0 if back[i - 1][1] in ("brute", "") else log10(2)
        cost, step = best[i - 1] + log10(alphabet(value[i - 1])) + joined, (i - 1, "brute")
        for start, span, sort in ends.get(i, ()):
            total = best[start] + span + (log10(2) if start else 0.0)
            if total < cost:
                cost, step = total, (start, sort)
        best.append(cost)
        back.append(step)
    parts, i = [], len(value)
    while i:
        start, sort = back[i]
        if sort == "brute" and parts and parts[-1][0] == "brute":
            parts[-1] = ("brute", start, parts[-1][2])
        else:
            parts.append((sort, start, i))
        i = start
    return best[-1], parts[::-1]


def base_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds: leftmost matches, not overlapping, each kind on its own."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m["value"]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_secrets(text: str, least: float, shortest: int) -> list[tuple[int, int, float]]:
    """Values in a credential's place that need at least ``10**least`` guesses: (start, end, log10 of guesses)."""
    out, at = [], 0
    while ":" in text or "=" in text:
        m = CONTEXT.search(text, at)
        if not m:
            break
        at = m.end()
        value = (QUOTED[m["open"]] if m["open"] else BARE).match(text, m.end())
        if not value:
            continue
        start, end = value.span()
        if m["open"] and text[end : end + 1] != m["open"]:  # no closing quote on the line: take it as bare
            value = BARE.match(text, m.end())
            if not value:
                continue
            start, end = value.span()
        while end > start and text[end - 1] in ".!?:" and not m["open"]:  # the sentence's mark
            end -= 1
        if end - start >= shortest:
            cost, _ = guess_cost(text[start:end])
            if cost >= least:
                out.append((start, end, cost))
        at = max(at, end)
    return out


def secret_spans(text: str, least: float, shortest: int) -> list[tuple[int, int, int, float | None]]:
    """Base spans, and guessed values that no base span covers; by start, then kind."""
    base = base_secrets(text)
    held = [(s, e) for s, _, e in base]
    spans: list[tuple[int, int, int, float | None]] = [(s, k, e, None) for s, k, e in base]
    for start, end, cost in guessed_secrets(text, least, shortest):
        if not any(s <= start and end <= e for s, e in held):
            spans.append((start, 3, end, cost))
    return sorted(spans, key=lambda x: x[:3])


def masked(text: str, spans: Iterable[tuple[int, int]], mark: str) -> str:
    """The text with every stretch that spans cover, overlapping ones taken together, replaced by ``mark``."""
    out, at, end = [], 0, 0
    for start, stop in sorted(spans):
        if start >= end:
            out.append(text[at:start])
            out.append(mark)
        end = max(end, stop)
        at = end
    return "".join(out) + text[at:]


def _scan(batches: Iterable[pa.RecordBatch], text: str, least: float, shortest: int, mark: str) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))
    for batch in pieces(with_text(batches, text), "text"):
        found, clean = [], []
        for value in batch.column(1).to_pylist():
            spans = secret_spans(value, least, shortest) if value else []
            found.append([{"kind": KINDS[k], "start": s, "end": e, "cost": c} for s, k, e, c in spans])
            clean.append(masked(value, [(s, e) for s, _, e, _ in spans], mark) if spans else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, kind), pa.array(clean, pa.string())], ["row", "spans", "masked"]
        )


def find_secrets(docs: DataFrame, text: str = "text", least: float = 8.0, shortest: int = 8, mark: str = "<secret>") -> DataFrame:
    """``docs`` with spans (kind, start, end in code points, cost: log10 of guesses of a guessed value) and masked:
    the text with all spans replaced by ``mark``, null where there is none.

    A value after a credential word (``password = …``) is cut into words, dates, repeats, keyboard walks and
    brute-force spans at least cost; from ``10**least`` guesses on it is a span of kind "guess", unless a base
    span covers it, so placeholders such as "changeme" are left alone.  Values are judged whole, base spans
    always stay.  Null and empty texts have no spans.  No shuffle.
    """
    kind = T.StructType([T.StructField("row", docs.schema)]).add("spans", T.DataType.fromDDL("array<struct<kind:string,start:long,end:long,cost:double>>"))
    kind = kind.add("masked", "string")
    done = docs.select(F.struct("*").alias("row")).mapInArrow(lambda b: _scan(b, text, least, shortest, mark), kind)
    return spread(done, docs.columns, ["spans", "masked"])
