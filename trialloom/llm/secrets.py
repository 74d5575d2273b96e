"""Secret scanning: fixed rules, and automata inferred from the credentials that they label.

The values found by the rules are labelled strings. For each label a prefix tree
of (a bounded sample of) them is merged, state by state, where two states'
outgoing frequencies agree within a Hoeffding bound; the result is a
probabilistic automaton of the format. Every other long token with a digit is a
candidate: its likelihood per character under the formats and under ordinary
tokens decides whether it is reported as ``grammar``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_batches, text_of
from trialloom.session import settle

#: Kinds in the order in which spans are listed.
KINDS = ("assign", "access", "hex", "grammar")
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run's first AKIA is its longest match
_HEX = re.compile(r"[0-9a-f]{24,}")  # only whole runs of hex digits can match
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Labelled strings of each kind that teach, about (by a hash of the string).
SAMPLE = 400
ALPHA = 0.05
#: Needed lead over ordinary tokens, in natural logarithms per character.
MARGIN = 0.25
_SPANS = "array<struct<start: long, rank: int, end: long, kind: string, value: string>>"


def base_spans(text: str) -> list[tuple[int, int, int, str, str]]:
    """(start, rank, end, kind, value) of the fixed rules, leftmost and not overlapping for each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), "assign", m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), "access", m.group()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), "hex", m.group()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple]) -> list[tuple[int, int, int, str, str]]:
    """Tokens of 16 or more characters with a digit that no base span touches; dots and the like at the ends go."""
    out, k = [], 0
    reach = sorted((s[0], s[2]) for s in taken)
    for m in _TOKEN.finditer(text):
        value = m.group()
        if not any(c in value for c in "0123456789"):
            continue
        start = m.start() + len(value) - len(value.lstrip(".-="))
        value = value.strip(".-=")
        end = start + len(value)
        while k < len(reach) and reach[k][1] <= start:
            k += 1
        if len(value) >= 16 and not any(a < end and b > start for a, b in reach[k:k + 4]):
            out.append((start, 3, end, "grammar", value))
    return out


def _classes() -> dict[str, str]:
    out = {c: c for c in "+/_.=-"}
    out |= dict.fromkeys("0123456789", "9") | dict.fromkeys("abcdef", "a")
    return out | dict.fromkeys("ghijklmnopqrstuvwxyz", "z") | {chr(c): "A" for c in range(65, 91)}


_CLASS = _classes()


def symbols(value: str) -> str:
    """A string in the alphabet of the automata: digits, low and high letters, capitals, signs."""
    return "".join(_CLASS.get(c, "?") for c in value)


@dataclass
class Automaton:
    """Probabilistic automaton: log-probabilities of the next symbol or of the end, by state."""

    step: list[dict[str, tuple[int, float]]]
    stop: list[float]
    floor: float = float(np.log(1e-4))

    def likelihood(self, text: str) -> float:
        """Log-probability per symbol, the end counted as one; without a known way on it stays where it is."""
        state, total = 0, 0.0
        for c in text:
            state, gain = self.step[state].get(c, (state, self.floor))
            total += gain
        return (total + self.stop[state]) / (len(text) + 1)


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the prefix tree of ``strings``, breadth first."""
    kids: list[dict[str, int]] = [{}]
    seen, ends = [0], [0]
    for s in strings:
        node = 0
        seen[0] += 1
        for c in s:
            if c not in kids[node]:
                kids[node][c] = len(kids)
                kids.append({})
                seen.append(0)
                ends.append(0)
            node = kids[node][c]
            seen[node] += 1
        ends[node] += 1
    flow = [{c: seen[k] for c, k in own.items()} for own in kids]
    bound = np.sqrt(0.5 * np.log(2 / alpha))

    def differ(f1, n1, f2, n2):
        return abs(f1 / n1 - f2 / n2) > bound * (n1 ** -0.5 + n2 ** -0.5)

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(ends[a], seen[a], ends[b], seen[b]):
                return False
            if any(differ(flow[a].get(c, 0), seen[a], flow[b].get(c, 0), seen[b]) for c in {*flow[a], *flow[b]}):
                return False
            todo += [(kids[a][c], kids[b][c]) for c in kids[a] if c in kids[b] and kids[a][c] != kids[b][c]]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            seen[a] += seen[b]
            ends[a] += ends[b]
            for c, k in kids[b].items():
                flow[a][c] = flow[a].get(c, 0) + flow[b][c]
                if c in kids[a]:
                    todo.append((kids[a][c], k))
                else:
                    kids[a][c] = k

    red = [0]
    while True:
        # a fold can give any earlier state new ways on, so all are looked at again
        blue = next(((node, c) for node in red for c in sorted(kids[node]) if kids[node][c] not in red), None)
        if blue is None:
            break
        node, c = blue
        own = kids[node][c]
        for r in red:
            if compatible(r, own):
                kids[node][c] = r
                fold(r, own)
                break
        else:
            red.append(own)
    at = {node: k for k, node in enumerate(red)}
    step, stop = [], []
    for node in red:
        whole = sum(flow[node].values()) + ends[node] + 1e-9
        step.append({c: (at[k], float(np.log(max(flow[node][c] / whole, 1e-9)))) for c, k in kids[node].items()})
        stop.append(float(np.log(max(ends[node] / whole, 1e-4))))
    return Automaton(step, stop)


@dataclass
class Formats:
    """Automata by label, ``plain`` for ordinary tokens, and the likelihood that a value of a label must reach."""

    automata: dict[str, Automaton]
    least: dict[str, float]

    def score(self, value: str) -> float:
        """Lead of the best format over ordinary tokens; minus infinity below every format's least likelihood."""
        s = symbols(value)
        fits = [v for k, a in self.automata.items() if k != "plain" and (v := a.likelihood(s)) >= self.least[k]]
        if not fits:
            return float("-inf")
        plain = self.automata.get("plain")
        return max(fits) - (plain.likelihood(s) if plain else Automaton([{}], [0.0]).likelihood(s))


def learn(samples: dict[str, list[str]], alpha: float = ALPHA) -> Formats:
    automata, least = {}, {}
    for kind, values in sorted(samples.items()):
        strings = sorted(map(symbols, values))
        if strings:
            automata[kind] = infer(strings, alpha)
            least[kind] = float(np.quantile([automata[kind].likelihood(s) for s in strings], 0.02))
    return Formats(automata, least)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans): base spans and candidates of each whole text; null counts as empty."""
    names = ("start", "rank", "end", "kind", "value")
    kind = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()),
                                       strict=True))))

    @F.arrow_udf(_SPANS)
    def find(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch.to_pylist():
            base = base_spans(t)
            out.append([dict(zip(names, s, strict=True)) for s in (*base, *candidates(t, base))])
        return pa.array(out, kind)

    return docs.select(F.col(key).alias("id"), find(text_of(text)).alias("spans"))


def learn_formats(found: DataFrame, sample: int = SAMPLE) -> Formats:
    """Formats from about ``sample`` different values of each kind, candidates being the ordinary tokens."""
    values = found.select(F.explode("spans").alias("s")).select(
        F.when(F.col("s.kind") == "grammar", "plain").otherwise(F.col("s.kind")).alias("kind"), "s.value").distinct()
    values = settle(values, "values")
    counts = {r[0]: r[1] for r in values.groupBy("kind").count().collect()}  # four rows at most
    if not counts:
        return Formats({}, {})
    chance = F.coalesce(*[F.when(F.col("kind") == k, F.lit(sample / n)) for k, n in sorted(counts.items())])
    draw = F.pmod(F.xxhash64(F.lit(5), "value"), F.lit(1 << 30)) / float(1 << 30)
    samples: dict[str, list[str]] = {}
    for kind, value in values.where(draw < chance).collect():
        samples.setdefault(kind, []).append(value)
    return learn(samples)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", margin: float = MARGIN,
                 sample: int = SAMPLE) -> DataFrame:
    """For each document: id and spans (start, rank, end, kind, value), by start, then kind.

    Places are code points, the end exclusive. The fixed rules' spans are always
    there; ``grammar`` spans come on top. Null and empty texts have none; without
    labelled values nothing is inferred. Repeated rows and null ids are rows like
    others; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    found = settle(scan(docs, key, text), "secrets")
    shared = docs.sparkSession.sparkContext.broadcast(learn_formats(found, sample))

    @F.arrow_udf("array<boolean>")
    def secret(batch: pa.Array) -> pa.Array:
        return pa.array([[shared.value.score(v) >= margin for v in own] for own in batch.to_pylist()],
                        pa.list_(pa.bool_()))

    free = F.filter("spans", lambda s: s.kind == "grammar")
    hit = F.filter(F.arrays_zip(free.alias("s"), secret(F.transform(free, lambda s: s.value)).alias("ok")),
                   lambda x: x["ok"])
    return found.select("id", F.array_sort(F.concat(
        F.filter("spans", lambda s: s.kind != "grammar"), F.transform(hit, lambda x: x["s"]))).alias("spans"))
