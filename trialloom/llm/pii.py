"""Personal data: fixed rules, and a skip-chain conditional random field over tokens.

Tokens with a digit or an at sign are nodes. Neighbours in the text form the
chain; a token and the next one like it in the document, however far, form a skip
edge: a repeat has the same letters and digits, a similar token of eight and more of
them differs in one (same length, first or last half equal; the latest such token
counts). Labels of the fixed rules teach the weights of token features, of the chain and
of the skip edges; loopy message passing, repeated until the messages settle, then gives
every token a label that agrees with its like. Tokens found so that no rule reports
are added with the kind ``crf_`` and the label's name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_batches, text_of

LABELS = ("none", "email", "ip", "card", "phone")
#: Kinds in the order in which spans are listed.
KINDS = (*LABELS[1:], *(f"crf_{k}" for k in LABELS[1:]))
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a start inside a run of digits changes nothing
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_MARKED = re.compile("[0-9@]")
#: Documents with a token of interest that teach, about (by a hash of the id).
SAMPLE = 1500
DIMS = 1 << 12
#: A message that moves by less (in natural logarithms) has settled.
SETTLED = 1e-6
SURE = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        after = m.end() if m else at + 1
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed rules, leftmost and not overlapping for each kind."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return sorted(out)


@dataclass
class Graph:
    """Tokens of a document: places, words, feature indices, and the two kinds of edges."""

    places: list[tuple[int, int]]
    words: list[str]
    features: list[np.ndarray]
    chain: np.ndarray
    skip: np.ndarray


def _hash(name: str) -> int:
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % DIMS


def _core(word: str) -> str:
    return re.sub(r"[^0-9a-z@]", "", word.lower())


def shape(word: str) -> str:
    """Runs of digits with their lengths up to four, runs of letters as one, other signs as they are."""
    out = re.sub(r"[^\W\d_]+", "a", word)
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 4)}", out)


def _one_apart(a: str, b: str) -> bool:
    """Whether two strings of one length differ in exactly one character."""
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), None)
    return at is not None and a[at + 1:] == b[at + 1:]


def graph(text: str) -> Graph:
    """The graph of a text. Skip edges link a token with the latest one like it: at most three for each token."""
    places, words, features, chain, skip, last, halves = [], [], [], [], [], {}, {}
    for m in _WORD.finditer(text) if _MARKED.search(text) else ():
        k, word = len(places), m.group()
        if not _MARKED.search(word):
            continue
        before = text[max(0, m.start() - 24):m.start()].rstrip().rpartition(" ")[2].lower()
        digits = sum(c.isdigit() for c in word)
        names = ["bias", f"shape={shape(word)}", f"before={before}", f"digits={min(digits, 20)}",
                 f"dots={min(word.count('.'), 4)}", f"at={'@' in word}", f"plus={word[0] == '+'}",
                 f"paren={'(' in word}", f"dash={min(word.count('-'), 3)}", f"letters={any(map(str.isalpha, word))}"]
        features.append(np.array(sorted({_hash(n) for n in names})))
        if places and m.start() - places[-1][1] <= 1:
            chain.append((k - 1, k))
        core = _core(word)
        like = {last[core]} if core in last else set()
        if core:
            last[core] = k
        if len(core) >= 8:
            half = len(core) // 2
            for side in ((len(core), 0, core[:half]), (len(core), 1, core[half:])):
                if side in halves and _one_apart(halves[side][0], core):
                    like.add(halves[side][1])
                halves[side] = (core, k)
        skip.extend((j, k) for j in sorted(like) if (j, k) not in chain[-1:])
        places.append(m.span())
        words.append(word)
    pair = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(places, words, features, pair(chain), pair(skip))


def token_labels(g: Graph, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of the rule span that touches each token (the first such span of it), else none."""
    out = np.zeros(len(g.places), np.int64)
    k = 0
    for i, (a, b) in enumerate(g.places):
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        for kind, s, e in spans[k:k + 8]:
            if s < b and e > a:
                out[i] = kind + 1
                break
    return out


@dataclass
class Field:
    """Weights: token features x labels, and label x label for chain and skip edges."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def potentials(self, g: Graph) -> np.ndarray:
        return np.array([self.node[f].sum(axis=0) for f in g.features]).reshape(len(g.places), len(LABELS))

    def marginals(self, g: Graph, settled: float = SETTLED) -> np.ndarray:
        """Label probabilities of each token by sum-product messages along all edges until they settle.

        Only edges at tokens whose belief moved are looked at again, so a change that
        travels along far repeats costs little. Without loops the result is exact.
        Messages that turn in a loop for more rounds than there are tokens are
        averaged with those before, and given up after four times as many.
        """
        local = self.potentials(g)
        edges = np.concatenate([g.chain, g.skip])
        if not len(edges):
            return _softmax(local)
        kind = np.repeat([0, 1], [len(g.chain), len(g.skip)])
        both, n = np.stack([self.chain, self.skip]), len(local)
        a, b = edges.T
        right = np.zeros((len(edges), len(LABELS)))  # messages a to b
        left = np.zeros_like(right)
        belief, active = local.copy(), np.arange(len(edges))
        for turn in range(4 * n + 32):
            e, w = active, both[kind[active]]
            to_b = _norm(_logsumexp((belief[a[e]] - left[e])[:, :, None] + w, 1))
            to_a = _norm(_logsumexp((belief[b[e]] - right[e])[:, None, :] + w, 2))
            share = 1.0 if turn < n + 8 else 0.5
            by_b, by_a = share * (to_b - right[e]), share * (to_a - left[e])
            np.add.at(belief, b[e], by_b)
            np.add.at(belief, a[e], by_a)
            right[e] += by_b
            left[e] += by_a
            moved = np.zeros(n, bool)
            moved[b[e][np.abs(by_b).max(axis=1) > settled]] = True
            moved[a[e][np.abs(by_a).max(axis=1) > settled]] = True
            active = np.flatnonzero(moved[a] | moved[b])
            if not len(active):
                break
        return _softmax(belief)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _norm(x: np.ndarray) -> np.ndarray:
    return x - _logsumexp(x, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    return np.exp(_norm(x)) if len(x) else x


def learn(graphs: list[tuple[Graph, np.ndarray]], epochs: int = 8, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood by stochastic gradient: each token's label given its neighbours' labels."""
    L = len(LABELS)
    f = Field(np.zeros((DIMS, L)), np.zeros((L, L)), np.zeros((L, L)))
    order = np.random.default_rng(7)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for k in order.permutation(len(graphs)):
            g, y = graphs[k]
            if not len(y):
                continue
            score = f.potentials(g)
            for edges, w in ((g.chain, f.chain), (g.skip, f.skip)):
                if len(edges):
                    np.add.at(score, edges[:, 1], w[y[edges[:, 0]]])
                    np.add.at(score, edges[:, 0], w.T[y[edges[:, 1]]])
            error = -_softmax(score)
            error[np.arange(len(y)), y] += 1
            for i, own in enumerate(g.features):
                f.node[own] += step * error[i]
            for edges, w in ((g.chain, f.chain), (g.skip, f.skip)):
                if len(edges):
                    np.add.at(w, y[edges[:, 0]], step * error[edges[:, 1]] / 2)
                    np.add.at(w.T, y[edges[:, 1]], step * error[edges[:, 0]] / 2)
                    w *= 1 - decay
            f.node *= 1 - decay if k % 64 == 0 else 1
    return f


def field_spans(g: Graph, field: Field, base: list[tuple[int, int, int]], sure: float = SURE) -> list[tuple[int, int, int]]:
    """(kind, start, end) of tokens with a label of probability ``sure`` that no rule span touches; chains of one label join."""
    if not len(g.places):
        return []
    seen = token_labels(g, base)
    p = field.marginals(g)
    label = np.where(p.max(axis=1) >= sure, p.argmax(axis=1), 0)
    linked = {int(b) for _, b in g.chain}
    out: list[tuple[int, int, int]] = []
    for k, (a, b) in enumerate(g.places):
        if not label[k] or seen[k]:
            continue
        kind = len(LABELS) - 1 + int(label[k]) - 1
        if k in linked and out and out[-1][0] == kind and out[-1][2] == g.places[k - 1][1]:
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
    return out


def _samples(docs: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """Texts with a digit or an at sign, about ``sample`` of them, by a hash of id and text."""
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(3), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < (sample / n if n else 0))


def learn_field(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """Weights from a bounded sample of documents; the tasks cut out the tokens, so whole texts stay there."""

    def cut(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                g = graph(t)
                y = token_labels(g, base_spans(t))
                flat = np.concatenate(g.features) if g.features else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "features": pa.array([flat], pa.list_(pa.int64())),
                    "cuts": pa.array([[len(x) for x in g.features]], pa.list_(pa.int64())),
                    "chain": pa.array([g.chain.ravel()], pa.list_(pa.int64())),
                    "skip": pa.array([g.skip.ravel()], pa.list_(pa.int64())),
                    "y": pa.array([y], pa.list_(pa.int64()))})

    rows = _samples(docs, key, text, sample).select("text").mapInArrow(
        cut, "features array<long>, cuts array<long>, chain array<long>, skip array<long>, y array<long>").collect()
    graphs = []
    for r in sorted(rows):
        flat, cuts = np.array(r["features"], np.int64), np.cumsum([0, *r["cuts"]])
        own = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        pair = [np.array(r[k], np.int64).reshape(-1, 2) for k in ("chain", "skip")]
        graphs.append((Graph([(0, 0)] * len(own), [], own, *pair), np.array(r["y"], np.int64)))
    return learn(graphs)


def find_personal_data(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text",
                       sure: float = SURE) -> DataFrame:
    """For each document: id and spans (rank, start, end, kind), by kind, then start.

    Places are code points, the end exclusive. The fixed rules' spans are always
    there; those of the field come on top. Null and empty texts have none, an empty
    table gives no rows. Repeated rows and null ids are rows like others; very long
    texts are read whole; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = ("rank", "start", "end", "kind")
    kind = pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True))))

    @F.arrow_udf("array<struct<rank: int, start: long, end: long, kind: string>>")
    def find(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch.to_pylist():
            base = base_spans(t)
            spans = sorted(base + field_spans(graph(t), shared.value, sorted(base, key=lambda s: s[1:]), sure))
            out.append([dict(zip(names, (*s, KINDS[s[0]]), strict=True)) for s in spans])
        return pa.array(out, kind)

    return docs.select(F.col(key).alias("id"), find(text_of(text)).alias("spans"))
