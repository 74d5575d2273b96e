"""Language identification by unigram pieces, summed over all segmentations.

Every language has probabilities of the pieces of a public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, by a forward pass; a
text's is the product over its words. The probabilities come from expectation
maximisation over the words of a bounded sample of each language.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_batches, held, held_out
from trialloom.llm.lattice import Lattice, by_length
from trialloom.llm.pieces import MARK, model_path

#: Words of more characters are summed in logarithms, as their probabilities leave the range of doubles.
PLAIN = 24
#: Labelled documents of a language that teach, about (by a hash of the id).
SAMPLE = 400
ROUNDS = 3
#: Words in a worker's table before it begins another and keeps this one to look up; bounds memory only.
WORDS = 150_000
#: Characters whose matches are held at once in a long word; bounds memory only.
STRETCH = 4096
_FLOOR = 1e-9


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of the model in lower case, each once, in the order of the model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or model_path())
    plain = (i for i in range(model.get_piece_size())
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return list(dict.fromkeys(model.id_to_piece(i).lower() for i in plain))


def forward(lattice: Lattice, codes: np.ndarray, probs: np.ndarray, found=None) -> np.ndarray:
    """alpha[k, word, language]: summed probability of all segmentations of the first k characters."""
    n = codes.shape[1]
    found = lattice.matches(codes) if found is None else found
    alpha = np.zeros((n + 1, len(codes), probs.shape[1]))
    alpha[0] = 1
    for end in range(1, n + 1):
        alpha[end] = alpha[end - 1] * _FLOOR  # a character without a piece
        for size in range(1, min(lattice.longest, end) + 1):
            if (hit := found.get((end - size, size))) is not None:
                alpha[end][hit[0]] += alpha[end - size][hit[0]] * probs[hit[1]]
    return alpha


def log_forward(lattice: Lattice, codes: np.ndarray, log_probs: np.ndarray) -> np.ndarray:
    """Logarithm of ``forward``'s last row, for words of any length: only as many steps are held as a piece is long."""
    n, reach = codes.shape[1], lattice.longest
    held = np.zeros((reach + 1, len(codes), log_probs.shape[1]))  # step k lies at k % (reach + 1)
    for low in range(0, n, STRETCH):
        found = lattice.matches(codes, max(low - reach, 0), min(low + STRETCH, n))
        for end in range(low + 1, min(low + STRETCH, n) + 1):
            now = held[(end - 1) % (reach + 1)] + np.log(_FLOOR)
            for size in range(1, min(reach, end) + 1):
                if (hit := found.get((end - size, size))) is not None:
                    at, ids = hit
                    now[at] = np.logaddexp(now[at], held[(end - size) % (reach + 1)][at] + log_probs[ids])
            held[end % (reach + 1)] = now
    return held[n % (reach + 1)]


def word_scores(lattice: Lattice, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Log-probability of each word for each language, over all segmentations of the whole word."""
    out = np.zeros((len(words), probs.shape[1]))
    log_probs = np.log(probs) if any(len(w) > PLAIN for w in words) else None
    for rows, codes in by_length(words):
        out[rows] = (np.log(forward(lattice, codes, probs)[-1]) if codes.shape[1] <= PLAIN
                     else log_forward(lattice, codes, log_probs))
    return out


def _long_uses(found, words: int, n: int, longest: int, log_probs: np.ndarray):
    """(word, piece, expected uses) of every match, summed in logarithms."""
    alpha, beta = np.zeros((n + 1, words)), np.zeros((n + 1, words))
    for end in range(1, n + 1):
        alpha[end] = alpha[end - 1] + np.log(_FLOOR)
        for size in range(1, min(longest, end) + 1):
            if (hit := found.get((end - size, size))) is not None:
                at, ids = hit
                alpha[end][at] = np.logaddexp(alpha[end][at], alpha[end - size][at] + log_probs[ids])
    for start in range(n - 1, -1, -1):
        beta[start] = beta[start + 1] + np.log(_FLOOR)
        for size in range(1, min(longest, n - start) + 1):
            if (hit := found.get((start, size))) is not None:
                at, ids = hit
                beta[start][at] = np.logaddexp(beta[start][at], beta[start + size][at] + log_probs[ids])
    for (start, size), (at, ids) in found.items():
        yield at, ids, np.exp(alpha[start][at] + log_probs[ids] + beta[start + size][at] - alpha[n][at])


def expected_counts(lattice: Lattice, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (rows) for one language with piece probabilities ``probs`` (n, 1)."""
    total = np.zeros(len(probs))
    weight = np.array(counts, float)
    for rows, codes in by_length(words):
        found = lattice.matches(codes)
        n = codes.shape[1]
        if n > PLAIN:
            for at, ids, use in _long_uses(found, len(codes), n, lattice.longest, np.log(probs[:, 0])):
                np.add.at(total, ids, use * weight[rows[at]])
            continue
        alpha = forward(lattice, codes, probs, found)[:, :, 0]
        beta = np.zeros((n + 1, len(codes)))
        beta[n] = 1
        for start in range(n - 1, -1, -1):
            beta[start] = beta[start + 1] * _FLOOR
            for size in range(1, min(lattice.longest, n - start) + 1):
                if (hit := found.get((start, size))) is not None:
                    beta[start][hit[0]] += beta[start + size][hit[0]] * probs[hit[1], 0]
        for (start, size), (at, ids) in found.items():
            use = alpha[start][at] * probs[ids, 0] * beta[start + size][at] / np.maximum(alpha[n][at], 1e-300)
            np.add.at(total, ids, use * weight[rows[at]])
    return total


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    probs: np.ndarray  # piece x language


_MARKS = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M")
_LETTERS = re.compile(r"[^\W\d_]+")


def _marked(marks) -> re.Pattern:
    return re.compile(f"(?:[^\\W\\d_]|[{''.join(sorted(marks))}])+")


# a class that reaches beyond the basic plane is searched mark by mark, one inside it is looked up
_NEAR, _FAR = _marked(c for c in _MARKS if c <= "\uffff"), _marked(_MARKS)


def split(text: str) -> list[str]:
    """Runs of letters and combining marks in lower case; signs and digits say nothing about the language."""
    low = text.lower()
    marks = () if low.isascii() else _MARKS.intersection(low)
    return (_LETTERS if not marks else _NEAR if max(marks) <= "\uffff" else _FAR).findall(low)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
        rounds: int = ROUNDS, path: str | None = None) -> LanguageModel:
    """Learn from about ``sample`` documents of each language outside the held-out fold, chosen by a hash of the id.

    Words and their counts, and in every round the expected counts, are summed by
    Spark; the driver gets pieces x languages numbers.
    """
    spark = docs.sparkSession
    pieces = vocabulary(path)
    known = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    share = known.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    shares = {r["lang"]: r["share"] for r in share.collect()}  # one row for each language
    languages = tuple(sorted(shares))
    if not languages:
        return LanguageModel((), tuple(pieces), np.zeros((len(pieces), 0)))
    chance = F.coalesce(*[F.when(F.col("lang") == name, F.lit(shares[name])) for name in languages])
    draw = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) / float(1 << 30)
    counts = known.where(draw < chance).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")).persist()
    lattice = Lattice(pieces)
    shared = spark.sparkContext.broadcast(lattice)
    lengths = np.array([len(p) for p in pieces], float)
    start = np.power(0.02, lengths)
    probs = np.repeat((start / start.sum())[:, None], len(languages), axis=1)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(probs)

        def expect(batches, now=now):
            total: dict[str, np.ndarray] = {}
            held: dict[str, list] = {}

            def flush(name):
                at, own = languages.index(name), held.pop(name)
                use = expected_counts(shared.value, [MARK + w for w, _ in own], np.array([n for _, n in own]),
                                      now.value[:, at:at + 1])
                total[name] = total.get(name, 0) + use

            for batch in batches:
                for name, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.setdefault(name, []).append((word, n))
                for name in [k for k, own in held.items() if len(own) > 50_000]:
                    flush(name)
            for name in list(held):
                flush(name)
            for name, use in total.items():
                at = np.flatnonzero(use > 0)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at)), "piece": pa.array(at),
                                                  "n": pa.array(use[at])})

        sums = counts.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(
            F.sum("n").alias("n")).collect()
        fresh = np.full(probs.shape, 0.1)
        for r in sums:
            fresh[r["piece"], languages.index(r["lang"])] += r["n"]
        probs = fresh / fresh.sum(axis=0)
    counts.unpersist()
    return LanguageModel(languages, tuple(pieces), probs)


class Scorer:
    """Language log-probabilities of texts; words met before are looked up."""

    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(list(model.pieces))
        self._reset()

    def _reset(self) -> None:
        """Begin another table and keep this one to look up."""
        self.older = getattr(self, "at", {}), getattr(self, "table", None)
        self.at: dict[str, int] = {}
        self.table = np.zeros((2 * WORDS, len(self.model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Prediction and its share of the posterior; ``und`` and 0 for null or without a letter."""
        split_ = [split(t) if t and self.model.languages else [] for t in texts]
        names, scores = [], []
        for at in range(0, len(split_), 500):
            part = split_[at:at + 500]
            for own, total in zip(part, self.totals(part), strict=True):
                if not any(c.isalpha() for w in own for c in w):
                    names.append("und")
                    scores.append(0.0)
                    continue
                k = int(total.argmax())
                names.append(self.model.languages[k])
                scores.append(float(1 / np.exp(total - total[k]).sum()))
        return names, scores

    def totals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Summed log-probabilities of the words of each text."""
        out = [np.zeros(len(self.model.languages)) for _ in texts]
        step, at = WORDS // 2, 0
        while at < len(texts):  # as many texts at once as the table can hold, long ones in parts
            to, n = at, 0
            while to < len(texts) and (n == 0 or n + len(texts[to]) <= step):
                n, to = n + len(texts[to]), to + 1
            for low in range(0, max(map(len, texts[at:to])), step):
                part = [t[low:low + step] for t in texts[at:to]]
                self._learn(set().union(*part))
                for k, own in enumerate(part):
                    if own:
                        out[at + k] += self.table[[self.at[w] for w in own]].sum(axis=0)
            at = to
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self.at) > WORDS:
            self._reset()
        new = words - self.at.keys()
        before, rows = self.older
        old = list(new & before.keys())
        fresh = list(new - before.keys())
        first = len(self.at)
        if old:
            self.table[first:first + len(old)] = rows[[before[w] for w in old]]
        if fresh:
            self.table[first + len(old):first + len(new)] = word_scores(self.lattice, [MARK + w for w in fresh],
                                                                        self.model.probs)
        self.at.update(zip(old + fresh, range(first, first + len(new)), strict=True))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct (lang, score) for each whole text.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if the model knows no language. Of equal scores the first
    language by name wins.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(batch: pa.Array) -> pa.Array:
        names, scores = _scorer(shared)(batch.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                          fields=list(kind))

    return docs.withColumn(out, predict(F.col(text).cast("string")))


def _scorer(shared) -> Scorer:
    model = shared.value
    return held("language", id(model), lambda: Scorer(model))
