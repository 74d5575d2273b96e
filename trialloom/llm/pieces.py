"""SentencePiece BPE encoding by a table of prefixes, and decoding.

The encoding of a text ends, for each of its prefixes, in one token only. Going
through the text, an automaton gives the pieces that end at a place; the one
whose start's own last token is compatible with it - the two, encoded together,
stay these two - is stored. The ids are then read backwards from the end. The work
is linear in the text.

No piece of the vocabulary has a word mark after another character, so a text
falls apart into words (marks and what follows them), and words already seen are
looked up.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from trialloom.llm.common import batches_of, bounded_batches, held, text_of
from trialloom.llm.lattice import Lattice, by_length

MARK = "▁"
#: Words in a worker's table before it begins another and keeps this one to look up; bounds memory only.
WORDS = 100_000


class Contents:
    """The bytes that each id of a model stands for: all that decoding needs."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        content = [b""] * model.get_piece_size()
        for i in range(len(content)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                content[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                content[i] = piece.replace(MARK, " ").encode()
        content[model.unk_id()] = " ⁇ ".encode()
        self.sizes = np.array([len(c) for c in content])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(content), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; control ids give nothing, the space put before the first piece goes."""
        size = self.sizes[ids]
        end = np.cumsum(size)
        at = np.repeat(self.starts[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)
        text = self.blob[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Pieces:
    """Vocabulary, merge ranks and the automaton of one BPE model without normalisation."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.unknown, self.begin, self.end = model.unk_id(), model.bos_id(), model.eos_id()
        self.ids, self.score, self.bytes_of = {}, {}, {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
        if any(a != MARK and b == MARK for p in self.ids for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("the model has pieces across words")
        self.piece = {i: p for p, i in self.ids.items()}
        self.length = [len(self.piece.get(i, "")) for i in range(self.size)]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.word = re.compile(self._cuts())
        self.lattice = Lattice(list(self.ids))
        self.own = np.array(list(self.ids.values()))  # id of each piece of the lattice
        self.width = np.array(self.length)
        self.pairs: dict[int, bool] = {}
        self.met = np.full(1 << 20, -2, np.int64)  # pairs met lately, by a hash, and whether they are compatible
        self.fits = np.zeros(1 << 20, bool)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cuts(self) -> str:
        """Pattern of words: runs that end where no piece has the two characters that meet there.

        A word begins with a mark; letters end before a sign that follows no letter in
        any piece; a line end that no piece has stands alone.
        """
        inside = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        line = "" if any("\n" in p for p in self.ids) else "\n"
        letters = [chr(c) for c in range(65, 383) if chr(c).isalpha()]
        signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
        signs = [c for c in signs if not any((a, c) in inside for a in letters)]
        signs = "".join(map(re.escape, signs)) + MARK + line
        return (f"{MARK}*[{''.join(letters)}]+(?=[{signs}]|\\Z)|{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+"
                + ("|\n" if line else ""))

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best pair of neighbours is merged, of equals the first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        return self.piece[token] if token < self.size else chr(token - self.size)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when encoded together; ``left`` -1: nothing is before ``right``."""
        b = self._text(right)
        parts = [b] if left < 0 else [self._text(left), b]
        return self.merge("".join(parts)) == parts

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a run of characters that no piece crosses.

        ``last[k]`` is the last token of the first k characters; a character that
        is no piece is a token of its own, numbered after the pieces.
        """
        n, size, length, pairs = len(word), self.size, self.length, self.pairs
        last = [-1] * (n + 1)
        if len(pairs) > 250_000:
            pairs.clear()
        for at, right in self.automaton.iter(word):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - length[right]
            left = last[start]
            if left < 0 and start:
                left = last[start] = size + ord(word[start - 1])
            pair = left << 32 | right
            known = pairs.get(pair)
            if known is None:
                known = pairs[pair] = self.compatible(left, right)
            if known:
                last[end] = right
        out: list[int] = []
        at = n
        while at:
            token = last[at]
            if 0 <= token < size:
                out.append(token)
                at -= length[token]
                continue
            at -= 1
            if self.bytes_of:
                out.extend(self.bytes_of[b] for b in reversed(word[at].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
        return tuple(reversed(out))

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` for arrays of tokens."""
        pair = left << 32 | right
        slot = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self.met[slot] != pair)
        if len(new):
            if len(self.pairs) > 250_000:
                self.pairs.clear()
            for p in np.unique(pair[new]).tolist():
                if p not in self.pairs:
                    self.pairs[p] = self.compatible(p >> 32, p & 0xFFFFFFFF)
            known = np.array([self.pairs[p] for p in pair[new].tolist()])
            out = self.fits[slot]
            out[new] = known
            _, own = np.unique(slot[new], return_index=True)  # two pairs may want one place
            self.met[slot[new[own]]], self.fits[slot[new[own]]] = pair[new[own]], known[own]
            return out
        return self.fits[slot]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """``encode_word`` for many words, a column of the tables at a time; long or unusual words one by one."""
        out: list[bytes | None] = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= 32]
        for rows, codes in by_length([words[k] for k in short]):
            n, size = codes.shape[1], self.size
            found = self.lattice.matches(codes)
            last = np.full((n + 1, len(codes)), -1, np.int64)
            for end in range(1, n + 1):
                for length in range(min(self.lattice.longest, end), 0, -1):
                    if (hit := found.get((end - length, length))) is None:
                        continue
                    open_ = last[end][hit[0]] < 0
                    at, right = hit[0][open_], self.own[hit[1][open_]]
                    if len(at):
                        ok = self._fit(last[end - length][at], right)
                        last[end][at[ok]] = right[ok]
                rest = last[end] < 0
                last[end][rest] = size + codes[rest, end - 1].astype(np.int64)
            tokens = np.zeros((len(codes), n), "<u4")
            place, word = np.full(len(codes), n), np.arange(len(codes))
            odd = np.zeros(len(codes), bool)
            used = np.zeros((len(codes), n), bool)
            column = n
            while len(word):
                token = last[place[word], word]
                odd[word] |= token >= size
                word, token = word[token < size], token[token < size]
                column -= 1
                tokens[word, column], used[word, column] = token, True
                place[word] -= self.width[token]
                word = word[place[word] > 0]
            ends = np.cumsum(used.sum(axis=1)) * 4
            data = tokens[used].tobytes()
            for k, a, b, strange in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), odd.tolist(), strict=True):
                if not strange:
                    out[short[k]] = data[a:b]
        return [np.array(self.encode_word(w), "<u4").tobytes() if o is None else o for w, o in zip(words, out, strict=True)]

    def split(self, text: str) -> list[list[str]]:
        """Words of a text, in parts of about a million characters."""
        text, parts, at = MARK + text.replace(" ", MARK), [], 0
        while at < len(text):
            cut = re.compile(f"[^{MARK}]{MARK}").search(text, at + 1_000_000)
            to = cut.start() + 1 if cut else len(text)
            parts.append(self.word.findall(text, at, to))
            at = to
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with begin and end ids, as the library gives them, as little-endian 32-bit integers."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        cut = [self.split(t) if t else [] for t in texts]
        known, older = self.words, self.older
        new: set[str] = set()
        for parts in cut:
            new.update(*parts)
        new -= known.keys()
        for w in new & older.keys():
            known[w] = older[w]
        fresh = list(new - older.keys())
        known.update(zip(fresh, self.encode_words(fresh), strict=True))
        out = [begin + b"".join([known[w] for words in parts for w in words]) + end for parts in cut]
        if len(known) > WORDS:
            self.words, self.older = {}, {w: ids for w, ids in known.items() if len(w) <= 64}
        return out


def load(path: str) -> Pieces:
    """The model of this worker process."""
    return held("pieces", path, lambda: Pieces(path))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as little-endian unsigned 32-bit integers, begin and end id included.

    A null text counts as empty; a column that already has the name is replaced.
    """
    bounded_batches(docs.sparkSession)
    path = model or model_path()

    @F.arrow_udf("binary")
    def encode(batch: pa.Array) -> pa.Array:
        pieces = load(path)
        return pa.array([ids for part in batches_of(batch) for ids in pieces.encode(part.to_pylist())], pa.binary())

    # not merged into what reads the ids: it would run once for each reader
    return docs.withColumn(out, encode.asNondeterministic()(text_of(text)))


def decode_documents(docs: DataFrame, model: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of binary ids; null ids count as none."""
    bounded_batches(docs.sparkSession)
    path = model or model_path()

    @F.arrow_udf("string")
    def decode(batch: pa.Array) -> pa.Array:
        contents = held("contents", path, lambda: Contents(path))
        return pa.array([contents.decode(np.frombuffer(b or b"", "<u4")) for b in batch.to_pylist()], pa.string())

    return docs.withColumn(out, decode(F.col(ids)))


def round_trip_documents(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids",
                         decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each whole text, and with the text that these ids give.

    The same as ``decode_documents(encode_documents(docs))``, in one worker for each
    task: two of them would keep their tables and batches side by side.
    """
    bounded_batches(docs.sparkSession)
    path = model or model_path()

    @F.arrow_udf("struct<ids: binary, decoded: string>")
    def there_and_back(batch: pa.Array) -> pa.Array:
        pieces, contents = held("round trip", path, lambda: (Pieces(path), Contents(path)))
        own, back = [], []
        for part in batches_of(batch):
            new = pieces.encode(part.to_pylist())
            own.append(pa.array(new, pa.binary()))
            back.append(pa.array([contents.decode(np.frombuffer(b, "<u4")) for b in new], pa.string()))
        if not own:
            own, back = [pa.array([], pa.binary())], [pa.array([], pa.string())]
        return pa.StructArray.from_arrays([pa.concat_arrays(own), pa.concat_arrays(back)], ["ids", "decoded"])

    both = docs.withColumn("_both", there_and_back.asNondeterministic()(text_of(text)))
    return both.withColumns({ids: F.col("_both.ids"), decoded: F.col("_both.decoded")}).drop("_both")
