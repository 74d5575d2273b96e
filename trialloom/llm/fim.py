"""Fill-in-the-middle: the lines of a text dealt to prefix, middle and suffix by Arrow's list kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_batches, text_of

#: What stands before each piece; a text that holds one of them stays as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Shares in percent: texts that are rearranged, and of these the suffix-first form.
RATE, SUFFIX_FIRST = 100, 50
#: Text bytes that one pass of the kernels handles (at least one text).
LOT = 4 << 20


def draws(key: str, seed: int = SEED) -> list[Column]:
    """The first four 8-digit groups of sha256('seed:id') as integers; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _pieces(units: pa.Array, parent: np.ndarray, chosen: np.ndarray, n: int) -> pa.Array:
    """The chosen units of each text, joined."""
    cuts = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(parent[chosen], minlength=n), out=cuts[1:])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), units.filter(pa.array(chosen))), _text(""))


def rearrange(texts: pa.Array, h: list[np.ndarray], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> pa.StructArray:
    """n, form, prefix_chars, middle_chars and output of each text; ``h`` holds its four draws."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = len(texts)
    parts = pc.split_pattern(texts, "\n")
    units, parent = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    start = parts.offsets.to_numpy().astype(np.int64)
    ordinal = np.arange(len(units)) - start[parent]
    last = ordinal == np.diff(start)[parent] - 1
    # a line keeps its end; what follows the last one is a unit only if it has characters
    real = ~(last & (pc.binary_length(units).to_numpy() == 0))
    units = pc.binary_join_element_wise(units, pc.if_else(pa.array(last), _text(""), _text("\n")), _text(""))
    n = np.bincount(parent[real], minlength=size)
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    role = (ordinal >= np.minimum(a, b)[parent]).astype(np.int8) + (ordinal >= np.maximum(a, b)[parent])
    prefix, middle, suffix = (_pieces(units, parent, real & (role == k), size) for k in range(3))

    held = pc.equal(texts, "")
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = pc.or_(held, pc.match_substring(texts, mark))
    held = pc.or_(held, pa.array(h[2] % 100 >= rate))
    first = pa.array(h[3] % 100 < suffix_first)
    marks = [_text(m) for m in (PREFIX, SUFFIX, MIDDLE, "")]
    output = pc.if_else(held, texts, pc.if_else(
        first, pc.binary_join_element_wise(marks[1], suffix, marks[0], prefix, marks[2], middle, marks[3]),
        pc.binary_join_element_wise(marks[0], prefix, marks[1], suffix, marks[2], middle, marks[3])))
    none = pa.scalar(None, pa.int64())
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pc.if_else(held, "plain", pc.if_else(first, "spm", "psm")),
         pc.if_else(held, none, pc.utf8_length(prefix).cast(pa.int64())),
         pc.if_else(held, none, pc.utf8_length(middle).cast(pa.int64())), output],
        ["n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "fim", seed: int = SEED,
                   rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with a struct ``out``: n, form, prefix_chars, middle_chars and output of each whole text.

    The cuts depend on ``seed`` and the id only. A null or empty text has no units
    and stays plain (empty output). Lines are what ends with a newline, and the
    rest behind the last one; carriage returns are ordinary characters. Repeated
    rows get equal results, a null id draws as the empty text, an empty table stays
    empty, very long texts are handled whole. Other columns pass through; one named
    ``out`` is replaced.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        h = [x.to_numpy(zero_copy_only=False) for x in (h1, h2, h3, h4)]
        ends, at, done = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0, []
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOT, side="right")))
            done.append(rearrange(texts.slice(at, to - at), [x[at:to] for x in h], rate, suffix_first))
            at = to
        kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                          ("middle_chars", pa.int64()), ("output", pa.string())])
        return pa.concat_arrays([x.cast(kind) for x in done]) if done else pa.array([], kind)

    # evaluated once, however many of its fields are read
    return docs.withColumn(out, cut.asNondeterministic()(text_of(text), *draws(key, seed)))


def restore(docs: DataFrame, form: str, output: str, out: str = "restored") -> DataFrame:
    """``docs`` with the text that ``output`` was made of: rearranged texts hold no mark of their own.

    A null form or output gives null; a column named ``out`` is replaced.
    """
    form, output = F.col(form), F.col(output)
    parts = docs.withColumn("_fim_parts", F.when(form != "plain", F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")))
    at = lambda k: F.col("_fim_parts")[k]
    return parts.withColumn(out, F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2)))
                            .when(form == "spm", F.concat(at(2), at(3), at(1)))).drop("_fim_parts")
