"""Counter-based random columns: a value depends on its key columns only.

The generator is the published Philox-4x32-10 (Salmon et al., 2011). Products of
32-bit words are formed from 16-bit limbs because bigint overflow is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.estimates import col

# Fixed values of the generator.
MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
KEY_STEPS = (0x9E3779B9, 0xBB67AE85)
ROUNDS = 10
WORD = 0xFFFFFFFF
# Fixed values of the study seed and key spaces.
SEED_TEXT = "SAL_STABILITY_MASTER_SEED_V1"
NAMESPACES = {"PILOT": 1, "FORMAL": 2, "BOOTSTRAP": 3}
FAMILIES = {
    "INITIAL_SYNC": 1, "G_TOA_ERROR": 2, "G_WIDTH_ERROR": 3, "H_PHASE": 4, "H_TRUE_WIDTH_LEVEL": 5,
    "H_TOA_ERROR": 6, "H_WIDTH_ERROR": 7, "F_TOA_ERROR": 8, "F_WIDTH_ERROR": 9,
    "TIE_G": 10, "TIE_H": 11, "TIE_F": 12, "BOOTSTRAP_INDEX": 13,
}


def keyed_seed(namespace: str | int, family: str | int, seed: str = SEED_TEXT) -> tuple[int, int]:
    """Two key words for a namespace and a variable family."""
    ns = NAMESPACES[namespace] if isinstance(namespace, str) else namespace
    fam = FAMILIES[family] if isinstance(family, str) else family
    root = hashlib.sha256(seed.encode("ascii")).digest()
    digest = hashlib.sha256(b"".join([root, ns.to_bytes(4, "little"), fam.to_bytes(4, "little")])).digest()
    first, second = digest[:4], digest[4:8]
    return int.from_bytes(first, "little"), int.from_bytes(second, "little")


def keyed_seed_columns(namespace: Column | str, family: Column | str, seed: str = SEED_TEXT) -> tuple[Column, Column]:
    """``keyed_seed`` for columns of namespace and family numbers."""
    def little(n: Column) -> Column:
        return F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)])

    text = F.concat(F.lit(hashlib.sha256(seed.encode("ascii")).hexdigest()), little(col(namespace)), little(col(family)))
    digest = F.sha2(F.unhex(text), 256)

    def word(at: int) -> Column:
        return F.conv(F.concat(*[F.substring(digest, at + 2 * i, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("bigint")

    return word(1), word(9)


def split64(n: Column | str) -> tuple[Column, Column]:
    """Low and high 32-bit words of a bigint in two's complement."""
    c = col(n).cast("bigint")
    return c.bitwiseAND(F.lit(WORD)), F.shiftrightunsigned(c, 32)


def _product(word: Column, constant: int) -> tuple[Column, Column]:
    upper = word * F.lit(constant >> 16)
    lower = word * F.lit(constant & 0xFFFF)
    low = (F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + lower).bitwiseAND(F.lit(WORD))
    high = F.shiftright(upper + F.shiftright(lower, 16), 16)
    return low, high


def with_words(df: DataFrame, counter: Sequence[Column | str], key: tuple[int, int],
               names: Sequence[str] = ("w0", "w1", "w2", "w3")) -> DataFrame:
    """Append the random words of a four-word counter; one projection per round."""
    keep = [f"`{c}`" for c in df.columns]
    tmp = ["__p0", "__p1", "__p2", "__p3"]
    out = df.select(*keep, *[col(c).cast("bigint").alias(t) for c, t in zip(counter, tmp)])
    k = list(key)
    for r in range(ROUNDS):
        if r:
            k = [(a + b) & WORD for a, b in zip(k, KEY_STEPS)]
        low0, high0 = _product(F.col(tmp[0]), MULTIPLIERS[0])
        low1, high1 = _product(F.col(tmp[2]), MULTIPLIERS[1])
        mixed = (high1.bitwiseXOR(F.col(tmp[1])).bitwiseXOR(F.lit(k[0])), low1,
                 high0.bitwiseXOR(F.col(tmp[3])).bitwiseXOR(F.lit(k[1])), low0)
        out = out.select(*keep, *[m.alias(t) for m, t in zip(mixed, tmp)])
    # A one-row generator: filters and join keys on a word stay above the rounds
    # instead of being copied, expanded, below them.
    row = F.struct(*[F.col(t).alias(n) for t, n in zip(tmp, names)])
    return out.select(*keep, F.inline(F.array(row)))


def address(condition, repeat, event) -> list[Column]:
    """Counter words of an addressed event: condition, repeat, event low, event high."""
    low, high = split64(event)
    return [col(condition), col(repeat), low, high]


def uniform(word: Column | str) -> Column:
    return (col(word).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def normal(word0: Column | str, word1: Column | str) -> Column:
    return F.sqrt(F.lit(-2.0) * F.log(uniform(word0))) * F.cos(F.lit(2.0) * F.pi() * uniform(word1))


def _wide(high: Column | str, low: Column | str) -> Column:
    return (col(high).cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)")
            + col(low).cast("decimal(20,0)")).cast("decimal(20,0)")


def tie_rank(w0="w0", w1="w1", w2="w2", w3="w3") -> tuple[Column, Column]:
    """128-bit rank as two decimals, to be compared high part first."""
    return _wide(w0, w1), _wide(w2, w3)


def word_to_unit(word: Column | str, units: Column | int) -> Column:
    """Unit id 1..R of an accepted word; null when the word must be redrawn."""
    r = units if isinstance(units, Column) else F.lit(units)
    r = r.cast("bigint")
    w = col(word)
    span = F.lit(4294967296)
    limit = span - span % r
    return F.when(w < limit, w % r + 1)
