"""64-bit hashes with wrap-around arithmetic, vectorised over numpy, and a linear congruential generator."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a's offset basis and prime, the 64-bit finalizer's multipliers, and the 48-bit generator's constants.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
MIX_A = 0xFF51AFD7ED558CCD
MIX_B = 0xC4CEB9FE1A85EC53
LCG_MULTIPLIER = 0x5DEECE66D
LCG_ADDEND = 0xB


def mix64(h: np.ndarray) -> np.ndarray:
    """The avalanche finalizer on uint64."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(MIX_A)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(MIX_B)
        return h ^ (h >> np.uint64(33))


def fnv1a(values: list[bytes]) -> np.ndarray:
    """FNV-1a of each byte string as uint64: all strings advance together, a byte position at a time."""
    n = len(values)
    lengths = np.fromiter(map(len, values), np.int64, n)
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    starts = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = lengths[order]
    h = np.full(n, FNV_BASIS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-sorted_lengths, -i, "left"))
            h[:m] = (h[:m] ^ flat[starts[:m] + i]) * np.uint64(FNV_PRIME)
    out = np.empty(n, np.uint64)
    out[order] = h
    return out


def hash64(texts: list[str]) -> np.ndarray:
    """Finalized FNV-1a over UTF-8, as signed 64-bit numbers."""
    return mix64(fnv1a([t.encode() for t in texts])).view(np.int64)


def hash64_column(text: Column) -> Column:
    """:func:`hash64` of a text column; null stays null."""

    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        missing = s.isna()
        out = pd.Series(hash64(s.fillna("").tolist()), dtype="Int64")
        out[missing.to_numpy()] = pd.NA
        return out

    return run(text)


def fingerprint_column(encoded: Column) -> Column:
    """FNV-1a without a finalizer of a binary column."""

    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(fnv1a([bytes(x or b"") for x in s]).view(np.int64))

    return run(encoded)


def text_hash32(text: str) -> int:
    """The 31-polynomial hash over UTF-16 code units, as a signed 32-bit number."""
    h = 0
    raw = text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (31 * h + (raw[i] << 8 | raw[i + 1])) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


class Lcg48:
    """A 48-bit linear congruential generator with the usual scrambled seed; draws ints below a bound and doubles in [0, 1)."""

    def __init__(self, seed: int) -> None:
        self.state = (seed ^ LCG_MULTIPLIER) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * LCG_MULTIPLIER + LCG_ADDEND) & ((1 << 48) - 1)
        v = self.state >> (48 - n)
        return v - (1 << n) if v >> (n - 1) and n == 32 else v

    def below(self, bound: int) -> int:
        r = self.bits(31)
        if bound & (bound - 1) == 0:
            return (bound * r) >> 31
        while True:
            v = r % bound
            if r - v + (bound - 1) < 1 << 31:
                return v
            r = self.bits(31)

    def unit(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0**-53


def zipf_index(u: float, items: int, theta: float, zeta_n: float) -> int:
    """Index for a uniform draw by Gray et al.'s inversion; 0 is the hottest."""
    uz = u * zeta_n
    if uz < 1.0:
        return 0
    if uz < 1.0 + math.pow(0.5, theta):
        return 1
    eta = (1.0 - math.pow(2.0 / items, 1.0 - theta)) / (1.0 - (1.0 + math.pow(0.5, theta)) / zeta_n)
    return min(items - 1, int(items * math.pow(eta * u - eta + 1.0, 1.0 / (1.0 - theta))))
