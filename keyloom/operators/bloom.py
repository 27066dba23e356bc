"""Bloom filters with double hashing over one 64-bit hash, as word tables and as bytes."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.hashing import hash64

MAX_BITS = 1 << 31


def sizing(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n keys at false-positive rate p."""
    if n < 1 or not 0 < p < 1:
        raise ValueError("need n >= 1 and 0 < p < 1")
    m = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, int(math.floor(m / n * math.log(2) + 0.5)))


def sizing_columns(n: Column, p: Column) -> tuple[Column, Column]:
    m = F.ceil(-n * F.ln(p) / F.pow(F.ln(F.lit(2.0)), 2))
    return m, F.greatest(F.lit(1), F.floor(m / n * F.ln(F.lit(2.0)) + 0.5))


def positions(keys: list[str], m: int, k: int) -> np.ndarray:
    """Bit numbers (k x n): the hash's high half plus multiples of its low half, both signed; a step of 0 becomes 1."""
    h = hash64(keys)
    h1, h2 = h >> 32, h.astype(np.int32).astype(np.int64)
    h2 = np.where(h2 == 0, 1, h2)
    return np.stack([((h1 + i * h2) & 0x7FFFFFFFFFFFFFFF) % m for i in range(k)])


def build(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """(word, bits): the filter's 64-bit words that aren't 0. Splits set their own words, which then are or-ed by number."""
    if m > MAX_BITS:
        raise ValueError("filter too large")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(-(-m // 64), np.uint64)
        for b in batches:
            at = positions([x for x in b.column(0).to_pylist() if x is not None], m, k).ravel()
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used].view(np.int64))], names=["word", "bits"])

    return keys.select(F.col(key).cast("string")).mapInArrow(split, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))


def probe(rows: DataFrame, key: str, bloom: DataFrame, m: int, k: int) -> DataFrame:
    """``rows`` with ``might_contain``. The filter, bounded by ``m``, goes to every task; a null key is in none."""
    words = np.zeros(-(-m // 64), np.int64)
    got = bloom.toPandas()
    words[got["word"].to_numpy(int)] = got["bits"].to_numpy(np.int64)
    held = rows.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    @F.pandas_udf(T.BooleanType())
    def test(s: pd.Series) -> pd.Series:
        at = positions(s.fillna("").tolist(), m, k)
        hit = ((held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
        return pd.Series(hit & s.notna().to_numpy())

    return rows.withColumn("might_contain", test(F.col(key)))


def serialize(words: np.ndarray, m: int, k: int) -> bytes:
    """Bits, hashes, number of words, words; all big-endian."""
    return struct.pack(">iii", m, k, len(words)) + words.astype(">u8").tobytes()


def deserialize(data: bytes) -> tuple[np.ndarray, int, int]:
    m, k, n = struct.unpack_from(">iii", data)
    return np.frombuffer(data, ">u8", n, 12).astype(np.uint64), m, k


def serialized(words: DataFrame, m: int, k: int) -> DataFrame:
    """(data): a filter's word table as one binary value; its size is bounded by ``m``, itself at most ``MAX_BITS``."""

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(-(-m // 64), np.uint64)
        for b in parts:
            out[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([serialize(out, m, k)], pa.binary())], names=["data"])

    return words.select("word", "bits").repartition(1).mapInArrow(join, "data binary")


def parsed(data: Column | str) -> Column:
    """Bits, hashes, words and bits set of a serialized filter."""

    @F.pandas_udf("bits bigint, hashes int, words bigint, bits_set bigint")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for words, m, k in (deserialize(bytes(x)) for x in s):
            out.append((m, k, len(words), int(np.unpackbits(words.view(np.uint8)).sum())))
        return pd.DataFrame(out, columns=["bits", "hashes", "words", "bits_set"]).astype({"hashes": "int32"})

    return run(data)
