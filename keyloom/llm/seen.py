"""Has this key been seen before? Filter then verify, with the filter's errors measured.

1. Every split answers for itself: of the requests of one key that it meets, all but the earliest repeat a key, so they are
   answered at once. What is left, one row per key and window of a split, is kept on disk with its key and its hash.
2. The hashes alone, 16 bytes a row, go to segments by hash. A segment reads them in the order of arrival, archive first,
   past an approximate membership filter of its own: a no is certain and ends there, a maybe goes on. Segments are as
   many as the keys need, so the filters' error rate doesn't depend on how many keys there are, and no filter leaves its task.
3. The maybes are looked up among the full keys on disk: rows whose hash some maybe has meet by hash and key, and a request is
   seen if a row of its very key came before it. Every maybe this disproves is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.session import stage

HASHES = 5
BITS_PER_KEY = 12
#: A segment holds at most so many keys (so a filter of 12 MB), and at least so many if there are enough tasks for all cores.
MOST_KEYS, LEAST_KEYS = 8_000_000, 50_000
#: A split answers for itself within windows of so many different keys, or so many bytes of them.
WINDOW_KEYS, WINDOW_BYTES = 200_000, 64 << 20
#: Rows a filter is asked for, and then told, at once.
STEP = 1024
#: Equal ranges of ids that errors are reported for.
BLOCKS = 20


def _firsts(archive: bool):
    """Per window of a split: rows that repeat an earlier one (no key), and the earliest of each key; the archive's rows have no id."""

    def rows(ids: np.ndarray, keys: list | None, hashes: np.ndarray | None) -> pa.RecordBatch:
        n = len(ids)
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays(
            [none(pa.int64()) if archive else pa.array(ids), none(pa.string()) if keys is None else pa.array(keys, pa.string()), none(pa.int64()) if hashes is None else pa.array(hashes)], names=["id", "key", "h"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        least, h, size = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            d = b.column(1).dictionary_encode()
            words = d.dictionary.to_pylist()
            code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))[d.indices.to_numpy()]
            grow = len(known) - len(least)
            size += b.column(1).nbytes * grow // b.num_rows
            least = np.append(least, np.full(grow, np.iinfo(np.int64).max))
            h = np.append(h, np.zeros(grow, np.int64))
            h[code] = b.column(2).to_numpy()
            was = least.copy()
            np.minimum.at(least, code, ids)
            if not archive:
                # what was the earliest and no longer is repeats a key, as do all later ones; rows of one id don't repeat each other
                beaten = was[(was > least) & (was < np.iinfo(np.int64).max)]
                later = ids[ids > least[code]]
                twice = np.flatnonzero(ids == least[code])
                first = np.unique(code[twice], return_index=True)[1]
                extra = np.ones(len(twice), bool)
                extra[first[was[code[twice[first]]] > ids[twice[first]]]] = False
                yield rows(np.append(beaten, later), None, None)
                if extra.any():
                    at = twice[extra]
                    yield rows(ids[at], b.column(1).take(pa.array(at)).to_pylist(), h[code[at]])
            if len(known) > WINDOW_KEYS or size > WINDOW_BYTES:
                yield rows(least, list(known), h)
                known, least, h, size = {}, np.empty(0, np.int64), np.empty(0, np.int64), 0
        if known:
            yield rows(least, list(known), h)

    return run


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers (HASHES x n) of 64-bit hashes."""
    z = h.view(np.uint64)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        step = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        return np.stack([((z + np.uint64(i) * step) >> np.uint64(1)) % np.uint64(bits) for i in range(HASHES)]).astype(np.int64)


def _asked(bits: int):
    """Answers for a segment's rows (h, id) in order of arrival: (id, h, maybe). The filter is all it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(-(-bits // 8), np.uint8)
        for b in batches:
            maybe = np.zeros(b.num_rows, bool)
            h = b.column(0).to_numpy()
            for lo in range(0, len(h), STEP):
                part = h[lo : lo + STEP]
                at = _bits(part, bits)
                byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
                # within a step equal hashes are compared themselves
                repeats = np.ones(len(part), bool)
                repeats[np.unique(part, return_index=True)[1]] = False
                maybe[lo : lo + STEP] = ((held[byte] & bit) != 0).all(axis=0) | repeats
                np.bitwise_or.at(held, byte.ravel(), bit.ravel())
            asks = b.column(1).is_valid()
            yield pa.RecordBatch.from_arrays([b.column(1).filter(asks), b.column(0).filter(asks), pa.array(maybe).filter(asks)], names=["id", "h", "maybe"])

    return run


@dataclass
class Seen:
    rows: DataFrame  #: ids of requests whose key was seen before
    answers: DataFrame  #: what the filter was asked: id, h, maybe
    verified: DataFrame  #: ids of the maybes that are right
    repeats: DataFrame  #: ids answered within a split, without the filter
    lo: int
    hi: int

    def disproved(self) -> DataFrame:
        """The log of measured errors: each request that the filter took for seen and whose key wasn't."""
        return self.answers.where("maybe").join(self.verified, "id", "left_anti").select("id")

    def errors(self, blocks: int = BLOCKS) -> DataFrame:
        """Per block of ids: requests, those repeated within a split, those asked, the filter's maybes, those disproved, keys that
        were new, and the share of wrong answers among these. Blocks are equal ranges between the first id and the last."""
        block = F.expr(f"cast((id - {self.lo}L) * {blocks}D / {self.hi - self.lo + 1}D as int)")
        one = lambda df, what: df.select(block.alias("block"), F.lit(what).alias("what"))
        all_ = one(self.repeats, "repeated").unionByName(one(self.verified, "verified")).unionByName(self.answers.select(block.alias("block"), F.when(F.col("maybe"), "maybe").otherwise("no").alias("what")))
        n = lambda *w: F.count_if(F.col("what").isin(*w))
        per = all_.groupBy("block").agg(n("repeated", "maybe", "no").alias("requests"), n("repeated").alias("repeated"), n("maybe", "no").alias("asked"), n("maybe").alias("maybes"), n("verified").alias("__v"))
        new = F.col("asked") - F.col("__v")
        return per.withColumn("disproved", F.col("maybes") - F.col("__v")).withColumn("new_keys", new).drop("__v").withColumn(
            "filter_error_rate", F.when(F.col("new_keys") > 0, F.col("disproved") / F.col("new_keys")).otherwise(F.lit(0.0))
        )


def seen_before(requests: DataFrame, archive: DataFrame, key: str = "key", order: str = "request_id", archive_key: str = "key", bits_per_key: float = BITS_PER_KEY, most_keys: int = MOST_KEYS) -> Seen:
    """Requests with a non-null key that the archive or an earlier request holds.

    Keys are exact text; the answer is exact, since only a filter's no is taken without looking. ``order`` is an integer and
    says what is earlier; requests of equal order don't precede each other. Null keys and requests without order are never
    seen and set nothing. A task holds a filter of ``bits_per_key`` x at most ``most_keys`` bits, or the keys of a window,
    however many keys there are. Empty tables on either side give what the other implies. Other columns are ignored,
    whatever their names.
    """
    spark = requests.sparkSession
    asked = requests.select(F.col(order).cast("bigint").alias("id"), F.col(key).alias("key")).where(F.col("key").isNotNull() & F.col("id").isNotNull())
    old = archive.select(F.lit(0).cast("bigint").alias("id"), F.col(archive_key).alias("key")).where(F.col("key").isNotNull())
    hashed = lambda df, kind: df.withColumn("h", F.xxhash64("key")).mapInArrow(_firsts(kind), "id bigint, key string, h bigint")
    kept = stage(hashed(asked, False).unionByName(hashed(old, True)), "seen-keys")
    repeats, firsts = kept.where("key IS NULL").select("id"), kept.where("key IS NOT NULL")
    size = kept.agg(F.count("h").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    lo, hi = (0, 0) if size.lo is None else (size.lo, size.hi)

    segments = max(1, -(-size.n // most_keys), min(-(-size.n // LEAST_KEYS), 2 * spark.sparkContext.defaultParallelism))
    # hashes are even over the segments; a tenth more room keeps the rate where one gets a little more than its share
    bits = max(1024, int(1.1 * bits_per_key * size.n / segments))
    met = firsts.select("h", "id").repartition(segments, "h").sortWithinPartitions("id")
    answers = stage(met.mapInArrow(_asked(bits), "id bigint, h bigint, maybe boolean"), "seen-answers")

    # rows of one hash meet once; the earliest of each key is settled among them, hash partitions hold whole keys
    wanted = firsts.join(answers.where("maybe").select("h"), "h", "left_semi")
    before = F.min(F.coalesce("id", F.lit(-(2**63)))).over(Window.partitionBy("h", "key"))
    # a null id, the archive's, is before any other
    verified = stage(wanted.withColumn("before", before).where(F.col("id") > F.col("before")).select("id"), "seen-verified")
    rows = repeats.unionByName(verified).select(F.col("id").alias(order))
    return Seen(rows, answers, verified, repeats, lo, hi)
