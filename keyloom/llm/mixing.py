"""A training mix of several sources by target shares of tokens.

Tokens are handed out in blocks of equal size by Sainte-Laguë's method: the next block goes to the source of highest
share / (2 blocks + 1). The same method deals a source's blocks to groups of shards by the tokens each has, and a group's to
its shards, which gives whole quotas per shard and source. There are as many groups as shards in a group, so the driver
and each task hold the square root of the number of shards. Within a shard, a source's documents are laid out in an order drawn by a seed and
its first blocks are taken, whole documents only, again from the start once all of them are used.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.session import stage

MAX_SOURCES = 10_000
BLOCK_TOKENS, SHARD_TOKENS = 1024, 8_000_000


def canonical_source(source: Column) -> Column:
    """Spellings that differ in case, blanks or ``-``/``_`` are the same source."""
    return F.regexp_replace(F.lower(source), r"[\s_\-]+", "")


def apportion(weights: list[float], blocks: int, caps: list[int] | None = None) -> list[int]:
    """Sainte-Laguë: ``blocks`` seats by highest quotients weight / (2 seats + 1), none beyond its cap. Equal quotients go to the first.

    Nearly all seats are given at once (a party's seats are never this far below its share), the last ones singly.
    """
    n = len(weights)
    caps = [blocks] * n if caps is None else list(caps)
    seats, total = [0] * n, sum(weights)
    open_ = [i for i in range(n) if weights[i] > 0 and caps[i] > 0]
    left = min(blocks, sum(caps[i] for i in open_))
    while open_:  # shares are of what is not yet capped
        rest = sum(weights[i] for i in open_)
        room = left - sum(seats[i] for i in range(n) if i not in open_)
        full = [i for i in open_ if room * weights[i] / rest - n >= caps[i]]
        for i in full:
            seats[i] = caps[i]
        if not full:
            for i in open_:
                seats[i] = min(caps[i], max(0, int(room * weights[i] / rest) - n))
            break
        open_ = [i for i in open_ if i not in full]
    heap = [(-weights[i] / (2 * seats[i] + 1), i) for i in range(n) if weights[i] > 0 and seats[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(left - sum(seats)):
        if not heap or not total:
            break
        _, i = heapq.heappop(heap)
        seats[i] += 1
        if seats[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * seats[i] + 1), i))
    return seats


@dataclass
class Mix:
    rows: DataFrame  #: source, doc_id, n_tokens, copies
    shares: DataFrame  #: per target: what was asked and what was reached


def mix(docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = 17) -> Mix:
    """Mix ``docs`` (doc_id, source, n_tokens) by ``targets`` (source, target_share, max_repeats).

    total_tokens: the size wanted, by default the largest at which no source that has documents runs short. A document is
    used whole, and at most max_repeats times. Sources without documents get nothing, and their share is spread over
    the others in proportion; the report names every target. Documents of a null or unnamed source, and those
    without tokens, are in no mix. Spellings of a target count as one: shares add, the least max_repeats holds; null shares or
    repeats are 0. Where total_tokens asks for more than the repeats allow, the sources that can make up for it do.
    """
    wanted: dict[str, list] = {}
    rows = targets.select(canonical_source(F.col("source")).alias("c"), "source", F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("repeats")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    for r in rows:
        if r.c is not None:
            w = wanted.setdefault(r.c, [r.source, 0.0, r.repeats])
            w[1] += max(0.0, r.share)
            w[2] = min(w[2], max(0, r.repeats))
    spark = docs.sparkSession
    names = sorted(wanted)
    known = spark.createDataFrame([(c,) for c in names], "c string")
    sized = docs.select("doc_id", canonical_source(F.col("source")).alias("c"), F.col("n_tokens").cast("bigint").alias("n"))
    # the targets are bounded by the check above; staged before the filter on n, which would count a text's tokens once more
    sized = stage(sized.join(F.broadcast(known), "c"), "mix-sizes").where("n > 0")
    have_total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-have_total // shard_tokens))
    in_group = math.isqrt(shards - 1) + 1  # shards of a group
    # a document's place in the drawn order and its shard come from independent hashes
    drawn = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("shard")), F.lit(shards))).withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    sums = stage(drawn.groupBy("c", "shard").agg(F.sum("n").alias("own")).withColumn("grp", F.floor(F.col("shard") / in_group)), "mix-shards")
    have: dict[str, dict[int, int]] = {c: {} for c in names}
    for r in sums.groupBy("c", "grp").agg(F.sum("own").alias("n")).collect():
        have[r.c][r.grp] = r.n
    tokens = {c: sum(have[c].values()) for c in names}
    usable = [c for c in names if tokens[c] * wanted[c][2] > 0 and wanted[c][1] > 0]
    share_of = sum(wanted[c][1] for c in usable)
    if total_tokens is None:
        total_tokens = int(min((tokens[c] * wanted[c][2] * share_of / wanted[c][1] for c in usable), default=0))
    blocks = max(1, total_tokens // block_tokens) if total_tokens > 0 and usable else 0
    quota = dict(zip(usable, apportion([wanted[c][1] for c in usable], blocks, [-(-tokens[c] * wanted[c][2] // block_tokens) for c in usable])))
    plan = []
    for c in usable:
        groups = sorted(have[c])
        own = [have[c][g] for g in groups]
        for g, q in zip(groups, apportion(own, quota[c], [-(-t * wanted[c][2] // block_tokens) for t in own])):
            if q:
                plan.append((c, g, q, wanted[c][2]))
    group_quotas = spark.createDataFrame(plan, "c string, grp bigint, q bigint, most bigint")

    def to_shards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        own, most = pdf["own"].tolist(), int(pdf["most"].iat[0])
        out = []
        for c, k, t, q in zip(pdf["c"], pdf["shard"].tolist(), own, apportion(own, int(pdf["q"].iat[0]), [-(-t * most // block_tokens) for t in own])):
            if q:
                full, rest = divmod(q * block_tokens, t)
                out.append((c, k, *((full, rest) if full < most else (most, 0))))
        return pd.DataFrame(out, columns=["c", "shard", "full", "rest"])

    quotas = sums.join(group_quotas, ["c", "grp"]).groupBy("c", "grp").applyInPandas(to_shards, "c string, shard bigint, full bigint, rest bigint")
    order = Window.partitionBy("c", "shard").orderBy("draw", "doc_id")
    laid = drawn.join(quotas, ["c", "shard"]).withColumn("start", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    # a document belongs to the block its middle lies in, so what is taken is as often above the quota as below
    copies = F.col("full") + F.when(2 * F.col("start") + F.col("n") <= 2 * F.col("rest"), 1).otherwise(0)
    spelt = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(wanted[c][0]))]) if names else F.create_map(F.lit(""), F.lit(""))
    taken = laid.select(spelt[F.col("c")].alias("source"), "doc_id", F.col("n").alias("n_tokens"), copies.alias("copies")).where("copies > 0")
    asked = spark.createDataFrame([(w[0], w[1], w[2], tokens[c], quota.get(c, 0)) for c, w in sorted(wanted.items())], "source string, target_share double, max_repeats int, available_tokens bigint, quota_blocks bigint")
    got = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    zero = F.lit(0).cast("bigint")
    shares = asked.join(got, "source", "left").select(
        *asked.columns, *[F.coalesce(F.col(x), zero).alias(x) for x in ("tokens", "n_docs", "most_copies")]
    )
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # a row per target
    shares = shares.withColumn("actual_share", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(F.lit(0.0)))
    return Mix(taken, shares)
