"""Packing items into containers of fixed capacity: hierarchical multi-length packing on the histogram of sizes.

How many items of which size go together depends only on how many items of each size there are, and sizes are at
most a capacity. So the histogram is gathered (its bound is the capacity, not the data), packed best fit decreasing
over all items at once, and the items take their places by their rank among those of equal size.

Tiers: items are routed to the smallest context size that holds them; the sizes are those of the containers and, within
each, its halves, quarters and so on. The longest tier is packed first; the gaps its windows leave are filled from the
shorter tiers, which then are packed in turn, each into what room is left and new windows. Containers are dealt to step
groups so that all groups hold about equally many tokens.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.session import stage

#: Items of one size ranked in one task.
RANKED = 1_000_000
#: Context sizes within a container: the whole, a half, a quarter, ...
LEVELS = 4


@dataclass
class Layout:
    """Places of a packing. Items of one size are numbered from ``base[size]`` on; containers of one kind are numbered from 0."""

    base: dict[int, int]
    first_item: np.ndarray
    kind: np.ndarray
    first_container: np.ndarray
    copies: np.ndarray  # items of the run in each of its containers
    offset: np.ndarray  # where the first of them lies
    size: np.ndarray
    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # kind: (first container, containers, tokens in each)


class _Bins:
    """Open containers of one capacity: runs of equally filled containers by the room left."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rooms: list[int] = []  # sorted; rooms with open runs
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.n = 0

    def push(self, room: int, run: tuple[int, int]) -> None:
        if room not in self.open:
            bisect.insort(self.rooms, room)
            self.open[room] = []
        self.open[room].append(run)

    def place(self, size: int, count: int, may_open: bool):
        """Best fit of ``count`` items of ``size``; yields (items, first container, per container, offset); what finds no room is left."""
        while count:
            i = bisect.bisect_left(self.rooms, size)
            if i < len(self.rooms):
                room = self.rooms[i]
                runs = self.open[room]
                start, n = runs.pop()
                if not runs:
                    del self.open[room], self.rooms[i]
                per = min(room // size, count)
                used = min(n, count // per)
                if used < n:
                    self.push(room, (start + used, n - used))
                self.push(room - per * size, (start, used))
                yield per * used, start, per, self.capacity - room
                count -= per * used
            elif may_open:
                n = -(-count // (self.capacity // size))
                self.push(self.capacity, (self.n, n))
                self.n += n
            else:
                break


def lay_out(histogram: dict[int, int], capacities: dict[int, int], tiered: bool, levels: int = 1) -> Layout:
    """Pack items of the given sizes, each at most the largest capacity.

    ``capacities``: kind to capacity. Tiered, an item is packed in its own kind's containers or in a gap of a longer
    kind; otherwise there must be one kind. Each kind has ``levels`` tiers of its own: only items of a level's tier open
    containers at that level, and items of all shorter ones fill the gaps before the next level's are packed. One level
    is plain best fit decreasing.
    """
    sizes = sorted(histogram, reverse=True)
    base, total = {}, 0
    for s in sizes:
        base[s] = total
        total += histogram[s]
    given = dict.fromkeys(sizes, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    runs = {}
    order = sorted(capacities, key=lambda k: -capacities[k])
    for i, kind in enumerate(order):
        below = capacities[order[i + 1]] if tiered and i + 1 < len(order) else 0
        bins = _Bins(capacities[kind])
        bounds = [b for b in (capacities[kind] >> k for k in range(1, levels)) if b > below]
        for bound in [*bounds, below]:
            for s in sizes:
                if s > capacities[kind] or given[s] == histogram[s]:
                    continue
                for items, start, per, offset in bins.place(s, histogram[s] - given[s], s > bound):
                    rows.append((base[s] + given[s], kind, start, per, offset, s))
                    given[s] += items
        runs[kind] = sorted((start, n, bins.capacity - room) for room, rs in bins.open.items() for start, n in rs)
    cols = list(zip(*sorted(rows))) if rows else [()] * 6
    return Layout(base, *[np.array(c, np.int64) for c in cols], runs)


def balance(runs: list[tuple[int, int, int]], per_step: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Deal containers, fullest first, to and fro over the step groups: (first containers, places in the order, groups)."""
    total = sum(n for _, n, _ in runs)
    at, seat = 0, {}
    for start, n, _ in sorted(runs, key=lambda r: (-r[2], r[0])):
        seat[start] = at
        at += n
    starts = sorted(seat)
    return np.array(starts, np.int64), np.array([seat[s] for s in starts], np.int64), max(1, -(-total // per_step))


_PLACE = "kind int, container bigint, at bigint, step bigint"


def _placer(layouts: dict[int, Layout], per_step: int):
    balanced = {p: {k: balance(r, per_step) for k, r in lay.runs.items()} for p, lay in layouts.items()}

    def place(plans: pd.Series, items: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({c: np.zeros(len(items), np.int64) for c in ("kind", "container", "at", "step")})
        plan, item = plans.to_numpy(np.int64), items.to_numpy(np.int64)
        for p in np.unique(plan):
            lay, m = layouts[int(p)], plan == p
            run = np.searchsorted(lay.first_item, item[m], "right") - 1
            within = item[m] - lay.first_item[run]
            container = lay.first_container[run] + within // lay.copies[run]
            kind = lay.kind[run]
            step = np.zeros(len(run), np.int64)
            for k, (starts, seats, groups) in balanced[int(p)].items():
                if (here := kind == k).any():
                    r = np.searchsorted(starts, container[here], "right") - 1
                    lap, pos = np.divmod(seats[r] + container[here] - starts[r], groups)
                    step[here] = np.where(lap % 2 == 0, pos, groups - 1 - pos)
            out.loc[m, "kind"], out.loc[m, "container"] = kind, container
            out.loc[m, "at"], out.loc[m, "step"] = lay.offset[run] + within % lay.copies[run] * lay.size[run], step
        return out.astype({"kind": "int32"})

    return place


def pack(sizes: DataFrame, containers: dict[str, int], *, tiered: bool, per_step: int = 64, levels: int = LEVELS) -> DataFrame:
    """Pack ``sizes`` (doc_id, n_tokens) into containers (kind to capacity in tokens).

    tiered: every document goes once into one of the kinds. Otherwise every kind holds all documents. Either way a kind's
    containers are packed in ``levels`` tiers of context sizes. Result: one row
    per piece: container_kind, container_id, step, doc_id, piece, n_pieces, token_from, token_to (of the document) and
    at (place in the container). Only a document larger than the container (tiered: than the largest) is split, into
    full pieces and a rest. A document without tokens, or with a null number of them, takes no room: its row has no
    container. Ties are settled by doc_id, so the result is the same however the input is partitioned; repeated
    doc_ids are documents of their own. No documents give no rows.
    """
    names = sorted(containers, key=lambda k: (containers[k], k))
    if not names or min(containers.values()) < 1:
        raise ValueError("capacities must be positive")
    plans = {0: {i: containers[k] for i, k in enumerate(names)}} if tiered else {i: {i: containers[k]} for i, k in enumerate(names)}
    limits = F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(max(c.values())).cast("bigint").alias("limit")) for p, c in plans.items()])
    docs = sizes.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("n"))
    per_plan = docs.select("doc_id", "n", F.explode(limits).alias("l")).select("doc_id", "n", "l.plan", "l.limit")
    cut = per_plan.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("limit")).cast("bigint")))
    items = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1))).select(
        "plan", "doc_id", "piece", "n_pieces", (F.col("piece") * F.col("limit")).alias("token_from"), F.least((F.col("piece") + 1) * F.col("limit"), F.col("n")).alias("token_to")
    ).withColumn("size", (F.col("token_to") - F.col("token_from")).cast("int"))

    histogram: dict[int, dict[int, int]] = {p: {} for p in plans}
    for r in items.where("size > 0").groupBy("plan", "size").agg(F.count(F.lit(1)).alias("c")).collect():
        histogram[r.plan][r.size] = r.c
    layouts = {p: lay_out(histogram[p], plans[p], tiered, levels) for p in plans}
    spark = sizes.sparkSession
    # at most one row per plan and size, so bounded by the capacities
    known = [(p, s, layouts[p].base[s], -(-c // RANKED)) for p, h in histogram.items() for s, c in h.items()]
    sized = items.where("size > 0").join(F.broadcast(spark.createDataFrame(known, "plan int, size int, base bigint, buckets bigint")), ["plan", "size"])
    # items of one size are ranked in buckets of bounded size, and the buckets put one after another
    bucketed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")))
    ranked = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("plan", "size", "bucket").orderBy("doc_id", "piece", "n_pieces")))
    many = bucketed.where("buckets > 1").groupBy("plan", "size", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = many.select("plan", "size", "bucket", (F.sum("c").over(Window.partitionBy("plan", "size").orderBy("bucket")) - F.col("c")).alias("before"))
    if any(b > 1 for *_, b in known):
        ranked = ranked.join(before, ["plan", "size", "bucket"], "left")
    else:
        ranked = ranked.withColumn("before", F.lit(0))
    place = F.pandas_udf(_placer(layouts, per_step), _PLACE)
    placed = ranked.withColumn("p", place("plan", F.col("base") + F.coalesce(F.col("before"), F.lit(0)) + F.col("rank") - 1))
    kind = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p.kind") + 1)
    cols = ["doc_id", "piece", "n_pieces", "token_from", "token_to"]
    out = placed.select(kind.alias("container_kind"), F.col("p.container").alias("container_id"), F.col("p.step").alias("step"), *cols, F.col("p.at").alias("at"))
    none = F.lit(None)
    no_room = items.where("size = 0").select(
        (none.cast("string") if tiered else F.element_at(F.array(*[F.lit(n) for n in names]), F.col("plan") + 1)).alias("container_kind"),
        none.cast("bigint").alias("container_id"), none.cast("bigint").alias("step"), *cols, none.cast("bigint").alias("at"),
    )
    return out.unionByName(no_room)


def fill_report(packed: DataFrame, containers: dict[str, int]) -> DataFrame:
    """Per kind: containers, pieces, tokens, tokens of room left, the share filled, and the least and most tokens of a step group."""
    capacity = F.create_map(*[x for k, c in containers.items() for x in (F.lit(k), F.lit(c).cast("bigint"))])
    size = F.col("token_to") - F.col("token_from")
    steps = packed.where(F.col("container_id").isNotNull()).groupBy("container_kind", "step").agg(
        F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("pieces"), F.sum(size).alias("tokens")
    )
    return steps.groupBy("container_kind").agg(
        F.sum("containers").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), F.min("tokens").alias("least_step_tokens"), F.max("tokens").alias("most_step_tokens")
    ).withColumn("room_left", F.col("n_containers") * capacity[F.col("container_kind")] - F.col("n_tokens")).withColumn(
        "filled", F.col("n_tokens") / (F.col("n_containers") * capacity[F.col("container_kind")])
    )


def audit(packed: DataFrame, sizes: DataFrame, containers: dict[str, int]) -> DataFrame:
    """What a packing of all documents into each kind promises, per kind: documents; those whose tokens aren't all there just
    once; those split though they fit; containers beyond their capacity, and with items that overlap or leave gaps between them."""
    capacity = F.create_map(*[x for k, c in containers.items() for x in (F.lit(k), F.lit(c).cast("bigint"))])[F.col("container_kind")]
    length = F.col("token_to") - F.col("token_from")
    docs = packed.groupBy("container_kind", "doc_id").agg(
        F.sum(length).alias("tokens"), F.max("token_to").alias("last"), F.count_distinct("piece").alias("pieces"), F.count(F.lit(1)).alias("rows"), F.max("n_pieces").alias("n_pieces")
    )
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    whole = (F.col("tokens") == n) & (F.col("last") == n) & (F.col("pieces") == F.col("n_pieces")) & (F.col("rows") == F.col("n_pieces"))
    kinds = sizes.sparkSession.createDataFrame([(k,) for k in sorted(containers)], "container_kind string")
    wanted = sizes.select("doc_id", "n_tokens", F.explode(F.array(*[F.lit(k) for k in sorted(containers)])).alias("container_kind"))
    by_doc = wanted.join(docs, ["container_kind", "doc_id"], "left").groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("incomplete"), F.count_if((F.col("n_pieces") > 1) & (n <= capacity)).alias("split")
    )
    boxes = packed.where("container_id IS NOT NULL").groupBy("container_kind", "container_id").agg(F.sum(length).alias("held"), F.max(F.col("at") + length).alias("end"), F.count_distinct("at").alias("places"), F.count(F.lit(1)).alias("items"))
    by_box = boxes.groupBy("container_kind").agg(F.count_if(F.col("end") > capacity).alias("overfull"), F.count_if((F.col("held") != F.col("end")) | (F.col("places") != F.col("items"))).alias("overlapping"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return kinds.join(by_doc, "container_kind", "left").join(by_box, "container_kind", "left").select("container_kind", *map(zero, ("documents", "incomplete", "split", "overfull", "overlapping")))


def staged_sizes(docs: DataFrame, size, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens), counted once and kept in the shared folder: packing reads it several times."""
    return stage(docs.select(F.col(doc_id).alias("doc_id"), size.alias("n_tokens")), "sizes")
