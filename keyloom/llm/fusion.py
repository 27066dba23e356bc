"""One representative per group of duplicate rows: the best surviving row and a record fused field by field.

1. Rows that another row of their key supersedes (a vector clock nowhere lower and somewhere higher) are set aside.
2. What is left votes, one vote per source and field. Truth is found by Bayesian fusion with copy detection: source
   accuracies, the posterior of each value, and for each pair of sources the probability that one copies the other,
   judged by the false values they share, are estimated in turn until they settle; copied votes are discounted.
3. The survivor of a key is its live unsuperseded row with the most filled-in fields (then the smallest id); the
   fused record holds the value of greatest posterior of each field.

Groups may be of any size: what is superseded is dropped in bounded windows before rows of a key meet, only what is left
is parsed, and votes are counted per source before they meet.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators.front import causal_front
from keyloom.session import stage

#: Texts that only say that there is no value; compared without case and surrounding blanks.
PLACEHOLDERS = frozenset(["", "-", "--", "?", "n/a", "na", "none", "null", "nil", "tbd", "tba", "unknown", "undefined", "not available"])
#: More sources than this would make the table of source pairs too large to hold.
MAX_SOURCES = 2000


def _no_constant(name: str) -> None:
    raise ValueError(name)


def filled_in(value: bytes | None) -> list[tuple[str, str]] | None:
    """Filled-in fields of a JSON object as (field, text); None for what is no valid JSON object."""
    if value is None:
        return None
    try:
        got = json.loads(bytes(value).decode("utf-8"), parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    if not isinstance(got, dict):
        return None
    out = []
    for k, v in got.items():
        text = v if isinstance(v, str) else "" if v is None or v == [] or v == {} else json.dumps(v, sort_keys=True, ensure_ascii=False)
        if text.strip().lower() not in PLACEHOLDERS:
            out.append((k, text.strip().encode("utf-8", "replace").decode()))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("val", T.StringType())])))
def _fields_udf(values: pd.Series) -> pd.Series:
    return pd.Series([[{"field": f, "val": v} for f, v in filled_in(x) or ()] for x in values], dtype=object)


@dataclass
class Sources:
    """What fusion learnt about the sources."""

    names: list[str]
    accuracy: np.ndarray
    copies: np.ndarray = field(repr=False)  # probability that two sources depend on each other


def _batch(b: pa.RecordBatch, src: Sources, n_false: int, copy_rate: float) -> dict:
    """Posterior of each voted value of the batch's items; all arrays, no loop over items."""
    votes = b.column("votes")
    offsets = votes.offsets.to_numpy() - votes.offsets[0].as_py()
    flat = votes.flatten()
    item = np.repeat(np.arange(len(b)), np.diff(offsets))
    s = flat.field("src").to_numpy(zero_copy_only=False).astype(np.int64)
    d = flat.field("val").dictionary_encode()
    v = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    groups, g = np.unique(item * max(1, len(d.dictionary)) + v, return_inverse=True)
    gi, gv = groups // max(1, len(d.dictionary)), groups % max(1, len(d.dictionary))
    k = len(src.names)
    member = np.zeros((len(groups), k), bool)
    member[g, s] = True
    order = np.argsort(-src.accuracy, kind="stable")
    weight = np.log(n_false * src.accuracy / (1 - src.accuracy))
    score = np.zeros(len(groups))
    for i, x in enumerate(order):
        independent = np.ones(len(groups))
        for y in order[:i][src.copies[x, order[:i]] > 1e-9]:
            independent *= np.where(member[:, y], 1 - copy_rate * src.copies[x, y], 1.0)
        score += np.where(member[:, x], weight[x] * independent, 0.0)
    top = np.full(len(b), -np.inf)
    np.maximum.at(top, gi, score)
    top = np.maximum(top, 0.0)
    e = np.exp(score - top[gi])
    total = np.bincount(gi, e, len(b)) + np.maximum(0, n_false + 1 - np.bincount(gi, minlength=len(b))) * np.exp(-top)
    return {"gi": gi, "gv": gv, "member": member, "p": e / total[gi], "values": d.dictionary, "n": np.bincount(gi, member.sum(1), len(b))}


def _best(r: dict, n_items: int) -> np.ndarray:
    """Index of each item's group of greatest posterior; of equal ones that with the smallest text."""
    rank = np.empty(len(r["values"]), np.int64)
    rank[np.argsort(np.array(r["values"].to_pylist(), object), kind="stable")] = np.arange(len(rank))
    order = np.lexsort((rank[r["gv"]], -np.round(r["p"], 12), r["gi"]))
    first = np.ones(len(order), bool)
    first[1:] = r["gi"][order][1:] != r["gi"][order][:-1]
    return order[first]


def _statistics(src: Sources, n_false: int, copy_rate: float):
    k = len(src.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, voted = np.zeros(k), np.zeros(k)
        true, false, both = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
        for b in batches:
            if not len(b):
                continue
            r = _batch(b, src, n_false, copy_rate)
            right += r["p"] @ r["member"]
            voted += r["member"].sum(0)
            m = r["member"].astype(float)
            t = np.zeros(len(m), bool)
            t[_best(r, len(b))] = True
            true += m[t].T @ m[t]
            false += m[~t].T @ m[~t]
            u = np.zeros((len(b), k))
            np.add.at(u, r["gi"], m)
            both += u.T @ u
        # pairs that never vote on the same item count nothing
        at = np.flatnonzero(both.ravel() + np.diag(voted).ravel())
        cells = [m.ravel()[at] for m in (true, false, both, np.diag(right), np.diag(voted))]
        yield pa.RecordBatch.from_arrays([pa.array(at // k), pa.array(at % k), *map(pa.array, cells)], names=["x", "y", "t", "f", "b", "r", "n"])

    return run


def _dependence(accuracy: np.ndarray, t: np.ndarray, f: np.ndarray, d: np.ndarray, n_false: int, copy_rate: float, prior: float) -> np.ndarray:
    """Posterior that two sources depend: shared false values are far likelier if one copies the other."""
    err = 1 - (accuracy[:, None] + accuracy[None, :]) / 2
    pt, pf = (1 - err) ** 2, err**2 / n_false
    pd_ = np.maximum(1e-12, 1 - pt - pf)
    ct, cf, cd = (1 - err) * copy_rate + pt * (1 - copy_rate), err * copy_rate + pf * (1 - copy_rate), pd_ * (1 - copy_rate)
    log_ratio = t * np.log(ct / pt) + f * np.log(cf / pf) + d * np.log(cd / pd_)
    odds = math.log(prior / (1 - prior)) + log_ratio
    out = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    np.fill_diagonal(out, 0.0)
    return out


def learn_sources(items: DataFrame, names: list[str], n_false: int = 20, copy_rate: float = 0.8, prior: float = 0.2, rounds: int = 6, tolerance: float = 1e-3) -> Sources:
    """Accuracies and dependences from ``items`` (votes: array of (src, val)). Each round is one pass; a source pair's counts come back."""
    k = len(names)
    src = Sources(names, np.full(k, 0.8), np.zeros((k, k)))
    for turn in range(rounds):
        got = (
            items.select("votes").mapInArrow(_statistics(src, n_false, copy_rate), "x bigint, y bigint, t double, f double, b double, r double, n double")
            .groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in "tfbrn"]).toPandas()
        )
        m = {c: np.zeros((k, k)) for c in "tfbrn"}
        for c in m:
            m[c][got["x"].to_numpy(int), got["y"].to_numpy(int)] = got[c]
        right, voted = m["r"].diagonal(), m["n"].diagonal()
        # a few invented votes keep the accuracy of a source with hardly any within bounds
        # first votes are equal: before copies are known, a clique's accuracies would only confirm the clique
        accuracy = np.clip((right + 8) / (voted + 10), 0.05, 0.99) if turn else src.accuracy
        # by the accuracies this round's truth rests on: a clique that outvotes the rest looks faultless afterwards
        copies = _dependence(src.accuracy, m["t"], m["f"], np.maximum(0, m["b"] - m["t"] - m["f"]), n_false, copy_rate, prior)
        settled = turn > 1 and np.abs(accuracy - src.accuracy).max(initial=0) < tolerance and np.abs(copies - src.copies).max(initial=0) < 0.01
        src = Sources(names, accuracy, copies)
        if settled:
            break
    return src


def _decide(src: Sources, n_false: int, copy_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            r = _batch(b, src, n_false, copy_rate)
            at = _best(r, len(b))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("field"), r["values"].take(pa.array(r["gv"][at])).cast(pa.string()), pa.array(r["p"][at]), pa.array(r["n"].astype(np.int64)[r["gi"][at]])],
                names=["key", "field", "val", "confidence", "votes"],
            )

    return run


@dataclass
class Fused:
    records: DataFrame  #: key, sibling_id, n_filled, record, confidence
    sources: Sources


def fuse(
    df: DataFrame, key: str = "key", row_id: str = "sibling_id", source: str = "node", value: str = "value", clock: str = "vector_clock", tombstone: str = "tombstone", n_false: int = 20, copy_rate: float = 0.8, prior: float = 0.2
) -> Fused:
    """:func:`fuse_groups` with what was learnt about the sources."""
    dead = F.coalesce(F.col(tombstone), F.lit(False))
    # what a deleted row holds is never read
    rows = df.select(F.col(key).alias("key"), F.col(row_id).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(clock).alias("clock"), dead.alias("dead"), F.when(~dead, F.col(value)).alias("value"))
    live = causal_front(rows, ["key"], "clock").where(~F.col("dead")).select("key", "id", "source", _fields_udf("value").alias("fields"))
    live = stage(live.withColumn("n_filled", F.size("fields")), "live")
    counted = live.select("key", "source", F.explode("fields").alias("f")).groupBy("key", "source", "f.field", "f.val").agg(F.count(F.lit(1)).alias("c"))
    votes = counted.groupBy("key", "field", "source").agg(F.min(F.struct((-F.col("c")).alias("less"), "val")).alias("v"))
    names = [r[0] for r in live.select("source").distinct().orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not names:
        names = [""]
    index = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("source")).cast("int") - 1
    items = votes.groupBy("key", "field").agg(F.sort_array(F.collect_list(F.struct(index.alias("src"), F.col("v.val").alias("val")))).alias("votes"))
    items = stage(items, "items")
    src = learn_sources(items, names, n_false, copy_rate, prior)
    fused = items.mapInArrow(_decide(src, n_false, copy_rate), "key string, field string, val string, confidence double, votes bigint")
    # a key's rows, its best one and its fused fields meet once
    best = F.struct((-F.col("n_filled")).alias("less"), "id")
    none, one = (lambda t: F.lit(None).cast(t)), F.lit(1)
    kind = live.select(best.alias("b")).schema["b"].dataType.simpleString()
    of_field = F.struct("field", "val", "confidence")
    parts = [
        rows.select("key", one.alias("n"), none(kind).alias("best"), none("struct<field:string,val:string,confidence:double>").alias("f")),
        live.select("key", F.lit(0).alias("n"), best.alias("best"), none("struct<field:string,val:string,confidence:double>").alias("f")),
        fused.select("key", F.lit(0).alias("n"), none(kind).alias("best"), of_field.alias("f")),
    ]
    met = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("key").agg(F.sum("n").alias("n"), F.min("best").alias("best"), F.sort_array(F.collect_list("f")).alias("fs"))
    as_map = lambda x: F.when(F.size("fs") > 0, F.map_from_entries(F.transform("fs", lambda e: F.struct(e["field"], e[x]))))
    records = met.where((F.col("n") >= 2) & F.col("best").isNotNull()).select(
        "key", F.col("best.id").alias("sibling_id"), (-F.col("best.less")).alias("n_filled"), as_map("val").alias("record"), as_map("confidence").alias("confidence")
    )
    return Fused(records, src)


def fuse_groups(df: DataFrame, **columns) -> DataFrame:  # noqa: ANN003
    """(key, sibling_id, n_filled, record, confidence) for each key with two or more rows and a survivor; ``columns`` as in :func:`fuse`.

    sibling_id and n_filled are the survivor's; record maps field to fused value, confidence to its posterior.
    A null clock is empty and a node a clock doesn't name counts 0; a null tombstone is false; a value that is no
    valid JSON object has no fields; a null source votes as a source of its own. A null key is a key. Repeated rows
    vote once per source; of equally likely values the smallest text is taken. Keys without a survivor, an
    empty table and tables of single rows give nothing. Other columns are ignored, whatever their names.
    """
    return fuse(df, **columns).records


def source_report(spark: SparkSession, src: Sources) -> DataFrame:
    """(source, accuracy, likeliest_copy, copy_probability): a row per source, with the source it most likely depends on."""
    rows = []
    for i, name in enumerate(src.names):
        j = int(np.argmax(src.copies[i])) if len(src.names) > 1 else i
        rows.append((name, float(src.accuracy[i]), src.names[j] if j != i else None, float(src.copies[i, j])))
    return spark.createDataFrame(rows, "source string, accuracy double, likeliest_copy string, copy_probability double")
