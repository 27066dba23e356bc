"""Optimistic concurrency: a store of versioned values driven by a log of set, cas and delete requests.

Requests are rows (idx, key, op SET/CAS/DELETE, value, expected). A set always succeeds; a cas on an absent key succeeds
if it expects 0 and starts the counter anew at 1; on a present one, as a delete, if it expects the current
version. A key's counter outlives its deletion.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.running import laid

RESULT = "key string, idx bigint, op string, success boolean, version bigint, value string"


def set_versions(writes: DataFrame) -> DataFrame:
    """Versions of unconditional writes: (key, idx, value, version)."""
    before = laid(writes.select("key", "idx", "value"), ["key"], ["idx"]).carried(total={"n": F.lit(1)}).rows()
    return before.select("key", "idx", "value", (F.col("n") + 1).cast("bigint").alias("version"))


class KeyState:
    """One key's state; shared by the batch and the streaming form."""

    def __init__(self, counter: int = 0, present: bool = False, version: int = 0, value: str | None = None) -> None:
        self.counter, self.present, self.version, self.value = counter, present, version, value

    def apply(self, op: str, value: str | None, expected: int | None) -> bool:
        if op == "SET":
            self.counter += 1
        elif op == "CAS" and not self.present:
            if expected != 0:
                return False
            self.counter = 1
        elif not self.present or self.version != expected:
            return False
        elif op == "DELETE":
            self.present, self.value = False, None
            return True
        else:
            self.counter += 1
        self.present, self.version, self.value = True, self.counter, value
        return True


_COLUMNS = ["key", "idx", "op", "success", "version", "value"]


def _step(state: KeyState, k, i, op, v, e) -> tuple:  # noqa: ANN001
    """One request's result. A failed request reports the version it met, 0 if there is none."""
    ok = state.apply(op, None if v is None or v != v else v, None if e is None or e != e else int(e))
    return k, i, op, ok, state.version if state.present else 0, state.value if state.present else None


def fold_rows(state: KeyState, pdf: pd.DataFrame) -> pd.DataFrame:
    """Results of one key's requests in order."""
    pdf = pdf.sort_values("idx")
    out = [_step(state, *r) for r in zip(pdf["key"], pdf["idx"], pdf["op"], pdf["value"], pdf["expected"])]
    return pd.DataFrame(out, columns=_COLUMNS)


def apply_requests(requests: DataFrame) -> DataFrame:
    """(key, idx, op, success, version, value) per request; each step depends on the one before, so a key is folded in order.

    Rows come sorted by key and idx and are folded as they pass, so a key of any length needs no more than its state.
    Keys with nothing but sets need no fold and stay in the JVM; there the version is a row number.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, KeyState()
        for b in batches:
            out = []
            for k, i, op, v, e in zip(b["key"], b["idx"], b["op"], b["value"], b["expected"]):
                if k != key:
                    key, state = k, KeyState()
                out.append(_step(state, k, i, op, v, e))
            yield pd.DataFrame(out, columns=_COLUMNS)

    conditional = requests.where("op <> 'SET'").select("key").distinct()
    plain = requests.join(conditional, "key", "left_anti")
    easy = set_versions(plain).select("key", "idx", F.lit("SET").alias("op"), F.lit(True).alias("success"), "version", "value")
    hard = requests.join(conditional, "key", "left_semi").select("key", "idx", "op", "value", "expected").repartition("key").sortWithinPartitions("key", "idx").mapInPandas(fold, RESULT)
    return easy.unionByName(hard)


def after_clear(requests: DataFrame, at: int | Column) -> DataFrame:
    """The requests that count once the store was cleared after ``idx`` = at: values and counters begin anew."""
    return requests.where(F.col("idx") > at)


def size(results: DataFrame) -> DataFrame:
    """(size): keys present after all requests."""
    return current(results).agg(F.count(F.lit(1)).alias("size"))


def current(results: DataFrame) -> DataFrame:
    """(key, version, value) of the keys present after all requests."""
    last = results.groupBy("key").agg(F.max_by(F.struct("version", "value"), "idx").alias("s"))
    return last.where("s.version > 0").select("key", "s.version", "s.value")
