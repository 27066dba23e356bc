"""Structured Streaming forms: metrics, change feeds, replica merges, at-most-once apply and conditional requests.

Each gives what its batch form gives once the stream's input is used up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.operators import metrics, occ
from keyloom.operators.changefeed import EqualityDeleteTable
from keyloom.operators.siblings import merge_siblings
from keyloom.session import Commits


def streaming_metrics(ops: DataFrame, *by: str) -> DataFrame:
    """Operation counters kept by the engine's own aggregation state; for update or complete output."""
    return metrics.operation_metrics(ops, *by)


def windowed_metrics(ops: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """The counters per time window; rows later than ``late`` behind the newest are dropped with their windows' state."""
    w = ops.withWatermark(time, late).withColumn("window", F.window(time, width))
    return metrics.operation_metrics(w, "window", *by)


def append_changes(changes: DataFrame, table: EqualityDeleteTable, checkpoint: str):
    """A query that appends each micro-batch of changes to an equality-delete table. A batch delivered twice changes nothing."""
    return changes.writeStream.foreachBatch(lambda df, number: table.append(df, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SiblingStore:
    """Sibling sets per key: each micro-batch is merged by itself and written as a folder of its own, and readers merge the folders.

    A batch never reads or rewrites what is stored. It counts once its marker is written, so a restart, a crash between
    writes and a batch delivered again all leave the store right; nothing is kept in this object. :meth:`compact` merges
    the folders so far into one. A store without batches can't be read, as it has no columns yet.
    """

    def __init__(self, spark, folder: str, columns: tuple[str, ...] = ("key", "value", "version", "clock", "tombstone")):
        self.spark, self.folder, self.columns = spark, folder.rstrip("/"), list(columns)
        self.commits = Commits(spark, self.folder)

    def merge(self, batch: DataFrame, number: int) -> None:
        name = f"batch-{number:019d}"
        # a batch delivered again may be in a compacted folder already
        if self.commits.has(name):
            return
        merge_siblings(batch.select(self.columns)).select(self.columns).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.commits.add(name)

    def _parts(self) -> list[str]:
        """The newest compacted folder and the batches that came after it."""
        names = self.commits.all()
        merged = [n for n in names if n.startswith("upto-")]
        return merged[-1:] + [n for n in names if n.startswith("batch-") and (not merged or n[6:] > merged[-1][5:])]

    def read(self) -> DataFrame:
        return merge_siblings(self.spark.read.parquet(*[f"{self.folder}/{n}" for n in self._parts()]).select(self.columns)).select(self.columns)

    def compact(self) -> None:
        """Merge all batches so far into one folder; batches are numbered in order, as a stream's are, so later ones have higher numbers."""
        last = self._parts()[-1].split("-")[1]
        name = f"upto-{last}"
        if not self.commits.has(name):
            self.read().write.mode("overwrite").parquet(f"{self.folder}/{name}")
            self.commits.add(name)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


APPLIED = "idx bigint, client string, seq bigint, op string, key string, value string, outcome string"
_SESSION = "last_seq bigint, op string, key string, value string"


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, cmd = (None, None)
    if state.exists:
        last, *rest = state.get
        cmd = tuple(rest)
    # a key's rows may come as several batches; their order is by index only when put together
    pdf = pd.concat(list(batches)).sort_values("idx")
    out = []
    for r in pdf.itertuples(index=False):
        now = (r.op, r.key, None if r.value is None or r.value != r.value else r.value)
        if last is None or r.seq > last:
            last, cmd, what = r.seq, now, "APPLIED"
        elif r.seq < last:
            what = "STALE"
        else:
            what = "DUPLICATE" if now == cmd else "CONFLICT"
        out.append((r.idx, r.client, r.seq, *now, what))
    state.update((int(last), *cmd))
    yield pd.DataFrame(out, columns=["idx", "client", "seq", "op", "key", "value", "outcome"])


def apply_at_most_once(log: DataFrame) -> DataFrame:
    """The streaming form of at-most-once apply: a client's last sequence number and command are its state."""
    return log.select("idx", "client", "seq", "op", "key", "value").groupBy("client").applyInPandasWithState(_apply, APPLIED, _SESSION, "append", GroupStateTimeout.NoTimeout)


_STORE = "counter bigint, present boolean, version bigint, value string"


def _requests(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = occ.KeyState(*state.get) if state.exists else occ.KeyState()
    out = occ.fold_rows(s, pd.concat(list(batches)))
    state.update((s.counter, s.present, s.version, s.value))
    yield out


def apply_requests(requests: DataFrame) -> DataFrame:
    """The streaming form of set, cas and delete: a key's counter and current value are its state."""
    return requests.select("idx", "key", "op", "value", "expected").groupBy("key").applyInPandasWithState(_requests, occ.RESULT, _STORE, "append", GroupStateTimeout.NoTimeout)
