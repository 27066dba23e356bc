"""Current state of a table from a feed of inserts, updates and deletes, as equality-delete files.

A batch of changes is appended without reading the table: live rows go to ``data`` files, and for every change an
equality delete ``(key, seq)`` goes to ``deletes`` files, since any change supersedes what its key held before.
Readers take the rows that no later delete of their key supersedes. Writing is therefore a narrow, append-only
job; the merge happens on read, or once in :meth:`EqualityDeleteTable.compact`. A batch is two sets of files, so it is
committed by a marker written last: readers see both or neither.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.session import Commits

KEY, SEQ, HARD, ROW = "__key", "__seq", "__hard", "__row"


def split_changes(changes: DataFrame, key: str, seq: str, is_delete: Column) -> tuple[DataFrame, DataFrame]:
    """Split changes into (inserts, equality deletes); neither needs a shuffle.

    inserts: ``__key, __seq, __row`` with the change's whole row as a struct, so columns of any name fit.
    deletes: ``__key, __seq, __hard``; hard marks an explicit delete, which also removes a row of its own
    sequence number, while an upsert removes only strictly older rows.
    Changes without key or sequence number were never committed and are left out. A null ``is_delete`` is false.
    """
    hard = F.coalesce(is_delete, F.lit(False))
    committed = changes.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    inserts = committed.where(~hard).select(
        F.col(key).alias(KEY), F.col(seq).alias(SEQ), F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias(ROW)
    )
    deletes = committed.select(F.col(key).alias(KEY), F.col(seq).alias(SEQ), hard.alias(HARD))
    return inserts, deletes


def merge_on_read(inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows of ``inserts`` that no later equality delete of their key removes; one row per live key.

    Both sides are combined per key before the shuffle, so a key with a third of all changes leaves a task as
    one row, and the anti join then is one to one. Combining inserts to the newest of a key does what the equality deletes
    of its upserts would do; the join applies all later deletes. Repeated and out-of-order changes don't matter: only
    sequence numbers are compared. If rows of one key and sequence number differ, one of them is kept.
    """
    newest = inserts.groupBy(KEY).agg(F.max(SEQ).alias(SEQ), F.max_by(ROW, SEQ).alias(ROW))
    last = deletes.groupBy(KEY).agg(
        F.max(SEQ).alias("__any"), F.max(F.when(F.col(HARD), F.col(SEQ))).alias("__hard_seq")
    )
    i, d = newest.alias("i"), last.alias("d")
    gone = (F.col(f"i.{KEY}") == F.col(f"d.{KEY}")) & (
        (F.col("d.__any") > F.col(f"i.{SEQ}"))
        | (F.coalesce(F.col("d.__hard_seq") >= F.col(f"i.{SEQ}"), F.lit(False)))
    )
    return i.join(d, gone, "left_anti").select(f"{ROW}.*")


class EqualityDeleteTable:
    """A table in a folder as append-only ``data`` and ``deletes`` files with sequence numbers, a folder for each batch.

    Cases: an empty table reads as empty once a batch (even an empty one) gave it its columns; a table never written to has
    no columns and can't be read; a batch applied twice changes nothing, and one whose number is committed isn't written
    again; what a writer left behind without committing is never read; columns of any name are kept apart from the table's own.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, seq: str, tombstone: str):
        self.spark, self.path, self.key, self.seq, self.tombstone = spark, path.rstrip("/"), key, seq, tombstone
        self.commits = Commits(spark, self.path)

    def append(self, changes: DataFrame, batch: int | str | None = None) -> None:
        """Write a batch and commit it. ``batch`` names it, as a stream does; without a name it is a batch of its own."""
        name = uuid.uuid4().hex if batch is None else f"batch-{batch}"
        if self.commits.has(name):
            return
        self._write(name, *split_changes(changes, self.key, self.seq, F.col(self.tombstone)))

    def _write(self, name: str, inserts: DataFrame, deletes: DataFrame) -> None:
        inserts.write.mode("overwrite").parquet(f"{self.path}/{name}/data")
        deletes.write.mode("overwrite").parquet(f"{self.path}/{name}/deletes")
        self.commits.add(name)

    def _files(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}/{kind}" for name in self.commits.all()])

    def read(self, columns: list[str] | None = None) -> DataFrame:
        """The live rows, of ``columns`` if given: other columns then are neither read nor shuffled."""
        data = self._files("data")
        if columns is not None:
            data = data.select(KEY, SEQ, F.struct(*[F.col(f"{ROW}.`{c}`").alias(c) for c in columns]).alias(ROW))
        return merge_on_read(data, self._files("deletes"))

    def compact(self, to: str) -> EqualityDeleteTable:
        """Write the live rows to another folder. Deletes stay: a change older than one may yet arrive."""
        other = EqualityDeleteTable(self.spark, to, self.key, self.seq, self.tombstone)
        live = self.read()
        rows = live.select(F.col(self.key).alias(KEY), F.col(self.seq).alias(SEQ), F.struct(*[F.col(f"`{c}`") for c in live.columns]).alias(ROW))
        other._write("compacted", rows, self._files("deletes").groupBy(KEY, HARD).agg(F.max(SEQ).alias(SEQ)).select(KEY, SEQ, HARD))
        return other


def current_state(changes: DataFrame, key: str = "key", seq: str = "version", tombstone: str = "tombstone") -> DataFrame:
    """Live rows of a change feed without files between: each key's newest row, deleted keys left out.

    Null keys and sequence numbers count for nothing; a null tombstone is false; only ``tombstone`` deletes,
    whatever the value holds; an empty feed gives an empty table; all columns of the feed are kept.
    """
    return merge_on_read(*split_changes(changes, key, seq, F.col(tombstone)))
