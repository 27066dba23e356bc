"""Data sources for binary files of a store: write-ahead logs, sorted tables and replicated-log files.

    register(spark)
    spark.read.format("kv_wal").load(folder)      # path, offset, op, key, value
    spark.read.format("kv_table").load(folder)    # path, key, value, seq; options start (inclusive) and end bound the keys
    spark.read.format("kv_table_footer").load(folder) # path, entries, max_seq
    spark.read.format("kv_raft_log").load(folder) # path, offset, kind, term, voted_for, idx, command

A file is one partition, opened where the task runs through the file system its URI names, so folders may lie on any storage
that executors share. Files are only read: where a log's tail is torn, reading stops there, and ``kv_wal_status``
reports the place. Missing folders read as empty. Logs are read in pieces; of a table only the footer, the index and the
blocks between the bounds are read, of ``kv_table_footer`` only the last bytes. Bounds are options
and not pushed filters: what a Python source is pushed in one plan still holds in the next plan of the same DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keyloom.sources import codecs
from keyloom.sources.files import Ranges, Whole, listed


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _FileReader(DataSourceReader):
    pattern = "*"

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p) for p in listed(self.options["path"], self.options.get("pattern", self.pattern))] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if partition.path:
            with Ranges(partition.path) as file:
                yield from self.rows(partition.path, file)

    def rows(self, path: str, file: Ranges) -> Iterator[tuple]:
        raise NotImplementedError


class WalReader(_FileReader):
    pattern = "*.wal"

    def rows(self, path: str, file: Ranges) -> Iterator[tuple]:
        for offset, payload in codecs.frames(file):
            yield (path, offset, *codecs.decode_change(payload))


class WalStatusReader(_FileReader):
    pattern = "*.wal"

    def rows(self, path: str, file: Ranges) -> Iterator[tuple]:
        end = codecs.valid_bytes(file)
        yield path, file.size, end, None if end == file.size else end


class RaftLogReader(_FileReader):
    pattern = "*.wal"

    def rows(self, path: str, file: Ranges) -> Iterator[tuple]:
        for offset, payload in codecs.frames(file):
            r = codecs.decode_record(payload)
            yield path, offset, r["kind"], r["term"], r["voted_for"], r["idx"], r["command"]


class TableReader(_FileReader):
    pattern = "*.sst"

    def rows(self, path: str, file: Ranges) -> Iterator[tuple]:
        for key, value, seq in codecs.table_scan(file, self.options.get("start"), self.options.get("end")):
            yield path, key, value, seq


class FooterReader(_FileReader):
    pattern = "*.sst"

    def rows(self, path: str, file: Ranges) -> Iterator[tuple]:
        n = codecs.FOOTER.size
        foot = codecs.table_footer(file.at(max(0, file.size - n), n))
        yield path, foot["count"], foot["max_seq"]


class _Source(DataSource):
    label, columns, reader_class = "", "", _FileReader

    @classmethod
    def name(cls) -> str:
        return cls.label

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return self.reader_class(dict(self.options))


class WalSource(_Source):
    label, columns, reader_class = "kv_wal", "path string, offset bigint, op string, key string, value binary", WalReader


class WalStatusSource(_Source):
    label, columns, reader_class = "kv_wal_status", "path string, bytes bigint, valid_bytes bigint, truncated_at bigint", WalStatusReader


class TableSource(_Source):
    label, columns, reader_class = "kv_table", "path string, key string, value binary, seq bigint", TableReader


class RaftLogSource(_Source):
    label, columns, reader_class = "kv_raft_log", "path string, offset bigint, kind string, term bigint, voted_for string, idx bigint, command binary", RaftLogReader


class FooterSource(_Source):
    label, columns, reader_class = "kv_table_footer", "path string, entries bigint, max_seq bigint", FooterReader


def register(spark: SparkSession) -> None:
    for source in (WalSource, WalStatusSource, TableSource, FooterSource, RaftLogSource):
        spark.dataSource.register(source)


def read_tables(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Entries with start <= key < end of a folder's tables; None is open."""
    register(spark)
    reader = spark.read.format("kv_table")
    for name, bound in (("start", start), ("end", end)):
        reader = reader if bound is None else reader.option(name, bound)
    return reader.load(folder)


def _write(rows: DataFrame, folder: str, suffix: str, encode: Callable[[Iterator[tuple]], Iterator[bytes]]) -> None:
    """A file a partition, of what ``encode`` makes of its rows as they pass; into a folder all executors share. Empty partitions leave none."""
    folder = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        file, n = Whole(f"{folder}/part-{ctx.partitionId():05d}{suffix}", ctx.taskAttemptId()), 0

        def passing() -> Iterator[tuple]:
            nonlocal n
            for b in batches:
                n += b.num_rows
                yield from zip(*(c.to_pylist() for c in b.columns))

        for data in encode(passing()):
            if n:
                file.write(data)
        file.commit()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows.mapInArrow(write, "n bigint").agg({"n": "sum"}).collect()


def write_tables(entries: DataFrame, folder: str, presorted: bool = False) -> None:
    """Write merged entries (key, value, seq) as sorted binary tables, one a range of keys; keys that don't strictly increase are an error.

    ``presorted`` takes partitions and their order as they are.
    """
    ordered = entries.select("key", "value", "seq")
    _write(ordered if presorted else ordered.repartitionByRange("key").sortWithinPartitions("key"), folder, ".sst", codecs.table_bytes)


def write_wal(changes: DataFrame, folder: str, order: str) -> None:
    """Append changes (key, value null = delete) as checksummed frames in the order of ``order``, a log a range."""
    ordered = changes.select("key", "value", order).repartitionByRange(order).sortWithinPartitions(order)
    _write(ordered, folder, ".wal", lambda rows: (codecs.frame(codecs.encode_change(r[0], r[1])) for r in rows))


def write_records(records: DataFrame, folder: str) -> None:
    """Write a node's log records (offset, kind, term, voted_for, idx, command) as one file, as a node's log is one."""
    ordered = records.select("offset", "kind", "term", "idx", "voted_for", "command").repartition(1).sortWithinPartitions("offset")
    _write(ordered, folder, ".wal", lambda rows: (codecs.frame(codecs.encode_record(kind, term, idx, vote, command or b"")) for _, kind, term, idx, vote, command in rows))
