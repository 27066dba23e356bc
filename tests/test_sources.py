import os
import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import lsm
from keyloom.sources import binary, codecs


def test_frames_and_torn_tails():
    data = b"".join(codecs.frame(codecs.encode_change(f"k{i}", b"v" * i)) for i in range(5))
    assert [codecs.decode_change(p)[1] for _, p in codecs.frames(data)] == [f"k{i}" for i in range(5)]
    assert len(list(codecs.frames(data[:-1]))) == 4 and codecs.valid_bytes(data + b"\0\0\0") == len(data)
    assert len(list(codecs.frames(data[:-1] + b"\xff"))) == 4  # a bad checksum at the very end
    with pytest.raises(codecs.Corruption):
        list(codecs.frames(data[:10] + b"\xff" + data[11:]))
    assert list(codecs.frames(b"")) == []
    assert codecs.decode_change(codecs.encode_change("k", b"")) == ("PUT", "k", b"") and codecs.decode_change(codecs.encode_change("k", None)) == ("DELETE", "k", None)


def test_tables():
    entries = [(f"k{i:05d}", None if i % 7 == 0 else b"x" * (i % 50), i) for i in range(2000)]
    data = codecs.encode_table(entries)
    foot = codecs.table_footer(data)
    assert foot["count"] == 2000 and foot["max_seq"] == 1999 and len(codecs.table_index(data, foot)) > 5
    assert list(codecs.table_scan(data)) == entries
    for lo, hi in (("k00100", "k00200"), (None, "k00003"), ("k01990", None), ("zz", None), ("k00100", "k00100"), (None, "")):
        assert list(codecs.table_scan(data, lo, hi)) == [e for e in entries if (lo is None or e[0] >= lo) and (hi is None or e[0] < hi)]
    with pytest.raises(ValueError):
        codecs.encode_table([("b", b"", 1), ("a", b"", 2)])
    with pytest.raises(codecs.Corruption):
        codecs.table_footer(data[:-1] + b"\0")
    with pytest.raises(codecs.Corruption):
        list(codecs.table_scan(b"\xff" + data[1:]))
    assert list(codecs.table_scan(codecs.encode_table([]))) == []


def test_sibling_sets_commands_and_records():
    s = [{"value": b"", "version": 3, "tombstone": True, "clock": {"é": 1, "b": -2}}, {"value": b"x", "version": 1, "tombstone": False, "clock": {}}]
    assert codecs.decode_siblings(codecs.encode_siblings(s)) == s
    with pytest.raises(codecs.Corruption):
        codecs.decode_siblings(b"\x01\0\0\0\0")
    for c in (("PUT", "c", 5, "k", b"v"), ("DELETE", "c", 6, "k", None)):
        assert codecs.decode_command(codecs.encode_command(*c)) == c
    for kind, kw in (("TERM", {"term": 4, "voted_for": "n"}), ("VOTE", {"voted_for": ""}), ("ENTRY", {"term": 1, "idx": 2, "data": b"c"}), ("TRUNCATE", {"idx": 9}), ("SNAPSHOT", {"term": 1, "idx": 7, "data": b"s"})):
        r = codecs.decode_record(codecs.encode_record(kind, **kw))
        assert r["kind"] == kind and all(r[k if k != "data" else "command"] == v for k, v in kw.items())


def test_read_through_spark(spark, tmp_path):
    binary.register(spark)
    rng = random.Random(1)
    e = [(f"k{rng.randint(0, 300):04d}", rng.choice([None, b"", b"v"]), i) for i in range(3000)]
    df = spark.createDataFrame(e, "key string, value binary, seq bigint")
    merged = lsm.newest_wins(df)
    binary.write_tables(merged, str(tmp_path / "t"))
    t = spark.read.format("kv_table").load(str(tmp_path / "t"))
    key = lambda d: sorted((r.key, None if r.value is None else bytes(r.value), r.seq) for r in d.collect())
    assert key(t) == key(merged)
    for lo, hi in (("k0100", "k0110"), ("k0290", None), (None, "k0003"), ("x", None), ("k0100", "k0050")):
        assert key(binary.read_tables(spark, str(tmp_path / "t"), lo, hi)) == key(merged.where(lsm.key_range(F.col("key"), lo, hi)))
    binary.write_wal(df, str(tmp_path / "w"), "seq")
    got = spark.read.format("kv_wal").load(str(tmp_path / "w"))
    assert got.count() == 3000 and got.where("op = 'DELETE'").count() == sum(v is None for _, v, _ in e)
    victim = next(p for p in sorted(os.listdir(tmp_path / "w")) if p.endswith(".wal"))
    with open(tmp_path / "w" / victim, "ab") as f:
        f.write(b"\0\0\0\x09abc")
    status = spark.read.format("kv_wal_status").load(str(tmp_path / "w"))
    assert status.where("truncated_at is not null").count() == 1 and got.count() == 3000
    assert spark.read.format("kv_wal").load(str(tmp_path / "none")).count() == 0


def test_only_needed_ranges_are_read(tmp_path):
    from keyloom.sources.files import Ranges, Whole, listed

    entries = [(f"k{i:06d}", b"x" * 100, i) for i in range(20_000)]
    path = f"file://{tmp_path}/t/part-0.sst"
    out = Whole(path, 1)
    for data in codecs.table_bytes(iter(entries)):
        out.write(data)
    assert listed(f"file://{tmp_path}/t", "*.sst") == []  # not there before it is whole
    out.commit()
    assert listed(f"file:{tmp_path}/t", "*.sst") and listed(str(tmp_path / "t"), "*.wal") == [] and listed(f"file://{tmp_path}/none", "*") == []
    with Ranges(path) as f:
        assert list(codecs.table_scan(f, "k000500", "k000503")) == entries[500:503] and f.read < f.size / 20
    with Ranges(path) as f:
        assert list(codecs.table_scan(f)) == entries


def test_logs_are_read_in_pieces(tmp_path, monkeypatch):
    from keyloom.sources.files import Ranges

    data = b"".join(codecs.frame(codecs.encode_change(f"k{i}", b"v" * (i % 300))) for i in range(500))
    monkeypatch.setattr(codecs, "PIECE", 64)
    for cut in (0, 1, 9, 200):
        (tmp_path / "l.wal").write_bytes(data[: len(data) - cut])
        with Ranges(str(tmp_path / "l.wal")) as f:
            assert list(codecs.frames(f)) == list(codecs.frames(data[: len(data) - cut]))
