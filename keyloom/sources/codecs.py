"""Binary layouts of log frames, sorted tables, sibling sets and commands; all numbers big-endian."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

from keyloom.sources.files import Ranges

#: Bytes of a log read at once.
PIECE = 4 << 20

# Fixed values of the formats.
MAX_FRAME = 64 << 20
PUT, DELETE = 1, 2
BLOCK_BYTES = 4096
TABLE_MAGIC = b"LSM2"
FOOTER = struct.Struct(">qqiq4sI")
SIBLINGS_FORMAT = 2
TOMBSTONE_FLAG = 1
RECORD_KINDS = {1: "TERM", 2: "VOTE", 3: "ENTRY", 4: "TRUNCATE", 5: "SNAPSHOT"}


class Corruption(ValueError):
    """Data that can't be what was written."""


def frame(payload: bytes) -> bytes:
    return struct.pack(">iI", len(payload), zlib.crc32(payload)) + payload


def frames(data: bytes | Ranges) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of a log's frames. A torn tail ends the log; a bad checksum with data after it is corruption.

    A length out of bounds reads as a torn tail wherever it stands, as there is no way on from it. A file is read in pieces.
    """
    size = len(data) if isinstance(data, bytes) else data.size
    held, held_at = (data, 0) if isinstance(data, bytes) else (b"", 0)

    def need(at: int, n: int) -> int:
        """Where in ``held`` the n bytes at ``at`` begin."""
        nonlocal held, held_at
        if at < held_at or at + n > held_at + len(held):
            held, held_at = data.at(at, max(n, PIECE)), at
        return at - held_at

    at = 0
    while at + 8 <= size:
        i = need(at, 8)
        n, crc = struct.unpack_from(">iI", held, i)
        if n < 0 or n > MAX_FRAME or at + 8 + n > size:
            return
        i = need(at + 8, n)
        payload = held[i : i + n]
        if zlib.crc32(payload) != crc:
            if at + 8 + n < size:
                raise Corruption(f"bad checksum at offset {at}")
            return
        yield at, payload
        at += 8 + n


def valid_bytes(data: bytes | Ranges) -> int:
    """Length of the part that :func:`frames` reads: where a writer would cut the file."""
    end = 0
    for at, payload in frames(data):
        end = at + 8 + len(payload)
    return end


def _block(data: bytes, at: int) -> tuple[bytes | None, int]:
    (n,) = struct.unpack_from(">i", data, at)
    return (None, at + 4) if n < 0 else (data[at + 4 : at + 4 + n], at + 4 + n)


def _sized(value: bytes | None) -> bytes:
    return struct.pack(">i", -1) if value is None else struct.pack(">i", len(value)) + value


def encode_change(key: str, value: bytes | None) -> bytes:
    """A put, or with a null value a delete."""
    return bytes([DELETE if value is None else PUT]) + _sized(key.encode()) + _sized(b"" if value is None else value)


def decode_change(payload: bytes) -> tuple[str, str, bytes | None]:
    kind = payload[0]
    if kind not in (PUT, DELETE):
        raise Corruption(f"unknown record type {kind}")
    key, at = _block(payload, 1)
    value, _ = _block(payload, at)
    return ("PUT" if kind == PUT else "DELETE"), (key or b"").decode(), value if kind == PUT else None


def table_bytes(entries: Iterable[tuple[str, bytes | None, int]], bloom: bytes = b"") -> Iterator[bytes]:
    """A sorted table a block at a time: checksummed blocks, filter bytes, sparse index, footer. Keys must strictly increase."""
    index, block, first, last, at, count, top = [], bytearray(), "", None, 0, 0, 0

    def close() -> bytes:
        index.append((first, at, len(block) + 4))
        return bytes(block) + struct.pack(">I", zlib.crc32(bytes(block)))

    for key, value, seq in entries:
        if last is not None and key.encode() <= last.encode():
            raise ValueError(f"keys must increase: {key!r} after {last!r}")
        if not block:
            first = key
        block += _sized(key.encode()) + _sized(value) + struct.pack(">q", seq)
        last, count, top = key, count + 1, max(top, seq) if count else seq
        if len(block) >= BLOCK_BYTES:
            out = close()
            at += len(out)
            block = bytearray()
            yield out
    if block:
        out = close()
        at += len(out)
        yield out
    tail = bloom + struct.pack(">i", len(index)) + b"".join(_sized(key.encode()) + struct.pack(">qi", offset, n) for key, offset, n in index)
    head = struct.pack(">qqiq4s", at, at + len(bloom), count, top, TABLE_MAGIC)
    yield tail + head + struct.pack(">I", zlib.crc32(head))


def encode_table(entries: Iterable[tuple[str, bytes | None, int]], bloom: bytes = b"") -> bytes:
    return b"".join(table_bytes(entries, bloom))


def table_footer(tail: bytes) -> dict:
    """Footer fields of a table's last bytes; corruption if the magic or the checksum is wrong."""
    if len(tail) < FOOTER.size:
        raise Corruption("too short for a table")
    raw = tail[-FOOTER.size :]
    bloom_at, index_at, count, max_seq, magic, crc = FOOTER.unpack(raw)
    if magic != TABLE_MAGIC or zlib.crc32(raw[:-4]) != crc:
        raise Corruption("bad table footer")
    return {"bloom_at": bloom_at, "index_at": index_at, "count": count, "max_seq": max_seq}


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def at(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length]


def table_index(data: bytes | Ranges, footer: dict) -> list[tuple[str, int, int]]:
    """(first key, offset, length) of each block."""
    source = _Bytes(data) if isinstance(data, bytes) else data
    raw = source.at(footer["index_at"], source.size - FOOTER.size - footer["index_at"])
    (n,) = struct.unpack_from(">i", raw, 0)
    at, out = 4, []
    for _ in range(n):
        key, at = _block(raw, at)
        offset, length = struct.unpack_from(">qi", raw, at)
        out.append(((key or b"").decode(), offset, length))
        at += 12
    return out


def table_scan(data: bytes | Ranges, start: str | None = None, end: str | None = None) -> Iterator[tuple[str, bytes | None, int]]:
    """(key, value, seq) with start <= key < end, tombstones included; only footer, index and the blocks between the bounds are read."""
    source = _Bytes(data) if isinstance(data, bytes) else data
    index = table_index(data, table_footer(source.at(max(0, source.size - FOOTER.size), FOOTER.size)))
    for i, (first, at, n) in enumerate(index):
        if end is not None and first.encode() >= end.encode():
            return
        if start is not None and i + 1 < len(index) and index[i + 1][0].encode() <= start.encode():
            continue
        raw = source.at(at, n)
        if zlib.crc32(raw[:-4]) != struct.unpack(">I", raw[-4:])[0]:
            raise Corruption(f"bad block at offset {at}")
        pos, stop = 0, len(raw) - 4
        while pos < stop:
            key, pos = _block(raw, pos)
            value, pos = _block(raw, pos)
            (seq,) = struct.unpack_from(">q", raw, pos)
            pos += 8
            k = (key or b"").decode()
            if (start is None or k.encode() >= start.encode()) and (end is None or k.encode() < end.encode()):
                yield k, value, seq


def encode_siblings(siblings: list[dict]) -> bytes:
    """Siblings as dicts of value, version, tombstone and clock (node to counter)."""
    out = bytearray(struct.pack(">bi", SIBLINGS_FORMAT, len(siblings)))
    for s in siblings:
        out += struct.pack(">qbi", s["version"], TOMBSTONE_FLAG if s["tombstone"] else 0, len(s["clock"]))
        for node, n in s["clock"].items():
            raw = node.encode()
            out += struct.pack(">H", len(raw)) + raw + struct.pack(">q", n)
        out += _sized(s["value"])
    return bytes(out)


def decode_siblings(data: bytes) -> list[dict]:
    if not data or data[0] != SIBLINGS_FORMAT:
        raise Corruption("unknown format of a sibling set")
    (n,), at, out = struct.unpack_from(">i", data, 1), 5, []
    for _ in range(n):
        version, flags, entries = struct.unpack_from(">qbi", data, at)
        at, clock = at + 13, {}
        for _ in range(entries):
            (size,) = struct.unpack_from(">H", data, at)
            node = data[at + 2 : at + 2 + size].decode()
            (clock[node],) = struct.unpack_from(">q", data, at + 2 + size)
            at += 10 + size
        value, at = _block(data, at)
        out.append({"value": value, "version": version, "tombstone": bool(flags & TOMBSTONE_FLAG), "clock": clock})
    return out


def encode_command(op: str, client: str, seq: int, key: str, value: bytes | None) -> bytes:
    return bytes([1 if op == "PUT" else 0]) + _sized(client.encode()) + struct.pack(">q", seq) + _sized(key.encode()) + _sized(value)


def decode_command(data: bytes) -> tuple[str, str, int, str, bytes | None]:
    client, at = _block(data, 1)
    (seq,) = struct.unpack_from(">q", data, at)
    key, at = _block(data, at + 8)
    value, _ = _block(data, at)
    return ("PUT" if data[0] == 1 else "DELETE"), (client or b"").decode(), seq, (key or b"").decode(), value


def encode_record(kind: str, term: int | None = None, idx: int | None = None, voted_for: str | None = None, data: bytes = b"") -> bytes:
    """A record of a node's log file by kind."""
    tag = bytes([next(k for k, v in RECORD_KINDS.items() if v == kind)])
    vote = _sized((voted_for or "").encode())
    if kind == "TERM":
        return tag + struct.pack(">q", term) + vote
    if kind == "VOTE":
        return tag + vote
    if kind == "TRUNCATE":
        return tag + struct.pack(">q", idx)
    pair = (term, idx) if kind == "ENTRY" else (idx, term)
    return tag + struct.pack(">qq", *pair) + _sized(data)


def decode_record(payload: bytes) -> dict:
    kind = RECORD_KINDS.get(payload[0])
    out = {"kind": kind, "term": None, "voted_for": None, "idx": None, "command": None}
    if kind == "TERM":
        (out["term"],) = struct.unpack_from(">q", payload, 1)
        out["voted_for"] = (_block(payload, 9)[0] or b"").decode()
    elif kind == "VOTE":
        out["voted_for"] = (_block(payload, 1)[0] or b"").decode()
    elif kind == "TRUNCATE":
        (out["idx"],) = struct.unpack_from(">q", payload, 1)
    elif kind == "ENTRY":
        out["term"], out["idx"] = struct.unpack_from(">qq", payload, 1)
        out["command"] = _block(payload, 17)[0]
    elif kind == "SNAPSHOT":
        out["idx"], out["term"] = struct.unpack_from(">qq", payload, 1)
        out["command"] = _block(payload, 17)[0]
    else:
        raise Corruption(f"unknown record type {payload[0]}")
    return out
