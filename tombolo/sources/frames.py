"""Checksummed frames in binary files, and their recovery after damage.

A frame is two magic bytes, a CRC-32 of the payload, its length, both little-
endian, and the payload. The reader goes on after damage at the next place
where a whole frame stands, so that damage costs the frames it hit and no
others. The payload of a change is JSON.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC = b"\x43\x44"
HEADER = 10
NOT_ENOUGH, WRONG_MAGIC, WRONG_CHECKSUM, UNPARSED, GOOD = "not_enough_bytes", "magic_mismatch", "checksum_mismatch", "parse_error", "ok"


def encode(payload: bytes) -> bytes:
    return MAGIC + zlib.crc32(payload).to_bytes(4, "little") + len(payload).to_bytes(4, "little") + payload


def entry_payload(op: str, key: str, value: str | None) -> bytes:
    return json.dumps({"op": op, "key": key, **({"value": value} if op == "set" else {})}, ensure_ascii=False, separators=(",", ":")).encode()


def entry_of(payload: bytes) -> tuple[str, str, str | None] | None:
    """(op, key, value) of a payload, or None where it is no change."""
    try:
        d = json.loads(payload.decode())
        op, key, value = d["op"], d["key"], d.get("value")
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    ok = isinstance(key, str) and (op == "set" and isinstance(value, str) or op == "delete" and value is None)
    return (op, key, value) if ok else None


def status_at(content: bytes, at: int) -> tuple[str, int]:
    """(status, end) of the frame at a place: size, magic, length, checksum and payload are tested in this order.

    A frame of no payload at the end of a file is taken for too few bytes.
    """
    if len(content) - at <= HEADER:
        return NOT_ENOUGH, at
    if content[at : at + 2] != MAGIC:
        return WRONG_MAGIC, at
    end = at + HEADER + int.from_bytes(content[at + 6 : at + 10], "little")
    if end > len(content):
        return NOT_ENOUGH, at
    payload = content[at + HEADER : end]
    if zlib.crc32(payload) != int.from_bytes(content[at + 2 : at + 6], "little"):
        return WRONG_CHECKSUM, at
    return (GOOD if entry_of(payload) else UNPARSED), end


def scan(content: bytes, report: bool = False) -> Iterator[tuple[int, str, bytes | None]]:
    """(offset, status, payload) of all whole frames, and with ``report`` of each place where reading broke off.

    Only places of the magic bytes can begin a frame; the search leaps from one to the next.
    """
    at, broken = 0, False
    while at < len(content):
        status, end = status_at(content, at)
        if status == GOOD:
            yield at, status, content[at + HEADER : end]
            at, broken = end, False
            continue
        if report and not broken:
            yield at, status, None
        broken = True
        at = content.find(MAGIC, at + 1)
        if at < 0:
            return


def has_at_least_one(content: bytes) -> bool:
    """Does a whole frame stand anywhere in ``content``?"""
    return next(scan(content), None) is not None


def encoded(changes: DataFrame) -> DataFrame:
    """Adds ``frame``, the bytes of each change, made by SQL functions alone."""
    payload = F.to_json(F.struct("op", "key", F.when(F.col("op") == "set", F.col("value")).alias("value"))).cast("binary")
    return changes.withColumn("_payload", payload).withColumn("frame", F.concat(F.lit(MAGIC), _little(F.crc32("_payload")), _little(F.octet_length("_payload").cast("long")), F.col("_payload"))).drop("_payload")


def _little(number: Column) -> Column:
    """The low four bytes of a number, lowest first."""
    digits = F.lpad(F.hex(number), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]))


def read(files: DataFrame, content: str = "content", report: bool = False) -> DataFrame:
    """(path, offset, status, op, key, value) of the frames in ``files`` (path, content).

    A file is one row and so one task's work; a log is written as many files of
    a bounded size. Frames that do not parse are left out, or reported.
    """

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, at, status, *(entry_of(p) if p is not None else (None, None, None))) for at, status, p in scan(data or b"", report)]
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "offset", "status", "op", "key", "value"])

    return files.select("path", F.col(content)).mapInArrow(decode, "path string, offset long, status string, op string, key string, value string")


def non_empty(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, any): does a file of (path, content) hold a whole frame?"""

    def test(batches):
        import pyarrow as pa

        for batch in batches:
            found = [has_at_least_one(data or b"") for data in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], ["path", "any"])

    return files.select("path", F.col(content)).mapInArrow(test, "path string, any boolean")


def read_logs(spark, path: str, report: bool = False) -> DataFrame:
    """The frames of all files below a path."""
    return read(spark.read.format("binaryFile").load(path), report=report)
