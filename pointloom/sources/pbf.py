"""Nodes of OpenStreetMap PBF files.

A file is a sequence of length-prefixed blobs (one file is one row, so 2 GB at most: larger extracts are to be split).  Files are read as rows (``binaryFile``), cut into
blobs by one pass over their headers, dealt out again, and each blob is inflated and decoded on
its own, so one large file keeps many tasks busy.  Decoding follows the published format: primitive
blocks with granularity and offsets, plain and dense (delta-coded) nodes; other elements are skipped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import pointloom

cloudpickle.register_pickle_by_value(pointloom)

#: Rows handed back at once.
ROWS = 65_536


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def signed(value: int) -> int:
    """Zigzag-coded value."""
    return (value >> 1) ^ -(value & 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """The zigzag-coded values of a packed field, all at once: seven bits of each by turns."""
    octets = np.frombuffer(data, np.uint8)
    last = np.nonzero(octets < 128)[0]
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size, values = last - first + 1, np.zeros(len(last), np.uint64)
    for k in range(int(size.max(initial=0))):
        long = np.nonzero(size > k)[0]
        values[long] |= (octets[first[long] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def blobs(data: bytes) -> Iterator[bytes]:
    """Contents of the data blobs of a file, still compressed."""
    at = 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        head = dict(fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        if head.get(1) == b"OSMData":
            yield data[at : at + head[3]]
        at += head[3]


def inflate(blob: bytes) -> bytes:
    got = dict(fields(blob))
    if 1 in got:
        return got[1]
    if 3 in got:
        return zlib.decompress(got[3])
    raise ValueError("blob compression is neither none nor zlib")


def block_nodes(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, latitude, longitude) of the nodes of a primitive block, as arrays."""
    got = list(fields(block))
    scalar = {n: v for n, v in got if isinstance(v, int)}
    grain, lat0, lon0 = scalar.get(17, 100), scalar.get(19, 0), scalar.get(20, 0)
    lat0, lon0 = (v - (1 << 64) if v >> 63 else v for v in (lat0, lon0))
    parts = [np.zeros((3, 0), np.int64)]
    for group in (v for n, v in got if n == 2):
        for number, value in fields(group):
            if number == 1:
                node = dict(fields(value))
                parts.append(np.array([[signed(node[1])], [signed(node[8])], [signed(node[9])]], np.int64))
            elif number == 2:
                dense = dict(fields(value))
                parts.append(np.stack([np.cumsum(packed(dense.get(n, b""))) for n in (1, 8, 9)]))
    id, lat, lon = np.concatenate(parts, axis=1)
    return id, (lat0 + grain * lat) / 1e9, (lon0 + grain * lon) / 1e9


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """id, lat, lon of all nodes of the files at ``path``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for blob in blobs(content.as_py()):
                    yield pa.record_batch([pa.array([blob], pa.binary())], names=["blob"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                columns = block_nodes(inflate(blob.as_py()))
                for at in range(0, len(columns[0]), ROWS):
                    yield pa.record_batch([pa.array(c[at : at + ROWS]) for c in columns], names=["id", "lat", "lon"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(cut, "blob binary").repartition(spark.sparkContext.defaultParallelism).mapInArrow(decode, "id long, lat double, lon double")
