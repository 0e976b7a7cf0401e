"""Boxes of ISO base media files as rows.

A box is a 32-bit big-endian size and four type bytes; size 1 is followed by a 64-bit size, size 0 reaches the end of what
holds it. One file is one row of Spark's binaryFile source, so a file is read by one task and files spread over tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the container format: boxes that hold boxes, and the bytes before their first child.
CONTAINERS = {b"meta": 4, b"moov": 0, b"trak": 0, b"edts": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"iprp": 0, b"ipco": 0, b"grpl": 0}
SCHEMA = "path string, box_no long, parent_no long, depth int, type string, offset long, header long, size long, error string"


def scan(data: bytes) -> Iterator[tuple]:
    """(box_no, parent_no, depth, type, offset, header bytes, size, error) in file order; a damaged box ends its parent's list with an error row."""
    number = 0
    stack = [(0, len(data), None, 0)]  # position, end, parent, depth
    while stack:
        at, end, parent, depth = stack.pop()
        if at >= end:
            continue
        if end - at < 8:
            yield number, parent, depth, None, at, 0, end - at, "truncated header"
            number += 1
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        header = 8
        if size == 1:
            if end - at < 16:
                yield number, parent, depth, kind.decode("latin-1"), at, 8, end - at, "truncated size"
                number += 1
                continue
            size, header = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < header or at + size > end:
            yield number, parent, depth, kind.decode("latin-1"), at, header, size if size < 1 << 63 else None, "size outside its parent"
            number += 1
            continue
        yield number, parent, depth, kind.decode("latin-1"), at, header, size, None
        stack.append((at + size, end, parent, depth))
        if kind in CONTAINERS:
            stack.append((at + header + CONTAINERS[kind], at + size, number, depth + 1))
        number += 1


def boxes(files: DataFrame) -> DataFrame:
    """A row per box of every file. files: path and content, as binaryFile gives them; null content has no boxes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(scan(content.as_py() or b""))
                if found:
                    number, parent, depth, kind, offset, header, size, error = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([path] * len(found), pa.string()), pa.array(number, pa.int64()), pa.array(parent, pa.int64()), pa.array(depth, pa.int32()), pa.array(kind, pa.string()),
                        pa.array(offset, pa.int64()), pa.array(header, pa.int64()), pa.array(size, pa.int64()), pa.array(error, pa.string()),
                    ], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of all files below a path."""
    return boxes(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
