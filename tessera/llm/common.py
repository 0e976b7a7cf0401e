"""Shared pieces of the training-data operators: staging, word rules, sorted-run streaming, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR; bytes.split() without arguments cuts at just these six.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z only, as bytes.translate() wants it.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Edges that one task contracts before the steps of components().
EDGES = 32768


def staging_dir(spark: SparkSession) -> str:
    """Folder for this application's staged tables, below the session's spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder; on a cluster that would not be shared, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Deletes what stage() wrote for this application; results not yet written become unreadable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8, null as empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of equal keys from batches sorted by keys, one group in memory at a time."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if key != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the pairs that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := root(x)) != (y := root(y)):
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def contracted(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """u, v (u > v): the same components from at most as many edges, each task's own joined to stars; it holds up to `most` at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (x := root(x)) != (y := root(y)):
                    parent[max(x, y)] = min(x, y)
            if len(parent) >= most:
                yield stars()
        if parent:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps: columns node, root, for every node of an edge.

    edges: two long columns, at least one of each linked pair in any order; loops and repeats are harmless, nulls are left
    out. root is the smallest node reachable. Every step is two shuffles on the edge list and its result is staged, so the
    lineage stays short; the driver sees only a count and a checksum. Edge counts never grow: a step replaces each edge by one.
    First each task contracts its own edges, about EDGES of them, so few are left to the steps and up to EDGES need none.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u"), F.col("v"))
        near = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both
        # small star: edges point from the larger node u to the smaller v
        least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        joined = near.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    now = stage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = mark(now)
    tasks = -(-seen[0] // EDGES)
    if seen[0]:
        now = stage(contracted(now.coalesce(tasks)), "edges")
        seen = mark(now) if tasks > 1 else (0, None)  # one task's stars are the components
    for _ in range(rounds if seen[0] else 0):
        now = stage(star(star(now, True), False), "edges")
        if (got := mark(now)) == seen:
            break
        seen = got
    else:
        if seen[0]:
            raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
