"""SimHash near-duplicates with a pigeonring filter.

A fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64 values (seed 42) of the text's word shingles,
repeats included. Fingerprints of a distance up to `distance` are linked, and groups are the links' components.

Search: the bits are cut into `distance + 1` segments on a ring. If the segments' differences add up to at most t of m, some
chain of consecutive segments has every prefix of l segments within floor(l * t / m) (pigeonring; t < m makes the first
segment equal). So distinct fingerprints meet by an equi-join of (start, first segment), or of the first two segments with one
side listing every second segment within its budget once there are more than `narrow` fingerprints. Pairs then pass chain
prefixes of growing length before the full Hamming check.

Exact copies and equal fingerprints are one node before any pair is formed. Where many fingerprints share a bucket, it is cut
into blocks of `block` and tasks get pairs of blocks, so no task holds more than two blocks; a task reports only the links that
join its own forest, never all pairs of a group. Links that are left out connect nodes that the reported ones connect already.

Defined results: null text is empty; no words give fingerprint zero, which is linked like any other; fewer words than a
shingle are one shingle; rows that repeat a doc_id are one node if their fingerprints link them; a null doc_id gets its
fingerprint and its group's smallest id (null if none has one); empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_ASCII, components, forest, sorted_runs, stage, text_bytes

SEED = 42


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(sizes + 1) - 1
    start = stop - sizes
    digest = xxhash.xxh64_intdigest
    spans = zip(start[:n].tolist(), stop[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    values = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # 64 bytes a value while they are counted
        ones += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, ids: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """ids and fp, the fingerprint as a signed long."""
    picked = docs.select(*ids, docs[text_col].alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + ", fp long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in text_bytes(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*batch.schema.names[:-1], "fp"])

    return picked.mapInArrow(run, schema)


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of distance + 1 segments of nearly equal width."""
    m = distance + 1
    return [(i * 64 // m, (i + 1) * 64 // m - i * 64 // m) for i in range(m)]


def _mask(segment: tuple[int, int]) -> np.uint64:
    return np.uint64(((1 << segment[1]) - 1) << segment[0])


def chain_links(left: np.ndarray, right: np.ndarray, start: int, distance: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of left and right within the distance whose chain from segment start holds at every prefix. same: left is right, each pair once."""
    cut = segments(distance)
    m = len(cut)
    found = []
    for at in range(0, len(left), 256):
        diff = left[at : at + 256, None] ^ right[None, :]
        mask, near = np.uint64(0), None
        for l in range(1, m + 1):  # the last prefix is the whole ring: the full check
            mask |= _mask(cut[(start + l - 1) % m])
            budget = l * distance // m
            if near is None:
                near = np.nonzero(np.bitwise_count(diff & mask) <= budget)
                if same:
                    near = tuple(x[near[1] > near[0] + at] for x in near)
                held = diff[near]
            else:
                ok = np.bitwise_count(held & mask) <= budget
                near, held = tuple(x[ok] for x in near), held[ok]
        found.append((near[0] + at, near[1]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))


def links(fps: DataFrame, distance: int = 4, narrow: int = 4_000_000, block: int = 4096, prefix: int | None = None) -> DataFrame:
    """a, b (a < b as longs): links between distinct fingerprints (column fp) that connect whatever pairs within the distance connect."""
    cut = segments(distance)
    m = len(cut)
    if not 0 <= distance <= 31:
        raise ValueError("distance must be 0 to 31")
    prefix = prefix or (1 if m < 3 or fps.count() <= narrow else 2)
    part = lambda c, i: F.shiftrightunsigned(c, cut[i % m][0]).bitwiseAND(F.lit((1 << cut[i % m][1]) - 1).cast("long"))
    rows = []
    for i in range(m):
        first = part(F.col("fp"), i)
        if prefix == 1:
            keys = F.array(F.struct(first.alias("key"), F.lit(True).alias("own")))
        else:  # one side lists what the second segment may be
            w = cut[(i + 1) % m][1]
            budget = 2 * distance // m
            if budget > 1:
                raise ValueError("two segments are for budgets of one difference")
            second = part(F.col("fp"), i + 1)
            joined = lambda flip, f=first, s=second: F.shiftleft(f, 32).bitwiseOR(s.bitwiseXOR(F.lit(flip).cast("long")))
            keys = F.array(*(F.struct(joined(flip).alias("key"), F.lit(flip == 0).alias("own")) for flip in (0, *((1 << k) for k in range(w if budget else 0)))))
        # one parameter only: transform() gives a second one the element's index
        rows.append(F.transform(keys, (lambda chain: lambda k: F.struct(chain.alias("chain"), k["key"].alias("key"), k["own"].alias("own")))(F.lit(i))))
    listed = fps.select("fp", F.explode(F.concat(*rows)).alias("k")).select("fp", "k.*")
    sizes = listed.groupBy("chain", "key").agg(F.count("*").alias("n"), F.count_if("own").alias("owners"))
    # a bucket matters if it has two members and one of them owns its key
    blocks = sizes.where("n > 1 and owners > 0").withColumn("blocks", F.expr(f"int((n + {block - 1}) div {block})")).select("chain", "key", "blocks")
    member = listed.join(blocks, ["chain", "key"]).withColumn("own_block", F.expr("int(pmod(xxhash64(fp), blocks))"))
    # block i meets each block j >= i in the cell (i, j)
    cells = member.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("chain", "key", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"), "own_block", "own", "fp")
    order = ["chain", "key", "i", "j"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for (chain, _, i, j), t in sorted_runs(batches, order):
            fp = t["fp"].to_numpy().view(np.uint64)
            mine = t["own_block"].to_numpy()
            own = t["own"].to_numpy(zero_copy_only=False)
            left, right = fp[(mine == i) & own], fp[mine == j]
            if prefix == 1:
                a, b = chain_links(left, right, chain, distance, i == j)
                sides = [(left[a], right[b])]
            else:  # owners against all; in a mixed cell both ways
                a, b = chain_links(left, right, chain, distance, False)
                sides = [(left[a], right[b])]
                if i != j:
                    left, right = fp[(mine == j) & own], fp[mine == i]
                    a, b = chain_links(left, right, chain, distance, False)
                    sides.append((left[a], right[b]))
            a, b = (np.concatenate(x) for x in zip(*sides, strict=True))
            keep = forest(a, b)
            out_a.append(a[keep].view(np.int64))
            out_b.append(b[keep].view(np.int64))
            if len(out_a) >= 2048:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    pairs = cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, ids: tuple[str, ...] = ("doc_id",), text_col: str = "text", **search) -> DataFrame:
    """One row per row of docs: ids, fp and component_id, the smallest doc_id (the first of ids) of its group."""
    prints = stage(fingerprints(docs, shingle, ids, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(ids[0]).alias("least"))
    nodes = stage(nodes, "nodes")
    roots = components(links(nodes.select("fp"), distance, **search))
    # fingerprints first: what the rows join is one small row per distinct fingerprint
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(*ids, "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of docs with one document of each group: the one with the smallest doc_id; of rows that repeat it, one."""
    found = near_duplicates(docs, distance, shingle)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["doc_id"])
