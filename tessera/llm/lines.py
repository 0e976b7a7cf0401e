"""Fuzzy line deduplication by MinHash.

Lines are what lies between line feeds; lines without a word are left alone. Two lines are near if the Jaccard similarity of
their character-shingle sets is at least `threshold`; equal lines always are. Of each component of near lines the first by
(doc_id, line number) stays and all others are cut out of their documents.

1. Signatures (numpy, one pass): shingle hashes by doubling, one-permutation MinHash into bands * rows bins, empty bins filled by
   optimal densification. At similarity 0.8, 12 bands of 4 rows let a pair meet with probability 0.998.
2. Banding: (band key, line id) rows meet by key. A bucket's lines are not paired: each is paired with the bucket's smallest id.
   Buckets whose lines the links so far leave in several components are searched again, in blocks, by sketches: bit sets of the
   shingles, whose common bits bound the similarity from above, so a pair that they rule out can't be near. What passes is
   verified; where that is far more than the lines, only a forest of it at first, and all that still joins two components
   after that. So the components are those of all pairs in all buckets, and the rows do not grow with a bucket's square.
3. Exact verification on the lines' texts, of which only candidates leave the scan (a Bloom filter of at most 8 MB tells them;
   what it lets through besides costs only time).
4. Distributed union-find, then one position per component, and one join that brings the kept positions to their documents.

Common lines are one node whatever their number, and positions are combined before they are shuffled. Ids are XXH64 values of
the lines (two of n different lines share one with probability n * n / 2^65).

Defined results: null text stays null; a line shorter than a shingle is near only to equal lines; a document all of whose lines
with words were cut keeps the rest (keep_unique_lines() drops it); rows that repeat doc_id and text keep and lose the same
lines; empty tables give no rows; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_ASCII, components, forest, stage, text_bytes

SEED = 42
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bits of the largest Bloom filter.
MOST_BITS = 1 << 26


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of so many code points."""
    have, out, done = codes.astype(np.uint64) + MIX[0], None, 0
    width, factor = 1, MIX[0]
    while True:
        if size & width:  # runs of powers of two, joined as size's bits say
            if out is None:
                out, done = have[: len(codes) - width + 1], width
            else:
                n = len(codes) - done - width + 1
                out, done = out[:n] * factor + have[done : done + n], done + width
        if (width << 1) > size:
            return _scramble(out)
        n = len(codes) - 2 * width + 1
        have = have[:n] * factor + have[width : width + n]
        width, factor = width * 2, np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)


def char_hashes(lines: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lines' shingles, one line after the other, and how many each has (0: shorter than a shingle)."""
    texts = [x.decode() for x in lines]
    count = np.maximum(0, np.fromiter(map(len, texts), np.int64, len(texts)) - size + 1)
    joined = np.frombuffer("\n".join(t for t, n in zip(texts, count.tolist(), strict=True) if n).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(joined):
        return np.empty(0, np.uint64), count
    h, own = shingle_hashes(joined, size), count[count > 0]
    start = np.concatenate(([0], np.cumsum(own + size)[:-1]))
    return h[np.repeat(start - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(own.sum())], count


def word_hashes(items: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """As char_hashes(), for shingles of words; fewer words than a shingle are one, none have none."""
    out, count = [], []
    for item in items:
        words = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in item.split()), np.uint64)
        if len(words):
            words = words - MIX[0]
            out.append(shingle_hashes(words, min(size, len(words))))
        count.append(max(1, len(words) - size + 1) if len(words) else 0)
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.array(count, np.int64)


def text_lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def whole_words(text: bytes) -> list[bytes]:
    """The whole text as one item: its words in ASCII lower case."""
    return [b" ".join(text.translate(LOWER_ASCII).split())]


@dataclass(frozen=True)
class Items:
    """What is compared: how a text falls into items, and the shingles of an item."""

    cut: Callable[[bytes], list[bytes]] = text_lines
    hashes: Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray]] = char_hashes
    size: int = 8


LINES = Items()
DOCUMENTS = Items(whole_words, word_hashes, 5)


def signatures(h: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (items, bands) of items that have count shingles each, one at least."""
    bins = bands * rows
    line = np.repeat(np.arange(len(count)), count)
    at = line.astype(np.uint64) * np.uint64(bins) + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32))
    key = np.sort((at << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
    cell = key >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sig = np.full(len(count) * bins, -1, np.int64)
    sig[cell[first].astype(np.int64)] = (key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sig = sig.reshape(len(count), bins)
    empty = sig < 0
    todo = np.flatnonzero(empty.any(1))
    rng = np.random.default_rng(SEED)  # the same donors in every task
    for attempt in range(1, 1025):
        if not len(todo):
            break
        donor = rng.integers(0, bins, bins)
        part, full = sig[todo], ~empty[todo]
        take = (part < 0) & full[:, donor]
        part[take] = (part[:, donor] + (attempt << 33))[take]
        sig[todo] = part
        todo = todo[(part < 0).any(1)]
    keys = np.zeros((len(count), bands), np.uint64)
    values = sig.astype(np.uint64).reshape(len(count), bands, rows)
    for r in range(rows):
        keys = _scramble(keys * MIX[0] + values[:, :, r] + np.uint64(r + 1))
    return _scramble(keys + np.arange(bands, dtype=np.uint64) * MIX[0])


def line_id(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line, SEED)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def band_rows(docs: DataFrame, items: Items, bands: int, rows: int) -> DataFrame:
    """key, id of every band of every different item that a shingle fits into."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: dict[int, bytes] = {}
        room = 0

        def pack() -> pa.RecordBatch:
            h, count = items.hashes(list(held.values()), items.size)
            ids = np.fromiter(held, np.uint64, len(held))[count > 0]
            keys = signatures(h, count[count > 0], bands, rows) if len(ids) else np.empty((0, bands), np.uint64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, bands).view(np.int64))], names=["key", "id"])

        for batch in batches:
            for text in text_bytes(batch):
                for item in items.cut(text):
                    if not item or (i := line_id(item)) in seen or not item.strip():
                        continue
                    seen.add(i)
                    held[i] = item
                    room += len(item)
                    if room > 1 << 18:
                        yield pack()
                        room = 0
                if len(seen) > 2_000_000:
                    seen.clear()
        if held:
            yield pack()

    return docs.select("text").mapInArrow(run, "key long, id long")


def bucket_members(bands: DataFrame) -> DataFrame:
    """key, id, rep (the bucket's smallest id) of buckets with two lines or more; a bucket streams through, never held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = rep = last = None  # of the run that the batch before ended in; pending: its first line waits for a second
        pending = False
        for batch in batches:
            k, i = (c.to_numpy() for c in batch.columns)
            if not len(k):
                continue
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
            if key is not None and k[0] == key and i[0] == last:
                fresh[0] = False
            carried = key is not None and k[0] == key
            k, i = k[fresh], i[fresh]
            if carried and pending and len(k) and k[0] == key:  # the waiting line stands before its second
                k, i = np.concatenate(([key], k)), np.concatenate(([rep], i))
                carried = False
            if not len(k):
                continue
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.append(starts, len(k)))
            reps = i[starts].copy()
            goes_on = carried and k[0] == key
            if goes_on:
                reps[0] = rep
            emit = size > 1
            if goes_on:
                emit[0] = True
            if not (len(starts) == 1 and goes_on):
                pending = bool(size[-1] == 1)
            key, rep, last = k[-1], reps[-1], i[-1]
            rows = np.repeat(emit, size)
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[rows]), pa.array(i[rows]), pa.array(np.repeat(reps, size)[rows])], names=["key", "id", "rep"])

    return bands.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long, rep long")


def bloom_bits(ids: DataFrame, n: int) -> np.ndarray:
    """Bits of a Bloom filter (2 hashes) of the long column id: 12 bits an id, MOST_BITS at most."""
    bits = 1 << max(16, min(MOST_BITS.bit_length() - 1, (12 * n).bit_length()))
    spots = ids.select(F.explode(F.array(*(F.shiftrightunsigned("id", s).bitwiseAND(F.lit(bits - 1).cast("long")) for s in (0, 31)))).alias("h"))
    words = spots.groupBy(F.expr("h div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(h % 64))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_bloom(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for s in (0, 31):
        h = (ids >> np.uint64(s)) & np.uint64(64 * len(bits) - 1)
        ok &= ((bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
    return ok


def line_texts(docs: DataFrame, ids: DataFrame, items: Items = LINES) -> DataFrame:
    """id, line for the ids, and for few others."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom_bits(ids, ids.count()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            lines = {i: x for t in text_bytes(batch) for x in items.cut(t) if x and (i := line_id(x)) not in seen}
            keys = np.fromiter(lines, np.uint64, len(lines))
            keys = keys[in_bloom(bits.value, keys)]
            found = keys.tolist()
            seen = seen | set(found) if len(seen) < 1_000_000 else set(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([lines[i] for i in found], pa.binary()).cast(pa.string())], names=["id", "line"])

    return docs.select("text").mapInArrow(run, "id long, line string").groupBy("id").agg(F.any_value("line").alias("line"))


#: Items whose sets are made together, and the bits that their numbers take of a sort key; shingle hashes keep the others.
TOGETHER = 1 << 14


def shingle_sets(items: Items, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles' hashes (50 bits) of at most TOGETHER items, one item after the other and each in order, and how many each has."""
    h, count = items.hashes(lines, items.size)
    key = np.sort((np.repeat(np.arange(len(lines), dtype=np.uint64), count) << np.uint64(50)) | (h >> np.uint64(14)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key & np.uint64((1 << 50) - 1), np.bincount((key >> np.uint64(50)).astype(np.int64), minlength=len(lines))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at start, one run after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def similarities(items: Items, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The Jaccard similarity of the shingle sets of each pair of items, at most TOGETHER / 2 pairs; 0 without shingles."""
    place: dict[bytes, int] = {}
    at = np.array([[place.setdefault(x, len(place)) for x in side] for side in (left, right)], np.int64)
    sets, n = shingle_sets(items, list(place))
    start = np.cumsum(n) - n
    pair = np.repeat(np.arange(len(left), dtype=np.uint64), n[at[0]]), np.repeat(np.arange(len(left), dtype=np.uint64), n[at[1]])
    key = np.sort(np.concatenate([(p << np.uint64(50)) | sets[_spread(start[k], n[k])] for p, k in zip(pair, at, strict=True)]))
    twice = (key[1:][key[1:] == key[:-1]] >> np.uint64(50)).astype(np.int64)
    both = np.bincount(twice, minlength=len(left))
    return both / np.maximum(1, n[at[0]] + n[at[1]] - both)


def _chunks(sizes: Iterable[int], most: int, rows: int) -> Iterator[slice]:
    """Stretches of so many rows and of sizes that add up to about `most`."""
    start, total, k = 0, 0, -1
    for k, size in enumerate(sizes):
        total += size
        if total >= most or k + 1 - start >= rows:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start <= k:
        yield slice(start, k + 1)


def verified(pairs: DataFrame, texts: DataFrame, items: Items, threshold: float) -> DataFrame:
    """pairs (a, b) with near: whether the exact Jaccard similarity of the sets of the shingles' hashes reaches the threshold."""
    left, right = (texts.select(F.col("id").alias(f"{s}_id"), F.col("line").alias(f"{s}_line")) for s in "ab")
    joined = pairs.join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id")).select("a", "b", "a_line", "b_line")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = text_bytes(batch, "a_line"), text_bytes(batch, "b_line")
            near = [np.empty(0, bool)]
            for c in _chunks((len(x) + len(y) for x, y in zip(one, two, strict=True)), 1 << 19, TOGETHER // 2):
                near.append(similarities(items, one[c], two[c]) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(near))], names=["a", "b", "near"])

    return joined.mapInArrow(run, "a long, b long, near boolean")


def sketch_rows(items: Items, lines: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """How many different shingles each of at most TOGETHER items has, and their bit sets."""
    sets, n = shingle_sets(items, lines)
    width = np.left_shift(1, np.clip(np.ceil(np.log2(4 * n + 1)).astype(np.int64), 6, 16))
    start = np.cumsum(width) - width
    bits = np.zeros(width.sum(), bool)
    bits[np.repeat(start, n) + (sets.astype(np.int64) & (np.repeat(width, n) - 1))] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return n, [packed[a : a + w] for a, w in zip((start // 8).tolist(), (width // 8).tolist(), strict=True)]


def sketches(texts: DataFrame, items: Items) -> DataFrame:
    """id, n (different shingles), bits: a set of 4 to 8 bits a shingle, 64 at least and 65536 at most, with each shingle's bit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = text_bytes(batch, "line")
            for c in _chunks(map(len, lines), 1 << 19, TOGETHER):
                n, bits = sketch_rows(items, lines[c])
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.start : c.stop], pa.array(n, pa.int32()), pa.array(bits, pa.binary())], names=["id", "n", "bits"])

    return texts.mapInArrow(run, "id long, n int, bits binary")


def possible(left: tuple, right: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in left and right of the pairs in different components that may reach the threshold, and the bound of their
    similarity. A side: n, root, bits (rows of words, equally wide on both sides). A bit that only one side has set stands for a
    shingle that only it has."""
    (ln, lroot, lbits), (rn, rroot, rbits) = left, right
    lset, rset = (np.bitwise_count(b).sum(1, dtype=np.int64) for b in (lbits, rbits))
    order, found = np.argsort(ln, kind="stable"), []
    step = max(1, (1 << 22) // max(1, rbits.size))
    for at in range(0, len(order), step):
        rows = order[at : at + step]
        cols = np.flatnonzero((rn >= threshold * ln[rows[0]] - 1) & (rn * threshold <= ln[rows[-1]] + 1))
        if not len(cols):
            continue
        common = np.bitwise_count(lbits[rows, None] & rbits[None, cols]).sum(2, dtype=np.int64)
        most = np.minimum((ln[rows] - lset[rows])[:, None], (rn[cols] - rset[cols])[None]) + common
        bound = most / np.maximum(1, ln[rows][:, None] + rn[cols][None] - most)
        a, b = np.nonzero((bound >= threshold - 1e-9) & (lroot[rows][:, None] != rroot[cols][None]))
        found.append((rows[a], cols[b], bound[a, b]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))


#: Lines of a cell whose pairs are listed; larger cells are searched line by block.
LISTED = 48


@dataclass
class Rows:
    """Lines in cells: id, root, n, mine (the block) and the bit sets, as words from `first` on, `width` words each."""

    ids: np.ndarray
    root: np.ndarray
    n: np.ndarray
    mine: np.ndarray
    first: np.ndarray
    width: np.ndarray
    words: np.ndarray

    @staticmethod
    def of(t: pa.RecordBatch) -> Rows:
        bits = t.column("bits")
        edges = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        data = np.frombuffer(bits.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        words = np.frombuffer(data.tobytes(), np.uint64)
        return Rows(*(t.column(c).to_numpy() for c in ("id", "root", "n", "mine")), (edges[:-1] - edges[0]) // 8, np.diff(edges) // 8, words)

    def bits(self, at: np.ndarray, width: int) -> np.ndarray:
        """Bit sets of lines of the width, or of twice as many words: then folded."""
        rows = self.words[self.first[at][:, None] + np.arange(width)]
        double = self.width[at] == 2 * width
        rows[double] |= self.words[self.first[at[double]][:, None] + np.arange(width, 2 * width)]
        return rows


def listed_pairs(rows: Rows, starts: np.ndarray, sizes: np.ndarray, same: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Of small cells: the pairs in different components that may reach the threshold, the bound of their similarity, and their cell's
    place in starts. same: whether a cell is of one block."""
    one, two, cell = [], [], []
    for k in np.unique(sizes[sizes > 1]).tolist():
        at, (p, q) = np.flatnonzero(sizes == k), np.triu_indices(k, 1)
        one.append((starts[at][:, None] + p).ravel())
        two.append((starts[at][:, None] + q).ravel())
        cell.append(np.repeat(at, len(p)))
    if not one:
        return (np.empty(0, int),) * 2 + (np.empty(0),) + (np.empty(0, int),)
    one, two, cell = (np.concatenate(x) for x in (one, two, cell))
    n, m = rows.n[one].astype(np.int64), rows.n[two].astype(np.int64)
    ok = (rows.root[one] != rows.root[two]) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
    ok &= same[cell] | (rows.mine[one] != rows.mine[two])
    one, two, cell = one[ok], two[ok], cell[ok]
    width, bound = np.minimum(rows.width[one], rows.width[two]), np.zeros(len(one))
    bound[np.maximum(rows.width[one], rows.width[two]) > 2 * width] = -1  # near sets' sizes are of one width or of two neighbours
    for w in np.unique(width).tolist():
        fit = np.flatnonzero((width == w) & (bound >= 0))
        for at in range(0, len(fit), max(1, (1 << 18) // w)):
            now = fit[at : at + max(1, (1 << 18) // w)]
            left, right = rows.bits(one[now], w), rows.bits(two[now], w)
            n, m = rows.n[one[now]].astype(np.int64), rows.n[two[now]].astype(np.int64)
            common, a, b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (left & right, left, right))
            most = np.minimum(n - a, m - b) + common
            bound[now] = most / np.maximum(1, n + m - most)
    ok = bound >= threshold - 1e-9
    return one[ok], two[ok], bound[ok], cell[ok]


def block_pairs(rows: Rows, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As listed_pairs(), of the rows of one cell of any size."""
    found = []
    by_width = {w: np.flatnonzero(rows.width == w) for w in np.unique(rows.width).tolist()}
    for w, at in by_width.items():
        for v, to in by_width.items():
            if v != w and v != 2 * w:
                continue
            a, b, bound = possible((rows.n[at], rows.root[at], rows.bits(at, w)), (rows.n[to], rows.root[to], rows.bits(to, w)), threshold)
            a, b = at[a], to[b]
            ok = (a < b) | (v != w)
            if not same:
                ok &= rows.mine[a] != rows.mine[b]
            found.append((a[ok], b[ok], bound[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cell_pairs(cells: DataFrame, threshold: float, dense: int | None) -> DataFrame:
    """a, b of the pairs in a cell that may be near. A cell with over `dense` pairs a line gives a forest of them, the likeliest
    pairs first, and a row of key, i, j; None: all cells give all pairs. Small cells are searched together, a batch at a time."""
    order = ["key", "i", "j"]
    names = [*order, "mine", "id", "root", "n", "bits"]

    def search(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The pairs of whole cells, which begin at starts."""
        rows = Rows.of(batch)
        key, i, j = (batch.column(c).to_numpy() for c in order)
        sizes, same = np.diff(np.append(starts, batch.num_rows)), i[starts] == j[starts]
        small = np.flatnonzero(sizes <= LISTED)
        found = [listed_pairs(rows, starts[small], sizes[small], same[small], threshold)]
        found = [(*found[0][:3], small[found[0][3]])]
        for c in np.flatnonzero(sizes > LISTED).tolist():
            own = slice(starts[c], starts[c] + sizes[c])
            part = Rows(rows.ids[own], rows.root[own], rows.n[own], rows.mine[own], rows.first[own], rows.width[own], rows.words)
            a, b, bound = block_pairs(part, bool(same[c]), threshold)
            found.append((a + starts[c], b + starts[c], bound, np.full(len(a), c)))
        a, b, bound, cell = (np.concatenate(x) for x in zip(*found, strict=True))
        marked = np.flatnonzero(np.bincount(cell, minlength=len(starts)) > dense * sizes) if dense is not None else np.empty(0, int)
        if len(marked):
            full = np.isin(cell, marked)
            keep = [np.flatnonzero(~full)]
            for c in marked.tolist():
                best = np.flatnonzero(cell == c)
                best = best[np.argsort(-bound[best], kind="stable")]
                keep.append(best[forest(rows.root[a[best]], rows.root[b[best]])])
            keep = np.concatenate(keep)
            a, b = a[keep], b[keep]
        none = pa.nulls(len(marked), pa.int64())
        at = starts[marked]
        yield pa.RecordBatch.from_arrays([
            *(pa.concat_arrays([pa.array(rows.ids[x]), none]) for x in (a, b)),
            *(pa.concat_arrays([pa.nulls(len(a), kind), pa.array(x[at], kind)]) for x, kind in ((key, pa.int64()), (i, pa.int32()), (j, pa.int32()))),
        ], names=["a", "b", *order])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # the last cell, which may go on; two blocks at most
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for c in order:
                column = batch.column(c).to_numpy()
                change[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(change)
            if len(starts) > 1:
                yield from search(batch.slice(0, starts[-1]), starts[:-1])
            rest = batch.slice(starts[-1])
        if rest is not None:
            yield from search(rest, np.zeros(1, int))

    return cells.select(*names).repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long, key long, i int, j int")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after more links (a, b): only the components that these join are searched again."""
    of = lambda c: roots.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root"))
    lifted = links.join(of("a"), F.col("a") == F.col("a_node"), "left").join(of("b"), F.col("b") == F.col("b_node"), "left")
    up = stage(components(lifted.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))), "joined-roots")
    moved = roots.join(up.select(F.col("node").alias("r0"), F.col("root").alias("r1")), F.col("root") == F.col("r0"), "left").select("node", F.coalesce("r1", "root").alias("root"))
    return stage(moved.union(up.join(roots, "node", "left_anti").select("node", "root")), "roots")


def near_items(docs: DataFrame, items: Items = LINES, threshold: float = 0.8, bands: int = 12, rows: int = 4, also: DataFrame | None = None, block: int = 2048, dense: int = 4) -> DataFrame:
    """node, root: the ids of items that are near others, and their component's smallest id. also: a, b of more pairs to verify."""
    members = stage(bucket_members(band_rows(docs, items, bands, rows)), "bucket-members")
    star = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    star = (star if also is None else star.union(also)).distinct()
    wanted = members.select("id") if also is None else members.select("id").union(also.select(F.explode(F.array("a", "b"))))
    texts = stage(line_texts(docs, wanted.distinct(), items), "candidates")
    roots = stage(components(verified(star, texts, items, threshold).where("near").select("a", "b")), "roots")
    # buckets whose lines no chain of links joins yet; equal sets of lines under other keys are found by other bands as well
    placed = members.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("lines")).where("least <> most")
    split = split.select("key", F.expr(f"int((lines + {block - 1}) div {block})").alias("blocks"))
    open_ = placed.join(split, "key").withColumn("mine", F.expr("int(pmod(xxhash64(id), blocks))"))
    cells = open_.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "root")
    cells = cells.join(sketches(texts, items), "id")
    found = stage(cell_pairs(cells, threshold, dense), "cell-pairs")
    pairs = lambda df: df.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = lambda df: verified(df, texts, items, threshold).where("near").select("a", "b")
    after = merged(roots, near(pairs(found)))
    full = found.where("key is not null").select("key", "i", "j")
    if full.isEmpty():
        return after
    again = cells.join(full, ["key", "i", "j"]).drop("root").join(after, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    rest = pairs(cell_pairs(again, threshold, None)).join(pairs(found), ["a", "b"], "left_anti")
    return merged(after, near(rest))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, size: int = 8, bands: int = 12, rows: int = 4, **search) -> DataFrame:
    """docs with text less its repeated lines, and two more columns: lines_before and lines_cut (lines with words)."""
    roots = near_items(docs, Items(size=size), threshold, bands, rows, **search)
    marked = docs.withColumn("__mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = marked.select(F.col("doc_id").alias("d"), F.col("__mark").alias("m"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(_has_word(F.col("line")))
    placed = lines.select("d", "m", "no", F.xxhash64("line").alias("id"))
    # equal lines are combined first; what meets the components is one row per different line
    first = placed.groupBy("id").agg(F.min(F.struct("d", "m", "no")).alias("at"))
    rooted = first.join(roots, F.col("id") == F.col("node"), "left").select(F.coalesce("root", "id").alias("root"), "at")
    kept = rooted.groupBy("root").agg(F.min("at").alias("at")).groupBy(F.col("at.d").alias("k_id"), F.col("at.m").alias("k_mark")).agg(F.collect_list("at.no").alias("__kept"))
    joined = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("__mark") == F.col("k_mark")), "left").drop("k_id", "k_mark", "__mark")
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, cut = [], [], []
            for text, keep in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                parts, keep = (text or "").split("\n"), set(keep or ())
                worded = [bool(p.strip(" \t\n\v\f\r")) for p in parts]
                before.append(sum(worded))
                cut.append(before[-1] - len(keep))
                texts.append(text if not cut[-1] else "\n".join(p for i, (p, w) in enumerate(zip(parts, worded, strict=True)) if not w or i in keep))
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -1], pa.array(before, pa.int64()), pa.array(cut, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lines_before", "lines_cut"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lines_before long, lines_cut long"
    return joined.mapInArrow(run, schema)


def keep_unique_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with the lines cut; documents that lost lines and have no other line with a word go. n_chars, if there, is counted anew."""
    out = dedup_lines(docs, **how).where((F.col("lines_cut") == 0) | (F.col("lines_cut") < F.col("lines_before")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines_cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
