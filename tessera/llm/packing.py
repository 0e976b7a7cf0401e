"""Packing documents into training windows under a source mixture, by deficit round-robin.

Documents are tokenized once and staged. A hash of doc_id and row deals them to shards of some 2M tokens (so a hot source and rows
that repeat a doc_id lie in all shards), and each shard fills windows from its source queues: for each window a source earns its target share of the window as credit,
the queues are visited in turn and serve packets (at most `packet` tokens of the document at the head, cut freely) while their
credit lasts; room that is left goes to the source with the largest credit, which then owes it. Unspent credit and debts are
carried to the next window, and across shards: what shards before it served is known from their token counts alone, so a shard
starts with the exact deficits that a serial run would hand it, settled at half a source's share per window. Everything is
packed, so targets default to the sources' shares of all tokens; each shard ends with at most one window that isn't full.

Deficits run through `lane` shards at most, so the running sums over shards never meet in one task.

Defined results: null text is empty and still has its end token; null source is a source of its own; repeated rows are
packed each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stage

END = 0


class ByteBpe:
    """Token ids as tokenizers gives them for the JSON file.

    With ranks, texts of Latin-1 letters go through tiktoken, which has the same vocabulary and is four times as fast; other
    scripts, where the two libraries' Unicode tables could differ, and texts with a special token's mark don't.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_loaded: dict[tuple, ByteBpe] = {}


def _tokenizer(*paths: str | None) -> ByteBpe:
    if paths not in _loaded:
        _loaded[paths] = ByteBpe(*paths)
    return _loaded[paths]


def default_paths() -> tuple[str, str, str]:
    """JSON file, ranks and pattern of the public 50k byte vocabulary, where the package is installed."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def tokenize(docs: DataFrame, paths: tuple[str, str | None, str | None], text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n (with the end token), ids (little-endian, 2 bytes each if all fit, else 4: then wide is true) and row, a number of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(*paths)
        row = TaskContext.get().partitionId() << 33  # staged, so a row's number is settled before it is read
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [np.append(tok.ids(t or ""), np.uint32(END)) for t in part.column(2).to_pylist()]
                wide = [bool(len(i) and i.max() > 0xFFFF) for i in found]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(i) for i in found], pa.int64()),
                    pa.array([i.astype("<u4" if w else "<u2").tobytes() for i, w in zip(found, wide, strict=True)], pa.binary()), pa.array(wide),
                    pa.array(row + np.arange(len(found)), pa.int64()),
                ], names=["doc_id", "source", "n", "ids", "wide", "row"])
                row += len(found)

    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, "doc_id long, source string, n long, ids binary, wide boolean, row long")


def fill_windows(queues: list[list[tuple[int, int]]], shares: list[float], owed: list[float], window: int = 1024, packet: int = 128) -> list[tuple[int, int, int, int, int]]:
    """Deficit round-robin over one shard: pieces (document, start, length, window number, offset).

    queues: per source its (document, tokens) in order. owed: tokens by which earlier shards fell short of a source's share.
    """
    heads = [deque(q) for q in queues]
    at = [0] * len(queues)  # tokens of the head that are out already
    credit, debt = [0.0] * len(queues), list(owed)
    pieces: list[tuple[int, int, int, int, int]] = []
    live, turn, number = [s for s, q in enumerate(heads) if q], 0, 0

    def serve(s: int, n: int, offset: int) -> None:
        doc, total = heads[s][0]
        last = pieces[-1] if pieces else None
        if last and last[0] == doc and last[3] == number and last[1] + last[2] == at[s] and last[4] + last[2] == offset:
            pieces[-1] = (doc, last[1], last[2] + n, number, last[4])
        else:
            pieces.append((doc, at[s], n, number, offset))
        credit[s] -= n
        at[s] += n
        if at[s] == total:
            heads[s].popleft()
            at[s] = 0

    while live:
        filled = 0
        for s in live:
            earned = shares[s] * window
            settle = max(-earned / 2, min(earned / 2, debt[s]))
            debt[s] -= settle
            credit[s] += earned + settle
        first = turn % len(live)
        for s in live[first:] + live[:first]:
            while heads[s] and filled < window:
                n = min(packet, heads[s][0][1] - at[s])
                if credit[s] < n:
                    break
                n = min(n, window - filled)
                serve(s, n, filled)
                filled += n
        live = [s for s in live if heads[s]]
        while live and filled < window:
            s = max(live, key=credit.__getitem__)
            n = min(packet, heads[s][0][1] - at[s], window - filled)
            serve(s, n, filled)
            filled += n
            if not heads[s]:
                live.remove(s)
        turn, number = turn + 1, number + 1
    return pieces


def pack(docs: DataFrame, paths: tuple[str, str | None, str | None] | None = None, targets: dict[str | None, float] | None = None, window: int = 1024, packet: int = 128, shard_tokens: int = 2_000_000, lane: int = 1024, keep_ids: bool = False, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source (and ids, little-endian
    unsigned 32-bit, with keep_ids). targets: weights by source, default the sources' shares of all tokens."""
    tokens = stage(tokenize(docs, paths or default_paths(), text_col, source_col), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    shards = max(1, total // shard_tokens)
    dealt = tokens.withColumn("mark", F.xxhash64("doc_id", "row")).withColumn("shard", F.expr(f"pmod(mark, {shards}L)"))
    counts = stage(dealt.groupBy("shard", "source").agg(F.sum("n").alias("n")), "token-counts")
    if targets is None:
        weights = counts.groupBy(F.col("source").alias("weight_source")).agg((F.sum("n") / F.lit(max(1, total))).alias("share"))
    else:
        whole = sum(targets.values())
        weights = docs.sparkSession.createDataFrame([(s, w / whole) for s, w in targets.items()], "weight_source string, share double")
    lanes = F.expr(f"shard div {lane}L")
    of_shard = counts.groupBy("shard").agg(F.sum("n").alias("all"))
    earlier = W.partitionBy("lane").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    of_shard = of_shard.withColumn("lane", lanes).select("shard", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
    mine = W.partitionBy("lane", "source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    deficits = counts.withColumn("lane", lanes).withColumn("served", F.coalesce(F.sum("n").over(mine), F.lit(0))).join(of_shard, "shard")
    deficits = deficits.join(weights, F.col("source").eqNullSafe(F.col("weight_source")), "left").select("shard", "source", F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("share", F.lit(0.0)) * F.col("before") - F.col("served")).alias("owed"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        order = np.lexsort((left["n"].to_numpy(), left["doc_id"].fill_null(0).to_numpy(), left["mark"].to_numpy()))
        by_source: dict[str | None, list[tuple[int, int]]] = {}
        lengths, sources = left["n"].to_pylist(), left["source"].to_pylist()
        for i in order.tolist():
            by_source.setdefault(sources[i], []).append((i, lengths[i]))
        known = {s: (w, o) for s, w, o in zip(right["source"].to_pylist(), right["share"].to_pylist(), right["owed"].to_pylist(), strict=True)}
        names = sorted(by_source, key=lambda s: (s is None, s or ""))
        pieces = fill_windows([by_source[s] for s in names], [known[s][0] for s in names], [known[s][1] for s in names], window, packet)
        blobs, wide, ids = left["ids"].to_pylist(), left["wide"].to_pylist(), left["doc_id"].to_pylist()
        cut = [np.frombuffer(blobs[d], "<u4" if wide[d] else "<u2")[a : a + n].astype("<u4").tobytes() for d, a, n, *_ in pieces]
        columns = {
            "doc_id": pa.array([ids[p[0]] for p in pieces], pa.int64()), "start": pa.array([p[1] for p in pieces], pa.int64()), "length": pa.array([p[2] for p in pieces], pa.int64()),
            "ids_crc32": pa.array(map(zlib.crc32, cut), pa.int64()), "doc_tokens": pa.array([lengths[p[0]] for p in pieces], pa.int64()),
            "sequence_id": pa.array([(shard << 32) + p[3] for p in pieces], pa.int64()), "offset": pa.array([p[4] for p in pieces], pa.int64()), "source": pa.array([sources[p[0]] for p in pieces], pa.string()),
        }
        return pa.table(columns | ({"ids": pa.array(cut, pa.binary())} if keep_ids else {}))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + (", ids binary" if keep_ids else "")
    return dealt.groupBy("shard").cogroup(deficits.groupBy("shard")).applyInArrow(run, schema)
