"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then a seeded choice of blocks.

1. Sizes: words per document; targets by source (weights 1, 2, 3 repeating in code-point order, null last), water-filled so
   that none exceeds `most` times its source's size.
2. The target of each source is cut into blocks of `block` words; Sainte-Lague (highest quotients target / (2k + 1)) gives each
   source an integer quota of all blocks, and again each shard of a source an integer share of that quota by shard size.
3. Within a shard the source's documents stand in seeded order, as one stream of words cut into blocks. A quota over the number
   of blocks takes whole passes; the rest goes to the blocks that the seed ranks first. No block is taken more than `most` times.

Shards are hashes of the document, so a hot source is spread over all of them, and no window is larger than a shard. A source's
shards are apportioned by levels of `fan`, so no group is larger either. Only one row per source reaches the driver: sources are
names that people gave, at most `SOURCES` of them (an error says so), and over 100,000 are joined by a shuffle instead of a
broadcast. One row per (source, shard) meets in joins; texts are never shuffled.

Defined results: null text has size 0 and taken 0; null source is a source of its own, the last; repeated rows share their
document's place by an ordinal and are counted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stage

WEIGHTS = (1, 2, 3)
#: What the driver can hold at some 100 bytes a source.
SOURCES = 1_000_000
_WORDS = re.compile(WORD)


def water_fill(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none over most times its own size; what is cut off goes to the others by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (Fraction(most * sizes[i], weights[i]), i))
    left, weight, out = Fraction(sum(sizes)), sum(weights), [0.0] * len(sizes)
    for i in order:
        part = min(Fraction(most * sizes[i]), left * weights[i] / weight)
        out[i] = float(part)
        left, weight = left - part, weight - weights[i]
    return out


def sainte_lague(shares: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients share / (2k + 1), ties to the earlier; most bounds each one's seats (their sum is all that is dealt).

    The first seats come from rounding at a divisor just too large, so the heap only hands out the few that are left.
    """
    n, most = len(shares), most or [seats] * len(shares)
    total = sum(shares)
    if not total or seats <= 0:
        return [0] * n
    exact = [Fraction(s) * seats / Fraction(total) for s in shares]
    # at the divisor that fits, the quotients add up to seats within n / 2: no one gets less than this
    out = [min(m, max(0, int(e * (1 - Fraction(n, 2 * seats)) - Fraction(1, 2)))) for e, m in zip(exact, most, strict=True)]
    slack = sum(out)
    heap = [(-Fraction(s) / (2 * o + 1), i) for i, (s, o) in enumerate(zip(shares, out, strict=True)) if s > 0 and o < most[i]]
    heapq.heapify(heap)
    for _ in range(min(seats, sum(most)) - slack):
        if not heap:
            raise RuntimeError("seats are left, but no share may take them")
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-Fraction(shares[i]) / (2 * out[i] + 1), i))
    return out


def source_plan(sizes: list[tuple[str | None, int]], block: int, most: int = 3, weights: tuple[int, ...] = WEIGHTS) -> list[tuple]:
    """(source_no, source, source_size, target, quota in blocks) for each source, in code-point order, null last."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    targets = water_fill([n for _, n in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
    quotas = sainte_lague(targets, round(sum(targets) / block))
    return [(i, s, n, t, q) for i, ((s, n), t, q) in enumerate(zip(rows, targets, quotas, strict=True))]


def block_words(total: int, largest: int = 256, blocks: int = 65536) -> int:
    """Words of a block: largest, or less where that would give fewer than so many blocks."""
    return max(1, min(largest, total // blocks))


def mix_sources(docs: DataFrame, seed: int = 20, most: int = 3, per_shard: int = 2048, block: int | None = None, ids: tuple[str, ...] = ("doc_id",), text_col: str = "text", source_col: str = "source", fan: int = 1024) -> DataFrame:
    """One row per row of docs: ids, size, source_size, target, taken, and parts: the taken runs of its words as
    array<struct<start, end, times>>, ends exclusive. per_shard: documents of a shard, about; fan: shards apportioned at once."""
    spark = docs.sparkSession
    sized = docs.select(*ids, docs[source_col].alias("source"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stage(sized, "sizes")
    if (n_sources := sized.select("source").distinct().count()) > SOURCES:
        raise ValueError(f"{n_sources} sources; targets are set on the driver for {SOURCES} at most")
    per_source = [(r["source"], r["n"], r["docs"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()]
    total, rows = sum(n for _, n, _ in per_source), sum(d for *_, d in per_source)
    block = block or block_words(total)
    plan = source_plan([(s, n) for s, n, _ in per_source], block, most)
    few = len(plan) <= 100_000  # a row is some 100 bytes; more sources than that are joined by a shuffle
    plan = spark.createDataFrame(plan, "source_no int, source_key string, source_size long, target double, quota long")
    plan = F.broadcast(plan) if few else plan
    shards = max(1, rows // per_shard)
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("source_key"))).withColumn("mark", F.xxhash64(F.lit(seed), *ids)).withColumn("shard", F.expr(f"int(pmod(mark, {shards}))"))

    def apportion(key, pdf):
        pdf = pdf.sort_values("part")
        seats = sainte_lague(pdf["shard_size"].tolist(), int(pdf["quota"].iloc[0]), [most * b for b in pdf["blocks"].tolist()])
        return pdf.assign(taken_blocks=seats)[["source_no", "part", "upper", "shard_size", "blocks", "taken_blocks"]]

    def dealt(rows: DataFrame, *group: str) -> DataFrame:
        return rows.groupBy("source_no", *group).applyInPandas(apportion, "source_no int, part long, upper long, shard_size long, blocks long, taken_blocks long")

    # a row per shard of a source; `fan` of them get their blocks as one, and each of those from its own ones, level by level
    blocks = F.when(F.col("shard_size") > 0, F.greatest(F.lit(1).cast("long"), F.round(F.col("shard_size") / block).cast("long"))).otherwise(F.lit(0).cast("long"))
    shard_sizes = placed.groupBy("source_no", F.col("shard").cast("long").alias("part")).agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    levels, parts = [stage(shard_sizes.withColumn("blocks", blocks), "shard-sizes")], shards
    while parts > fan:
        up = levels[-1].groupBy("source_no", F.expr(f"part div {fan}").alias("part")).agg(F.sum("shard_size").alias("shard_size"), F.first("quota").alias("quota"), F.sum("blocks").alias("blocks"))
        levels, parts = [*levels, stage(up, "shard-groups")], -(-parts // fan)
    with_upper = lambda rows: rows.withColumn("upper", F.expr(f"part div {fan}"))
    quotas = dealt(with_upper(levels[-1]))
    for rows in reversed(levels[:-1]):
        above = stage(quotas, "group-quotas").select("source_no", F.col("part").alias("upper"), F.col("taken_blocks").alias("quota"))
        quotas = dealt(with_upper(rows.drop("quota")).join(above, ["source_no", "upper"]), "upper")
    quotas = quotas.select("source_no", F.col("part").cast("int").alias("shard"), "shard_size", "blocks", "taken_blocks")
    key = ["source_no", "shard"]
    in_shard = W.partitionBy(*key)
    by_seed = in_shard.orderBy("mark", *ids, "size")
    ordered = placed.withColumn("place", F.row_number().over(by_seed)).withColumn("stop", F.sum("size").over(by_seed.rowsBetween(W.unboundedPreceding, 0)))
    ordered = ordered.join(quotas, key).withColumn("start", F.col("stop") - F.col("size"))
    first, last = F.expr("((start + 1) * blocks - 1) div shard_size"), F.expr("(stop * blocks - 1) div shard_size")
    pieces = ordered.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    chosen = quotas.where("blocks > 0").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rank = F.row_number().over(in_shard.orderBy(F.xxhash64(F.lit(seed), *key, "block"), "block"))
    chosen = chosen.select(*key, "block", F.expr("taken_blocks div blocks").alias("whole"), (rank <= F.expr("taken_blocks % blocks")).cast("long").alias("more"))
    # merge: a size estimate misses the explode and would broadcast the blocks
    pieces = pieces.join(chosen.hint("merge"), [*key, "block"]).select(
        *key, "place",
        (F.greatest("start", F.expr("block * shard_size div blocks")) - F.col("start")).alias("a"),
        (F.least("stop", F.expr("(block + 1) * shard_size div blocks")) - F.col("start")).alias("b"),
        (F.col("whole") + F.col("more")).alias("times"),
    )
    taken = pieces.where("times > 0").groupBy(*key, "place").agg(F.sum(F.expr("(b - a) * times")).alias("taken"), F.sort_array(F.collect_list(F.struct(F.col("a").alias("start"), F.col("b").alias("end"), "times"))).alias("parts"))
    out = ordered.join(taken, [*key, "place"], "left")
    return out.select(*ids, "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("parts", F.expr("cast(array() as array<struct<start: long, end: long, times: long>>)")).alias("parts"))


def taken_text(text: str, parts: list[dict]) -> str:
    """The taken words of a text, pass by pass, one pass a paragraph; a pass over all words is the text as it is."""
    words = [m.span() for m in _WORDS.finditer(text)]
    passes = []
    for k in range(1, max((p["times"] for p in parts), default=0) + 1):
        runs: list[list[int]] = []
        for p in parts:
            if p["times"] < k:
                continue
            if runs and runs[-1][1] == p["start"]:
                runs[-1][1] = p["end"]
            else:
                runs.append([p["start"], p["end"]])
        whole = runs == [[0, len(words)]]
        passes.append(text if whole else "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs))
    return "\n\n".join(passes)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: columns as they are, text cut to the taken words and repeated as often as they are taken.

    Documents without a taken word go; n_chars, if there, is counted anew. Rows that repeat doc_id and text are told apart by a
    number, so each gets its own share.
    """
    same = W.partitionBy("doc_id", "__mark").orderBy("__mark")
    numbered = docs.withColumn("__mark", F.xxhash64("text")).withColumn("__copy", F.row_number().over(same))
    mix = mix_sources(numbered, ids=("doc_id", "__mark", "__copy"), **how).where("taken > 0")
    mix = mix.select(F.col("doc_id").alias("__id"), F.col("__mark").alias("__text"), F.col("__copy").alias("__no"), F.col("parts").alias("__parts"))
    joined = numbered.join(mix.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__text")) & (F.col("__copy") == F.col("__no"))).select(*docs.columns, "__parts")
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [taken_text(t or "", p) for t, p in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -1]], names=batch.schema.names[:-1])

    out = joined.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
