"""Sample tables and timing: running sums, run-length expansion, as-of lookup, offsets, repetition, frame units, tiles.

Orders must be unique within their partition, else which of the tied rows comes first is not defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INFINITE = 0xFFFFFFFF


def exclusive_running_sum(df: DataFrame, value: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the sum of value over earlier rows of the same keys; 0 for the first."""
    earlier = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("long"))


def rle_expand(df: DataFrame, count: str, name: str = "nth") -> DataFrame:
    """Each row count times, numbered from 1; rows with a null count or one below 1 go. No shuffle."""
    n = F.col(count).cast("long")
    return df.where(n > 0).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), n)))


def asof_last(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], take: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the last right row of its keys at or before it (strict: before it), by union and one window."""
    pos = [f"__o{i}" for i in range(len(left_order))]
    struct = F.struct(*(F.col(c).alias(c) for c in take))
    l_rows = left.select(*keys, *(F.col(c).alias(p) for c, p in zip(left_order, pos, strict=True)), F.lit(0 if strict else 1).alias("__side"), F.struct("*").alias("__left"), F.lit(None).cast(right.select(struct.alias("s")).schema["s"].dataType).alias("__right"))
    r_rows = right.select(*keys, *(F.col(c).alias(p) for c, p in zip(right_order, pos, strict=True)), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(l_rows.schema["__left"].dataType).alias("__left"), struct.alias("__right"))
    upto = W.partitionBy(*keys).orderBy(*pos, "__side").rowsBetween(W.unboundedPreceding, 0)
    found = l_rows.union(r_rows).withColumn("__found", F.last("__right", ignorenulls=True).over(upto)).where(F.col("__left").isNotNull())
    return found.select("__left.*", *(F.col("__found")[c].alias(f"asof_{c}") for c in take))


def repetition(entries: DataFrame, key: str, media_time: Column, duration: Column) -> DataFrame:
    """key, kind (finite, infinite, unknown) and n (finite: entries - 1) of each edit list."""
    grouped = entries.groupBy(key).agg(
        F.bool_or((media_time == 0) & (duration == INFINITE)).alias("endless"), F.bool_and(media_time == 0).alias("zero"), F.min(duration).alias("low"), F.max(duration).alias("high"), F.count("*").alias("entries"),
    )
    finite = F.col("zero") & (F.col("low") == F.col("high"))
    kind = F.when(F.col("endless"), "infinite").when(finite, "finite").otherwise("unknown")
    return grouped.select(key, kind.alias("kind"), F.when(kind == "finite", F.col("entries") - 1).alias("n"))


def units(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "unit") -> DataFrame:
    """Adds the number of the unit a row belongs to; a unit begins where starts holds, rows before the first are unit 0."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)).cast("long"))


def slots(samples: DataFrame, key: str, order: str, mask: str, count: int = 8) -> DataFrame:
    """Adds slots: what each of the reference slots holds when a sample begins, the order value of the last earlier sample whose mask has
    the slot's bit (null: none). streaming.playback keeps the same state sample by sample."""
    earlier = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    taken = [F.last(F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.col(order)), ignorenulls=True).over(earlier) for i in range(count)]
    return samples.withColumn("slots", F.array(*taken))


def merge_tiles(tiles: DataFrame, key: str, tile: str, size: str, counts: DataFrame, count: str) -> DataFrame:
    """key, fault, tile, offset, size: each key's tiles re-offset in id order (ids 0..count - 1), or one row with its fault.

    bitstream: no tiles expected, an id that occurs twice or is outside; unsupported: ids that are missing. counts: a row per key;
    tiles of keys that it lacks are left out.
    """
    each = tiles.groupBy(key).agg(F.count("*").alias("__n"), F.countDistinct(tile).alias("__d"), F.min(tile).alias("__low"), F.max(tile).alias("__top"))
    bad = (F.col(count) < 1) | (F.col("__low") < 0) | (F.col("__top") >= F.col(count)) | (F.col("__n") > F.col("__d"))
    fault = F.when(bad, "bitstream").when(F.coalesce("__d", F.lit(0)) < F.col(count), "unsupported")
    checked = counts.select(key, count).join(each.hint("merge"), key, "left").select(key, fault.alias("fault"))
    whole = exclusive_running_sum(tiles.join(checked.where("fault is null").hint("merge"), key), F.col(size), [key], [tile], "offset").select(key, "fault", tile, "offset", size)
    return whole.unionByName(checked.where("fault is not null"), allowMissingColumns=True)
