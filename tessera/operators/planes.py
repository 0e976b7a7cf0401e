"""Plane rows: one row per (image, plane, y) with an array of samples. Geometry, mosaics, chroma, colour, gain maps, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.integers import div


def synthetic(spark: SparkSession, frames: int, width: int, height: int, depth: int = 8, plane: int = 0) -> DataFrame:
    """frame_id, y, samples with sample (7x + 13y + 29 plane + 31 frame) modulo 2^depth."""
    rows = spark.range(frames * height).select(div(F.col("id"), height).alias("frame_id"), (F.col("id") % height).alias("y"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))
    return rows.withColumn("samples", F.transform(at, lambda x: (x * 7 + F.col("y") * 13 + plane * 29 + F.col("frame_id") * 31) % (1 << depth)))


def pixels(rows: DataFrame, name: str = "v") -> DataFrame:
    """Exploded form: the other columns, x, and the sample."""
    return rows.select(*(c for c in rows.columns if c != "samples"), F.posexplode("samples").alias("x", name)).withColumn("x", F.col("x").cast("long"))


def crop_box(size: int, n: int, d: int, off_n: int, off_d: int) -> tuple[int, int]:
    """Start and length of a clean aperture along one axis: the image's middle, plus the offset, less half the length, each division
    truncated toward zero on its own. ValueError for zero denominators and outside the image."""
    if d <= 0 or off_d <= 0:
        raise ValueError("zero denominator")
    length = n // d
    offset = abs(off_n) // off_d * (1 if off_n >= 0 else -1)
    start = size // 2 + offset - length // 2
    if length < 1 or start < 0 or start + length > size:
        raise ValueError("clean aperture outside the image")
    return start, length


def crop(rows: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """Rows and samples inside the box, moved to the origin. The row filter reaches the scan."""
    inside = rows.where(F.col("y").between(y0, y0 + height - 1))
    return inside.withColumns({"y": F.col("y") - y0, "samples": F.slice("samples", x0 + 1, width)})


def mirror(rows: DataFrame, axis: int, height: int) -> DataFrame:
    """axis 0 swaps left and right, 1 top and bottom; no shuffle."""
    return rows.withColumn("samples", F.reverse("samples")) if axis == 0 else rows.withColumn("y", height - 1 - F.col("y"))


def rotate(rows: DataFrame, turns: int, width: int, height: int, keys: list[str]) -> DataFrame:
    """Quarter turns counter-clockwise. Two quarter turns need no shuffle; odd ones regroup samples by image and new row."""
    turns %= 4
    if turns == 0:
        return rows
    if turns == 2:
        return mirror(mirror(rows, 0, height), 1, height)
    flat = pixels(rows)
    new_y, new_x = (width - 1 - F.col("x"), F.col("y")) if turns == 1 else (F.col("x"), height - 1 - F.col("y"))
    moved = flat.select(*keys, new_y.alias("y"), F.struct(new_x.alias("x"), "v").alias("p"))
    return moved.groupBy(*keys, "y").agg(F.sort_array(F.collect_list("p"))["v"].alias("samples"))


def mosaic_offsets(cells: DataFrame, image: str = "grid_id") -> DataFrame:
    """Adds left and top of every cell (row, col, width, height): sums of the widths and heights before it."""
    before = lambda part, by: W.partitionBy(image, part).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumns({
        "left": F.coalesce(F.sum("width").over(before("row", "col")), F.lit(0)).cast("long"),
        "top": F.coalesce(F.sum("height").over(before("col", "row")), F.lit(0)).cast("long"),
    })


def upsample_420(chroma: DataFrame, luma_height: int, keys: list[str]) -> DataFrame:
    """Chroma rows at luma size: nearest across; odd rows average this chroma row and the next, rounded up."""
    last = (luma_height + 1) // 2 - 1
    uses = F.array(F.struct((F.col("y") * 2).alias("to")), F.struct((F.col("y") * 2 + 1).alias("to")), F.struct((F.col("y") * 2 - 1).alias("to")))
    if last == 0:
        uses = F.slice(uses, 1, 2)
    spread = chroma.select(*keys, "samples", F.col("y").alias("from"), F.explode(uses).alias("u")).select(*keys, "samples", "from", F.col("u.to").alias("y")).where(F.col("y").between(0, luma_height - 1))
    both = spread.groupBy(*keys, "y").agg(F.min_by("samples", "from").alias("a"), F.max_by("samples", "from").alias("b"))
    mixed = F.zip_with("a", "b", lambda a, b: div(a + b + 1, 2))
    return both.select(*keys, "y", F.flatten(F.transform(mixed, lambda v: F.array(v, v))).alias("samples"))


def yuv_to_rgb(y: Column, u: Column, v: Column, kr: float, kb: float, depth: int = 8, full: bool = True) -> dict[str, Column]:
    """r, g and b of a sample, rounded and clamped to the depth."""
    top, unit = (1 << depth) - 1, 1 << (depth - 8)
    luma = y / top if full else (y - 16 * unit) / (219.0 * unit)
    scale = float(top) if full else 224.0 * unit
    cb, cr = (u - (1 << (depth - 1))) / scale, (v - (1 << (depth - 1))) / scale
    kg = 1 - kr - kb
    r, b = luma + 2 * (1 - kr) * cr, luma + 2 * (1 - kb) * cb
    g = luma - (2 * kb * (1 - kb) / kg) * cb - (2 * kr * (1 - kr) / kg) * cr
    return {k: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * top).cast("long") for k, c in (("r", r), ("g", g), ("b", b))}


def differences(a: Column, b: Column) -> dict[str, Column]:
    """Mean and largest absolute difference of two arrays and the number of positions that differ."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return {"mean_abs": F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size(gap), "max_abs": F.array_max(gap), "n_different": F.size(F.filter(gap, lambda x: x > 0)).cast("long")}
