"""Native planes of frames as rows: geometry, mosaics, alpha, conversion to RGB, gain-map resampling.

A row is one line of one plane: frame_id, plane (0 luma, 1 and 2 chroma, 3 alpha), y and samples (array of long), with the plane's width, height,
sub_x, sub_y (1: half as many samples) and the frame's depth beside them. Frames of all sizes stand in one table; what is done to
them comes from columns, so one plan serves them all. Lines are shuffled by frame and line; only rotation by odd turns moves blocks.
Both sides of every join grow with the frames, and lines that are made from small keys look small to the planner: joins are merge joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.binding import let

#: Lines of a block that a quarter turn transposes at once.
BLOCK = 64


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def ceil_shift(size: Column, half: Column) -> Column:
    """Samples of a plane along an axis: half as many, rounded up, where half is 1."""
    return F.when(half == 1, F.shiftright(size + 1, 1)).otherwise(size)


def power_of_two(bits: Column) -> Column:
    """2 to the power of bits."""
    return F.call_function("shiftleft", _long(1), bits.cast("int"))


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def aperture(size: Column, n: Column, d: Column, off_n: Column, off_d: Column) -> dict[str, Column]:
    """start, length and fault (bitstream: a zero denominator or outside) of a clean aperture along one axis.

    Every division truncates toward zero on its own: the middle of the image, plus the offset, less half the length.
    """
    whole = lambda a, b: F.when(b != 0, F.call_function("div", a, b))
    length = whole(n, d)
    start = whole(size, _long(2)) + whole(off_n, off_d) - whole(length, _long(2))
    fault = F.when((d == 0) | (off_d == 0) | (length < 1) | (start < 0) | (start + length > size), "bitstream")
    return {"start": start, "length": length, "fault": fault}


def crop_planes(rows: DataFrame, x: str = "crop_x", y: str = "crop_y", width: str = "crop_width", height: str = "crop_height") -> DataFrame:
    """Lines inside each frame's box, moved to the origin. A frame whose box doesn't start on a chroma sample has no lines (see crop_faults())."""
    left, top = _right(F.col(x), F.col("sub_x")), _right(F.col(y), F.col("sub_y"))
    new_w, new_h = ceil_shift(F.col(width), F.col("sub_x")), ceil_shift(F.col(height), F.col("sub_y"))
    boxed = rows.withColumns({"__left": left, "__top": top, "__w": new_w, "__h": new_h}).where((F.col("y") >= F.col("__top")) & (F.col("y") < F.col("__top") + F.col("__h")))
    ok = (F.col(x) % power_of_two(F.col("sub_x")) == 0) & (F.col(y) % power_of_two(F.col("sub_y")) == 0)
    cut = boxed.where(ok).withColumns({"samples": F.slice("samples", (F.col("__left") + 1).cast("int"), F.col("__w").cast("int")), "y": F.col("y") - F.col("__top"), "width": F.col("__w"), "height": F.col("__h")})
    return cut.drop("__left", "__top", "__w", "__h")


def crop_faults(rows: DataFrame, x: str = "crop_x", y: str = "crop_y") -> DataFrame:
    """frame_id, fault (unsupported) of frames with a subsampled plane that the box doesn't start a sample of."""
    off = ((F.col("sub_x") == 1) & (F.col(x) % 2 != 0)) | ((F.col("sub_y") == 1) & (F.col(y) % 2 != 0))
    return rows.where(off).select("frame_id", F.lit("unsupported").alias("fault")).distinct()


def mirror_planes(rows: DataFrame, axis: str = "axis") -> DataFrame:
    """axis 0 swaps left and right, 1 top and bottom, null nothing; no shuffle."""
    a = F.col(axis)
    return rows.withColumns({"samples": F.when(a == 0, F.reverse("samples")).otherwise(F.col("samples")), "y": F.when(a == 1, F.col("height") - 1 - F.col("y")).otherwise(F.col("y"))})


def rotate_planes(rows: DataFrame, turns: str = "turns") -> DataFrame:
    """Quarter turns counter-clockwise, null none. Half turns need no shuffle; for quarter turns blocks of lines are transposed, so what is
    shuffled is a fragment of BLOCK samples, and no task holds more than BLOCK lines or a new line."""
    t = F.coalesce(F.pmod(F.col(turns), F.lit(4)), F.lit(0))
    kept = rows.where(t % 2 == 0).withColumns({"samples": F.when(t == 2, F.reverse("samples")).otherwise(F.col("samples")), "y": F.when(t == 2, F.col("height") - 1 - F.col("y")).otherwise(F.col("y"))})
    keys = [c for c in rows.columns if c not in ("y", "samples")]
    block = rows.where(t % 2 == 1).groupBy(*keys, F.expr(f"y div {BLOCK}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("y", "samples")))["samples"].alias("lines"))
    columns = F.transform(F.sequence(_long(0), F.col("width") - 1), lambda x: F.struct(x.alias("x"), F.transform("lines", lambda line: F.get(line, x.cast("int"))).alias("part")))
    flat = block.select(*keys, "b", F.inline(columns))
    odd = F.pmod(F.col(turns), F.lit(4))
    # one turn: the last column is the first line, in order; three turns: the first column is the first line, backwards
    new_y = F.when(odd == 1, F.col("width") - 1 - F.col("x")).otherwise(F.col("x"))
    joined = flat.groupBy(*keys, new_y.alias("y")).agg(F.flatten(F.array_sort(F.collect_list(F.struct("b", "part")))["part"]).alias("samples"))
    turned = joined.withColumn("samples", F.when(odd == 3, F.reverse("samples")).otherwise(F.col("samples")))
    swapped = turned.withColumns({"width": F.col("height"), "height": F.col("width"), "sub_x": F.col("sub_y"), "sub_y": F.col("sub_x")})
    return kept.unionByName(swapped.select(*kept.columns))


def transform_planes(rows: DataFrame) -> DataFrame:
    """Crop (columns crop_x, crop_y, crop_width, crop_height, null: none), then mirror (axis), then rotation (turns)."""
    cropped = crop_planes(rows.where("crop_width is not null")).unionByName(rows.where("crop_width is null"))
    return rotate_planes(mirror_planes(cropped))


def whole_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells' lines, completed: if a cell of a grid has colour, monochrome ones get neutral chroma as the first coloured cell has it; if one has
    alpha, the others get an opaque plane. cells: grid_id, frame_id, pos, width, height, depth."""
    planes = rows.groupBy("frame_id").agg(F.bool_or(F.col("plane") == 1).alias("coloured"), F.bool_or(F.col("plane") == 3).alias("alpha"), F.max(F.when(F.col("plane") == 1, F.col("sub_x"))).alias("cx"), F.max(F.when(F.col("plane") == 1, F.col("sub_y"))).alias("cy"))
    own = cells.join(planes.hint("merge"), "frame_id")
    of_grid = own.groupBy("grid_id").agg(F.bool_or("coloured").alias("any_colour"), F.bool_or("alpha").alias("any_alpha"), F.min_by(F.struct("cx", "cy", "depth"), F.when(F.col("coloured"), F.col("pos"))).alias("like"))
    judged = own.join(of_grid.hint("merge"), "grid_id").where("any_colour")
    line = lambda w, v: F.transform(F.sequence(_long(1), w), lambda _: v)
    neutral = power_of_two(F.col("like.depth") - 1)
    chroma = judged.where("not coloured").select("frame_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("plane"), F.col("like.cx").alias("sub_x"), F.col("like.cy").alias("sub_y"), F.col("like.depth").alias("depth"), F.col("width").alias("w"), F.col("height").alias("h"), neutral.alias("v"))
    opaque = judged.where("any_alpha and not alpha").select("frame_id", F.lit(3).alias("plane"), F.lit(0).alias("sub_x"), F.lit(0).alias("sub_y"), F.col("like.depth").alias("depth"), F.col("width").alias("w"), F.col("height").alias("h"), (power_of_two(F.col("like.depth")) - 1).alias("v"))
    made = chroma.unionByName(opaque).select("frame_id", "plane", "sub_x", "sub_y", "depth", ceil_shift(F.col("w"), F.col("sub_x")).alias("width"), ceil_shift(F.col("h"), F.col("sub_y")).alias("height"), "v")
    made = made.withColumn("y", F.explode(F.sequence(_long(0), F.col("height") - 1))).withColumn("samples", line(F.col("width"), F.col("v"))).drop("v")
    return rows.select(*made.columns).unionByName(made)


def mosaic(rows: DataFrame, cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Lines of the grids' planes: cells side by side in their order, cut to the output size, columns as in rows, frame_id the grid's.

    rows: the cells' lines; cells: grid_id, frame_id, pos, width, height; grids: grid_id, rows, columns, width, height. A grid whose cells
    don't share their column's width and row's height, or don't cover the output, has no lines (see mosaic_faults()).
    """
    good = grids.join(mosaic_faults(cells, grids).hint("merge"), "grid_id", "left_anti").select("grid_id", "columns", F.col("width").alias("out_w"), F.col("height").alias("out_h"))
    placed = _placed(cells, good)
    lines = rows.join(placed.select("grid_id", "frame_id", "column", "top", "out_w", "out_h").hint("merge"), "frame_id")
    w, h = ceil_shift(F.col("out_w"), F.col("sub_x")), ceil_shift(F.col("out_h"), F.col("sub_y"))
    at = (_right(F.col("top"), F.col("sub_y")) + F.col("y")).alias("y")
    keys = ["grid_id", "plane", "sub_x", "sub_y", "depth"]
    parts = lines.select(*keys, w.alias("width"), h.alias("height"), at, "column", "samples").where("y < height")
    joined = parts.groupBy(*keys, "width", "height", "y").agg(F.flatten(F.array_sort(F.collect_list(F.struct("column", "samples")))["samples"]).alias("line"))
    return joined.select(F.col("grid_id").alias("frame_id"), "plane", "width", "height", "sub_x", "sub_y", "depth", "y", F.slice("line", F.lit(1), F.col("width").cast("int")).alias("samples"))


def _placed(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """cells with row, column, left and top: sums of the sizes of the first row and column, one small array per grid."""
    own = cells.join(grids.hint("merge"), "grid_id").withColumns({"row": F.expr("pos div columns"), "column": F.expr("pos % columns")})
    sizes = own.groupBy("grid_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("row") == 0, F.struct("column", "width"))))["width"].alias("widths"), F.array_sort(F.collect_list(F.when(F.col("column") == 0, F.struct("row", "height"))))["height"].alias("heights"),
    )
    before = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n.cast("int")), _long(0), lambda s, x: s + x)
    return own.join(sizes.hint("merge"), "grid_id").withColumns({"left": before("widths", F.col("column")), "top": before("heights", F.col("row"))}).drop("widths", "heights")


def mosaic_faults(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """grid_id, fault (bitstream) of grids whose cells differ within a row or column, or leave a part of the output uncovered."""
    own = cells.join(grids.select("grid_id", "columns", F.col("width").alias("out_w"), F.col("height").alias("out_h")).hint("merge"), "grid_id").withColumns({"row": F.expr("pos div columns"), "column": F.expr("pos % columns")})
    lines = own.groupBy("grid_id", "out_w", "out_h", "row").agg(F.sum("width").alias("w"), F.countDistinct("height").alias("n"), F.max("height").alias("h"))
    by_row = lines.groupBy("grid_id").agg(F.bool_or((F.col("n") > 1) | (F.col("w") < F.col("out_w"))).alias("bad"), F.sum("h").alias("h"), F.max("out_h").alias("out_h")).select("grid_id", (F.col("bad") | (F.col("h") < F.col("out_h"))).alias("bad"))
    by_column = own.groupBy("grid_id", "column").agg((F.countDistinct("width") > 1).alias("bad")).select("grid_id", "bad")
    return by_row.union(by_column).groupBy("grid_id").agg(F.bool_or("bad").alias("bad")).where("bad").select("grid_id", F.lit("bitstream").alias("fault"))


def append_alpha(rows: DataFrame, alpha: DataFrame) -> DataFrame:
    """rows and the lines of each frame's alpha (a plane 0 of its own frame, with frame_id the owner's) as plane 3 at the owner's depth."""
    depth = rows.where("plane = 0 and y = 0").select("frame_id", F.col("depth").alias("to_depth"))
    scaled = alpha.join(depth.hint("merge"), "frame_id")
    top = lambda d: power_of_two(F.col(d)) - 1
    value = F.transform("samples", lambda s: F.when(F.col("depth") == F.col("to_depth"), s).otherwise(F.call_function("div", s * top("to_depth") + F.shiftright(top("depth"), 1), top("depth"))))
    ready = scaled.withColumn("samples", value).drop("depth", "plane").withColumnRenamed("to_depth", "depth")  # a step each: in one, the lambda would see the new depth
    return rows.unionByName(ready.withColumn("plane", F.lit(3)).select(*rows.columns))


def append_alpha_grid(rows: DataFrame, lines: DataFrame, cells: DataFrame, grids: DataFrame) -> DataFrame:
    """rows with each frame's alpha put together from a grid of monochrome cells; grid_id is the owner's frame_id (see mosaic())."""
    return append_alpha(rows, mosaic(lines.where("plane = 0"), cells, grids))


def alpha_faults(frames: DataFrame, alphas: DataFrame) -> DataFrame:
    """frame_id, fault of alpha images that don't fit: another size (bitstream), more planes than one (unsupported), a frame with alpha of its own
    (bitstream). frames: frame_id, width, height, planes (their numbers); alphas likewise, frame_id the owner's."""
    both = frames.alias("f").join(alphas.alias("a").hint("merge"), "frame_id")
    size = (F.col("a.width") != F.col("f.width")) | (F.col("a.height") != F.col("f.height"))
    fault = F.when(size, "bitstream").when(F.size("a.planes") != 1, "unsupported").when(F.array_contains("f.planes", 3), "bitstream")
    return both.select("frame_id", fault.alias("fault")).where("fault is not null")


def luma_lines(rows: DataFrame, position: str | None = None) -> DataFrame:
    """frame_id, y, width, depth and lines: array(y, u, v, alpha) of arrays at luma size, u and v null for monochrome frames, alpha null without one.

    Chroma is repeated across; for 4:2:0 an odd line takes the mean of its chroma line and the next, rounded up, unless the column
    `position` says colocated. Chroma and alpha lines come by one join on (frame, line).
    """
    luma = rows.where("plane = 0").select("frame_id", "y", "width", "height", "depth", F.col("samples").alias("luma"))
    colocated = F.coalesce(F.col(position) == "colocated", F.lit(False)) if position else F.lit(False)
    other = rows.where("plane > 0").withColumn("__still", colocated)
    # the lines of a chroma line: itself (doubled if there are half as many) and, as the second of a mean, the odd line before
    top = F.call_function("shiftleft", F.col("y"), F.col("sub_y"))
    uses = F.array(F.struct(top.alias("at"), F.lit(0).alias("second")), F.struct((top + 1).alias("at"), F.lit(0).alias("second")), F.struct((top - 1).alias("at"), F.lit(1).alias("second")))
    mixed = (F.col("sub_x") == 1) & (F.col("sub_y") == 1) & ~F.col("__still")
    kept = F.filter(uses, lambda u: F.when(F.col("sub_y") == 0, (u["at"] == F.col("y")) & (u["second"] == 0)).otherwise((u["second"] == 0) | mixed))
    spread = other.select("frame_id", "plane", "sub_x", "samples", F.inline(kept)).groupBy("frame_id", F.col("at").alias("y"), "plane", "sub_x").agg(F.min_by("samples", "second").alias("a"), F.max_by("samples", "second").alias("b"))
    wide = F.when(F.col("sub_x") == 1, F.flatten(F.transform(F.zip_with("a", "b", _mean_up), lambda v: F.array(v, v)))).otherwise(F.zip_with("a", "b", _mean_up))
    by_line = spread.select("frame_id", "y", "plane", wide.alias("s")).groupBy("frame_id", "y").agg(*(F.any_value(F.when(F.col("plane") == p, F.col("s")), ignoreNulls=F.lit(True)).alias(f"p{p}") for p in (1, 2, 3)))
    lines = luma.join(by_line.hint("merge"), ["frame_id", "y"], "left")
    fit = lambda c: F.slice(c, F.lit(1), F.col("width").cast("int"))
    return lines.select("frame_id", "y", "width", "depth", F.array("luma", *(fit(f"p{p}") for p in (1, 2, 3))).alias("lines"))


def _mean_up(a: Column, b: Column) -> Column:
    return F.shiftright(a + b + 1, 1)


def pixels_of(lines: DataFrame) -> DataFrame:
    """frame_id, y, x, depth, luma, u, v, alpha: exploded luma_lines(), chroma null for monochrome frames."""
    l, u, v, a = (F.get("lines", F.lit(i)) for i in range(4))
    each = F.transform(l, lambda s, i: F.struct(i.cast("long").alias("x"), s.alias("luma"), F.get(u, i).alias("u"), F.get(v, i).alias("v"), F.get(a, i).alias("alpha")))
    return lines.select("frame_id", "y", "depth", F.inline(each))


def resampled(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """frame_id, y, samples: bilinear, with half-pixel centres, edges repeated, rounded. lines: frame_id, y, width, height and samples of one channel;
    sizes: frame_id, new_width, new_height. Every line goes to the new lines between it and its neighbours only."""
    src = lambda i, n, m: F.least(F.greatest((i + 0.5) * m / n - 0.5, F.lit(0.0)), (m - 1).cast("double"))
    new = sizes.select("frame_id", "new_width", "new_height", F.explode(F.sequence(_long(0), F.col("new_height") - 1)).alias("to"))
    shape = lines.groupBy("frame_id").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    placed = new.join(shape.hint("merge"), "frame_id").withColumn("at", src(F.col("to"), F.col("new_height"), F.col("h")))
    first = F.floor("at").cast("long")
    placed = placed.withColumns({"y0": first, "y1": F.least(first + 1, F.col("h") - 1), "fy": F.col("at") - first})
    of = lambda c: lines.select("frame_id", F.col("y").alias(c), F.col("samples").alias(f"s_{c}"))
    both = placed.join(of("y0").hint("merge"), ["frame_id", "y0"]).join(of("y1").hint("merge"), ["frame_id", "y1"])

    def sample(x: Column) -> Column:
        def mixed(p: Column) -> Column:
            x0 = F.floor(p).cast("int")
            x1, fx = F.least(x0 + 1, (F.col("w") - 1).cast("int")), p - F.floor(p)
            across = lambda s: F.get(s, x0) + (F.get(s, x1) - F.get(s, x0)) * fx
            return let(across("s_y0"), lambda t: F.round(t + (across("s_y1") - t) * F.col("fy")).cast("long"))

        return let(src(x, F.col("new_width"), F.col("w")), mixed)

    return both.select("frame_id", F.col("to").alias("y"), F.transform(F.sequence(_long(0), F.col("new_width") - 1), sample).alias("samples"))
