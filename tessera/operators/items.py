"""Items of image containers by joins: primary item, payloads, alpha items, grids, gain maps, sample programs, validation, tracks.

The tables are those of sources.bodies.table(): every one has path, the file. Only path and ids are shuffled, payloads just where they
are asked for. Both sides of every join grow with the files, and nested tables look smaller to the planner than their rows are: joins are merge joins.
Violations are rows (path, rule, subject): a file without one is valid, and the smallest rule is what a
parser that stops at its first error would report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.relations import item_properties
from tessera.operators.staging import settled

#: Fixed value: the auxiliary type of alpha planes.
ALPHA = "urn:mpeg:mpegB:cicp:systems:auxiliary:alpha"
#: Kinds of properties of which an item may have one, colour apart.
SINGLE = ("auxC", "clap", "irot", "imir", "ispe", "pixi", "av1C", "prem", "a1op", "lsel", "a1lx")


def effective_primary(files: DataFrame, items: DataFrame, refs: DataFrame) -> DataFrame:
    """path, primary_item, item: the primary item, for a gain-map item its first AV1 input (null: it has none)."""
    kinds = items.groupBy("path", "item").agg(F.any_value("type").alias("type"))
    primary = files.where("primary_item is not null").select("path", "primary_item")
    derived = primary.join(kinds.where("type = 'tmap'").select("path", F.col("item").alias("primary_item")).hint("merge"), ["path", "primary_item"])
    inputs = refs.where("kind = 'dimg'").select("path", F.col("from_item").alias("primary_item"), "ref_no", "pos", F.col("to_item").alias("item"))
    base = derived.join(inputs.hint("merge"), ["path", "primary_item"]).join(kinds.where("type = 'av01'").select("path", "item").hint("merge"), ["path", "item"])
    first = base.groupBy("path").agg(F.min_by("item", F.struct("ref_no", "pos")).alias("base"))
    marked = primary.join(derived.select("path", F.lit(True).alias("derived")).hint("merge"), "path", "left").join(first.hint("merge"), "path", "left")
    return marked.select("path", "primary_item", F.when(F.col("derived"), F.col("base")).otherwise(F.col("primary_item")).alias("item"))


def colours(assoc: DataFrame, props: DataFrame) -> DataFrame:
    """path, item, place: an item's colour property: the first CICP description, or the first ICC profile where it has none."""
    own = assoc.join(props.where("kind = 'colr'").select("path", F.col("place").alias("index"), "text").hint("merge"), ["path", "index"])
    icc = F.col("text").isin("prof", "rICC")
    return own.groupBy("path", "item").agg(F.min_by("index", F.struct(icc, "pos")).alias("place"))


def properties_of(assoc: DataFrame, props: DataFrame) -> DataFrame:
    """path, item, kind, place: the property of each kind that holds for an item: the last one, for colour see colours()."""
    other = props.where("kind not in ('colr', 'other')").select(F.col("path").alias("file"), "place", "kind", F.col("place").alias("value"))
    found = item_properties(assoc.select(F.col("path").alias("file"), "item", F.lit(0).alias("record"), "pos", "index"), other)
    plain = found.select(F.col("file").alias("path"), "item", "kind", F.col("value").alias("place"))
    return plain.union(colours(assoc, props).select("path", "item", F.lit("colr"), "place"))


def item_violations(files: DataFrame, items: DataFrame, locations: DataFrame, refs: DataFrame, assoc: DataFrame, props: DataFrame) -> DataFrame:
    """path, rule, subject of every broken rule, in the order of a parser that stops at the first.

    0 primary item absent, or without a usable base; 1 it has no information; 2 no location; 3 an association of an unknown item;
    4 index out of range; 5 essential property that isn't known; 6 operating point or layer that isn't handled; 7 the same colour
    type twice; 8 another property twice; 9 the primary item has no association; 10 it lacks a required property.
    """
    primary = effective_primary(files.select("path", "primary_item"), items, refs)
    row = lambda df, rule, subject: df.select("path", F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))
    known = items.select("path", "item").distinct()
    usable = primary.where("item is not null")
    placed = assoc.join(props.select("path", F.col("place").alias("index"), "kind", "numbers", "text").hint("merge"), ["path", "index"], "left")
    lacking = row(files.select("path").join(usable.select("path").hint("merge"), "path", "left_anti"), 0, F.lit(""))
    no_info = row(usable.join(known.hint("merge"), ["path", "item"], "left_anti"), 1, F.col("item"))
    no_place = row(usable.join(locations.select("path", "item").hint("merge"), ["path", "item"], "left_anti"), 2, F.col("item"))
    orphan = row(assoc.select("path", "item").distinct().join(known.hint("merge"), ["path", "item"], "left_anti"), 3, F.col("item"))
    number = F.get("numbers", F.lit(0))
    faults = F.array_compact(F.array(
        F.when(F.col("kind").isNull(), 4), F.when(F.col("essential") & (F.col("kind") == "other"), 5),
        F.when(((F.col("kind") == "a1op") & (number != 0)) | ((F.col("kind") == "lsel") & ~number.isin(0, 0xFFFF)), 6),
    ))
    each = placed.select("path", "item", F.explode(faults).alias("rule")).select("path", "rule", F.col("item").cast("string").alias("subject")).distinct()
    colour = F.when(F.col("text").isin("prof", "rICC"), "icc ").otherwise(F.col("text"))
    twice = lambda df, rule, *by: row(df.groupBy("path", "item", *by).count().where("count > 1").select("path", "item").distinct(), rule, F.col("item"))
    same_colour = twice(placed.where("kind = 'colr'").withColumn("colour", colour), 7, "colour")
    same_kind = twice(placed.where(F.col("kind").isin(*SINGLE)), 8, "kind")
    own = usable.join(assoc.select("path", "item").distinct().hint("merge"), ["path", "item"], "left_anti")
    bare = row(own, 9, F.col("item"))
    kinds = items.groupBy("path", "item").agg(F.any_value("type").alias("type"))
    derived = usable.join(kinds.withColumnRenamed("item", "primary_item").hint("merge"), ["path", "primary_item"], "left").withColumn("derived", F.coalesce(F.col("type").isin("grid", "sato"), F.lit(False)))
    have = placed.groupBy("path", "item").agg(F.collect_set("kind").alias("have"))
    wanted = F.when(F.col("derived"), F.array(F.lit("ispe"), F.lit("pixi"))).otherwise(F.array(F.lit("ispe"), F.lit("pixi"), F.lit("av1C")))
    missing = row(derived.join(have.hint("merge"), ["path", "item"]).withColumn("lacks", F.explode(F.array_except(wanted, "have"))), 10, F.col("lacks"))
    out = lacking
    for more in (no_info, no_place, orphan, each, same_colour, same_kind, bare, missing):
        out = out.unionByName(more)
    return out


def first_faults(violations: DataFrame) -> DataFrame:
    """path, rule, subject: the first violation of each file."""
    return violations.groupBy("path").agg(F.min(F.struct("rule", "subject")).alias("v")).select("path", "v.*")


def container_info(tables: DataFrame) -> DataFrame:
    """path, major, primary_item, item (the effective primary), n_items, width, height, depth (of the first channel) and fault of every file, all rules in one call.

    fault: the file's own, else that of its first broken rule: unsupported for an essential property or a layer that isn't handled and for a
    gain map without a base, bitstream for the others. Files with a fault have no size.
    """
    items, locations, refs, assoc, props = (tables.select("path", F.inline(t)) for t in ("items", "locations", "refs", "assoc", "props"))
    whole = tables.where("fault is null")
    primary = effective_primary(whole, items, refs)
    broken = first_faults(item_violations(whole, items, locations, refs, assoc, props)).select("path", "rule")
    own = primary.join(properties_of(assoc, props).hint("merge"), ["path", "item"]).join(props.select("path", "place", "numbers").hint("merge"), ["path", "place"])
    number = lambda kind, i: F.max(F.when(F.col("kind") == kind, F.get("numbers", F.lit(i))))
    size = own.groupBy("path").agg(number("ispe", 0).alias("width"), number("ispe", 1).alias("height"), number("pixi", 0).alias("depth"))
    rows = tables.select("path", F.col("fault").alias("own_fault"), "major", F.size("items").alias("n_items"), "primary_item")
    joined = rows.join(primary.select("path", "item").hint("merge"), "path", "left").join(broken.hint("merge"), "path", "left").join(size.hint("merge"), "path", "left")
    late = F.when(F.col("rule").isin(5, 6) | ((F.col("rule") == 0) & F.col("primary_item").isNotNull()), "unsupported").when(F.col("rule").isNotNull(), "bitstream")
    fault = F.coalesce("own_fault", late)
    return joined.select("path", "major", "primary_item", "item", "n_items", *(F.when(fault.isNull(), F.col(c)).alias(c) for c in ("width", "height", "depth")), fault.alias("fault"))


def payloads(files: DataFrame, parsed: DataFrame, deepest: int = 16) -> DataFrame:
    """path, item, payload, fault: every located item's bytes, its extents one after the other.

    files: path and content. Method 0 cuts them out of the file, 1 out of the idat box, 2 out of another item, whose own payload is
    needed first: such items are settled level by level, and one that is left after `deepest` levels is in a cycle (bitstream) or
    deeper than that (unsupported). fault short: an extent ends outside; bitstream: no idat, no reference, more bytes than there are.
    """
    extent = F.struct(F.col("no"), (F.col("base") + F.col("offset")).alias("start"), "length", "index")
    own = parsed.select("path", F.inline("extents")).groupBy("path", "item", "method").agg(F.array_sort(F.collect_list(extent)).alias("extents"))
    located = parsed.select("path", F.inline("locations")).select("path", "item", "method")
    each = located.join(own.hint("merge"), ["path", "item", "method"], "left").withColumn("extents", F.coalesce("extents", F.expr("cast(array() as array<struct<no: int, start: bigint, length: bigint, index: bigint>>)")))
    total = lambda e: F.aggregate(e, F.lit(0).cast("long"), lambda s, x: s + x["length"])

    def cut(source: Column, e: Column) -> dict[str, Column]:
        outside = F.exists(e, lambda x: x["start"] + x["length"] > F.length(source))
        joined = F.aggregate(e, F.lit(b""), lambda s, x: F.concat(s, F.substring(source, x["start"].cast("int") + 1, x["length"].cast("int"))))
        fault = F.when(source.isNull() | (total(e) > F.length(source)), "bitstream").when(outside, "short")
        return {"payload": F.when(fault.isNull(), joined), "fault": fault}

    sources = files.select("path", "content").join(parsed.select("path", "idat").hint("merge"), "path")
    direct = each.where("method < 2").join(sources.hint("merge"), "path").withColumn("source", F.when(F.col("method") == 0, F.col("content")).otherwise(F.col("idat")))
    done = settled(direct.withColumns(cut(F.col("source"), F.col("extents"))).select("path", "item", "payload", "fault"), "payloads")  # every level looks here
    refs = parsed.select("path", F.inline("refs")).where("kind = 'iloc'")
    firsts = refs.groupBy("path", "from_item").agg(F.min("ref_no").alias("ref_no"))
    targets = refs.join(firsts.hint("merge"), ["path", "from_item", "ref_no"]).select("path", F.col("from_item").alias("item"), (F.col("pos") + 1).cast("long").alias("index"), F.col("to_item").alias("target"))
    waiting = each.where("method = 2").select("path", "item", F.posexplode_outer("extents").alias("k", "x")).select("path", "item", "k", "x.*")
    waiting = waiting.join(targets.hint("merge"), ["path", "item", "index"], "left").select("path", "item", "k", "start", "length", "target")
    for _ in range(deepest):
        state = done.select("path", F.col("item").alias("target"), F.col("payload").alias("source"), F.col("fault").alias("source_fault"))
        looked = waiting.join(state.hint("merge"), ["path", "target"], "left")
        known = F.col("source").isNotNull() | F.col("source_fault").isNotNull() | F.col("target").isNull()
        piece = F.when(F.col("start") + F.col("length") <= F.length("source"), F.substring(F.col("source"), F.col("start").cast("int") + 1, F.col("length").cast("int")))
        fault = F.when(F.col("k").isNull(), F.lit(None)).when(F.col("target").isNull(), "bitstream").otherwise(F.coalesce("source_fault", F.when(piece.isNull(), "short")))
        ready = looked.groupBy("path", "item").agg(F.bool_and(known).alias("known"), F.min_by(fault, F.when(fault.isNotNull(), F.col("k"))).alias("fault"), F.array_sort(F.collect_list(F.struct("k", piece.alias("piece")))).alias("pieces")).where("known")
        joined = F.aggregate("pieces", F.lit(b""), lambda s, x: F.concat(s, F.coalesce(x["piece"], F.lit(b""))))
        now = ready.select("path", "item", F.when(F.col("fault").isNull(), joined).alias("payload"), "fault")
        now = settled(now.join(done.select("path", "item").hint("merge"), ["path", "item"], "left_anti"), "payloads")
        if now.isEmpty():
            break
        done = done.unionByName(now)
    left = waiting.select("path", "item").distinct().join(done.select("path", "item").hint("merge"), ["path", "item"], "left_anti")
    return done.unionByName(left.select("path", "item", F.lit(None).cast("binary").alias("payload"), F.lit("bitstream").alias("fault")))


def alpha_properties(assoc: DataFrame, props: DataFrame) -> DataFrame:
    """path, item: those with an alpha auxiliary type among their properties."""
    marks = props.where((F.col("kind") == "auxC") & (F.col("text") == ALPHA)).select("path", F.col("place").alias("index"))
    return assoc.join(marks.hint("merge"), ["path", "index"]).select("path", "item").distinct()


def alpha_items(owners: DataFrame, refs: DataFrame, assoc: DataFrame, props: DataFrame) -> DataFrame:
    """path, item: what the owners (path, item) refer to as auxiliary; in files without that, every item with an alpha type."""
    direct = refs.where("kind = 'auxl'").join(owners.select("path", F.col("item").alias("from_item")).hint("merge"), ["path", "from_item"]).select("path", F.col("to_item").alias("item")).distinct()
    other = alpha_properties(assoc, props).join(direct.select("path").distinct().hint("merge"), "path", "left_anti")
    return direct.union(other)


def grid_cells(grids: DataFrame, items: DataFrame, refs: DataFrame, assoc: DataFrame, props: DataFrame) -> DataFrame:
    """path, item, pos, cell, width, height, alpha, fault: a row per cell of every grid, or one row with its fault.

    grids: path, item, rows, columns. bitstream: not one list of inputs, another number of cells than rows * columns, a cell without
    information, size or codec record; unsupported: a cell that is no AV1 image, or with several alpha items.
    """
    lists = refs.where("kind = 'dimg'").groupBy("path", F.col("from_item").alias("item")).agg(F.countDistinct("ref_no").alias("lists"), F.count("*").alias("cells"))
    counted = grids.join(lists.hint("merge"), ["path", "item"], "left")
    shape = F.when((F.coalesce("lists", F.lit(0)) != 1) | (F.col("cells") != F.col("rows") * F.col("columns")), "bitstream")
    counted = counted.select("path", "item", shape.alias("shape"))
    cells = counted.where("shape is null").join(refs.where("kind = 'dimg'").select("path", F.col("from_item").alias("item"), "pos", F.col("to_item").alias("cell")).hint("merge"), ["path", "item"])
    kinds = items.groupBy("path", F.col("item").alias("cell")).agg(F.any_value("type").alias("type"))
    own = properties_of(assoc, props)
    size = own.where("kind = 'ispe'").join(props.select("path", "place", "numbers").hint("merge"), ["path", "place"]).select("path", F.col("item").alias("cell"), F.get("numbers", F.lit(0)).alias("width"), F.get("numbers", F.lit(1)).alias("height"))
    codec = own.where("kind = 'av1C'").select("path", F.col("item").alias("cell"), F.lit(True).alias("codec"))
    aux = refs.where("kind = 'auxl'")
    outward = aux.select("path", F.col("from_item").alias("cell"), F.col("to_item").alias("alpha"))
    marked = alpha_properties(assoc, props).withColumnRenamed("item", "from_item")
    inward = aux.join(marked.hint("merge"), ["path", "from_item"]).select("path", F.col("to_item").alias("cell"), F.col("from_item").alias("alpha")).distinct()
    alphas = outward.union(inward.join(outward.select("path", "cell").distinct().hint("merge"), ["path", "cell"], "left_anti")).groupBy("path", "cell").agg(F.count("*").alias("alphas"), F.min("alpha").alias("alpha"))
    full = cells.join(kinds.hint("merge"), ["path", "cell"], "left").join(size.hint("merge"), ["path", "cell"], "left").join(codec.hint("merge"), ["path", "cell"], "left").join(alphas.hint("merge"), ["path", "cell"], "left")
    fault = F.when(F.col("alphas") > 1, "unsupported").when(F.col("type").isNull(), "bitstream").when(F.col("type") != "av01", "unsupported").when(F.col("width").isNull() | F.col("codec").isNull(), "bitstream")
    judged = full.withColumn("fault", fault)
    first = judged.groupBy("path", "item").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.struct(F.col("alphas").isNull() | (F.col("alphas") < 2), "pos"))).alias("bad"))
    good = judged.join(first.where("bad is null").select("path", "item").hint("merge"), ["path", "item"]).select("path", "item", "pos", "cell", "width", "height", "alpha", "fault")
    bad = counted.where("shape is not null").select("path", "item", F.col("shape").alias("fault")).union(first.where("bad is not null").select("path", "item", "bad"))
    return good.unionByName(bad, allowMissingColumns=True)


def gain_map_preferred(files: DataFrame, items: DataFrame, groups: DataFrame) -> DataFrame:
    """path, item, preferred: the first gain-map item of a file, preferred if it is first in every group that holds it and the primary item."""
    maps = items.where("type = 'tmap'").groupBy("path").agg(F.min("item_no").alias("item_no")).join(items.where("type = 'tmap'").select("path", "item_no", "item").hint("merge"), ["path", "item_no"]).select("path", "item")
    maps = maps.join(files.select("path", "primary_item").hint("merge"), "path")
    of_group = groups.groupBy("path", "group_no").agg(F.collect_set("entity").alias("all"), F.min_by("entity", "pos").alias("first"))
    both = maps.join(of_group.hint("merge"), "path").where(F.array_contains("all", F.col("item")) & F.array_contains("all", F.col("primary_item")))
    judged = both.groupBy("path", "item").agg(F.bool_and(F.col("first") == F.col("item")).alias("preferred"))
    return maps.join(judged.hint("merge"), ["path", "item"], "left").select("path", "item", F.coalesce("preferred", F.lit(True)).alias("preferred"))


def gain_map_inputs(maps: DataFrame, items: DataFrame, refs: DataFrame) -> DataFrame:
    """path, item, base, map, fault: a gain-map item's two inputs; bitstream: none, not two, or no such item; unsupported: a map of another type."""
    lists = refs.where("kind = 'dimg'").join(maps.select("path", F.col("item").alias("from_item")).hint("merge"), ["path", "from_item"])
    firsts = lists.groupBy("path", "from_item").agg(F.min("ref_no").alias("ref_no"))
    own = lists.join(firsts.hint("merge"), ["path", "from_item", "ref_no"]).groupBy("path", F.col("from_item").alias("item")).agg(F.count("*").alias("n"), F.min_by("to_item", "pos").alias("base"), F.max_by("to_item", "pos").alias("map"))
    kinds = items.groupBy("path", F.col("item").alias("map")).agg(F.any_value("type").alias("type"))
    judged = maps.select("path", "item").join(own.hint("merge"), ["path", "item"], "left").join(kinds.hint("merge"), ["path", "map"], "left")
    fault = F.when((F.coalesce("n", F.lit(0)) != 2) | F.col("type").isNull(), "bitstream").when(~F.col("type").isin("av01", "grid"), "unsupported")
    return judged.select("path", "item", "base", "map", fault.alias("fault"))


def sample_program_inputs(files: DataFrame, items: DataFrame, refs: DataFrame, assoc: DataFrame, props: DataFrame) -> DataFrame:
    """path, item, inputs, depth, fault: the sample program that binds the primary item, its inputs in order and its output depth.

    Bound is the first program item that is the primary item or has it among its inputs; files without one have no row.
    """
    programs = items.where("type = 'sato'").join(files.select("path", "primary_item").where("primary_item is not null").hint("merge"), "path")
    lists = refs.where("kind = 'dimg'").select("path", F.col("from_item").alias("item"), "ref_no", "pos", "to_item")
    all_inputs = lists.groupBy("path", "item").agg(F.collect_set("to_item").alias("all"))
    firsts = lists.groupBy("path", "item").agg(F.min("ref_no").alias("ref_no"))
    own = lists.join(firsts.hint("merge"), ["path", "item", "ref_no"]).groupBy("path", "item").agg(F.array_sort(F.collect_list(F.struct("pos", "to_item")))["to_item"].alias("inputs"))
    bound = programs.join(all_inputs.hint("merge"), ["path", "item"], "left").where((F.col("item") == F.col("primary_item")) | F.array_contains("all", F.col("primary_item")))
    chosen = bound.groupBy("path").agg(F.min_by(F.struct("item", "primary_item"), "item_no").alias("c")).select("path", "c.*").join(own.hint("merge"), ["path", "item"], "left")
    kinds = items.groupBy("path", F.col("item").alias("input")).agg(F.any_value("type").alias("type"))
    each = chosen.select("path", "item", F.explode("inputs").alias("input")).join(kinds.hint("merge"), ["path", "input"], "left").groupBy("path", "item").agg(F.bool_or(F.col("type").isNull()).alias("unknown"), F.bool_or(~F.col("type").isin("av01", "grid")).alias("other"))
    depth = properties_of(assoc, props).where("kind = 'pixi'").join(props.select("path", "place", "numbers").hint("merge"), ["path", "place"]).select("path", "item", F.array_distinct("numbers").alias("depths"))
    size = properties_of(assoc, props).where("kind = 'ispe'").select("path", "item", F.lit(True).alias("sized"))
    full = chosen.join(each.hint("merge"), ["path", "item"], "left").join(depth.hint("merge"), ["path", "item"], "left").join(size.hint("merge"), ["path", "item"], "left")
    one = F.get("depths", F.lit(0))
    fault = (
        F.when(F.col("inputs").isNull(), "bitstream").when((F.col("item") != F.col("primary_item")) & ~F.array_contains("inputs", F.col("primary_item")), "unsupported")
        .when(F.col("sized").isNull() | F.col("depths").isNull() | (F.size("depths") == 0), "bitstream").when((F.size("depths") > 1) | ~one.between(8, 16), "unsupported")
        .when(F.col("unknown"), "bitstream").when(F.col("other"), "unsupported")
    )
    return full.select("path", "item", "inputs", F.when(F.size("depths") == 1, one).alias("depth"), fault.alias("fault"))


# --- tracks


def track_roles(tracks: DataFrame) -> DataFrame:
    """tracks with role: colour (no auxiliary reference, no auxiliary type) or alpha (both, of alpha); only the first of a role stays."""
    none = F.size("auxl") == 0
    role = F.when(~none & (F.col("aux_type") == ALPHA), "alpha").when(none & F.col("aux_type").isNull(), "colour")
    marked = tracks.withColumn("role", role).where("role is not null")
    first = marked.groupBy("path", "role").agg(F.min("track_no").alias("track_no"))
    return marked.join(first.hint("merge"), ["path", "role", "track_no"], "left_semi")


def track_faults(tracks: DataFrame) -> DataFrame:
    """path, track_no, fault of tracks whose tables contradict each other; all checks are on the track's own row, without a shuffle.

    No samples-per-chunk record, or none for a chunk; description 0 or not of AV1; more or fewer samples than the chunks hold; durations for
    another number of samples.
    """
    record = lambda c: F.try_element_at(F.filter("per_chunk", lambda r: r["first_chunk"] <= c), F.lit(-1))
    chunks = F.transform("chunks", lambda _, i: record(i + 1))
    of_chunk = F.when(F.size("chunks") > 0, chunks).otherwise(F.expr("cast(array() as array<struct<first_chunk: bigint, samples: bigint, description: bigint>>)"))
    held = F.aggregate(of_chunk, F.lit(0).cast("long"), lambda s, r: s + F.coalesce(r["samples"], F.lit(0)))
    no_description = F.exists(of_chunk, lambda r: r.isNull() | (r["description"] == 0) | F.get("descriptions", r["description"].cast("int") - 1).isNull())
    timed = F.aggregate("durations", F.lit(0).cast("long"), lambda s, d: s + d["count"])
    bad = (F.size("per_chunk") == 0) | no_description | (held != F.size("sizes")) | (F.col("durations").isNotNull() & (timed != F.size("sizes")))
    return tracks.select("path", "track_no", F.when(bad, "bitstream").alias("fault")).where("fault is not null")


def track_samples(tracks: DataFrame) -> DataFrame:
    """path, track_no, sample_no, offset, size, description, pts, duration, pts_ms, duration_ms of every sample of tracks without a fault.

    A file's tables are one row, so samples come out of it without a shuffle: run lengths are expanded in the row and running sums
    are taken over its arrays, by one window over (track, chunk) and one over the track.
    """
    good = tracks.join(track_faults(tracks).hint("merge"), ["path", "track_no"], "left_anti")
    chunk = good.select("path", "track_no", "per_chunk", F.posexplode("chunks").alias("c", "chunk_offset"))
    record = F.try_element_at(F.filter("per_chunk", lambda r: r["first_chunk"] <= F.col("c") + 1), F.lit(-1))
    chunk = chunk.select("path", "track_no", "c", "chunk_offset", record.alias("r")).where("r.samples > 0")
    each = chunk.select("path", "track_no", "c", "chunk_offset", F.col("r.description").alias("description"), F.explode(F.expr("sequence(1L, r.samples)")).alias("k"))
    numbered = each.withColumn("sample_no", (F.row_number().over(W.partitionBy("path", "track_no").orderBy("c", "k")) - 1).cast("long"))
    sizes = good.select("path", "track_no", F.posexplode("sizes").alias("n", "size")).select("path", "track_no", F.col("n").cast("long").alias("sample_no"), "size")
    runs = good.select("path", "track_no", "timescale", F.coalesce("durations", F.array(F.struct(F.size("sizes").cast("long").alias("count"), F.lit(0).cast("long").alias("duration")))).alias("durations"))
    flat = runs.select("path", "track_no", "timescale", F.posexplode("durations").alias("e", "d")).where("d.count > 0").select("path", "track_no", "timescale", "e", "d.duration", F.explode(F.expr("sequence(1L, d.count)")).alias("k"))
    in_order = W.partitionBy("path", "track_no").orderBy("e", "k")
    earlier = in_order.rowsBetween(W.unboundedPreceding, -1)
    timed = flat.select("path", "track_no", (F.row_number().over(in_order) - 1).cast("long").alias("sample_no"), "timescale", "duration", F.coalesce(F.sum("duration").over(earlier), F.lit(0)).cast("long").alias("pts"))
    joined = numbered.join(sizes.hint("merge"), ["path", "track_no", "sample_no"]).join(timed.hint("merge"), ["path", "track_no", "sample_no"])
    before = W.partitionBy("path", "track_no", "c").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    ms = lambda c: F.expr(f"({c} * 1000 + timescale div 2) div timescale")
    offset = (F.col("chunk_offset") + F.coalesce(F.sum("size").over(before), F.lit(0))).cast("long")
    return joined.select("path", "track_no", "sample_no", offset.alias("offset"), "size", "description", "pts", "duration", ms("pts").alias("pts_ms"), ms("duration").alias("duration_ms"))


def track_repetition(tracks: DataFrame) -> DataFrame:
    """path, track_no, kind (finite, infinite, unknown) and n (finite: edits - 1); tracks without edits are unknown. No shuffle."""
    endless = F.exists("edits", lambda e: (e["media_time"] == 0) & (e["duration"] == 0xFFFFFFFF))
    same = F.forall("edits", lambda e: (e["media_time"] == 0) & (e["duration"] == F.get("edits", F.lit(0))["duration"]))
    kind = F.when(F.coalesce(F.size("edits"), F.lit(0)) < 1, "unknown").when(endless, "infinite").when(same, "finite").otherwise("unknown")
    return tracks.select("path", "track_no", kind.alias("kind"), F.when(kind == "finite", F.size("edits") - 1).alias("n"))


def alpha_count_faults(tracks: DataFrame) -> DataFrame:
    """path, colour, alpha: files whose alpha track has another number of samples than the colour track. tracks: with role."""
    n = tracks.groupBy("path").agg(*(F.coalesce(F.max(F.when(F.col("role") == r, F.size("sizes"))), F.lit(0)).alias(r) for r in ("colour", "alpha")))
    return n.where("alpha > 0 and alpha <> colour")


def description_faults(samples: DataFrame, tracks: DataFrame, has_header: DataFrame) -> DataFrame:
    """path, track_no, sample_no of samples whose description isn't the track's first and that bring no sequence header of their own.

    has_header: path, track_no, sample_no, has_header.
    """
    first = F.try_element_at(F.filter("descriptions", lambda d: d.isNotNull()), F.lit(1))
    other = tracks.select("path", "track_no", F.posexplode("descriptions").alias("i", "d"), first.alias("first")).where("d is not null and d <> first")
    changed = samples.join(other.select("path", "track_no", (F.col("i") + 1).cast("long").alias("description")).hint("merge"), ["path", "track_no", "description"], "left_semi")
    return changed.join(has_header.where("has_header").hint("merge"), ["path", "track_no", "sample_no"], "left_anti").select("path", "track_no", "sample_no")
