"""Payloads of items and samples as rows: unit streams, codec records, grids, gain-map descriptors, sample programs.

All parse functions raise Fault (short, bitstream, unsupported); parsed() turns one of them into a column of a table, with the
fault beside the values. Null payloads are short.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.bodies import Bits, Cursor, Fault

#: Unit types of the stream.
UNIT_TYPES = {1: "sequence_header", 2: "temporal_delimiter", 3: "frame_header", 4: "tile_group", 5: "metadata", 6: "frame", 7: "redundant_frame_header", 8: "tile_list", 15: "padding"}


def leb128(c: Cursor) -> int:
    """Seven bits a byte, lowest first, 8 bytes at most."""
    value = 0
    for k in range(8):
        byte = c.number(1)
        value |= (byte & 0x7F) << (7 * k)
        if byte < 0x80:
            return value
    raise Fault("bitstream", "size of more than 8 bytes")


def units(data: bytes | None) -> list[dict]:
    """type, extension, offset and size of each unit's payload."""
    c, out = Cursor(data or b""), []
    while c.at < c.end:
        header = c.number(1)
        if header & 0x81:
            raise Fault("bitstream", "forbidden or reserved bit of a unit header")
        extension = c.number(1) if header & 4 else None
        size = leb128(c) if header & 2 else c.end - c.at
        start = c.at
        c.take(size)
        out.append({"type": header >> 3 & 15, "extension": extension, "offset": start, "size": size})
    return out


def codec_record(data: bytes | None) -> dict:
    """Profile, level, tier, depth and layout of a codec configuration record."""
    c = Cursor(data or b"")
    c.need(4, "codec record")
    first, profile, layout, delay = (c.number(1) for _ in range(4))
    if first < 128:
        raise Fault("bitstream", "marker bit is not set")
    if first & 127 != 1:
        raise Fault("unsupported", f"codec record version {first & 127}")
    if delay >> 5:
        raise Fault("bitstream", "reserved bits are set")
    high, twelve = bool(layout & 64), bool(layout & 32)
    implied = profile >> 5 == 2 and not high  # 8 bits of this profile are 4:2:2, whatever the bits say
    return {
        "profile": profile >> 5, "level": profile & 31, "tier": layout >> 7, "depth": 12 if twelve else 10 if high else 8, "mono": bool(layout & 16),
        "sub_x": implied or bool(layout & 8), "sub_y": not implied and bool(layout & 4), "position": layout & 3, "delay": delay & 15 if delay & 16 else None,
    }


def grid(data: bytes | None) -> dict:
    """Rows, columns and output size of a grid."""
    c = Cursor(data or b"")
    c.need(8, "grid")
    version, flags, rows, columns = (c.number(1) for _ in range(4))
    if version:
        raise Fault("unsupported", f"grid version {version}")
    wide = 4 if flags & 1 else 2
    return {"rows": rows + 1, "columns": columns + 1, "width": c.number(wide), "height": c.number(wide)}


def gain_map(data: bytes | None) -> dict:
    """Headrooms and channels of a gain-map descriptor, rationals as numerator and denominator."""
    c = Cursor(data or b"")

    def rational(signed: bool = False) -> list[int]:
        n, d = c.number(4), c.number(4)
        if not d:
            raise Fault("bitstream", "denominator is zero")
        return [n - (1 << 32) if signed and n >> 31 else n, d]

    if version := c.number(1):
        raise Fault("unsupported", f"descriptor version {version}")
    if least := c.number(2):
        raise Fault("unsupported", f"least version {least}")
    writer, flags = c.number(2), c.number(1)
    base, alternate = rational(), rational()
    channels = [{"min": rational(True), "max": rational(True), "gamma": rational(), "base_offset": rational(True), "alternate_offset": rational(True)} for _ in range(3 if flags & 128 else 1)]
    if base == alternate:
        raise Fault("bitstream", "headrooms must differ")
    for x in channels:
        if x["max"][0] * x["min"][1] < x["min"][0] * x["max"][1]:
            raise Fault("bitstream", "maximum below minimum")
        if x["gamma"][0] <= 0:
            raise Fault("bitstream", "gamma must be positive")
    if not writer and any(c.rest()):
        raise Fault("bitstream", "bytes left over")
    return {"writer": writer, "base_space": bool(flags & 64), "base": base, "alternate": alternate, "channels": channels}


#: Operators by token.
UNARY = {64: "neg", 65: "abs", 66: "not", 67: "log2"}
BINARY = {128: "add", 129: "sub", 130: "mul", 131: "div", 132: "and", 133: "or", 134: "xor", 135: "pow", 136: "min", 137: "max"}


def program(data: bytes | None) -> tuple[int, list]:
    """Intermediate width and the tokens of a sample expression, inputs named in_0, in_1 and so on, as compile_expression() takes them."""
    c = Cursor(data or b"")
    c.need(2, "program")
    header, n = c.number(1), c.number(1)
    if header & 0xFC:
        raise Fault("unsupported", "version or reserved bits of a program")
    bits, tokens, depth = 8 << (header & 3), [], 0
    if not n or c.end - c.at < n:
        raise Fault("bitstream", "token count exceeds the payload")
    for _ in range(n):
        token = c.number(1)
        if token == 0:
            value = c.number(bits // 8)
            tokens.append(("const", value - (1 << bits) if value >> (bits - 1) else value))
            depth += 1
        elif token <= 32:
            tokens.append(("input", f"in_{token - 1}"))
            depth += 1
        elif token in UNARY or token in BINARY:
            need = 1 if token in UNARY else 2
            if depth < need:
                raise Fault("bitstream", "stack underflow")
            depth -= need - 1
            tokens.append(UNARY.get(token) or BINARY[token])
        else:
            raise Fault("unsupported", f"reserved token {token}")
    if depth != 1 or c.at != c.end:
        raise Fault("bitstream", "a program must leave one value and no bytes")
    return bits, tokens


RATIONAL = "array<bigint>"
#: Result types of the parse functions.
TYPES: dict[Callable, str] = {
    units: "array<struct<type: int, extension: int, offset: bigint, size: bigint>>",
    codec_record: "struct<profile: int, level: int, tier: int, depth: int, mono: boolean, sub_x: boolean, sub_y: boolean, position: int, delay: int>",
    grid: "struct<rows: int, columns: int, width: bigint, height: bigint>",
    gain_map: f"struct<writer: int, base_space: boolean, base: {RATIONAL}, alternate: {RATIONAL}, channels: array<struct<min: {RATIONAL}, max: {RATIONAL}, gamma: {RATIONAL}, base_offset: {RATIONAL}, alternate_offset: {RATIONAL}>>>",
}


def parsed(df: DataFrame, payload: str, parse: Callable, name: str = "value") -> DataFrame:
    """df with two more columns: `name` by the parse function, and `fault`, null where it holds. One narrow pass."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(TYPES[parse]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, faults = [], []
            for data in batch.column(payload).to_pylist():
                try:
                    values.append(parse(data))
                    faults.append(None)
                except Fault as e:
                    values.append(None)
                    faults.append(e.kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind), pa.array(faults, pa.string())], names=[*batch.schema.names, name, "fault"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{name}` {TYPES[parse]}, fault string")


def first_unit(found: Column, payload: Column, kind: int) -> Column:
    """The payload of the first unit of a type; null if there is none."""
    unit = F.get(F.filter(found, lambda u: u["type"] == kind), F.lit(0))
    return F.substring(payload, unit["offset"].cast("int") + 1, unit["size"].cast("int"))


def count_units(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda u: u["type"] == kind))


def sample_kind(found: Column, payload: Column) -> dict[str, Column]:
    """kind of a sample by its first frame or frame header (null: none; short: an empty one), show_idx, and whether a sequence header is there."""
    frame = F.get(F.filter(found, lambda u: u["type"].isin(3, 6)), F.lit(0))
    byte = F.when(frame["size"] > 0, F.conv(F.hex(F.substring(payload, frame["offset"].cast("int") + 1, F.lit(1))), 16, 10).cast("int"))
    names = F.array(*map(F.lit, ("key", "inter", "intra_only", "switch")))
    kind = F.when(frame.isNotNull() & byte.isNull(), F.lit("short")).when(byte >= 128, F.lit("show_existing")).otherwise(F.get(names, F.shiftright(byte, 5).bitwiseAND(F.lit(3))))
    return {"kind": kind, "show_idx": F.when(byte >= 128, F.shiftright(byte, 4).bitwiseAND(F.lit(7))), "has_header": F.exists(found, lambda u: u["type"] == 1)}


def sequence_header(data: bytes | None) -> dict:
    """What the header of a coded sequence says of size, depth, layout, colour and tools; `more` is what frame headers need besides."""
    b = Bits(data or b"")
    profile, still, reduced = b.read(3), b.flag(), b.flag()
    if profile > 2:
        raise Fault("bitstream", f"profile {profile}")
    more = {"model": False, "equal_interval": False, "presentation_bits": 0, "removal_bits": 0, "points": [(0, False)], "id_bits": 0, "delta_id_bits": 0, "screen": 2, "integer_mv": 2, "warped": False, "ref_mvs": False, "separate_uv": False}
    level = b.read(5) if reduced else _operating_points(b, more)
    more["wide"], more["high"] = b.read(4) + 1, b.read(4) + 1
    out = {"profile": profile, "still": still, "reduced": reduced, "level": level, "points": len(more["points"]), "width": b.read(more["wide"]) + 1, "height": b.read(more["high"]) + 1}
    if not reduced and b.flag():
        more["delta_id_bits"] = b.read(4) + 2
        more["id_bits"] = b.read(3) + more["delta_id_bits"] + 1
        if more["id_bits"] > 16:
            raise Fault("bitstream", "frame ids of more than 16 bits")
    out["large_blocks"], out["filter_intra"], out["intra_edge"] = b.flag(), b.flag(), b.flag()
    out["order_bits"] = 0 if reduced else _inter_tools(b, more)
    out["superres"], out["cdef"], out["restoration"] = b.flag(), b.flag(), b.flag()
    colour = _colour(b, profile)
    more["separate_uv"] = colour.pop("separate_uv")
    return out | colour | {"grain": b.flag(), "more": more}


def _operating_points(b: Bits, more: dict) -> int:
    """Level of the first operating point."""
    delay_bits = 0
    if b.flag():  # timing
        b.read(64)
        more["equal_interval"] = b.flag()
        if more["equal_interval"]:
            b.uvlc()
        more["model"] = b.flag()
        if more["model"]:
            delay_bits = b.read(5) + 1
            b.read(32)
            more["removal_bits"], more["presentation_bits"] = b.read(5) + 1, b.read(5) + 1
    display = b.flag()
    points, levels = [], []
    for _ in range(b.read(5) + 1):
        idc = b.read(12)
        levels.append(b.read(5))
        if levels[-1] > 7:
            b.flag()
        modelled = more["model"] and b.flag()
        if modelled:
            b.read(2 * delay_bits + 1)
        if display and b.flag():
            b.read(4)
        points.append((idc, modelled))
    more["points"] = points
    return levels[0]


def _inter_tools(b: Bits, more: dict) -> int:
    """Bits of an order hint."""
    b.read(2)
    more["warped"] = b.flag()
    b.flag()
    ordered = b.flag()
    if ordered:
        b.flag()
        more["ref_mvs"] = b.flag()
    more["screen"] = 2 if b.flag() else b.read(1)
    if more["screen"]:
        more["integer_mv"] = 2 if b.flag() else b.read(1)
    return b.read(3) + 1 if ordered else 0


def _colour(b: Bits, profile: int) -> dict:
    high = b.flag()
    depth = 12 if profile == 2 and high and b.flag() else 10 if high else 8
    mono = profile != 1 and b.flag()
    described = b.flag()
    codes = [b.read(8) for _ in range(3)] if described else [2, 2, 2]
    out = {"depth": depth, "mono": mono, "described": described, "primaries": codes[0], "transfer": codes[1], "matrix": codes[2], "position": None}
    if mono:
        return out | {"full": b.flag(), "sub_x": True, "sub_y": True, "separate_uv": False}
    if codes == [1, 13, 0]:
        full, sub_x, sub_y = True, False, False
    else:
        full = b.flag()
        sub_x = profile == 0 or (profile == 2 and (depth < 12 or b.flag()))
        sub_y = profile == 0 or (profile == 2 and depth == 12 and sub_x and b.flag())
        if sub_x and sub_y:
            out["position"] = b.read(2)
    return out | {"full": full, "sub_x": sub_x, "sub_y": sub_y, "separate_uv": b.flag()}


TYPES[sequence_header] = (
    "struct<profile: int, still: boolean, reduced: boolean, level: int, points: int, width: bigint, height: bigint, large_blocks: boolean, filter_intra: boolean, intra_edge: boolean, order_bits: int, "
    "superres: boolean, cdef: boolean, restoration: boolean, depth: int, mono: boolean, described: boolean, primaries: int, transfer: int, matrix: int, position: int, full: boolean, sub_x: boolean, sub_y: boolean, grain: boolean>"
)


def header_faults(record: Column, header: Column, nclx: Column, size: Column) -> Column:
    """bitstream where a file's boxes contradict its sequence header: codec record, colour description (2 matches anything), size; else null.

    record and header: structs of codec_record() and sequence_header(); nclx: array of primaries, transfer, matrix and range, or null;
    size: array of width and height.
    """
    differs = lambda *names: functools.reduce(lambda a, b: a | b, (record[n] != header[n] for n in names))
    layout = differs("profile", "level", "depth", "mono", "sub_x", "sub_y") | (header["position"].isNotNull() & (record["position"] != header["position"]))
    code = lambda i, name: (F.get(nclx, F.lit(i)) != 2) & (F.get(nclx, F.lit(i)) != header[name])
    colour = header["described"] & (code(0, "primaries") | code(1, "transfer") | code(2, "matrix"))
    unspecified = (F.get(nclx, F.lit(0)) == 2) & (F.get(nclx, F.lit(1)) == 2) & (F.get(nclx, F.lit(2)) == 2)
    ranged = ((F.get(nclx, F.lit(3)) == 1) != header["full"]) & ~unspecified
    sized = (F.get(size, F.lit(0)) != header["width"]) | (F.get(size, F.lit(1)) != header["height"])
    return F.when(layout | (nclx.isNotNull() & (colour | ranged)) | sized, "bitstream")


def layout_faults(header: Column, layout: Column) -> Column:
    """bitstream where extended pixel information (its text: type:location or - per channel) contradicts the sequence header; null without it.

    Types: 0 full, 1 half as wide, 2 half in both, 4 half as high; locations count for chroma only: 0 vertical, 2 colocated.
    """
    channels = F.split(layout, ",")
    chroma = F.when(header["sub_x"] & header["sub_y"], 2).when(header["sub_x"], 1).when(header["sub_y"], 4).otherwise(0)
    place = F.when(header["position"] == 1, 0).when(header["position"] == 2, 2)

    def bad(text: Column, i: Column) -> Column:
        kind, location = (F.split_part(text, F.lit(":"), F.lit(k)).try_cast("int") for k in (1, 2))
        wrong = (kind != F.when(i == 0, 0).otherwise(chroma)) | ((i > 0) & ((header["position"] == 3) | F.coalesce(location != place, F.lit(False))))
        return F.when(text == "-", False).otherwise(F.coalesce(wrong, F.lit(False)))

    count = F.size(channels) != F.when(header["mono"], 1).otherwise(3)
    return F.when(layout.isNotNull() & (count | F.exists(F.transform(channels, bad), lambda b: b)), "bitstream")


def preflight_fault(depth: Column) -> Column:
    """unsupported for depths that aren't decoded."""
    return F.when(~depth.isin(8, 10, 12), "unsupported")


# --- frames of a sample, tiles of a frame


def encoded_unit(kind: int, payload: bytes) -> bytes:
    """A unit with its size and without an extension."""
    size, n = bytearray(), len(payload)
    while n > 127:
        size.append(n & 127 | 128)
        n >>= 7
    return bytes([kind << 3 | 2, *size, n]) + payload


def frame_units(data: bytes | None) -> list[dict]:
    """The frames of a sample as streams of their own: a frame, or a frame header with the tile groups after it up to the next frame or
    delimiter; the sample's first sequence header stands before each."""
    found = units(data)
    body = lambda u: data[u["offset"] : u["offset"] + u["size"]]
    prefix = next((encoded_unit(1, body(u)) for u in found if u["type"] == 1), b"")
    out, headed = [], False
    for u in found:
        if u["type"] in (3, 6):
            out.append(prefix + encoded_unit(u["type"], body(u)))
            headed = u["type"] == 3
        elif u["type"] == 4 and headed:
            out[-1] += encoded_unit(4, body(u))
        elif u["type"] == 2:
            headed = False
    return [{"payload": p, "has_header": bool(prefix)} for p in out]


TYPES[frame_units] = "array<struct<payload: binary, has_header: boolean>>"

#: The widest tile in samples, and the largest in area.
TILE_WIDTH, TILE_AREA = 4096, 4096 * 2304


def _log2(unit: int, whole: int) -> int:
    """The least n with unit * 2^n >= whole."""
    return max(0, (-(-whole // unit) - 1).bit_length())


def tile_layout(b: Bits, width: int, height: int, large_blocks: bool, reduced: bool = False) -> dict:
    """Starts of tile columns and rows in units of 4 samples, the end last, and the bytes of a tile's size."""
    shift = 5 if large_blocks else 4
    mi = [2 * -(-n // 8) for n in (width, height)]
    sb = [-(-n // (1 << shift)) for n in mi]
    widest, area = TILE_WIDTH >> (shift + 2), TILE_AREA >> 2 * (shift + 2)
    least = _log2(widest, sb[0])
    least_all = max(least, _log2(area, sb[0] * sb[1]))
    starts: list[list[int]] = []
    logs: list[int] = []
    if b.flag():  # uniform
        for axis in (0, 1):
            low = least if axis == 0 else max(_log2(max(area // max(sb[0], 1), 1), sb[1]), least_all - logs[0])
            most = _log2(1, sb[axis])
            while low < most and b.flag():
                low += 1
            step = -(-sb[axis] // (1 << low))
            starts.append([at << shift for at in range(0, sb[axis], step)] + [mi[axis]])
            logs.append(low)
    else:
        largest = 0
        for axis in (0, 1):
            limit, at, own = (widest if axis == 0 else max(area // max(largest, 1), 1)), 0, []
            while at < sb[axis]:
                own.append(at << shift)
                size = b.below(min(limit, sb[axis] - at)) + 1
                largest = max(largest, size) if axis == 0 else largest
                at += size
            starts.append([*own, mi[axis]])
            logs.append(_log2(1, len(own)))
    columns, rows = (len(s) - 1 for s in starts)
    context = b.read(sum(logs)) if columns * rows > 1 else 0
    dependent = not reduced and logs[1] > 0 and b.flag()
    across = b.flag() if not reduced and sum(logs) > 0 else columns * rows > 1
    return {"columns": starts[0], "rows": starts[1], "logs": sum(logs), "context": context, "dependent": dependent, "across": across, "size_bytes": b.read(2) + 1 if columns * rows > 1 else 0}


def tile_group(data: bytes, b: Bits, tiles: int, logs: int, size_bytes: int) -> list[dict]:
    """tile, offset and size of each payload in a tile group; b stands where the group begins."""
    first, last = 0, tiles - 1
    if tiles > 1 and b.flag():
        first, last = b.read(logs), b.read(logs)
    if first > last or last >= tiles:
        raise Fault("bitstream", f"tiles {first} to {last} of {tiles}")
    b.align()
    at, out = b.at // 8, []
    for tile in range(first, last + 1):
        size = len(data) - at
        if tile < last:
            if at + size_bytes > len(data):
                raise Fault("short", "tile size")
            size = int.from_bytes(data[at : at + size_bytes], "little") + 1
            at += size_bytes
        if at + size > len(data):
            raise Fault("short", "tile payload")
        out.append({"tile": tile, "offset": at, "size": size})
        at += size
    return out


def tile_rectangles(layout: DataFrame) -> DataFrame:
    """layout (columns width, height, shift of a block, columns and rows as tile_layout() gives them) with a row per tile: tile, its place, its blocks
    and its samples. No shuffle."""
    spans = lambda c, size: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, i: F.struct(i.cast("long").alias("at"), a.alias("start"), F.get(c, i + 1).alias("stop"), F.col(size).alias("size")))
    keys = [c for c in layout.columns if c not in ("columns", "rows")]
    n = (F.size("columns") - 1).alias("n")
    rows = layout.select(*keys, "columns", n, F.explode(spans("rows", "height")).alias("r"))
    each = rows.select(*keys, "n", "r", F.explode(spans("columns", "width")).alias("c"))
    block = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shift"))
    whole = lambda x: F.call_function("div", x, block)
    pixel = lambda s, k: F.least(F.col(f"{s}.{k}") * 4, F.col(f"{s}.size"))
    return each.select(
        *keys, (F.col("r.at") * F.col("n") + F.col("c.at")).alias("tile"), whole(F.col("c.start")).alias("sb_col_start"), whole(F.col("c.stop") + block - 1).alias("sb_col_end"), whole(F.col("r.start")).alias("sb_row_start"), whole(F.col("r.stop") + block - 1).alias("sb_row_end"),
        pixel("c", "start").alias("x"), pixel("r", "start").alias("y"), (pixel("c", "stop") - pixel("c", "start")).alias("tile_width"), (pixel("r", "stop") - pixel("r", "start")).alias("tile_height"),
    )
