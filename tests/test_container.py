"""Parsers of box bodies, unit streams and payloads on small cases, damaged ones too."""

import struct

import pytest

from tessera.operators import items
from tessera.sources import bodies, payloads
from tessera.sources.bodies import Bits, Cursor, Fault, box, full_box

FTYP = box("ftyp", b"avif\0\0\0\0mif1")


def test_large_and_open_sizes():
    big = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    out = bodies.parse(FTYP + big + struct.pack(">I4s", 0, b"mdat") + b"rest")
    assert "fault" not in out and out["major"] == "avif" and out["brands"] == ["mif1"]
    for bad in (b"", None, b"\0\0\0", FTYP[:10], struct.pack(">I4sQ", 1, b"ftyp", 1 << 62), struct.pack(">I4s", 4, b"ftyp")):
        assert bodies.parse(bad)["fault"] in ("short", "bitstream")


@pytest.mark.parametrize(
    ("meta", "fault"),
    [
        (full_box("pitm", b"\0\1", 2), "unsupported"), (full_box("pitm", b""), "short"), (full_box("iinf", b"\0\1", 2), "unsupported"), (full_box("iinf", b"\0\1" + full_box("infe", bytes(9), 1)), "unsupported"),
        (full_box("iinf", b"\0\1" + full_box("infe", b"\0\1\0\0av01\xff\0", 2)), "bitstream"), (full_box("iloc", bytes([0x44, 0x50, 0, 0])), "unsupported"), (full_box("iloc", bytes([0x44, 0, 0, 1, 0, 1, 0, 1, 0, 0])), "unsupported"),
        (full_box("iloc", bytes([0x44, 0, 0, 1, 0, 1, 0, 3, 0, 0, 0, 0]), 1), "unsupported"), (full_box("iloc", bytes([0x44, 0x04, 0, 1, 0, 1, 0, 2, 0, 0, 0, 1]) + bytes(12), 1), "bitstream"),
        (full_box("iref", b"", 2), "unsupported"), (full_box("iref", box("dimg", b"\0\1\0\2\0\1")), "short"), (box("grpl", full_box("altr", bytes(8), 1)), "unsupported"),
        (box("iprp", full_box("ipma", b"\0\0\0\1\0\1\2\1")), "short"), (box("iprp", box("ipco", box("lsel", b"1"))), "bitstream"), (box("iprp", box("ipco", box("a1lx", b"\2"))), "bitstream"),
        (box("iprp", box("ipco", box("clap", bytes(31)))), "short"), (box("iprp", box("ipco", full_box("ispe", bytes(4)))), "short"), (box("iprp", box("ipco", full_box("pixi", b"\1\x08", 0, 2))), "unsupported"),
        (box("iprp", box("ipco", full_box("pixi", b"\1\x08\x10", 0, 1))), "bitstream"), (box("iprp", box("ipco", full_box("auxC", b"\xff\0"))), "bitstream"),
    ],
)
def test_broken_meta_boxes(meta, fault):
    assert bodies.parse(FTYP + full_box("meta", meta))["fault"] == fault


def test_extended_pixel_information():
    # one channel, subsampled 4:2:0 at location 1, labelled; then a plain one
    out = bodies.parse(FTYP + full_box("meta", box("iprp", box("ipco", full_box("pixi", bytes([2, 8, 10, 0b00000011, 0x21]) + b"luma\0" + bytes([0]), 0, 1)))))
    assert out["props"][0]["numbers"] == [8, 10] and out["props"][0]["text"] == "2:1,-"


def test_associations_add_up_but_do_not_repeat():
    one, two = full_box("ipma", b"\0\0\0\1\0\1\2\1\1"), full_box("ipma", b"\0\0\0\1\0\1\1\2")
    out = bodies.parse(FTYP + full_box("meta", box("iprp", one + two)))
    assert [(a["pos"], a["index"]) for a in out["assoc"]] == [(0, 1), (1, 1), (2, 2)]
    assert bodies.parse(FTYP + full_box("meta", box("iprp", one + one)))["fault"] == "bitstream"


def test_bit_reader():
    bits = Bits(bytes([0b10100000, 0b01000000]))
    assert (bits.read(1), bits.read(2)) == (1, 1)
    bits = Bits(bytes([0b00101000]))
    assert bits.uvlc() == 4  # two zeros, then 01 after the one
    assert Bits(bytes(5)).uvlc() == 0xFFFFFFFF
    # below(5): 3 short codes of 2 bits, 2 long ones of 3
    assert [Bits(bytes([b])).below(5) for b in (0b00000000, 0b01000000, 0b10000000, 0b11000000, 0b11100000)] == [0, 1, 2, 3, 4]
    bits = Bits(bytes([0b10000000, 1]))
    bits.read(1)
    bits.align()
    assert bits.at == 8
    bits = Bits(bytes([0b10000001]))
    bits.read(1)
    with pytest.raises(Fault):
        bits.align()
    with pytest.raises(Fault):
        Bits(b"a").read(9)


def test_unit_streams():
    assert payloads.leb128(Cursor(bytes([0xE5, 0x8E, 0x26]))) == 624485
    for bad, kind in ((bytes([0x80] * 8), "bitstream"), (bytes([0x80]), "short")):
        with pytest.raises(Fault) as e:
            payloads.leb128(Cursor(bad))
        assert e.value.kind == kind
    for data, kind in ((b"\x0e", "short"), (b"\x0a\x80", "short"), (b"\x0a\x02\xff", "short"), (b"\x80", "bitstream"), (b"\x09", "bitstream")):
        with pytest.raises(Fault) as e:
            payloads.units(data)
        assert e.value.kind == kind
    assert payloads.units(None) == [] and payloads.units(b"\x10")[0]["size"] == 0


def test_sample_programs():
    assert payloads.program(bytes([2, 5, 1, 0]) + struct.pack(">i", -7) + bytes([2, 128, 130])) == (32, [("input", "in_0"), ("const", -7), ("input", "in_1"), "add", "mul"])
    for bad, kind in ((b"\2", "short"), (b"\2\0", "bitstream"), (b"\x42\1\1", "unsupported"), (b"\2\1\x40", "bitstream"), (b"\2\2\1\x80", "bitstream"), (b"\2\1\x21", "unsupported"), (b"\0\1\1\1", "bitstream"), (b"\1\1\0", "short")):
        with pytest.raises(Fault) as e:
            payloads.program(bad)
        assert e.value.kind == kind, bad


def test_payloads_of_items_in_items(spark):
    """Item 3 lies in item 2, which lies in the file; 4 and 5 lie in each other; 6 points outside, 7 has no reference, 8 no extent."""
    def entry(item, method, *extents):
        return struct.pack(">HHHH", item, method, 0, len(extents)) + b"".join(struct.pack(">III", *e) for e in extents)

    iloc = full_box("iloc", bytes([0x44, 0x04]) + struct.pack(">H", 7) + entry(2, 0, (1, 0, 8), (1, 4, 4)) + entry(3, 2, (1, 8, 4), (1, 0, 2)) + entry(4, 2, (1, 0, 1)) + entry(5, 2, (1, 0, 1)) + entry(6, 0, (1, 1 << 20, 4)) + entry(7, 2, (1, 0, 1)) + entry(8, 0), 1)
    iref = full_box("iref", box("iloc", b"\0\3\0\1\0\2") + box("iloc", b"\0\4\0\1\0\5") + box("iloc", b"\0\5\0\1\0\4"))
    content = FTYP + full_box("meta", iloc + iref)
    files = spark.createDataFrame([("a", bytearray(content))], "path string, content binary")
    got = {r.item: (bytes(r.payload) if r.payload is not None else None, r.fault) for r in items.payloads(files, bodies.file_tables(files)).collect()}
    assert got[2] == (content[:8] + b"ftyp", None) and got[3] == (b"ftyp" + content[:2], None)
    assert got[4] == got[5] == (None, "bitstream") and got[6] == (None, "short") and got[7] == (None, "bitstream") and got[8] == (b"", None)


def test_faulty_tracks(spark):
    base = {"path": "a", "auxl": [], "aux_type": None, "timescale": 1, "sizes": [1, 2, 3], "chunks": [0, 9], "per_chunk": [(1, 2, 1), (2, 1, 1)], "durations": [(3, 5)], "descriptions": [bytearray(b"x"), None], "edits": None}
    changes = [{}, {"per_chunk": []}, {"per_chunk": [(2, 3, 1)]}, {"per_chunk": [(1, 2, 0), (2, 1, 1)]}, {"per_chunk": [(1, 2, 2), (2, 1, 1)]}, {"per_chunk": [(1, 2, 1)]}, {"sizes": [1, 2]}, {"durations": [(2, 5)]}, {"durations": None}, {"per_chunk": [(2, 1, 1), (1, 2, 1)], "sizes": [1, 2, 3, 4], "durations": [(4, 5)]}]
    schema = "path string, " + bodies.FIELDS["tracks"].removeprefix("array<struct<").removesuffix(">>").replace(": array", " array").replace("track_no:", "track_no").replace("aux_type:", "aux_type").replace("timescale:", "timescale")
    rows = [{**base, **c, "track_no": i} for i, c in enumerate(changes)]
    names = ["path", "track_no", "auxl", "aux_type", "timescale", "sizes", "chunks", "per_chunk", "durations", "descriptions", "edits"]
    tracks = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    assert {r.track_no for r in items.track_faults(tracks).collect()} == {1, 2, 3, 4, 5, 6, 7}
    # the last record in table order counts, whatever its first chunk
    last = sorted((r.sample_no, r.offset) for r in items.track_samples(tracks.where("track_no = 9")).collect())
    assert last == [(0, 0), (1, 1), (2, 9), (3, 12)]


def test_roles_counts_and_descriptions(spark):
    rows = [("a", 0, [], None, [1, 2]), ("a", 1, [], None, [1]), ("a", 2, [1], items.ALPHA, [1]), ("a", 3, [1], "other", [1]), ("b", 0, [], items.ALPHA, [1]), ("c", 0, [], None, [1]), ("c", 1, [1], items.ALPHA, [1])]
    tracks = spark.createDataFrame(rows, "path string, track_no int, auxl array<long>, aux_type string, sizes array<long>")
    roles = items.track_roles(tracks)
    assert sorted((r.path, r.track_no, r.role) for r in roles.collect()) == [("a", 0, "colour"), ("a", 2, "alpha"), ("c", 0, "colour"), ("c", 1, "alpha")]
    assert [tuple(r) for r in items.alpha_count_faults(roles).collect()] == [("a", 2, 1)]
    described = spark.createDataFrame([("a", 0, [None, bytearray(b"x"), bytearray(b"y"), bytearray(b"x")])], "path string, track_no int, descriptions array<binary>")
    samples = spark.createDataFrame([("a", 0, n, d) for n, d in enumerate((2, 3, 3, 4))], "path string, track_no int, sample_no long, description long")
    headers = spark.createDataFrame([("a", 0, 1, True), ("a", 0, 2, False)], "path string, track_no int, sample_no long, has_header boolean")
    assert [r.sample_no for r in items.description_faults(samples, described, headers).collect()] == [2]


def test_frames_of_a_sample():
    unit = payloads.encoded_unit
    data = unit(2, b"") + unit(1, b"sh") + unit(3, b"a") + unit(4, b"t1") + unit(4, b"t2") + unit(2, b"") + unit(4, b"lost") + unit(6, b"f") + unit(4, b"lost") + unit(3, b"b") + unit(6, b"g" * 200)
    prefix = unit(1, b"sh")
    assert [u["payload"] for u in payloads.frame_units(data)] == [prefix + unit(3, b"a") + unit(4, b"t1") + unit(4, b"t2"), prefix + unit(6, b"f"), prefix + unit(3, b"b"), prefix + unit(6, b"g" * 200)]
    assert payloads.frame_units(unit(6, b"x")) == [{"payload": unit(6, b"x"), "has_header": False}] and payloads.frame_units(None) == []


def test_tiles_of_unequal_sizes_and_their_payloads():
    # 20 blocks of 64 across, 3 down: columns of 4, 15 and 1 blocks, rows of 1 and 2
    text = "0" + "0011" + "1110" + "0" + "1"  # widths 4 and 15 (the last is 1 without a bit), heights 1 and 2
    layout = payloads.tile_layout(Bits(int((text + "0" * 64)[:64], 2).to_bytes(8, "big")), 1280, 190, False)
    assert layout["columns"] == [0, 64, 304, 320] and layout["rows"] == [0, 16, 48]
    group = bytes([0b10111000]) + bytes([2, 0]) + b"abc" + b"rest"  # tiles 1 to 2 of 4, sizes of two bytes
    assert payloads.tile_group(bytes([0b10110000]) + group[1:], Bits(bytes([0b10110000]) + group[1:]), 4, 2, 2) == [{"tile": 1, "offset": 3, "size": 3}, {"tile": 2, "offset": 6, "size": 4}]
    one = payloads.tile_group(b"whole", Bits(b"whole"), 1, 0, 0)
    assert one == [{"tile": 0, "offset": 0, "size": 5}]
    with pytest.raises(Fault):
        payloads.tile_group(bytes([0b11001000]), Bits(bytes([0b11001000])), 4, 2, 1)  # from 2 to 1
    with pytest.raises(Fault):
        payloads.tile_group(bytes([0, 9, 9]), Bits(bytes([0, 9, 9])), 2, 1, 1)  # a size outside


def test_pixel_layouts_against_headers(spark):
    from pyspark.sql import functions as F

    cases = [
        (False, True, True, 1, "0:0,2:0,2:0", None), (False, True, True, 1, "0:0,2:2,2:0", "bitstream"), (False, True, True, 0, "-,2:4,-", None), (False, True, True, 3, "-,2:0,-", "bitstream"), (False, True, True, 2, "-,2:2,2:2", None),
        (False, True, False, None, "-,1:0,1:0", None), (False, True, False, None, "-,2:0,1:0", "bitstream"), (False, False, False, None, "0:0,0:0,0:0", None), (False, False, False, None, "0:0", "bitstream"), (True, True, True, None, "0:0", None), (True, True, True, None, "-,-,-", "bitstream"), (False, True, True, 1, None, None),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, mono boolean, sub_x boolean, sub_y boolean, position int, layout string")
    header = F.struct("mono", "sub_x", "sub_y", "position")
    assert {r.i: r.fault for r in df.select("i", payloads.layout_faults(header, F.col("layout")).alias("fault")).collect()} == {i: c[5] for i, c in enumerate(cases)}
    assert [r[0] for r in spark.createDataFrame([(8,), (9,), (12,)], "d int").select(payloads.preflight_fault(F.col("d"))).collect()] == [None, "unsupported", None]
