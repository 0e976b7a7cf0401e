"""Every registered query against its SQL in DuckDB, and operators on small cases."""

import glob
import os
import struct

import duckdb
import pytest

from tessera.functions import colour
from tessera.functions.sample_expression import compile_expression
from tessera.operators import frames, planes, relations, sequence
from tessera.plans import ORACLE_SQL, QUERIES
from tessera.sources.boxes import boxes


def ordered(columns, rows):
    return sorted(tuple(str(v) for _, v in sorted(zip(columns, r, strict=True))) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert ordered(got.columns, got.collect()) == ordered(columns, want.fetchall())


def value(spark, tokens, **how):
    return spark.range(1).select(compile_expression(tokens, **how).alias("v")).first().v


def test_expressions_saturate_and_refuse(spark):
    big = ("const", (1 << 63) - 1)
    assert value(spark, [big, big, "mul", ("const", 56), "div"], bits=64, depth=16) == 65535
    assert value(spark, [("const", -3), ("const", 3), "pow", "neg"], bits=32) == 27
    assert value(spark, [("const", -7), ("const", 2), "div", "neg"], bits=32) == 3
    assert value(spark, [("const", 2), ("const", 100), "pow"], bits=8) == 127
    for tokens in ([], ["add"], [("const", 1), ("const", 2)], ["sqrt"]):
        with pytest.raises(ValueError):
            compile_expression(tokens)
    for tokens in ([("const", 1), ("const", 0), "div"], [("const", 2), ("const", -1), "pow"]):
        with pytest.raises(Exception, match="bitstream|unsupported"):
            value(spark, tokens)


def test_closure_survives_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "s long, d long")
    got = relations.closure(edges, spark.createDataFrame([(1,), (9,), (7,)], "r long"), "s", "d", "r")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (7, 7, 0), (9, 9, 0)]


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_boxes_of_good_and_damaged_files(spark):
    good = box(b"ftyp", b"avif") + box(b"meta", b"\0" * 4 + box(b"iprp", box(b"ipco", box(b"ispe", b"12"))) + box(b"idat", b""))
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"\0\0\0")), ("c", None), ("d", bytearray(struct.pack(">I4s", 99, b"free")))], "path string, content binary")
    rows = boxes(files).collect()
    assert [(r.type, r.depth, r.parent_no) for r in rows if r.path == "a"] == [("ftyp", 0, None), ("meta", 0, None), ("iprp", 1, 1), ("ipco", 2, 2), ("ispe", 3, 3), ("idat", 1, 1)]
    assert [(r.path, r.error) for r in rows if r.error] == [("b", "truncated header"), ("d", "size outside its parent")]


def test_clean_aperture_and_gain_weight():
    assert planes.crop_box(10, 4, 1, 0, 1) == (3, 4)
    assert planes.crop_box(10, 5, 1, 0, 1) == (3, 5)  # halves are cut off one by one: 5 + 0 - 2
    assert planes.crop_box(11, 5, 1, -3, 2) == (2, 5)  # 5 - 1 - 2
    for bad in ((10, 11, 1, 0, 1), (10, 4, 0, 0, 1), (10, 4, 1, 0, 0), (10, 4, 1, 9, 1)):
        with pytest.raises(ValueError):
            planes.crop_box(*bad)
    assert colour.gain_weight(1.0, 0.0, 4.0) == 0.25 and colour.gain_weight(9.0, 0.0, 4.0) == 1.0 and colour.gain_weight(1.0, 2.0, 2.0) == 0.0
    assert colour.gain_weight(1.0, 0.0, 4.0, backward=True) == -0.25
    for bad in (float("nan"), float("inf"), -1.0):
        with pytest.raises(ValueError):
            colour.gain_weight(bad, 0.0, 1.0)


def test_long_programs_compile_and_run(spark):
    for n in (11, 60):
        assert value(spark, [("const", 5), *["neg"] * n], bits=32) == (0 if n % 2 else 5)
    series = [("const", 1)]
    for k in range(40):
        series += [("const", k), "add", ("const", 3), "mul", ("const", 1000), "min"]
    want = 1
    for k in range(40):
        want = min((want + k) * 3, 1000)
    assert value(spark, series, bits=32, depth=16) == want


def test_primaries_and_derived_weights():
    import numpy as np

    for code in colour.PRIMARIES:
        m = np.array([[float(v) for v in row] for row in colour.rgb_to_xyz(code)])
        xyz = [np.array([x / y, 1, (1 - x - y) / y]) for x, y in colour.PRIMARIES[code]]
        assert m @ np.ones(3) == pytest.approx(xyz[3])  # white
        for i in range(3):
            assert m[:, i] / m[1, i] == pytest.approx(xyz[i])
        back = np.array(colour.primaries_matrix(1, code)) @ np.array(colour.primaries_matrix(code, 1))
        assert back == pytest.approx(np.eye(3), abs=1e-12)
    assert colour.luma_weights(1) == pytest.approx((0.2126, 0.0722), abs=1e-4) and colour.luma_weights(9) == pytest.approx((0.2627, 0.0593), abs=1e-4)
    assert colour.shared_primaries(2, 9) == (9, 9) and colour.shared_primaries(1, 2) == (1, 1) and colour.shared_primaries(1, 9) == (1, 9) and colour.shared_primaries(9, None) == (9, 9)
    for f in (lambda: colour.transfer_curve(3), lambda: colour.rgb_to_xyz(2), lambda: colour.sample_range(7, True)):
        with pytest.raises(ValueError):
            f()
    assert [colour.matrix_code(*x) for x in ((None, True), (None, False), (9, True))] == [6, 2, 9]


def test_negative_channels_move_to_their_luminance(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([0.5, -0.25, 1.0],), ([0.2, 0.3, 0.4],), ([-1.0, -1.0, -1.0],)], "c array<double>").select(colour.in_gamut(F.col("c")).alias("c")).collect()
    light = 0.5 * 0.2126 - 0.25 * 0.7152 + 0.0722
    share = max(light, 0) / (max(light, 0) + 0.25)
    assert rows[0].c == pytest.approx([max(light, 0) + share * (v - max(light, 0)) for v in (0.5, -0.25, 1.0)])
    assert rows[1].c == [0.2, 0.3, 0.4] and rows[2].c == pytest.approx([0, 0, 0])


def test_every_user_has_a_repetition(spark, sf_dir, duck):
    got = QUERIES["repetition_class"](spark, sf_dir).collect()
    assert {r.kind for r in got} == {"infinite", "finite", "unknown"}
    assert {r.user_id for r in got} == {x for (x,) in duck.execute("SELECT DISTINCT user_id FROM events").fetchall()}
    assert sum(r.n + 1 for r in got if r.kind == "finite") == duck.execute("SELECT count(*) FROM events WHERE user_id % 3 = 1").fetchone()[0]


def test_tiles_are_merged_or_refused(spark):
    tiles = spark.createDataFrame([(1, 1, 5), (1, 0, 7), (2, 0, 3), (3, 0, 1), (3, 0, 1), (4, 2, 1), (5, 0, 1)], "k long, tile long, size long")
    counts = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, 2), (5, 0), (6, 1)], "k long, n long")
    got = sorted((tuple(r) for r in sequence.merge_tiles(tiles, "k", "tile", "size", counts, "n").collect()), key=str)
    b, u = "bitstream", "unsupported"
    assert got == [(1, None, 0, 0, 7), (1, None, 1, 7, 5), (2, u, None, None, None), (3, b, None, None, None), (4, b, None, None, None), (5, b, None, None, None), (6, u, None, None, None)]


def test_first_association_record_counts(spark):
    own = spark.createDataFrame([(1, 9, 0, 0, 1), (1, 9, 0, 1, 3), (1, 9, 1, 0, 2)], "file long, item long, record long, pos long, index long")
    properties = spark.createDataFrame([(1, 1, "ispe", "a"), (1, 2, "irot", "b"), (1, 3, "ispe", "c")], "file long, place long, kind string, value string")
    assert [tuple(r) for r in relations.item_properties(own, properties).collect()] == [(1, 9, "ispe", "c")]


def test_alpha_of_a_grid(spark):
    line = "frame_id long, plane int, width long, height long, sub_x int, sub_y int, depth int, y long, samples array<long>"
    rows = spark.createDataFrame([(7, 0, 3, 2, 0, 0, 10, y, [1, 2, 3]) for y in range(2)], line)
    lines = spark.createDataFrame([(i, 0, 2, 1, 0, 0, 8, 0, [i, 255]) for i in range(4)], line)
    cells = spark.createDataFrame([(7, i, i, 2, 1) for i in range(4)], "grid_id long, frame_id long, pos long, width long, height long")
    grids = spark.createDataFrame([(7, 2, 2, 3, 2)], "grid_id long, rows long, columns long, width long, height long")
    got = frames.append_alpha_grid(rows, lines, cells, grids).where("plane = 3").orderBy("y").collect()
    scale = lambda v: (v * 1023 + 127) // 255
    assert [r.samples for r in got] == [[scale(v) for v in own] for own in ([0, 255, 1], [2, 255, 3])] and {(r.frame_id, r.depth) for r in got} == {(7, 10)}
