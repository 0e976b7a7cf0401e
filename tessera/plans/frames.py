"""Queries over native planes and pixels, a frame per part or a pixel per event, with odd and even sizes, 8, 10 and 12 bits and every chroma
layout; the SQL works on single samples."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.functions import icc
from tessera.operators import frames as P
from tessera.operators.staging import spread
from tessera.plans.queries import query

#: The frames' rule: size, depth, chroma layout (mono, 4:4:4, 4:2:2, 4:2:0) and alpha by key; a sample by its place.
F_SQL = """f AS (SELECT p_partkey AS k, 4 + p_partkey // 3 % 5 AS w, 3 + p_partkey // 4 % 4 AS h, 8 + 2 * (p_partkey % 3) AS d, CASE WHEN p_partkey % 4 >= 2 THEN 1 ELSE 0 END AS sx, CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 0 END AS sy FROM part),
l AS (SELECT f.*, p.range AS p, CASE WHEN p.range IN (1, 2) THEN sx ELSE 0 END AS px, CASE WHEN p.range IN (1, 2) THEN sy ELSE 0 END AS py FROM f, range(4) p WHERE (p.range = 0) OR (p.range < 3 AND k % 4 > 0) OR (p.range = 3 AND k % 5 = 0)),
s AS (SELECT l.*, x.range AS x, y.range AS y, (x.range * 7 + y.range * 13 + p * 29 + k * 31) % CAST(2 ** d AS BIGINT) AS v FROM l, range(9) x, range(7) y WHERE x.range < (w + px) // (1 + px) AND y.range < (h + py) // (1 + py))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("frame_id")
    third = lambda a, b: F.call_function("div", k, F.lit(a).cast("long")) % b
    f = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("frame_id")))
    return f.select("frame_id", (4 + third(3, 5)).alias("w"), (3 + third(4, 4)).alias("h"), (8 + 2 * (k % 3)).cast("int").alias("depth"), (k % 4 >= 2).cast("int").alias("sx"), (k % 4 == 3).cast("int").alias("sy"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all planes of all frames."""
    k = F.col("frame_id")
    kinds = F.filter(F.array(*map(F.lit, range(4))), lambda p: (p == 0) | ((p < 3) & (k % 4 > 0)) | ((p == 3) & (k % 5 == 0)))
    each = frames(spark, sf_dir).withColumn("plane", F.explode(kinds))
    chroma = F.col("plane").isin(1, 2)
    each = each.withColumns({"sub_x": F.when(chroma, F.col("sx")).otherwise(0), "sub_y": F.when(chroma, F.col("sy")).otherwise(0)})
    each = each.withColumns({"width": P.ceil_shift(F.col("w"), F.col("sub_x")), "height": P.ceil_shift(F.col("h"), F.col("sub_y"))})
    lines = each.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)))
    sample = lambda x: (x * 7 + F.col("y") * 13 + F.col("plane") * 29 + k * 31) % P.power_of_two(F.col("depth"))
    return lines.select("frame_id", "plane", "width", "height", "sub_x", "sub_y", "depth", "y", F.transform(F.sequence(F.lit(0).cast("long"), F.col("width") - 1), sample).alias("samples"))


def samples(lines: DataFrame) -> DataFrame:
    return lines.select("frame_id", F.col("plane").cast("long").alias("plane"), "y", F.posexplode("samples").alias("x", "v")).withColumn("x", F.col("x").cast("long"))


@query("""WITH f AS (SELECT p_partkey AS k, 20 + p_partkey % 7 AS size, 10 + p_partkey % 9 AS n, 1 + p_partkey % 2 AS d, (p_partkey % 11 - 5) * 3 AS off_n, p_partkey % 5 AS off_d FROM part),
s AS (SELECT k, n // d AS length, size, size // 2 + CAST(trunc(off_n / nullif(off_d, 0)) AS BIGINT) - n // d // 2 AS start FROM f)
SELECT k AS frame_id, length, start, CASE WHEN start IS NULL OR start < 0 OR start + length > size THEN 'bitstream' END AS fault FROM s""")
def aperture_boxes(spark, sf_dir):
    k = F.col("p_partkey")
    found = P.aperture(20 + k % 7, 10 + k % 9, 1 + k % 2, (k % 11 - 5) * 3, k % 5)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("frame_id"), *(c.alias(n) for n, c in found.items()))


BOX = {"crop_x": "CASE WHEN k % 6 = 0 THEN k % 3 WHEN k % 6 = 1 THEN 2 END", "crop_y": "CASE WHEN k % 6 = 0 THEN 0 WHEN k % 6 = 1 THEN k // 6 % 2 END", "crop_width": "CASE WHEN k % 6 < 2 THEN w - 2 END", "crop_height": "CASE WHEN k % 6 < 2 THEN h - 1 END"}


@query(f"""WITH {F_SQL}, b AS (SELECT s.*, {", ".join(f"{e} AS {n}" for n, e in BOX.items())} FROM s),
ok AS (SELECT * FROM b WHERE crop_x IS NULL OR ((px = 0 OR crop_x % 2 = 0) AND (py = 0 OR crop_y % 2 = 0))),
c AS (SELECT k, p, px, py, d, coalesce(crop_width, w) AS cw, coalesce(crop_height, h) AS ch, x - coalesce(crop_x, 0) // (1 + px) AS x, y - coalesce(crop_y, 0) // (1 + py) AS y, v FROM ok),
i AS (SELECT *, (cw + px) // (1 + px) AS pw, (ch + py) // (1 + py) AS ph FROM c), j AS (SELECT * FROM i WHERE x >= 0 AND x < pw AND y >= 0 AND y < ph),
m AS (SELECT k, p, pw, ph, CASE WHEN k % 3 = 0 THEN pw - 1 - x ELSE x END AS x, CASE WHEN k % 3 = 1 THEN ph - 1 - y ELSE y END AS y, v FROM j)
SELECT k AS frame_id, p AS plane, CASE k // 2 % 4 WHEN 0 THEN y WHEN 1 THEN pw - 1 - x WHEN 2 THEN ph - 1 - y ELSE x END AS y, CASE k // 2 % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN pw - 1 - x ELSE ph - 1 - y END AS x, v FROM m""")
def planes_transformed(spark, sf_dir):
    k = F.col("frame_id")
    size = frames(spark, sf_dir).select("frame_id", "w", "h")
    six, zero = k % 6, F.lit(0).cast("long")
    lines = planes(spark, sf_dir).join(size.hint("merge"), "frame_id").withColumns({
        "crop_x": F.when(six == 0, k % 3).when(six == 1, zero + 2), "crop_y": F.when(six == 0, zero).when(six == 1, F.call_function("div", k, F.lit(6).cast("long")) % 2),
        "crop_width": F.when(six < 2, F.col("w") - 2), "crop_height": F.when(six < 2, F.col("h") - 1),
        "axis": F.when(k % 3 < 2, k % 3), "turns": F.call_function("div", k, F.lit(2).cast("long")) % 4,
    })
    return samples(P.transform_planes(lines))


# --- mosaics: 2 x 3 cells of a part's grid


CELLS = """g AS (SELECT p_partkey AS g, 14 + p_partkey % 6 AS ow, 7 + p_partkey % 3 AS oh FROM part), c AS (SELECT g, ow, oh, i.range AS i, g * 6 + i.range AS k, 4 + 2 * (i.range % 3) + CASE WHEN g % 10 = 0 AND i.range = 4 THEN 2 ELSE 0 END AS w, 4 + 2 * (i.range // 3) AS h,
(g + i.range) % 4 = 0 AS mono, (g + i.range) % 5 = 0 AS alpha FROM g, range(6) i),
q AS (SELECT g, bool_or(NOT mono) AS colour, bool_or(alpha) AS alphas FROM c GROUP BY g),
p AS (SELECT c.*, p.range AS p, CASE WHEN p.range IN (1, 2) THEN 2 ELSE 1 END AS z, CASE WHEN p.range IN (1, 2) AND mono THEN 128 WHEN p.range = 3 AND NOT alpha THEN 255 END AS fill FROM c JOIN q USING (g), range(4) p WHERE p.range = 0 OR (p.range < 3 AND colour) OR (p.range = 3 AND alphas)),
s AS (SELECT g, ow, oh, i, p, z, x.range AS x, y.range AS y, coalesce(fill, (x.range * 7 + y.range * 13 + p * 29 + k * 31) % 256) AS v FROM p, range(10) x, range(6) y WHERE x.range < w // z AND y.range < h // z)"""


@query(f"""WITH {CELLS}, t AS (SELECT g, ow, p, (CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 10 END) // z + x AS x, (i // 3 * 4) // z + y AS y, (ow + z - 1) // z AS pw, (oh + z - 1) // z AS ph, v FROM s)
SELECT g AS frame_id, p AS plane, y, x, v::BIGINT AS v FROM t WHERE x < pw AND y < ph AND g % 10 <> 0 AND ow <= 18""")
def mosaic_planes(spark, sf_dir):
    g = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("grid_id")))
    long = lambda n: F.lit(n).cast("long")
    grids = g.select("grid_id", long(2).alias("rows"), long(3).alias("columns"), (14 + F.col("grid_id") % 6).alias("width"), (7 + F.col("grid_id") % 3).alias("height"))
    i, grid = F.col("pos"), F.col("grid_id")
    cells = g.withColumn("pos", F.explode(F.sequence(long(0), long(5))))
    cells = cells.select("grid_id", (grid * 6 + i).alias("frame_id"), "pos", (4 + 2 * (i % 3) + F.when((grid % 10 == 0) & (i == 4), 2).otherwise(0)).alias("width"), (4 + 2 * F.expr("pos div 3")).alias("height"), F.lit(8).alias("depth"))
    kinds = F.filter(F.array(*map(F.lit, range(4))), lambda p: (p == 0) | ((p < 3) & ((grid + i) % 4 > 0)) | ((p == 3) & ((grid + i) % 5 == 0)))
    each = cells.withColumn("plane", F.explode(kinds)).withColumn("sub_x", F.col("plane").isin(1, 2).cast("int")).withColumn("sub_y", F.col("sub_x"))
    each = each.withColumns({"width": P.ceil_shift(F.col("width"), F.col("sub_x")), "height": P.ceil_shift(F.col("height"), F.col("sub_y"))}).withColumn("y", F.explode(F.sequence(long(0), F.col("height") - 1)))
    sample = lambda x: (x * 7 + F.col("y") * 13 + F.col("plane") * 29 + F.col("frame_id") * 31) % 256
    lines = each.select("frame_id", "plane", "width", "height", "sub_x", "sub_y", "depth", "y", F.transform(F.sequence(long(0), F.col("width") - 1), sample).alias("samples"))
    return samples(P.mosaic(P.whole_cells(lines, cells), cells, grids))


@query(f"""WITH {CELLS} SELECT g AS grid_id, 'bitstream' AS fault FROM g WHERE g % 10 = 0 OR ow > 18""")
def mosaic_faults(spark, sf_dir):
    g = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("grid_id")))
    long = lambda n: F.lit(n).cast("long")
    cells = g.withColumn("pos", F.explode(F.sequence(long(0), long(5)))).withColumns({"width": 4 + 2 * (F.col("pos") % 3) + F.when((F.col("grid_id") % 10 == 0) & (F.col("pos") == 4), 2).otherwise(0), "height": 4 + 2 * F.expr("pos div 3")})
    return P.mosaic_faults(cells, g.select("grid_id", long(3).alias("columns"), (14 + F.col("grid_id") % 6).alias("width"), (7 + F.col("grid_id") % 3).alias("height")))


# --- alpha


@query(f"""WITH {F_SQL}, a AS (SELECT k, w, h, d, 8 + 2 * (k // 3 % 3) AS ad FROM f WHERE k % 5 <> 0), t AS (SELECT a.*, x.range AS x, y.range AS y, (x.range * 5 + y.range * 3 + k) % CAST(2 ** ad AS BIGINT) AS v, CAST(2 ** d AS BIGINT) - 1 AS top, CAST(2 ** ad AS BIGINT) - 1 AS atop FROM a, range(9) x, range(7) y WHERE x.range < w AND y.range < h)
SELECT k AS frame_id, 3::BIGINT AS plane, y, x, CASE WHEN d = ad THEN v ELSE (v * top + atop // 2) // atop END AS v FROM t""")
def alpha_appended(spark, sf_dir):
    k = F.col("frame_id")
    depth = (8 + 2 * (F.call_function("div", k, F.lit(3).cast("long")) % 3)).cast("int")
    line = planes(spark, sf_dir).where("plane = 0 and frame_id % 5 <> 0").withColumn("depth", depth)
    value = F.transform(F.sequence(F.lit(0).cast("long"), F.col("width") - 1), lambda x: (x * 5 + F.col("y") * 3 + k) % P.power_of_two(F.col("depth")))
    return samples(P.append_alpha(planes(spark, sf_dir), line.withColumn("samples", value)).where("plane = 3 and frame_id % 5 <> 0"))


@query("""SELECT p_partkey AS frame_id, CASE WHEN p_partkey % 7 = 0 THEN 'bitstream' WHEN p_partkey % 6 = 0 THEN 'unsupported' ELSE 'bitstream' END AS fault FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 6 = 0 OR p_partkey % 5 = 0""")
def alpha_faults(spark, sf_dir):
    k = F.col("frame_id")
    own = frames(spark, sf_dir).select("frame_id", F.col("w").alias("width"), F.col("h").alias("height"), F.when(k % 5 == 0, F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0))).alias("planes"))
    alpha = own.select("frame_id", (F.col("width") + (k % 7 == 0).cast("int")).alias("width"), "height", F.when(k % 6 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0))).alias("planes"))
    return P.alpha_faults(own, alpha)


# --- colour


@query(f"""WITH {F_SQL}, u AS (SELECT k, p, x, y, v, (h + sy) // (1 + sy) AS ch FROM s), o AS (SELECT k, x, y, v, sx, sy, d FROM s WHERE p = 0)
SELECT o.k AS frame_id, o.y, o.x, o.v AS luma, CASE WHEN o.sy = 1 AND o.y % 2 = 1 AND o.k % 8 <> 3 THEN (a.v + b.v + 1) // 2 ELSE a.v END AS u, e.v AS alpha FROM o LEFT JOIN u a ON a.k = o.k AND a.p = 1 AND a.x = o.x // (1 + o.sx) AND a.y = o.y // (1 + o.sy)
LEFT JOIN u b ON b.k = o.k AND b.p = 1 AND b.x = a.x AND b.y = least(a.y + 1, a.ch - 1) LEFT JOIN u e ON e.k = o.k AND e.p = 3 AND e.x = o.x AND e.y = o.y""")
def chroma_at_luma(spark, sf_dir):
    lines = planes(spark, sf_dir).withColumn("position", F.when(F.col("frame_id") % 8 == 3, "colocated").otherwise("vertical"))
    return P.pixels_of(P.luma_lines(lines, "position")).select("frame_id", "y", "x", "luma", "u", "alpha")


#: Matrix, depth, full range and primaries of each test description.
DESCRIBED = [(m, (8, 10, 12)[i % 3], i % 2 == 0, 9 if m in (12, 13) else 1) for i, m in enumerate((1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14))]


def _matrix_sql(name: str) -> str:
    """The channel of every description, as a CASE over event_id % 13."""
    out = []
    derived = {9: (0.2627002120112671, 0.05930171646986196)}
    for i, (m, depth, full, primaries) in enumerate(DESCRIBED):
        top, unit = 2**depth - 1, 2 ** (depth - 8)
        l = f"least(greatest((y - {0 if full else 16 * unit}) / {top if full else 219 * unit}::DOUBLE, 0), 1)"
        cb, cr = (f"(({c} - {2 ** (depth - 1)}) / {top if full else 224 * unit}::DOUBLE)" for c in "uv")
        kr, kb = {1: (0.2126, 0.0722), 2: (0.2126, 0.0722), 4: (0.30, 0.11), 5: (0.299, 0.114), 6: (0.299, 0.114), 7: (0.212, 0.087), 9: (0.2627, 0.0593), 10: (0.2627, 0.0593)}.get(m, derived.get(primaries, (0, 0)))
        red, blue = f"({l} + 2 * (1 - {kr}::DOUBLE) * {cr})", f"({l} + 2 * (1 - {kb}::DOUBLE) * {cb})"
        if m in (10, 13):
            red = f"({l} + CASE WHEN {cr} < 0 THEN 2 * (1 - {kr}::DOUBLE) * {cr} ELSE 2 * {kr}::DOUBLE * {cr} END)"
            blue = f"({l} + CASE WHEN {cb} < 0 THEN 2 * (1 - {kb}::DOUBLE) * {cb} ELSE 2 * {kb}::DOUBLE * {cb} END)"
        green = f"(({l} - {kr}::DOUBLE * {red} - {kb}::DOUBLE * {blue}) / (1 - {kr}::DOUBLE - {kb}::DOUBLE))"
        if m == 8:
            red, green, blue = f"({l} - {cb} + {cr})", f"({l} + {cb})", f"({l} - {cb} - {cr})"
        if m == 11:
            red, green, blue = f"(2 * {cr} + 0.991902::DOUBLE * {l})", l, f"((2 * {cb} + {l}) / 0.986566::DOUBLE)"
        if m == 14:
            a = f"(0.008609037037932756::DOUBLE * {cb} + 0.11102962500302596::DOUBLE * {cr})"
            lms = f"({l} + {a})", f"({l} - {a})", f"({l} + 0.5600313357106791::DOUBLE * {cb} - 0.32062717498731885::DOUBLE * {cr})"
            rows = ((3.4366066943330784, -2.50645211865627, 0.06984542432319148), (-0.7913295555989287, 1.9836004517922907, -0.192270896193362), (-0.025949899690592672, -0.09891371471172644, 1.1248636144023192))
            red, green, blue = ("(" + " + ".join(f"({w}::DOUBLE * {x})" for w, x in zip(r, lms, strict=True)) + ")" for r in rows)
        out.append(f"WHEN {i} THEN {dict(r=red, g=green, b=blue)[name]}")
    return f"CAST(round(least(greatest(CASE event_id % 13 {' '.join(out)} END, 0), 1) * 65535) AS BIGINT) AS {name}"


YUV = "p AS (SELECT event_id, event_id * 7 % CAST(2 ** (8 + 2 * (event_id % 13 % 3)) AS BIGINT) AS y, event_id * 13 % CAST(2 ** (8 + 2 * (event_id % 13 % 3)) AS BIGINT) AS u, event_id * 29 % CAST(2 ** (8 + 2 * (event_id % 13 % 3)) AS BIGINT) AS v FROM events)"


@query(f"WITH {YUV} SELECT event_id, {_matrix_sql('r')}, {_matrix_sql('g')}, {_matrix_sql('b')} FROM p")
def colour_matrices(spark, sf_dir):
    e = F.col("event_id")
    top = P.power_of_two(8 + 2 * (e % 13 % 3))
    pixels = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (e * 7 % top).alias("y"), (e * 13 % top).alias("u"), (e * 29 % top).alias("v"))
    rgb: Column = F.lit(None)
    for i, (m, depth, full, primaries) in reversed(list(enumerate(DESCRIBED))):
        rgb = F.when(e % 13 == i, C.decoded(F.col("y"), F.col("u"), F.col("v"), m, depth, full, primaries)).otherwise(rgb)
    return pixels.select("event_id", rgb.alias("rgb")).select("event_id", *(F.get("rgb", F.lit(i)).alias(n) for i, n in enumerate("rgb")))


TRANSFERS = (1, 4, 5, 8, 9, 10, 13, 17)
SRGB = "CASE WHEN l <= 0.0031308::DOUBLE THEN l * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(l, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END"


@query(f"""WITH v AS (SELECT event_id, event_id * 641 % 65536 AS v, event_id % 8 AS t FROM events), e AS (SELECT *, v / 65535::DOUBLE AS e FROM v),
l AS (SELECT *, CASE t WHEN 1 THEN pow(e, 2.2::DOUBLE) WHEN 2 THEN pow(e, 2.8::DOUBLE) WHEN 3 THEN e WHEN 4 THEN CASE WHEN e <= 0 THEN 0.01::DOUBLE ELSE pow(10::DOUBLE, 2 * (e - 1)) END
WHEN 5 THEN CASE WHEN e <= 0 THEN sqrt(10::DOUBLE) / 1000 ELSE pow(10::DOUBLE, 2.5::DOUBLE * (e - 1)) END ELSE pow(e, 2.6::DOUBLE) * (52.37::DOUBLE / 48) END AS l FROM e)
SELECT event_id, CASE WHEN t IN (0, 6) THEN v ELSE CAST(round(least(greatest({SRGB}, 0), 1) * 65535) AS BIGINT) END AS v FROM l""")
def transfer_curves(spark, sf_dir):
    e = F.col("event_id")
    value: Column = F.lit(None)
    for i, code in reversed(list(enumerate(TRANSFERS))):
        value = F.when(e % 8 == i, C.displayed(F.array(F.col("v")), code)).otherwise(value)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (e * 641 % 65536).alias("v")).select("event_id", F.get(value, F.lit(0)).alias("v"))


@query(f"""WITH v AS (SELECT event_id, event_id % 2 AS t, [event_id * 641 % 65536, event_id * 257 % 65536, event_id * 7919 % 65536] AS c FROM events),
e AS (SELECT event_id, t, [x / 65535::DOUBLE FOR x IN c] AS e FROM v), p AS (SELECT event_id, t, [CASE WHEN x <= 0 THEN 0 ELSE pow(greatest(pow(x, 1 / 78.84375::DOUBLE) - 0.8359375::DOUBLE, 0) / (18.8515625::DOUBLE - 18.6875::DOUBLE * pow(x, 1 / 78.84375::DOUBLE)), 1 / 0.1593017578125::DOUBLE) * 100 END FOR x IN e] AS pq,
[CASE WHEN x <= 0 THEN 0 WHEN x <= 0.5 THEN pow(x * x / 3, 1.2::DOUBLE) ELSE least(pow((exp((x - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12, 1.2::DOUBLE), 1) END FOR x IN e] AS hlg FROM e),
l AS (SELECT event_id, i.range AS i, (CASE WHEN t = 0 THEN pq ELSE hlg END)[i.range + 1] AS x FROM p, range(3) i), s AS (SELECT event_id, i, least(greatest(x / (1 + x) * 1.25::DOUBLE, 0), 1) AS l FROM l)
SELECT event_id, i, CAST(round(least(greatest({SRGB}, 0), 1) * 65535) AS BIGINT) AS v FROM s""")
def hdr_display(spark, sf_dir):
    e = F.col("event_id")
    rgb = F.array(e * 641 % 65536, e * 257 % 65536, e * 7919 % 65536)
    out = F.when(e % 2 == 0, C.displayed(rgb, 16)).otherwise(C.displayed(rgb, 18))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.posexplode(out).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


GAIN = [{"min": -1.0, "max": 2.0, "gamma": 1.5, "base_offset": 0.015625, "alternate_offset": 0.03125}]


@query(f"""WITH p AS (SELECT event_id, i.range AS i, (event_id * (641 + i.range) % 65536) / 65535::DOUBLE AS e, (event_id * 31 % 65536) / 65535::DOUBLE AS m FROM events, range(3) i),
b AS (SELECT *, CASE WHEN e <= 0.04045::DOUBLE THEN e / 12.92::DOUBLE ELSE pow((e + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS b FROM p),
l AS (SELECT event_id, i, greatest((b + 0.015625::DOUBLE) * pow(2::DOUBLE, (-1 + 3 * pow(m, 1 / 1.5::DOUBLE)) * 0.5::DOUBLE) - 0.03125::DOUBLE, 0) AS l FROM b)
SELECT event_id, i, CAST(round(least(greatest({SRGB}, 0), 1) * 65535) AS BIGINT) AS v FROM l""")
def gain_map_applied(spark, sf_dir):
    e = F.col("event_id")
    out = C.gain_applied(F.array(*(e * (641 + i) % 65536 for i in range(3))), F.array(*[e * 31 % 65536] * 3), GAIN, C.gain_weight(1.0, 0.0, 2.0))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.posexplode(out).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@query(f"""WITH {F_SQL}, n AS (SELECT k, w, h, 3 + k % 8 AS nw, 2 + k % 7 AS nh FROM f), t AS (SELECT n.*, x.range AS x, y.range AS y, least(greatest((x.range + 0.5) * w / nw::DOUBLE - 0.5, 0), w - 1) AS ax, least(greatest((y.range + 0.5) * h / nh::DOUBLE - 0.5, 0), h - 1) AS ay FROM n, range(10) x, range(8) y WHERE x.range < nw AND y.range < nh),
q AS (SELECT *, floor(ax)::BIGINT AS x0, floor(ay)::BIGINT AS y0, ax - floor(ax) AS fx, ay - floor(ay) AS fy FROM t), z AS (SELECT k, x, y, v FROM s WHERE p = 0),
r AS (SELECT q.k, q.x, q.y, fy, a.v + (b.v - a.v) * fx AS top, c.v + (e.v - c.v) * fx AS bottom FROM q JOIN z a ON a.k = q.k AND a.x = x0 AND a.y = y0 JOIN z b ON b.k = q.k AND b.x = least(x0 + 1, w - 1) AND b.y = y0
JOIN z c ON c.k = q.k AND c.x = x0 AND c.y = least(y0 + 1, h - 1) JOIN z e ON e.k = q.k AND e.x = least(x0 + 1, w - 1) AND e.y = least(y0 + 1, h - 1))
SELECT k AS frame_id, y, x, CAST(round(top + (bottom - top) * fy) AS BIGINT) AS v FROM r""")
def gain_map_resampled(spark, sf_dir):
    sizes = frames(spark, sf_dir).select("frame_id", (3 + F.col("frame_id") % 8).alias("new_width"), (2 + F.col("frame_id") % 7).alias("new_height"))
    out = P.resampled(planes(spark, sf_dir).where("plane = 0"), sizes)
    return out.select("frame_id", "y", F.posexplode("samples").alias("x", "v")).withColumn("x", F.col("x").cast("long"))


def _rgb_sql(name: str) -> str:
    y, cb, cr = "(l / top::DOUBLE)", "((u - (top + 1) // 2) / top::DOUBLE)", "((w - (top + 1) // 2) / top::DOUBLE)"
    red, blue = f"({y} + 2 * (1 - 0.299::DOUBLE) * {cr})", f"({y} + 2 * (1 - 0.114::DOUBLE) * {cb})"
    green = f"(({y} - 0.299::DOUBLE * {red} - 0.114::DOUBLE * {blue}) / (1 - 0.299::DOUBLE - 0.114::DOUBLE))"
    own = {"r": ("w", red), "g": ("l", green), "b": ("u", blue)}[name]
    as_is = lambda c: f"CASE WHEN d = 8 THEN {c} * 257 ELSE ({c} * 65535 + top // 2) // top END"
    return f"CASE WHEN u IS NULL THEN {as_is('l')} WHEN k % 4 = 1 THEN {as_is(own[0])} ELSE CAST(round(least(greatest({own[1]}, 0), 1) * 65535) AS BIGINT) END"


@query(f"""WITH {F_SQL}, o AS (SELECT k, d, CAST(2 ** d AS BIGINT) - 1 AS top, x, y, v, sx, sy, (h + sy) // (1 + sy) AS ch FROM s WHERE p = 0),
j AS (SELECT o.k, o.d, o.top, o.x, o.y, o.v AS l, CASE WHEN o.sy = 1 AND o.y % 2 = 1 THEN (a.v + b.v + 1) // 2 ELSE a.v END AS u, CASE WHEN o.sy = 1 AND o.y % 2 = 1 THEN (c.v + e.v + 1) // 2 ELSE c.v END AS w, q.v AS a FROM o
LEFT JOIN s a ON a.k = o.k AND a.p = 1 AND a.x = o.x // (1 + o.sx) AND a.y = o.y // (1 + o.sy) LEFT JOIN s b ON b.k = o.k AND b.p = 1 AND b.x = a.x AND b.y = least(a.y + 1, o.ch - 1)
LEFT JOIN s c ON c.k = o.k AND c.p = 2 AND c.x = o.x // (1 + o.sx) AND c.y = o.y // (1 + o.sy) LEFT JOIN s e ON e.k = o.k AND e.p = 2 AND e.x = c.x AND e.y = least(c.y + 1, o.ch - 1) LEFT JOIN s q ON q.k = o.k AND q.p = 3 AND q.x = o.x AND q.y = o.y),
r AS (SELECT k, y, x, d, a, top, {_rgb_sql("r")} AS r, {_rgb_sql("g")} AS g, {_rgb_sql("b")} AS b FROM j)
SELECT k AS frame_id, y, x, r, g, b, (r * 255 + 32767) // 65535 AS r8, CASE WHEN a IS NULL THEN 65535 WHEN d = 8 THEN a * 257 ELSE (a * 65535 + top // 2) // top END AS a, CASE WHEN a IS NULL THEN 255 ELSE (a * 255 + top // 2) // top END AS a8 FROM r""")
def frames_rgba(spark, sf_dir):
    """Full-range frames without a colour description; those with full chroma are identity ones."""
    depth, columns = F.col("depth"), [F.col(c) for c in ("luma", "u", "v", "alpha")]
    per = lambda f: F.when(depth == 8, f(8)).when(depth == 10, f(10)).otherwise(f(12))
    identity = F.col("frame_id") % 4 == 1
    pixels = P.pixels_of(P.luma_lines(planes(spark, sf_dir)))
    rgba = F.when(identity, per(lambda d: C.rgba_16(*columns, d, 0, True))).otherwise(per(lambda d: C.rgba_16(*columns, d, None, True)))
    out = pixels.select("frame_id", "y", "x", rgba.alias("c"), F.coalesce(per(lambda d: C.alpha_8(F.col("alpha"), d)), F.lit(255).cast("long")).alias("a8"))
    return out.select("frame_id", "y", "x", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate("rgba")), F.get(C.rgba_8(F.col("c")), F.lit(0)).alias("r8"), "a8")


#: Columns of a matrix profile, in 65536ths, and a gamma of 563 / 256.
ICC_XYZ = {b"rXYZ": (28580, 14582, 911), b"gXYZ": (25238, 46983, 6363), b"bXYZ": (9378, 3972, 46799)}


def _icc_sql(row: int) -> str:
    linear = [f"({' + '.join(f'({ICC_XYZ[n][k]} / 65536::DOUBLE) * l{i}' for i, n in enumerate(ICC_XYZ))})" for k in range(3)]
    return "(" + " + ".join(f"({m}::DOUBLE) * {x}" for m, x in zip(icc.D50_TO_SRGB[row], linear, strict=True)) + ")"


@query(f"""WITH v AS (SELECT event_id, {", ".join(f"pow((event_id * {m} % 65536) / 65535::DOUBLE, 563 / 256::DOUBLE) AS l{i}" for i, m in enumerate((641, 257, 7919)))} FROM events),
x AS (SELECT event_id, {", ".join(f"least(greatest({_icc_sql(i)}, 0), 1) AS x{i}" for i in range(3))} FROM v)
SELECT event_id, {", ".join(f"CAST(floor((CASE WHEN x{i} <= 0.0031308::DOUBLE THEN x{i} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(x{i}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END) * 65535 + 0.5) AS BIGINT) AS {n}" for i, n in enumerate("rgb"))} FROM x""")
def icc_matrix_profile(spark, sf_dir):
    long = lambda *v: b"XYZ \0\0\0\0" + struct.pack(">3i", *v)
    curve = b"curv\0\0\0\0" + struct.pack(">IH", 1, 563)
    profile = icc.profile_bytes({b"wtpt": long(63190, 65536, 54061), **{k: long(*v) for k, v in ICC_XYZ.items()}, **{k: curve for k in (b"rTRC", b"gTRC", b"bTRC")}})
    e = F.col("event_id")
    pixels = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (e * 641 % 65536).alias("r"), (e * 257 % 65536).alias("g"), (e * 7919 % 65536).alias("b"))
    return icc.converted(pixels, profile)
