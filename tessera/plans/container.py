"""Queries over generated image-container files, one per row of a driver's table, and the SQL that gives the same rows from the rule
by which the files are made. So the files grow with the scale, and every parser and join is held against numbers it never saw."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.integers import loop_count
from tessera.operators import items as I
from tessera.operators import sequence as S
from tessera.operators.staging import settled, spread
from tessera.plans.queries import query
from tessera.sources import bodies as B
from tessera.sources import frame_header as H
from tessera.sources import payloads as P
from tessera.sources.bodies import box, full_box


def made(spark: SparkSession, sf_dir: str, table: str, key: str, make: Callable[[int], bytes]) -> DataFrame:
    """path (the key) and content: one generated file per row of a table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                keys = batch.column(0)[at : at + 1024].to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(map(str, keys), pa.string()), pa.array(map(make, keys), pa.binary())], names=["path", "content"])

    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long"))
    return spread(keys).mapInArrow(run, "path string, content binary")  # keys are small, files are not


def tables_of(files: DataFrame) -> DataFrame:
    """The files' tables, parsed once and written, for queries that join several of them."""
    return settled(B.file_tables(files), "file-tables")


def u16(n: int) -> bytes:
    return struct.pack(">H", n)


def u32(n: int) -> bytes:
    return struct.pack(">I", n)


# --- still images: a file per part. The rules below and the SQL state the same numbers.


def still(k: int) -> bytes:
    """A file with 2 to 5 items whose boxes change their versions and widths with the key."""
    n, v2, v3 = 2 + k % 4, k % 2, k % 3
    ids = range(1, n + 1)
    wide = u32 if v2 else u16
    infos = b"".join(full_box("infe", wide(i) + u16(0) + (b"av01" if i in (1, n) or (k + i) % 3 else b"Exif") + (b"i%d" % i if v2 else b"") + b"\0", 2 + v2) for i in ids)
    iinf = full_box("iinf", wide(n) + infos, v2)
    size = 8 if k % 2 else 4
    entries = []
    for i in ids:
        extents = b"".join((u32(e + 1) if v3 and k % 5 == 0 else b"") + (i * 5 + e * 10).to_bytes(size, "big") + u32(5 + (k + i + e) % 40) for e in range((k + i) % 3))
        entries.append((u32 if v3 == 2 else u16)(i) + (u16(int(i == 2)) if v3 else b"") + u16(0) + (u32(k % 50) if k % 2 else b"") + u16((k + i) % 3) + extents)
    sizes = bytes([size << 4 | 4, (4 if k % 2 else 0) << 4 | (4 if v3 and k % 5 == 0 else 0)])
    iloc = full_box("iloc", sizes + (u32 if v3 == 2 else u16)(n) + b"".join(entries), v3)
    refs = box("dimg", wide(1) + u16(n - 1) + b"".join(map(wide, range(2, n + 1)))) + (box("auxl", wide(1) + u16(1) + wide(n)) if k % 3 == 0 else b"")
    iref = full_box("iref", refs, v2)
    order = (n, 1) if v2 else (1, n)
    grpl = box("grpl", full_box("eqiv", u32(1) + u32(0)) + full_box("altr", u32(7) + u32(2) + u32(order[0]) + u32(order[1])))
    props = [
        full_box("ispe", u32(16 + k % 100) + u32(8 + k % 60)), full_box("pixi", bytes([3] + [8 + 2 * v3] * 3)), box("av1C", bytes([0x81, 0, 12, 0])), box("irot", bytes([k % 4])),
        box("imir", bytes([k % 2])), box("colr", b"nclx" + u16(1 + k % 9) + u16(13) + u16(6) + bytes([128 * (k % 2)])), box("colr", b"prof" + bytes(k % 7)),
        full_box("auxC", I.ALPHA.encode() + b"\0"), box("free", b""), box("clap", b"".join(map(u32, (k % 9 + 1, 1, 4, 1, 0, 1, 0, 1)))), box("a1lx", bytes([1]) + u32(k) + u32(2) + u32(0)),
        box("a1op", b"\0"), box("lsel", b"\xff\xff"), box("irot", bytes([(k + 1) % 4])),
    ]
    large = k // 2 % 2
    mark = lambda index, essential: u16(index | essential << 15) if large else bytes([index | essential << 7])
    one = full_box("ipma", u32(1) + wide(1) + bytes([6]) + b"".join(mark(i, i == 3) for i in (1, 2, 3, 4, 7, 6)), v2, large)
    two = full_box("ipma", u32(2) + wide(n) + bytes([2]) + mark(1, 0) + mark(8, 1) + wide(1) + bytes([1]) + mark(14, 0), v2, large)
    meta = full_box("meta", full_box("pitm", wide(1), v2) + iinf + iloc + box("idat", bytes((k + j * 7) % 256 for j in range(256))) + iref + grpl + box("iprp", box("ipco", b"".join(props)) + one + two))
    return box("ftyp", b"avif" + u32(0) + b"mif1" + (b"avis" if k % 3 == 0 else b"")) + meta + box("mdat", bytes(64))


def stills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.file_tables(made(spark, sf_dir, "part", "p_partkey", still))




def key() -> Column:
    """The file's key: its row in the driver's table."""
    return F.col("path").cast("long").alias("file_id")


#: Files and their items, for the SQL.
ITEMS = "f AS (SELECT p_partkey AS k, 2 + p_partkey % 4 AS n FROM part), i AS (SELECT k, n, range AS i FROM f, range(1, 6) WHERE range <= n)"


@query("""SELECT p_partkey AS file_id, 'avif' AS major, CASE WHEN p_partkey % 3 = 0 THEN 'mif1,avis' ELSE 'mif1' END AS brands, true AS avif, 1::BIGINT AS primary_item FROM part""")
def file_brands(spark, sf_dir):
    return B.is_avif(stills(spark, sf_dir)).select(key(), "major", F.array_join("brands", ",").alias("brands"), "avif", "primary_item")


@query(f"""WITH {ITEMS} SELECT k AS file_id, i AS item, CASE WHEN i IN (1, n) OR (k + i) % 3 <> 0 THEN 'av01' ELSE 'Exif' END AS type, CASE WHEN k % 2 = 1 THEN 'i' || i ELSE '' END AS name FROM i""")
def box_items(spark, sf_dir):
    return B.table(stills(spark, sf_dir), "items").select(key(), "item", "type", "name")


@query(f"""WITH {ITEMS} SELECT k AS file_id, i AS item, CASE WHEN k % 3 > 0 AND i = 2 THEN 1 ELSE 0 END AS method, CASE WHEN k % 2 = 1 THEN k % 50 ELSE 0 END AS base, e.range::INT AS no,
CASE WHEN k % 3 > 0 AND k % 5 = 0 THEN e.range + 1 ELSE 1 END AS index, i * 5 + e.range * 10 AS "offset", 5 + (k + i + e.range) % 40 AS length FROM i, range(0, 2) e WHERE e.range < (k + i) % 3""")
def box_extents(spark, sf_dir):
    return B.table(stills(spark, sf_dir), "extents").select(key(), "item", "method", "base", "no", "index", "offset", "length")


@query(f"""WITH {ITEMS} SELECT k AS file_id, 0 AS ref_no, 'dimg' AS kind, 1::BIGINT AS from_item, (i - 2)::INT AS pos, i AS to_item FROM i WHERE i > 1
UNION ALL SELECT k, 1, 'auxl', 1, 0, n FROM f WHERE k % 3 = 0""")
def box_references(spark, sf_dir):
    return B.table(stills(spark, sf_dir), "refs").select(key(), "ref_no", "kind", "from_item", "pos", "to_item")


@query(f"""WITH {ITEMS} SELECT k AS file_id, 0 AS group_no, p.range::INT AS pos, CASE WHEN (p.range = 0) = (k % 2 = 1) THEN n ELSE 1 END AS entity FROM f, range(0, 2) p""")
def box_groups(spark, sf_dir):
    return B.table(stills(spark, sf_dir), "groups").select(key(), "group_no", "pos", "entity")


PLACES = """f AS (SELECT p_partkey AS k FROM part), p(place, kind) AS (VALUES (1,'ispe'),(2,'pixi'),(3,'av1C'),(4,'irot'),(5,'imir'),(6,'colr'),(7,'colr'),(8,'auxC'),(9,'other'),(10,'clap'),(11,'a1lx'),(12,'a1op'),(13,'lsel'),(14,'irot'))"""


@query(f"""WITH {PLACES} SELECT k AS file_id, place, kind, CASE place WHEN 1 THEN (16 + k % 100) || ',' || (8 + k % 60) WHEN 2 THEN concat_ws(',', 8 + 2 * (k % 3), 8 + 2 * (k % 3), 8 + 2 * (k % 3))
WHEN 4 THEN (k % 4)::VARCHAR WHEN 5 THEN (k % 2)::VARCHAR WHEN 6 THEN (1 + k % 9) || ',13,6,' || (k % 2) WHEN 10 THEN (k % 9 + 1) || ',1,4,1,0,1,0,1' WHEN 11 THEN k || ',2,0' WHEN 12 THEN '0' WHEN 13 THEN '65535'
WHEN 14 THEN ((k + 1) % 4)::VARCHAR ELSE '' END AS numbers, CASE place WHEN 6 THEN 'nclx' WHEN 7 THEN 'prof' WHEN 8 THEN '{I.ALPHA}' END AS text,
CASE place WHEN 1 THEN 12 WHEN 2 THEN 8 WHEN 3 THEN 4 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 11 WHEN 7 THEN 4 + k % 7 WHEN 8 THEN 48 WHEN 9 THEN 0 WHEN 10 THEN 32 WHEN 11 THEN 13 WHEN 12 THEN 1 WHEN 13 THEN 2 ELSE 1 END AS bytes FROM f, p""")
def box_properties(spark, sf_dir):
    return B.table(stills(spark, sf_dir), "props").select(key(), "place", "kind", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"), "text", F.length("payload").cast("long").alias("bytes"))


@query("""WITH f AS (SELECT p_partkey AS k, 2 + p_partkey % 4 AS n FROM part), a(pos, i) AS (VALUES (0,1),(1,2),(2,3),(3,4),(4,7),(5,6),(6,14))
SELECT k AS file_id, 1::BIGINT AS item, pos, i AS index, i = 3 AS essential FROM f, a UNION ALL SELECT k, n, pos, i, i = 8 FROM f, (VALUES (0,1),(1,8)) b(pos, i)""")
def box_associations(spark, sf_dir):
    return B.table(stills(spark, sf_dir), "assoc").select(key(), "item", "pos", "index", "essential")


@query(f"""WITH f AS (SELECT p_partkey AS k, 2 + p_partkey % 4 AS n FROM part) SELECT k AS file_id, i AS item, kind, place FROM f, LATERAL (VALUES (1::BIGINT,'ispe',1),(1,'pixi',2),(1,'av1C',3),(1,'irot',14),(1,'colr',6),(n,'ispe',1),(n,'auxC',8)) t(i, kind, place)""")
def item_metadata(spark, sf_dir):
    files = tables_of(made(spark, sf_dir, "part", "p_partkey", still))
    return I.properties_of(B.table(files, "assoc"), B.table(files, "props")).select(key(), "item", "kind", "place")


@query(f"""WITH {ITEMS}, x AS (SELECT k, i, (k + i) % 3 AS e, CASE WHEN k % 3 > 0 AND i = 2 THEN 1 ELSE 0 END AS method, CASE WHEN k % 2 = 1 THEN k % 50 ELSE 0 END AS base FROM i),
p AS (SELECT x.*, r.range AS no, b.range AS b FROM x, range(0, 2) r, range(0, 45) b WHERE r.range < e AND b.range < 5 + (k + i + r.range) % 40)
SELECT x.k AS file_id, x.i AS item, count(p.b) AS bytes, CAST(sum(CASE WHEN x.method = 1 THEN (x.k + (p.base + p.i * 5 + p.no * 10 + p.b) * 7) % 256 END) AS BIGINT) AS idat_sum
FROM x LEFT JOIN p ON x.k = p.k AND x.i = p.i GROUP BY x.k, x.i, x.method""")
def item_payloads(spark, sf_dir):
    files = made(spark, sf_dir, "part", "p_partkey", still)
    tables = tables_of(files)
    found = I.payloads(files, tables).join(B.table(tables, "locations").select("path", "item", "method").hint("merge"), ["path", "item"])
    digits = F.transform(F.sequence(F.lit(1), F.length("payload")), lambda j: F.conv(F.hex(F.substring("payload", j, F.lit(1))), 16, 10).cast("long"))
    total = F.when((F.col("method") == 1) & (F.length("payload") > 0), F.aggregate(digits, F.lit(0).cast("long"), lambda s, x: s + x))
    return found.select(key(), "item", F.length("payload").cast("long").alias("bytes"), total.alias("idat_sum"))


@query("""SELECT p_partkey AS file_id, 2 + p_partkey % 4 AS item FROM part""")
def alpha_items(spark, sf_dir):
    files = tables_of(made(spark, sf_dir, "part", "p_partkey", still))
    refs, assoc, props = (B.table(files, t) for t in ("refs", "assoc", "props"))
    return I.alpha_items(files.select("path", F.col("primary_item").alias("item")), refs, assoc, props).select(key(), "item")


# --- one rule broken per file


def broken(k: int) -> bytes:
    """The rule that k % 13 names is broken: 0 to 10 as item_violations() numbers them, 11 none, 12 the primary item is a gain map on item 2."""
    rule, gain = k % 13, k % 13 == 12
    kinds = {1: b"tmap" if gain or rule == 0 else b"av01", 2: b"Exif" if rule == 0 else b"av01"}
    if rule == 1:
        del kinds[1]
    infos = b"".join(full_box("infe", u16(i) + u16(0) + t + b"\0", 2) for i, t in kinds.items())
    located = [i for i in (1, 2) if not (rule == 2 and i == 1)]
    iloc = full_box("iloc", bytes([0x44, 0]) + u16(len(located)) + b"".join(u16(i) + u16(0) + u16(1) + u32(0) + u32(4) for i in located))
    props = [
        full_box("ispe", u32(4) + u32(4)), full_box("pixi", bytes([3, 8, 8, 8])), box("av1C", bytes([0x81, 0, 12, 0])), box("zzzz", b""), box("a1op", b"\1"),
        box("colr", b"prof"), box("colr", b"rICC"), box("irot", b"\0"), box("irot", b"\1"),
    ]
    lists = {1: [1, 2, 3, *{5: [0x84], 6: [5], 7: [6, 7], 8: [8, 9], 4: [10]}.get(rule, [4])], 2: [1, 2, 3]}
    if rule == 3:
        lists[9] = [1]
    if rule == 9:
        del lists[1]
    if rule == 10:
        lists[1] = [1, 3]
    ipma = full_box("ipma", u32(len(lists)) + b"".join(u16(i) + bytes([len(own), *own]) for i, own in lists.items()))
    iref = full_box("iref", box("dimg", u16(1) + u16(1) + u16(2)))
    return box("ftyp", b"avif" + u32(0)) + full_box("meta", full_box("pitm", u16(1)) + full_box("iinf", u16(len(kinds)) + infos) + iloc + iref + box("iprp", box("ipco", b"".join(props)) + ipma))


@query("""SELECT p_partkey AS file_id, (p_partkey % 13)::INT AS rule FROM part WHERE p_partkey % 13 < 11""")
def first_item_fault(spark, sf_dir):
    files = tables_of(made(spark, sf_dir, "part", "p_partkey", broken))
    found = I.item_violations(files, *(B.table(files, t) for t in ("items", "locations", "refs", "assoc", "props")))
    return I.first_faults(found).select(key(), "rule")


@query("""SELECT p_partkey AS file_id, 1::BIGINT AS primary_item, CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 12 THEN 2 ELSE 1 END::BIGINT AS item FROM part""")
def effective_primary(spark, sf_dir):
    files = tables_of(made(spark, sf_dir, "part", "p_partkey", broken))
    return I.effective_primary(files, B.table(files, "items"), B.table(files, "refs")).select(key(), "primary_item", "item")


@query("""SELECT p_partkey AS file_id, 'avif' AS major, 1::BIGINT AS primary_item, CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 12 THEN 2 ELSE 1 END::BIGINT AS item, CASE WHEN p_partkey % 13 = 1 THEN 1 ELSE 2 END AS n_items, CASE WHEN p_partkey % 13 > 10 THEN 4 END::BIGINT AS width, CASE WHEN p_partkey % 13 > 10 THEN 4 END::BIGINT AS height,
CASE WHEN p_partkey % 13 > 10 THEN 8 END::BIGINT AS depth, CASE WHEN p_partkey % 13 IN (0, 5, 6) THEN 'unsupported' WHEN p_partkey % 13 < 11 THEN 'bitstream' END AS fault FROM part""")
def container_info(spark, sf_dir):
    found = I.container_info(tables_of(made(spark, sf_dir, "part", "p_partkey", broken)))
    return found.select(key(), "major", "primary_item", "item", "n_items", "width", "height", "depth", "fault")


DAMAGE = ("none", "bitstream", "short", "unsupported", "unsupported", "short", "bitstream", "bitstream", "unsupported", "short")


def damaged(k: int) -> bytes:
    """A file that breaks a rule of its boxes, the one that k % 10 names in DAMAGE's order."""
    head, wrong = box("ftyp", b"avif" + u32(0)), k % 10
    inner = {
        1: lambda: b"", 2: lambda: full_box("iinf", u16(9000)), 3: lambda: full_box("pitm", u16(1), 2), 4: lambda: full_box("iloc", bytes([0x30, 0]) + u16(0)),
        5: lambda: full_box("ispe", b"")[:-2] + b"\0" * 3, 6: lambda: box("iprp", box("ipco", box("a1op", b"12"))), 7: lambda: box("grpl", full_box("altr", u32(1) + u32(0) + b"x")),
        8: lambda: box("iprp", box("ipco", full_box("pixi", bytes([1, 8]), 1))), 9: lambda: b"\0\0\0\x20free",
    }.get(wrong, lambda: b"")()
    return (box("free", b"") if wrong == 1 else head) + full_box("meta", inner)


@query(f"""SELECT p_partkey AS file_id, (['{"','".join(DAMAGE)}'])[p_partkey % 10 + 1] AS fault FROM part""")
def file_faults(spark, sf_dir):
    return B.file_tables(made(spark, sf_dir, "part", "p_partkey", damaged)).select(key(), F.coalesce("fault", F.lit("none")).alias("fault"))


# --- grids, gain maps, sample programs


def derived(k: int) -> bytes:
    """Primary item 1 is a grid (k % 3 = 0, its payload in idat), a gain map's base or a sample program's input; items 2.. are its parts."""
    form, rows, columns = k % 3, 1 + k % 2, 1 + k // 2 % 3
    cells = rows * columns - (k % 11 == 0)
    ids = list(range(2, 2 + rows * columns)) if form == 0 else [2, 3]
    kinds = {1: b"grid" if form == 0 else b"av01"} | {i: b"Exif" if k % 7 == 0 and i == 2 else b"av01" for i in ids}
    dimg = box("dimg", u16(1) + u16(cells) + b"".join(u16(i) for i in ids[:cells])) if form == 0 else b""
    groups = b""
    if form == 1:
        kinds[9] = b"tmap"
        dimg = box("dimg", u16(9) + u16(2) + u16(1) + u16(2 if k % 5 else 8))
        groups = box("grpl", full_box("altr", u32(1) + u32(2) + (u32(9) + u32(1) if k % 4 else u32(1) + u32(9))) + full_box("altr", u32(2) + u32(2) + u32(3) + u32(9)))
    if form == 2:
        kinds[9] = b"sato"
        dimg = box("dimg", u16(9) + u16(2) + u16(1 if k % 5 else 3) + u16(2))
    aux = b"".join(box("auxl", u16(i) + u16(1) + u16(20 + i)) for i in ids if form == 0 and (k + i) % 4 == 0)
    infos = b"".join(full_box("infe", u16(i) + u16(0) + t + b"\0", 2) for i, t in kinds.items())
    props = [full_box("ispe", u32(10 + k % 5) + u32(6)), full_box("pixi", bytes([3, 8, 8, 8 + 2 * (k % 8 == 7)])), box("av1C", bytes([0x81, 0, 12, 0]))]
    ipma = full_box("ipma", u32(len(kinds)) + b"".join(u16(i) + bytes([3, 1, 2, 3]) for i in kinds))
    payload = bytes([0, 0, rows - 1, columns - 1]) + u16(640 + k % 10) + u16(480)
    iloc = full_box("iloc", bytes([0x44, 0]) + u16(1) + u16(1) + u16(1) + u16(0) + u16(1) + u32(0) + u32(8), 1)
    meta = full_box("pitm", u16(1)) + full_box("iinf", u16(len(kinds)) + infos) + iloc + box("idat", payload) + full_box("iref", dimg + aux) + groups + box("iprp", box("ipco", b"".join(props)) + ipma)
    return box("ftyp", b"avif" + u32(0)) + full_box("meta", meta)


def _numbered(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode("items").alias("item_no", "x")).select("path", "item_no", "x.*")


GRIDS = """g AS (SELECT p_partkey AS k, 1 + p_partkey % 2 AS r, 1 + p_partkey // 2 % 3 AS c FROM part WHERE p_partkey % 3 = 0)"""


@query(f"""WITH {GRIDS}, j AS (SELECT k, r, c, CASE WHEN k % 11 = 0 THEN 'bitstream' WHEN k % 7 = 0 THEN 'unsupported' END AS fault FROM g)
SELECT k AS file_id, r AS rows, c AS columns, 640 + k % 10 AS width, 480::BIGINT AS height, i.range::INT AS pos, 2 + i.range AS cell, 10 + k % 5 AS cell_width, CASE WHEN (k + 2 + i.range) % 4 = 0 THEN 22 + i.range END AS alpha, fault FROM j, range(0, 6) i WHERE fault IS NULL AND i.range < r * c
UNION ALL SELECT k, r, c, 640 + k % 10, 480, NULL, NULL, NULL, NULL, fault FROM j WHERE fault IS NOT NULL""")
def grid_cells(spark, sf_dir):
    files = made(spark, sf_dir, "part", "p_partkey", derived)
    tables = tables_of(files)
    bodies = I.payloads(files, tables).join(B.table(tables, "items").where("type = 'grid'").select("path", "item").hint("merge"), ["path", "item"])
    grids = P.parsed(bodies.select("path", "item", "payload"), "payload", P.grid).select("path", "item", "value.*")
    cells = I.grid_cells(grids.select("path", "item", "rows", "columns"), *(B.table(tables, t) for t in ("items", "refs", "assoc", "props")))
    cells = cells.select("path", "pos", "cell", F.col("width").alias("cell_width"), "alpha", "fault")
    return grids.join(cells.hint("merge"), "path").select(key(), F.col("rows").cast("long").alias("rows"), F.col("columns").cast("long").alias("columns"), "width", "height", "pos", "cell", "cell_width", "alpha", "fault")


@query("""SELECT p_partkey AS file_id, p_partkey % 4 <> 0 AS preferred, 1::BIGINT AS base, CASE WHEN p_partkey % 5 = 0 THEN 8 ELSE 2 END::BIGINT AS map,
CASE WHEN p_partkey % 5 = 0 THEN 'bitstream' WHEN p_partkey % 7 = 0 THEN 'unsupported' END AS fault FROM part WHERE p_partkey % 3 = 1""")
def gain_map_inputs(spark, sf_dir):
    tables = tables_of(made(spark, sf_dir, "part", "p_partkey", derived))
    items, refs = _numbered(tables), B.table(tables, "refs")
    maps = I.gain_map_preferred(tables, items, B.table(tables, "groups"))
    return maps.join(I.gain_map_inputs(maps, items, refs).hint("merge"), ["path", "item"]).select(key(), "preferred", "base", "map", "fault")


@query("""SELECT p_partkey AS file_id, '1,2' AS inputs, CASE WHEN p_partkey % 8 <> 7 THEN 8 END::BIGINT AS depth, CASE WHEN p_partkey % 8 = 7 OR p_partkey % 7 = 0 THEN 'unsupported' END AS fault FROM part WHERE p_partkey % 3 = 2 AND p_partkey % 5 <> 0""")
def sample_program_inputs(spark, sf_dir):
    tables = tables_of(made(spark, sf_dir, "part", "p_partkey", derived))
    found = I.sample_program_inputs(tables, _numbered(tables), *(B.table(tables, t) for t in ("refs", "assoc", "props")))
    return found.select(key(), F.array_join(F.col("inputs").cast("array<string>"), ",").alias("inputs"), "depth", "fault")


@query("""SELECT p_partkey AS file_id, CASE WHEN p_partkey % 9 = 0 THEN 'unsupported' WHEN p_partkey % 4 = 0 THEN 'bitstream' WHEN p_partkey % 5 = 0 THEN 'bitstream' END AS fault,
CASE WHEN p_partkey % 9 = 0 OR p_partkey % 4 = 0 OR p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 1 THEN 3 ELSE 1 END::INT AS channels,
CASE WHEN p_partkey % 9 = 0 OR p_partkey % 4 = 0 OR p_partkey % 5 = 0 THEN NULL ELSE -(p_partkey % 6) END AS least, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 4 = 0 OR p_partkey % 5 = 0 THEN NULL ELSE 2.0 / (1 + p_partkey % 4) END AS headroom FROM part""")
def gain_map_descriptors(spark, sf_dir):
    def make(k: int) -> bytes:
        ratio = lambda n, d: struct.pack(">iI", n, d)
        channel = ratio(-(k % 6), 1) + ratio(3 if k % 5 else -9, 1) + ratio(1, 1) + ratio(0, 1) + ratio(0, 1)
        alternate = (0, 1) if k % 4 == 0 else (2, 1 + k % 4)
        return bytes([int(k % 9 == 0), 0, 0, 0, 0, 128 * (k % 2)]) + ratio(0, 1) + ratio(*alternate) + channel * (3 if k % 2 else 1)

    found = P.parsed(made(spark, sf_dir, "part", "p_partkey", make), "content", P.gain_map)
    least = F.get(F.get("value.channels", F.lit(0))["min"], F.lit(0))
    headroom = F.get("value.alternate", F.lit(0)) / F.get("value.alternate", F.lit(1))
    return found.select(key(), "fault", F.when(F.col("fault").isNull(), F.size("value.channels")).alias("channels"), least.alias("least"), headroom.alias("headroom"))


# --- unit streams: a sample per event


def sample(k: int) -> bytes:
    """A temporal delimiter, a sequence header for one key in two, then a frame (k % 3: frame header and tile group instead), whose size takes 1 to 3 bytes."""
    def unit(kind: int, body: bytes, extension: bool = False) -> bytes:
        n, size = len(body), b""
        while True:
            size += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                break
        return bytes([kind << 3 | 2 | 4 * extension]) + (b"\x20" if extension else b"") + size + body

    out = unit(2, b"") + (unit(1, bytes(3 + k % 4)) if k % 2 else b"")
    first = bytes([128 | k % 8 << 4 if k % 5 == 0 else k % 4 << 5])
    body = first + bytes(k % 300)
    if k % 3 == 0:
        return out + unit(3, body, True) + bytes([4 << 3]) + bytes(k % 50)
    return out + unit(6, body) + (b"\x81" if k % 17 == 0 else b"")


SAMPLES = """e AS (SELECT event_id AS k, event_id % 3 <> 0 AND event_id % 17 = 0 AS bad FROM events)"""


@query(f"""WITH {SAMPLES} SELECT k AS sample_id, CASE WHEN bad THEN 'bitstream' END AS fault, CASE WHEN NOT bad THEN 2 + k % 2 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END END AS units, CASE WHEN NOT bad THEN CASE WHEN k % 5 = 0 THEN 'show_existing' ELSE (['key','inter','intra_only','switch'])[k % 4 + 1] END END AS kind,
CASE WHEN NOT bad AND k % 5 = 0 THEN (k % 8)::INT END AS show_idx, CASE WHEN NOT bad THEN (k % 2)::INT END AS has_header, CASE WHEN NOT bad AND k % 2 = 1 THEN 3 + k % 4 END AS header_bytes, CASE WHEN NOT bad AND k % 3 = 0 THEN k % 50 END AS tile_bytes FROM e""")
def sample_units(spark, sf_dir):
    found = P.parsed(made(spark, sf_dir, "events", "event_id", sample), "content", P.units)
    units, payload = F.col("value"), F.col("content")
    size = lambda kind: F.length(P.first_unit(units, payload, kind)).cast("long")
    n = F.when(F.col("fault").isNull(), F.size(units).cast("long"))
    return found.select(F.col("path").cast("long").alias("sample_id"), "fault", n.alias("units"), *((c.cast("int") if k == "has_header" else c).alias(k) for k, c in P.sample_kind(units, payload).items()), size(1).alias("header_bytes"), size(4).alias("tile_bytes"))


@query("""SELECT p_partkey AS file_id, CASE WHEN p_partkey % 6 = 0 THEN 'bitstream' WHEN p_partkey % 7 = 0 THEN 'unsupported' END AS fault, CASE WHEN p_partkey % 6 > 0 AND p_partkey % 7 > 0 THEN (p_partkey % 3)::INT END AS profile,
CASE WHEN p_partkey % 6 > 0 AND p_partkey % 7 > 0 THEN CASE WHEN p_partkey // 3 % 2 = 0 THEN 8 ELSE 10 END END AS depth, CASE WHEN p_partkey % 6 > 0 AND p_partkey % 7 > 0 THEN ((p_partkey % 3 = 2 AND p_partkey // 3 % 2 = 0) OR p_partkey // 6 % 2 = 1)::INT END AS sub_x,
CASE WHEN p_partkey % 6 > 0 AND p_partkey % 7 > 0 THEN (NOT (p_partkey % 3 = 2 AND p_partkey // 3 % 2 = 0) AND p_partkey // 12 % 2 = 1)::INT END AS sub_y, CASE WHEN p_partkey % 6 > 0 AND p_partkey % 7 > 0 AND p_partkey % 5 = 0 THEN (p_partkey % 16)::INT END AS delay FROM part""")
def codec_records(spark, sf_dir):
    make = lambda k: bytes([0x81 if k % 7 else 0x82, k % 3 << 5 | k % 32, (k // 3 % 2) << 6 | (k // 6 % 2) << 3 | (k // 12 % 2) << 2, (0x20 if k % 6 == 0 else 0) | (0x10 | k % 16 if k % 5 == 0 else 0)]) if k % 6 or k % 7 else bytes([1, 0, 0, 0])
    found = P.parsed(made(spark, sf_dir, "part", "p_partkey", make), "content", P.codec_record)
    return found.select(key(), "fault", "value.profile", "value.depth", F.col("value.sub_x").cast("int").alias("sub_x"), F.col("value.sub_y").cast("int").alias("sub_y"), "value.delay")


# --- sequence headers: bits per part


def header_bits(k: int) -> bytes:
    """A sequence header whose fields follow the key; reduced for one key in four."""
    out: list[tuple[int, int]] = []
    put = lambda *fields: out.extend(fields)  # noqa: E731  (value, bits)
    profile, reduced = k % 3, k % 4 == 1
    put((profile, 3), (int(reduced), 1), (int(reduced), 1))
    if reduced:
        put((k % 32, 5))
    else:
        put((1, 1), (30, 32), (1000, 32), (1, 1), (0b00101, 5), (1, 1), (4, 5), (90, 32), (9, 5), (9, 5))  # timing with a uvlc of 4, decoder model
        put((1, 1), (1, 5))
        for level in (k % 32, 9):
            put((0, 12), (level, 5), *([(1, 1)] if level > 7 else []), (1, 1), (0, 11), (1, 1), (3, 4))
    put((11, 4), (10, 4), (15 + k % 2000, 12), (7 + k % 1000, 11))
    if not reduced:
        put((1, 1), (3, 4), (2, 3))
    put((k % 2, 1), (1, 1), (0, 1))
    if not reduced:
        put((0b1010, 4), (k // 2 % 2, 1), *([(3, 2)] if k // 2 % 2 else []), (0, 1), (1, 1), (0, 1), (1, 1), *([(k % 8, 3)] if k // 2 % 2 else []))
    put((0, 1), (1, 1), (k // 3 % 2, 1))
    high, twelve, mono, described = k // 4 % 2, k // 8 % 2, int(k % 7 == 0), int(k % 5 < 3)
    srgb = k % 5 == 1
    put((high, 1), *([(twelve, 1)] if profile == 2 and high else []), *([(mono, 1)] if profile != 1 else []), (described, 1))
    if described:
        put(*((1, 8), (13, 8), (0, 8)) if srgb else ((9, 8), (16, 8), (9, 8)))
    if mono and profile != 1:
        put((k // 5 % 2, 1))
    else:
        if not srgb:
            put((k // 5 % 2, 1))
            if profile == 2 and high and twelve:
                put((k // 16 % 2, 1), *([(k // 32 % 2, 1)] if k // 16 % 2 else []))
            if profile == 0 or (profile == 2 and high and twelve and k // 16 % 2 and k // 32 % 2):
                put((k % 3 % 2 + k // 9 % 2, 2))
        put((0, 1))
    put((k // 6 % 2, 1))
    text = "".join(f"{v:0{n}b}" for v, n in out) + "1"
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


HEADERS = """h AS (SELECT p_partkey AS k, p_partkey % 3 AS profile, p_partkey % 4 = 1 AS reduced, p_partkey // 4 % 2 = 1 AS high, p_partkey // 8 % 2 = 1 AS twelve, p_partkey % 7 = 0 AND p_partkey % 3 <> 1 AS mono, p_partkey % 5 < 3 AS described, p_partkey % 5 = 1 AS srgb FROM part),
d AS (SELECT *, CASE WHEN profile = 2 AND high AND twelve THEN 12 WHEN high THEN 10 ELSE 8 END AS depth FROM h),
x AS (SELECT *, CASE WHEN mono THEN true WHEN srgb THEN false WHEN profile = 0 THEN true WHEN profile = 1 THEN false WHEN depth = 12 THEN k // 16 % 2 = 1 ELSE true END AS sub_x,
CASE WHEN mono THEN true WHEN srgb THEN false WHEN profile = 0 THEN true WHEN profile = 1 THEN false ELSE depth = 12 AND k // 16 % 2 = 1 AND k // 32 % 2 = 1 END AS sub_y, CASE WHEN NOT mono AND srgb THEN true ELSE k // 5 % 2 = 1 END AS "full" FROM d)"""


@query(f"""WITH {HEADERS} SELECT k AS file_id, profile::INT AS profile, reduced, (k % 32)::INT AS level, 16 + k % 2000 AS width, 8 + k % 1000 AS height, CASE WHEN NOT reduced AND k // 2 % 2 = 1 THEN k % 8 + 1 ELSE 0 END::INT AS order_bits, depth, mono,
CASE WHEN srgb THEN '1,13,0' WHEN described THEN '9,16,9' ELSE '2,2,2' END AS codes, sub_x, sub_y, "full", CASE WHEN NOT mono AND sub_x AND sub_y THEN k % 3 % 2 + k // 9 % 2 END::INT AS position, k // 6 % 2 = 1 AS grain FROM x""")
def sequence_headers(spark, sf_dir):
    found = P.parsed(made(spark, sf_dir, "part", "p_partkey", header_bits), "content", P.sequence_header)
    v = lambda n: F.col(f"value.{n}")
    codes = F.concat_ws(",", *(v(n).cast("string") for n in ("primaries", "transfer", "matrix")))
    return found.select(key(), *(v(n).alias(n) for n in ("profile", "reduced", "level", "width", "height", "order_bits", "depth", "mono", "sub_x", "sub_y", "full", "position", "grain")), codes.alias("codes"))


@query(f"""WITH {HEADERS} SELECT k AS file_id, CASE WHEN k % 11 = 0 THEN 'bitstream' WHEN k % 13 = 0 AND described THEN 'bitstream' WHEN k % 17 = 0 THEN 'bitstream' WHEN k % 19 = 0 THEN 'bitstream' END AS fault FROM x""")
def header_faults(spark, sf_dir):
    """One part in 11 has another level, in 13 other primaries, in 17 the other range, in 19 another width than its header."""
    found = P.parsed(made(spark, sf_dir, "part", "p_partkey", header_bits), "content", P.sequence_header)
    v, k = (lambda n: F.col(f"value.{n}")), F.col("path").cast("long")
    record = F.struct(v("profile").alias("profile"), (v("level") + (k % 11 == 0).cast("int")).alias("level"), *(v(n).alias(n) for n in ("depth", "mono", "sub_x", "sub_y", "position")))
    primaries = F.when(k % 13 == 0, 5).otherwise(v("primaries"))
    # primaries 1, not 2, where the range is to differ: a description that says nothing may have any range
    nclx = F.array(F.when((k % 17 == 0) & ~v("described"), 1).otherwise(primaries).cast("long"), v("transfer").cast("long"), v("matrix").cast("long"), (v("full") != (k % 17 == 0)).cast("long"))
    size = F.array(v("width") + (k % 19 == 0).cast("int"), v("height"))
    return found.select(key(), P.header_faults(record, F.col("value"), nclx, size).alias("fault"))


TILES = """p AS (SELECT p_partkey AS k, 100 + p_partkey * 37 % 8000 AS w, 80 + p_partkey * 53 % 5000 AS h, CASE WHEN p_partkey % 2 = 1 THEN 5 ELSE 4 END AS s FROM part), m AS (SELECT *, 2 * ((w + 7) // 8) AS mw, 2 * ((h + 7) // 8) AS mh FROM p),
b AS (SELECT *, (mw + (1 << s) - 1) >> s AS sw, (mh + (1 << s) - 1) >> s AS sh, 4096 >> (s + 2) AS widest, 9437184 >> (2 * (s + 2)) AS area FROM m),
n AS (SELECT *, (SELECT min(range) FROM range(20) WHERE widest << range >= sw) AS lc, (SELECT min(range) FROM range(20) WHERE area << range >= sw * sh) AS la, (SELECT min(range) FROM range(20) WHERE greatest(area // sw, 1) << range >= sh) AS lr, (SELECT min(range) FROM range(20) WHERE 1 << range >= sw) AS hc, (SELECT min(range) FROM range(20) WHERE 1 << range >= sh) AS hr FROM b),
c AS (SELECT *, least(lc + k % 3, greatest(hc, lc)) AS cl FROM n), r AS (SELECT *, least(greatest(lr, greatest(lc, la) - cl) + k // 3 % 2, greatest(hr, greatest(lr, greatest(lc, la) - cl))) AS rl FROM c),
t AS (SELECT *, (sw + (1 << cl) - 1) >> cl AS tw, (sh + (1 << rl) - 1) >> rl AS th FROM r), g AS (SELECT *, (sw + tw - 1) // tw AS nc, (sh + th - 1) // th AS nr FROM t)"""


@query(f"""WITH {TILES} SELECT k AS frame_id, r.range * nc + c.range AS tile, c.range * tw AS sb_col_start, least((c.range + 1) * tw, sw) AS sb_col_end, r.range * th AS sb_row_start, least((r.range + 1) * th, sh) AS sb_row_end, c.range * tw * (4 << s) AS x, r.range * th * (4 << s) AS y,
least((c.range + 1) * tw * (4 << s), w) - c.range * tw * (4 << s) AS tile_width, least((r.range + 1) * th * (4 << s), h) - r.range * th * (4 << s) AS tile_height FROM g, range(64) c, range(64) r WHERE c.range < nc AND r.range < nr""")
def tile_plans(spark, sf_dir):
    """Uniform tiles of a frame per part, from bits that ask for up to two more columns and one more row of tiles than the least."""
    def layouts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                width, height, large = 100 + k * 37 % 8000, 80 + k * 53 % 5000, k % 2 == 1
                columns = [-(-(2 * -(-n // 8)) // (32 if large else 16)) for n in (width, height)]
                low = P._log2(P.TILE_WIDTH >> (7 if large else 6), columns[0])
                more = min(k % 3, max(P._log2(1, columns[0]) - low, 0))
                bits = "1" + "1" * more + ("0" if low + more < P._log2(1, columns[0]) else "") + "1" * (k // 3 % 2) + "0" * 40
                found = P.tile_layout(B.Bits(int(bits.ljust(64, "0"), 2).to_bytes(8, "big")), width, height, large)
                out.append({"frame_id": k, "width": width, "height": height, "shift": 5 if large else 4, "columns": found["columns"], "rows": found["rows"]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("frame_id", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("shift", pa.int32()), ("columns", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))]))

    layout = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long")).mapInArrow(layouts, "frame_id long, width long, height long, shift int, columns array<bigint>, rows array<bigint>")
    return P.tile_rectangles(layout).drop("width", "height", "shift")


@query("""WITH s AS (SELECT event_id AS k, event_id % 3 AS form, event_id % 2 = 1 AS has_header, CASE WHEN event_id % 2 = 1 THEN 2 + 3 + event_id % 4 ELSE 0 END AS prefix, 1 + event_id % 300 AS body, event_id % 50 AS tiles FROM events WHERE event_id % 3 = 0 OR event_id % 17 > 0)
SELECT k AS sample_id, 0::INT AS unit, has_header, prefix + 1 + CASE WHEN body > 127 THEN 2 ELSE 1 END + body + CASE WHEN form = 0 THEN 2 + tiles ELSE 0 END AS bytes FROM s""")
def frame_units(spark, sf_dir):
    found = P.parsed(made(spark, sf_dir, "events", "event_id", sample), "content", P.frame_units).where("fault is null")
    return found.select(F.col("path").cast("long").alias("sample_id"), F.posexplode("value").alias("unit", "u")).select("sample_id", "unit", "u.has_header", F.length("u.payload").cast("long").alias("bytes"))


# --- playback: samples per user, a slot mask and a frame kind by event


PLAY = """e AS (SELECT user_id, event_id, event_id % 4 = 3 AS shows, event_id % 8 AS idx, CASE WHEN event_id % 4 = 3 THEN 0 WHEN event_id % 16 = 0 THEN 255 ELSE (event_id * 37) % 256 END AS mask FROM events)"""


@query(f"""WITH {PLAY}, w AS (SELECT user_id, event_id, shows, idx, {", ".join(f"last_value(CASE WHEN (mask >> {i}) & 1 = 1 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s{i}" for i in range(8))} FROM e),
s AS (SELECT *, [s0, s1, s2, s3, s4, s5, s6, s7][idx + 1] AS slot FROM w) SELECT user_id, event_id, CASE WHEN shows THEN slot ELSE event_id END AS frame, CASE WHEN shows AND slot IS NULL THEN 'unsupported' END AS fault FROM s""")
def playback(spark, sf_dir):
    return played(S.slots(samples_of(spark.read.parquet(f"{sf_dir}/events.parquet")), "user_id", "event_id", "mask"))


def samples_of(events: DataFrame) -> DataFrame:
    """user_id, event_id, shows, idx (the slot that is shown) and mask (the slots that the sample's frame takes)."""
    e = F.col("event_id")
    shows = e % 4 == 3
    return events.select("user_id", "event_id", shows.alias("shows"), (e % 8).cast("int").alias("idx"), F.when(shows, 0).when(e % 16 == 0, 255).otherwise(e * 37 % 256).cast("int").alias("mask"))


def played(slotted: DataFrame) -> DataFrame:
    slot = F.get("slots", F.col("idx"))
    return slotted.select("user_id", "event_id", F.when(F.col("shows"), slot).otherwise(F.col("event_id")).alias("frame"), F.when(F.col("shows") & slot.isNull(), "unsupported").alias("fault"))


def _bits(*fields: tuple[int, int]) -> bytes:
    """Fields (value, bits) as bytes, with a closing one."""
    value, size = 0, 1
    for v, n in fields:
        value, size = value << n | v & (1 << n) - 1, size + n
    return ((value << 1 | 1) << -size % 8).to_bytes(-(-size // 8), "big")


def coded_sequence(user: int) -> bytes:
    """A sequence header with order hints of 6 bits and a size by user."""
    head = [(0, 3), (0, 2), (0, 1), (0, 1), (0, 5), (0, 12), (4, 5), (8, 4), (8, 4), (64 + user % 100, 9), (40 + user % 50, 9), (0, 1), (0, 1), (1, 1), (1, 1)]
    return _bits(*head, (1, 4), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (5, 3), (0, 1), (1, 1), (0, 1), (0, 1), (0, 1), (0, 1), (1, 1), (0, 2), (0, 1), (0, 1))


def coded_frame(event: int, n: int, user: int) -> bytes:
    """The n-th frame header of a user: each sixth a key frame, one in eleven of the others cut short, one in seven showing a slot."""
    wide, high = (-(-(2 * -(-size // 8)) // 16) for size in (65 + user % 100, 41 + user % 50))
    tiles = [(1, 1), *[(0, 1)] * ((wide > 1) + (high > 1))]
    tail = [*tiles, (1 + event % 255, 8), *[(0, 1)] * 6, (10, 6), (20, 6), (3, 6), (4, 6), (2, 3), (0, 1), (1, 2), (0, 2), (5, 4), (3, 2), (6, 4), (0, 2), (1, 1)]
    if n % 6 == 0:
        return _bits((0, 1), (0, 2), (1, 1), (0, 1), (0, 1), (0, 1), (n % 64, 6), (0, 1), (0, 1), *tail, (0, 1))
    if n % 7 == 0:
        return _bits((1, 1), (event % 8, 3))
    whole = _bits((0, 1), (1, 2), (1, 1), (0, 1), (0, 1), (0, 1), (0, 1), (n % 64, 6), (0, 3), (event * 37 % 256, 8), (0, 1), *[(i, 3) for i in range(7)], (0, 1), (1, 1), (1, 1), (0, 1), (0, 1), (0, 1), *tail, (0, 1), (0, 1), (0, 1), *[(0, 1)] * 7)
    return whole[:4] if n % 11 == 0 else whole


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
f AS (SELECT *, n % 6 = 0 AS key, n % 6 > 0 AND n % 7 = 0 AS shows, n % 6 > 0 AND n % 7 > 0 AND n % 11 = 0 AS short FROM n),
m AS (SELECT *, CASE WHEN shows OR short THEN 0 WHEN key THEN 255 ELSE event_id * 37 % 256 END AS mask FROM f),
w AS (SELECT *, [""" + ", ".join(f"last_value(CASE WHEN (mask >> {i}) & 1 = 1 THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for i in range(8)) + """][event_id % 8 + 1] AS slot FROM m)
SELECT user_id, event_id, CASE WHEN short THEN 'short' END AS fault, CASE WHEN short THEN NULL WHEN key OR (shows AND slot % 6 = 0) THEN 0 ELSE 1 END AS kind, CASE WHEN NOT short THEN mask END AS refresh,
CASE WHEN short THEN NULL WHEN shows THEN slot % 64 ELSE n % 64 END AS order_hint, CASE WHEN NOT short THEN 65 + user_id % 100 END AS width, CASE WHEN short OR shows THEN NULL ELSE 1 + event_id % 255 END AS base_q FROM w""")
def frame_headers(spark, sf_dir):
    """Headers of a user's frames with the slots between them; a header that is cut short leaves them as they are."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    numbered = e.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([coded_frame(i, n, u) for u, i, n in rows], pa.binary()), pa.array([coded_sequence(u) if n == 0 else None for u, _, n in rows], pa.binary())], names=["user_id", "event_id", "payload", "sequence"])

    made_of = numbered.mapInArrow(coded, "user_id long, event_id long, payload binary, sequence binary")
    found = H.track_headers(made_of, "user_id", "event_id", "payload", "sequence")
    return found.select("user_id", "event_id", "fault", "kind", "refresh", "order_hint", "width", "base_q")


# --- tracks: a file per customer


def movie(k: int) -> bytes:
    """A colour track of 2 + k % 4 chunks, records from chunk 1 (1 + k % 3 samples) and from chunk 3 (2), and for one key in two an alpha track."""
    chunks = 2 + k % 4
    counts = [1 + k % 3 if c < 3 else 2 for c in range(1, chunks + 1)]
    n = sum(counts)

    def track(alpha: bool, short: bool) -> bytes:
        entry = box("av01", bytes(78) + (full_box("auxi", I.ALPHA.encode() + b"\0") if alpha else b""))
        stsc = [(1, counts[0], 1)] + ([(3, 2, 1)] if chunks > 2 else [])
        sizes = b"".join(u32(10 + (k + s) % 7) for s in range(n))
        stco = full_box("co64", u32(chunks) + b"".join(struct.pack(">Q", 1000 * c + k % 100) for c in range(chunks))) if k % 2 else full_box("stco", u32(chunks) + b"".join(u32(1000 * c + k % 100) for c in range(chunks)))
        stbl = full_box("stsd", u32(1) + entry) + full_box("stsc", u32(len(stsc)) + b"".join(struct.pack(">III", *r) for r in stsc)) + full_box("stsz", u32(0) + u32(n) + sizes) + stco
        if not short:
            stbl += full_box("stts", u32(3) + u32(1) + u32(40 + k % 5) + u32(0) + u32(99) + u32(n - 1) + u32(33))
        head = full_box("mdhd", bytes(8) + u32(600 + k % 10) + bytes(8)) if k % 6 else b""
        mdia = box("mdia", head + full_box("hdlr", u32(0) + (b"auxv" if alpha else b"pict") + bytes(12)) + box("minf", box("stbl", stbl)))
        edits = {0: [(5, 0)] * (1 + k % 3), 1: [(0xFFFFFFFF, 0)], 2: [(5, 1)], 3: []}[k % 4]
        edts = box("edts", full_box("elst", u32(len(edits)) + b"".join(struct.pack(">IiI", *e, 65536) for e in edits))) if k % 5 else b""
        return box("trak", (box("tref", box("auxl", u32(1))) if alpha else b"") + edts + mdia)

    sound = box("trak", box("mdia", full_box("hdlr", u32(0) + b"soun" + bytes(12))))
    return box("ftyp", b"avis" + u32(0)) + box("moov", sound + track(False, k % 7 == 0) + (track(True, False) if k % 2 else b"") + track(False, True))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = tables_of(made(spark, sf_dir, "customer", "c_custkey", movie))
    return I.track_roles(B.table(tables, "tracks"))


CHUNKS = """c AS (SELECT c_custkey AS k, r.range AS c, CASE WHEN r.range < 2 THEN 1 + c_custkey % 3 ELSE 2 END AS n FROM customer, range(0, 5) r WHERE r.range < 2 + c_custkey % 4),
s AS (SELECT k, c, j.range AS j, row_number() OVER (PARTITION BY k ORDER BY c, j.range) - 1 AS s, count(*) OVER (PARTITION BY k) AS n FROM c, range(0, 3) j WHERE j.range < c.n),
t AS (SELECT *, 10 + (k + s) % 7 AS size, CASE WHEN k % 6 = 0 THEN 1 ELSE 600 + k % 10 END AS scale FROM s)"""


@query(f"""WITH {CHUNKS}, r(role) AS (VALUES ('colour'), ('alpha')), d AS (SELECT t.*, role, CASE WHEN role = 'colour' AND k % 7 = 0 THEN 0 WHEN s = 0 THEN 40 + k % 5 ELSE 33 END AS duration, CASE WHEN s = 0 OR (role = 'colour' AND k % 7 = 0) THEN 0 ELSE 40 + k % 5 + 33 * (s - 1) END AS pts FROM t, r WHERE role = 'colour' OR k % 2 = 1)
SELECT k AS file_id, role, s AS sample_no, 1000 * c + k % 100 + CAST(coalesce(sum(size) OVER (PARTITION BY k, role, c ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size, pts, duration, (pts * 1000 + scale // 2) // scale AS pts_ms FROM d""")
def track_samples(spark, sf_dir):
    tracks = _tracks(spark, sf_dir)
    roles = tracks.select("path", "track_no", "role")
    return I.track_samples(tracks).join(roles.hint("merge"), ["path", "track_no"]).select(key(), "role", "sample_no", "offset", "size", "pts", "duration", "pts_ms")


@query("""SELECT c_custkey AS file_id, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 IN (2, 3) THEN 'unknown' WHEN c_custkey % 4 = 1 THEN 'infinite' ELSE 'finite' END AS kind, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 4 = 0 THEN c_custkey % 3 END AS n FROM customer""")
def track_repetition(spark, sf_dir):
    found = I.track_repetition(_tracks(spark, sf_dir).where("role = 'colour'"))
    return found.select(key(), "kind", F.col("n").cast("long").alias("n"))


@query(f"""WITH {CHUNKS}, n AS (SELECT DISTINCT k, n, scale FROM t), d AS (SELECT *, CASE WHEN k % 7 = 0 THEN 0 ELSE 40 + k % 5 + 33 * (n - 1) END AS duration FROM n)
SELECT k AS file_id, n AS colour, CASE WHEN k % 2 = 1 THEN n ELSE 0 END AS alpha, duration, (duration * 1000 + scale // 2) // scale AS duration_ms, CASE WHEN k % 5 > 0 AND k % 4 = 0 THEN k % 3 WHEN k % 5 > 0 AND k % 4 = 1 THEN 0 ELSE 1 END AS loops FROM d""")
def animations(spark, sf_dir):
    """Sample counts, duration and loops of every movie whose alpha track, if any, fits its colour track."""
    tracks = _tracks(spark, sf_dir)
    counts = tracks.groupBy("path").agg(*(F.coalesce(F.max(F.when(F.col("role") == r, F.size("sizes"))), F.lit(0)).cast("long").alias(r) for r in ("colour", "alpha")))
    good = counts.join(I.alpha_count_faults(tracks).select("path").hint("merge"), "path", "left_anti")
    colour = tracks.where("role = 'colour'")
    total = colour.select("path", "timescale", F.coalesce(F.aggregate("durations", F.lit(0).cast("long"), lambda s, d: s + d["count"] * d["duration"]), F.lit(0).cast("long")).alias("duration"))
    loops = I.track_repetition(colour).select("path", loop_count(F.col("kind"), F.col("n")).alias("loops"))
    return good.join(total.hint("merge"), "path").join(loops.hint("merge"), "path").select(key(), "colour", "alpha", "duration", F.expr("(duration * 1000 + timescale div 2) div timescale").alias("duration_ms"), "loops")
