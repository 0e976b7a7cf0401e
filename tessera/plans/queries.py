"""The engine's queries over the driver's tables and synthetic planes, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import integers as I
from tessera.functions.sample_expression import compile_expression
from tessera.operators import planes as P
from tessera.operators import relations as R
from tessera.operators import sequence as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FRAMES, WIDTH, HEIGHT = 3, 24, 16
PLANE = f"(SELECT f.range AS frame_id, y.range AS y, x.range AS x, (x.range*7 + y.range*13 + f.range*31) % 256 AS v FROM range({FRAMES}) f, range({HEIGHT}) y, range({WIDTH}) x)"


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plane(spark: SparkSession) -> DataFrame:
    return P.synthetic(spark, FRAMES, WIDTH, HEIGHT)


@query("""WITH t AS (SELECT user_id, event_id % 40 AS d, coalesce(sum(event_id % 40) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pts FROM events)
SELECT user_id, count(*) AS n, CAST(sum((d*1000 + 300) // 600) AS BIGINT) AS total_ms, CAST(max((pts*1000 + 300) // 600) AS BIGINT) AS last_pts_ms FROM t GROUP BY user_id""")
def track_timing(spark, sf_dir):
    timed = S.exclusive_running_sum(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 40).alias("d")), F.col("d"), ["user_id"], ["ts", "event_id"], "pts")
    return timed.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(I.ticks_to_ms(F.col("d"), 600)).alias("total_ms"), F.max(I.ticks_to_ms(F.col("pts"), 600)).alias("last_pts_ms"))


@query("""SELECT event_id, CAST(coalesce(sum(event_id % 40) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pts FROM events""")
def pts_exclusive_sum(spark, sf_dir):
    return S.exclusive_running_sum(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id"), F.col("event_id") % 40, ["user_id"], ["ts", "event_id"], "pts").select("event_id", "pts")


@query("SELECT p_partkey, CAST(unnest(range(1, p_size + 1)) AS BIGINT) AS nth FROM part")
def rle_expand(spark, sf_dir):
    return S.rle_expand(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "nth")


@query("SELECT event_id, CAST((event_id*37*1000 + 45000) // 90000 AS BIGINT) AS ms FROM events")
def ticks_to_ms(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", I.ticks_to_ms(F.col("event_id") * 37, 90000).alias("ms"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS earlier FROM orders")
def asof_chunk(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    order = ["o_orderdate", "o_orderkey"]
    return S.asof_last(o, o, ["o_custkey"], order, order, ["o_orderkey"], strict=True).select("o_orderkey", F.col("asof_o_orderkey").alias("earlier"))


@query("""SELECT event_id, CAST(user_id * 1000000 + coalesce(sum(event_id % 97 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sample_offset FROM events""")
def chunk_offsets(spark, sf_dir):
    e = S.exclusive_running_sum(_t(spark, sf_dir, "events").select("user_id", "event_id"), F.col("event_id") % 97 + 1, ["user_id"], ["event_id"], "before")
    return e.select("event_id", (F.col("user_id") * 1000000 + F.col("before")).alias("sample_offset"))


@query(f"""WITH e AS (SELECT user_id, CASE WHEN user_id % 6 = 5 THEN event_id % 2 ELSE 0 END AS media_time,
CASE WHEN user_id % 3 = 0 AND event_id % 50 = 0 THEN {S.INFINITE} WHEN user_id % 3 = 1 THEN 7 ELSE event_id % 2 END AS duration FROM events),
g AS (SELECT user_id, bool_or(media_time = 0 AND duration = {S.INFINITE}) AS endless, bool_and(media_time = 0) AS zero, min(duration) AS lo, max(duration) AS hi, count(*) AS n FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN endless THEN 'infinite' WHEN zero AND lo = hi THEN 'finite' ELSE 'unknown' END AS kind, CASE WHEN NOT endless AND zero AND lo = hi THEN n - 1 END AS n, CAST(CASE WHEN endless THEN 0 WHEN zero AND lo = hi THEN n - 1 ELSE 1 END AS BIGINT) AS loops FROM g""")
def repetition_class(spark, sf_dir):
    """Edit lists per user, over all events: times and durations from user_id and event_id."""
    user, event = F.col("user_id"), F.col("event_id")
    d = F.when((user % 3 == 0) & (event % 50 == 0), F.lit(S.INFINITE)).when(user % 3 == 1, 7).otherwise(event % 2)
    r = S.repetition(_t(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", F.when(user % 6 == 5, event % 2).otherwise(0), d)
    return r.withColumn("loops", I.loop_count(F.col("kind"), F.col("n")))


@query("""WITH u AS (SELECT user_id, sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit FROM events)
SELECT user_id, CAST(unit AS BIGINT) AS unit, count(*) AS n FROM u GROUP BY user_id, unit""")
def gaps_islands(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    first = e.agg(F.min("event_type").alias("first_type"))  # one row
    return S.units(e.crossJoin(F.broadcast(first)), ["user_id"], ["ts", "event_id"], F.col("event_type") == F.col("first_type")).groupBy("user_id", "unit").agg(F.count("*").alias("n"))


@query("""SELECT 1 AS rule, concat_ws('/', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS "key", count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 2, CAST(c_custkey AS VARCHAR), count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY c_custkey""")
def validation_rules(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return R.duplicate_keys(lines, ["l_orderkey", "l_linenumber"], 1).union(R.orphans(_t(spark, sf_dir, "customer"), "c_custkey", _t(spark, sf_dir, "orders"), "o_custkey", 2))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS item FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, o_orderkey AS item FROM orders WHERE o_orderstatus <> 'F')
SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k))""")
def alpha_fallback(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item"), "o_orderstatus")
    return R.with_fallback(o.where("o_orderstatus = 'F'").select("k", "item"), o.where("o_orderstatus <> 'F'").select("k", "item"), ["k"])


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS e FROM lineitem), f AS (SELECT g, min(e) AS f FROM l GROUP BY g)
SELECT l.e AS entity, bool_and(l.e = f.f OR NOT EXISTS (SELECT 1 FROM l o WHERE o.g = l.g AND o.e = l.e // 2 + 1)) AS preferred FROM l JOIN f ON l.g = f.g GROUP BY l.e""")
def alt_group_pref(spark, sf_dir):
    """An entity is preferred if it is first wherever it is grouped with its own primary entity, here half its key."""
    groups = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("entity")).distinct()
    groups = groups.withColumns({"place": F.col("entity"), "primary": F.call_function("div", F.col("entity"), F.lit(2).cast("long")) + 1})
    return R.first_everywhere(groups, "l_orderkey", "entity", "place", "primary")


@query("""SELECT p_partkey, 'p_brand' AS name, p_brand AS value FROM part WHERE p_brand IS NOT NULL UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE p_type IS NOT NULL UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part WHERE p_size IS NOT NULL""")
def metadata_long(spark, sf_dir):
    return R.unpivot_metadata(_t(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])


def _expression(spark, sf_dir, tokens, bits, depth):
    return _t(spark, sf_dir, "part").select("p_partkey", compile_expression(tokens, bits, depth).alias("v"))


@query("SELECT p_partkey, CAST(least(greatest((p_partkey * 3 - p_size * 1000) // 7, 0), 65535) AS BIGINT) AS v FROM part")
def sato_arith(spark, sf_dir):
    return _expression(spark, sf_dir, [("input", "p_partkey"), ("const", 3), "mul", ("input", "p_size"), ("const", 1000), "mul", "sub", ("const", 7), "div"], 32, 16)


@query("SELECT p_partkey, CAST(least(greatest(xor((p_partkey & 255) | p_size, CAST(85 AS BIGINT)) + (length(bin(p_partkey)) - 1), 0), 255) AS BIGINT) AS v FROM part")
def sato_bits(spark, sf_dir):
    return _expression(spark, sf_dir, [("input", "p_partkey"), ("const", 255), "and", ("input", "p_size"), "or", ("const", 85), "xor", ("input", "p_partkey"), "log2", "add"], 32, 8)


@query("SELECT p_partkey, CAST(least(greatest(least(greatest(abs(least(-(-p_size * p_size), 32767) - 600), 100), 900), 0), 1023) AS BIGINT) AS v FROM part")
def sato_minmax_clamp(spark, sf_dir):
    return _expression(spark, sf_dir, [("input", "p_size"), "neg", ("input", "p_size"), "mul", "neg", ("const", 600), "sub", "abs", ("const", 100), "max", ("const", 900), "min"], 16, 10)


@query(f"SELECT frame_id, y - 3 AS y, x - 5 AS x, v FROM {PLANE} WHERE y BETWEEN 3 AND 10 AND x BETWEEN 5 AND 16")
def crop(spark, sf_dir):
    return P.pixels(P.crop(_plane(spark), 5, 3, 12, 8))


@query(f"SELECT 0 AS axis, frame_id, y, {WIDTH - 1} - x AS x, v FROM {PLANE} UNION ALL SELECT 1, frame_id, {HEIGHT - 1} - y, x, v FROM {PLANE}")
def mirror(spark, sf_dir):
    both = [P.pixels(P.mirror(_plane(spark), a, HEIGHT)).select(F.lit(a).alias("axis"), "frame_id", "y", "x", "v") for a in (0, 1)]
    return both[0].union(both[1])


@query(f"""SELECT 1 AS turns, frame_id, {WIDTH - 1} - x AS y, y AS x, v FROM {PLANE} UNION ALL SELECT 2, frame_id, {HEIGHT - 1} - y, {WIDTH - 1} - x, v FROM {PLANE} UNION ALL SELECT 3, frame_id, x, {HEIGHT - 1} - y, v FROM {PLANE}""")
def rotate(spark, sf_dir):
    one, two, three = (P.pixels(P.rotate(_plane(spark), t, WIDTH, HEIGHT, ["frame_id"])).select(F.lit(t).alias("turns"), "frame_id", "y", "x", "v") for t in (1, 2, 3))
    return one.union(two).union(three)


@query("""WITH c AS (SELECT p_partkey AS grid_id, r.range AS "row", c.range AS col, 8 + c.range * p_size AS width, 4 + r.range * 2 AS height FROM part, range(3) r, range(4) c)
SELECT grid_id, "row", col, CAST(coalesce(sum(width) OVER (PARTITION BY grid_id, "row" ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "left", CAST(coalesce(sum(height) OVER (PARTITION BY grid_id, col ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM c""")
def grid_compose(spark, sf_dir):
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("grid_id"), "p_size", to(3).alias("row")).withColumn("col", to(4))
    cells = cells.select("grid_id", "row", "col", (8 + F.col("col") * F.col("p_size")).alias("width"), (4 + F.col("row") * 2).alias("height"))
    return P.mosaic_offsets(cells).select("grid_id", "row", "col", "left", "top")


@query(f"SELECT frame_id, y, x, CAST((v * 1023 + 127) // 255 AS BIGINT) AS ten, v * 257 AS sixteen, CAST((v * 257 * 255 + 32767) // 65535 AS BIGINT) AS eight FROM {PLANE}")
def depth_scale(spark, sf_dir):
    v = F.col("v")
    return P.pixels(_plane(spark)).select("frame_id", "y", "x", I.rescale(v, 255, 1023).alias("ten"), I.to_16_bit(v, 8).alias("sixteen"), I.to_8_bit(v * 257).alias("eight"))


@query(f"SELECT frame_id, y, x, CAST(CASE WHEN a = 0 THEN 0 ELSE least((v * 255 + a // 2) // a, 255) END AS BIGINT) AS c FROM (SELECT *, (x * 11) % 256 AS a FROM {PLANE})")
def unpremultiply(spark, sf_dir):
    return P.pixels(_plane(spark)).select("frame_id", "y", "x", I.unpremultiply(F.col("v"), (F.col("x") * 11) % 256, 255).alias("c"))


@query(f"""SELECT a.frame_id, y.range AS y, x.range AS x, CAST((a.v + b.v + 1) // 2 AS BIGINT) AS v FROM range({2 * HEIGHT}) y, range({2 * WIDTH}) x, {PLANE} a, {PLANE} b
WHERE a.frame_id = b.frame_id AND a.x = x.range // 2 AND b.x = a.x AND a.y = y.range // 2 AND b.y = least(a.y + y.range % 2, {HEIGHT - 1})""")
def chroma_upsample(spark, sf_dir):
    return P.pixels(P.upsample_420(_plane(spark), 2 * HEIGHT, ["frame_id"]))


def _rgb(k: str) -> str:
    luma, cb, cr = "(v / 255.0::DOUBLE)", "((((v*3) % 256) - 128) / 255.0::DOUBLE)", "((((v*5) % 256) - 128) / 255.0::DOUBLE)"
    e = {"r": f"{luma} + 2*(1-0.299::DOUBLE)*{cr}", "b": f"{luma} + 2*(1-0.114::DOUBLE)*{cb}", "g": f"{luma} - (2*0.114::DOUBLE*(1-0.114::DOUBLE)/0.587::DOUBLE)*{cb} - (2*0.299::DOUBLE*(1-0.299::DOUBLE)/0.587::DOUBLE)*{cr}"}[k]
    return f"CAST(round(least(greatest({e}, 0), 1) * 255) AS BIGINT) AS {k}"


@query(f"SELECT frame_id, y, x, {_rgb('r')}, {_rgb('g')}, {_rgb('b')} FROM {PLANE}")
def yuv_to_rgb(spark, sf_dir):
    rgb = P.yuv_to_rgb(F.col("v"), (F.col("v") * 3) % 256, (F.col("v") * 5) % 256, 0.299, 0.114)
    return P.pixels(_plane(spark)).select("frame_id", "y", "x", *(c.alias(k) for k, c in rgb.items()))


@query("""WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CAST(round(list_sum(d) / len(d) * 1e6) AS BIGINT) AS mean_abs, CAST(round(list_max(d) * 1e6) AS BIGINT) AS max_abs, CAST(len(list_filter(d, lambda x: x > 0)) AS BIGINT) AS n_different FROM p""")
def diff_metrics(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    m = P.differences(F.col("embedding"), F.col("other"))
    return e.select("vec_id", "embedding").join(nxt, "vec_id").select("vec_id", F.round(m["mean_abs"] * 1e6).cast("long").alias("mean_abs"), F.round(m["max_abs"] * 1e6).cast("long").alias("max_abs"), m["n_different"].alias("n_different"))


@query("SELECT event_id, (event_id >> 3) & 15 AS obu_type, (event_id & 4) <> 0 AS has_extension, (event_id & 2) <> 0 AS has_size, (event_id & 128) <> 0 AS forbidden FROM events")
def obu_classify(spark, sf_dir):
    bit = lambda m: F.col("event_id").bitwiseAND(F.lit(m).cast("long")) != 0
    return _t(spark, sf_dir, "events").select("event_id", F.shiftright("event_id", 3).bitwiseAND(F.lit(15).cast("long")).alias("obu_type"), bit(4).alias("has_extension"), bit(2).alias("has_size"), bit(128).alias("forbidden"))


@query("SELECT event_id, ((event_id*5 - user_id) & 63) - ((event_id*5 - user_id) & 64) AS distance FROM events")
def order_hint_distance(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", I.order_distance(F.col("event_id") * 5, F.col("user_id"), 7).alias("distance"))


@query("""SELECT event_id, CASE WHEN (event_id & 128) <> 0 THEN 'ShowExisting' ELSE list_extract(['Key', 'Inter', 'IntraOnly', 'Switch'], CAST(((event_id >> 5) & 3) + 1 AS BIGINT)) END AS kind,
CASE WHEN (event_id & 128) <> 0 THEN (event_id >> 4) & 7 END AS idx FROM events""")
def sample_classify(spark, sf_dir):
    bits = lambda n, m: F.shiftright("event_id", n).bitwiseAND(F.lit(m).cast("long"))
    shown, kinds = bits(7, 1) == 1, F.array(*map(F.lit, ("Key", "Inter", "IntraOnly", "Switch")))
    return _t(spark, sf_dir, "events").select("event_id", F.when(shown, "ShowExisting").otherwise(F.get(kinds, bits(5, 3).cast("int"))).alias("kind"), F.when(shown, bits(4, 7)).alias("idx"))


@query("""WITH t AS (SELECT l_orderkey AS k, l_linenumber - 1 AS tile, l_partkey % 97 + 1 AS size FROM lineitem), c AS (SELECT o_orderkey AS k, o_orderkey % 4 AS n FROM orders),
g AS (SELECT k, count(*) AS m, count(DISTINCT tile) AS d, min(tile) AS lo, max(tile) AS hi FROM t GROUP BY k),
f AS (SELECT c.k, CASE WHEN n < 1 OR lo < 0 OR hi >= n OR m > d THEN 'bitstream' WHEN coalesce(d, 0) < n THEN 'unsupported' END AS fault FROM c LEFT JOIN g ON c.k = g.k)
SELECT t.k, fault, tile, CAST(coalesce(sum(size) OVER (PARTITION BY t.k ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size FROM t JOIN f ON t.k = f.k WHERE fault IS NULL
UNION ALL SELECT k, fault, NULL, NULL, NULL FROM f WHERE fault IS NOT NULL""")
def tile_merge(spark, sf_dir):
    tiles = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("tile"), (F.col("l_partkey") % 97 + 1).alias("size"))
    return S.merge_tiles(tiles, "k", "tile", "size", _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4).alias("n")), "n")


@query("""WITH p AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_type AS kind, props AS value FROM events),
a AS (SELECT user_id AS file, event_id % 5 AS item, event_id % 3 AS record, event_id AS pos, event_id % 10 + 1 AS "index" FROM events),
f AS (SELECT file, item, min(record) AS record FROM a GROUP BY file, item)
SELECT a.file, a.item, kind, max_by(value, pos) AS value FROM a JOIN f ON a.file = f.file AND a.item = f.item AND a.record = f.record JOIN p ON p.file = a.file AND p.place = a."index" GROUP BY a.file, a.item, kind""")
def item_properties(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "event_id", "event_type", "props")
    place = F.row_number().over(W.partitionBy("file").orderBy("event_id")).cast("long")
    properties = e.select("file", place.alias("place"), F.col("event_type").alias("kind"), F.col("props").alias("value"))
    own = F.col("event_id")
    return R.item_properties(e.select("file", (own % 5).alias("item"), (own % 3).alias("record"), own.alias("pos"), (own % 10 + 1).alias("index")), properties)
