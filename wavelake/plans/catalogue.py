"""The engine's queries over the test tables, each beside the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import headers, samples
from ..functions.lookups import FORMATS, GENRES, IMA_MOVES, IMA_STEPS, MAGICS, sql_values
from ..operators import adpcm, measure, predict, probe, seek, tags
from ..sources import tables as t
from ..sources.tables import BYTE_SQL, FLOAT_SQL, HEADER_SQL, MONO_SQL, STEREO_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Level measurement

MEASURES = "round(sqrt(avg(v * v)), 9) AS rms, round(avg(v), 9) AS dc"


@query("measure_peak_rms_dc", f"SELECT track, max(abs(v)) AS peak, {MEASURES} FROM {FLOAT_SQL} GROUP BY track")
def measure_peak_rms_dc(spark, d):
    return measure.measure(t.float_tracks(spark, d), "track")


@query("measure_combine_blocks", f"SELECT track, max(abs(v)) AS peak, {MEASURES} FROM {FLOAT_SQL} GROUP BY track")
def measure_combine_blocks(spark, d):
    return measure.combine_blocks(measure.measure_blocks(t.float_tracks(spark, d)))


@query(
    "measure_per_channel",
    f"SELECT track, ch, max(abs(v)) AS peak, {MEASURES} FROM (SELECT track, 0 AS ch, l / 32768.0::DOUBLE AS v FROM {STEREO_SQL} UNION ALL SELECT track, 1, r / 32768.0::DOUBLE FROM {STEREO_SQL}) GROUP BY track, ch",
)
def measure_per_channel(spark, d):
    each = F.posexplode(F.array("l", "r")).alias("ch", "x")  # one scan; no union of two
    s = t.stereo_tracks(spark, d).select("track", each).select("track", F.col("ch").cast("bigint").alias("ch"), samples.to_fraction(F.col("x"), "s16").alias("v"))
    return measure.measure(s, "track", "ch")


# Sample formats


def sql_narrow(v: str, fmt: str) -> str:
    s = samples.SCALE[fmt]
    x = f"({v}) * {float(s)}::DOUBLE"
    return f"CAST(least(greatest(CASE WHEN {x} >= 0 THEN floor({x} + 0.5) ELSE ceil({x} - 0.5) END, {-s}), {s - 1}) AS BIGINT)" + (" + 128" if fmt == "u8" else "")


def add_conversion(name: str, fmt: str, gain: float):
    @query(name, f"SELECT track, frame, {sql_narrow(f'v * {gain}::DOUBLE', fmt)} AS x FROM {FLOAT_SQL}")
    def convert(spark, d):
        return t.float_tracks(spark, d).select("track", "frame", samples.to_integer(F.col("v") * gain, fmt).alias("x"))


for _fmt in ("s16", "s24", "s32", "u8", "s8"):
    add_conversion(f"convert_f32_{_fmt}", _fmt, 1.0)
add_conversion("convert_over_full_scale", "s16", 4.0)


@query("convert_s16_f64", f"SELECT track, frame, x / 32768.0::DOUBLE AS v FROM {MONO_SQL}")
def convert_s16_f64(spark, d):
    return t.mono_tracks(spark, d).select("track", "frame", samples.to_fraction(F.col("x"), "s16").alias("v"))


@query("convert_s16_u8", f"SELECT track, frame, {sql_narrow('x / 32768.0::DOUBLE', 'u8')} AS x FROM {MONO_SQL}")
def convert_s16_u8(spark, d):
    return t.mono_tracks(spark, d).select("track", "frame", samples.to_integer(samples.to_fraction(F.col("x"), "s16"), "u8").alias("x"))


# Layouts


@query("layout_offsets", f"SELECT track, frame, ch, (frame * 2 + ch) * 2 AS interleaved, (ch * count(*) OVER (PARTITION BY track, ch) + frame) * 2 AS planar FROM {STEREO_SQL}, (VALUES (0), (1)) c(ch)")
def layout_offsets(spark, d):
    tracks = t.stereo_tracks(spark, d).withColumn("frames", F.count("*").over(Window.partitionBy("track")))
    s = tracks.select("track", "frame", "frames", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("ch"))
    at = lambda planar: headers.layout_offset(F.col("frame"), F.col("ch"), F.lit(2), F.col("frames"), 2, planar)
    return s.select("track", "frame", "ch", at(False).alias("interleaved"), at(True).alias("planar"))


@query("channel_layout_valid", f"SELECT b, b % 9 AS channels, b % 9 > 0 AND (b = 0 OR bit_count(b::BIGINT) = b % 9) AS valid, count(*) AS n FROM {BYTE_SQL} GROUP BY b")
def channel_layout_valid(spark, d):
    b = t.byte_rows(spark, d).groupBy("b").agg(F.count("*").alias("n"))
    return b.select("b", (F.col("b") % 9).alias("channels"), headers.layout_valid(F.col("b"), F.col("b") % 9).alias("valid"), "n")


SPEAKER_SQL = "(VALUES (0, 'FL'), (1, 'FR'), (2, 'FC'), (3, 'LFE'), (4, 'BL'), (5, 'BR'), (6, 'FLC'), (7, 'FRC')) AS t(bit, name)"


@query("channel_layout_at", f"SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY bit) - 1 AS at, name FROM (SELECT *, event_id // 256 % 9 AS c FROM events JOIN {BYTE_SQL} USING (event_id)) JOIN {SPEAKER_SQL} ON (b >> bit) & 1 = 1 WHERE c = bit_count(b::BIGINT)")
def channel_layout_at(spark, d):
    b = t.byte_rows(spark, d)
    at = F.posexplode(headers.layout_channels(F.col("b"), F.floor(F.col("event_id") / 256) % 9)).alias("at", "name")
    return b.select("event_id", at).select("event_id", F.col("at").cast("bigint").alias("at"), "name")


@query("default_mask", "SELECT b % 10 AS channels, CASE b % 10 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 51 WHEN 5 THEN 55 WHEN 6 THEN 63 WHEN 7 THEN 1807 WHEN 8 THEN 1599 ELSE 0 END AS mask, count(*) AS n FROM " + BYTE_SQL + " GROUP BY ALL")
def default_mask(spark, d):
    b = t.byte_rows(spark, d).groupBy((F.col("b") % 10).alias("channels")).agg(F.count("*").alias("n"))
    return b.select("channels", headers.default_mask(F.col("channels")).alias("mask"), "n")


@query("frame_sizes", f"SELECT name, p_size AS channels, p_partkey, CASE WHEN name = 'dsd1' THEN (p_size * p_partkey + 7) // 8 WHEN name = 'opaque' THEN p_partkey ELSE bits // 8 * p_size * p_partkey END AS bytes FROM part, {sql_values([(n, b) for n, b, _, _ in FORMATS], 'name', 'bits')}")
def frame_sizes(spark, d):
    c, n = F.col("p_size").cast("bigint"), F.col("p_partkey")
    sizes = [F.struct(F.lit(name).alias("name"), headers.bytes_for(name, c, n).alias("bytes")) for name, *_ in FORMATS]
    return t.read(spark, d, "part").select("p_partkey", c.alias("channels"), F.explode(F.array(*sizes)).alias("s")).select("s.name", "channels", "p_partkey", "s.bytes")


# Companding

ULAW = "least(abs(x), 32635) + 132"
_SEG = lambda m, first: " + ".join(f"CAST({m} > {(first << k) - 1} AS INT)" for k in range(7))
ULAW_ENCODE = f"(SELECT *, 255 - (CASE WHEN x < 0 THEN 128 ELSE 0 END + seg * 16 + ((m >> (seg + 3)) & 15)) AS b FROM (SELECT *, {_SEG('m', 256)} AS seg FROM (SELECT *, {ULAW} AS m FROM src)))"
ULAW_DECODE = "(SELECT *, CASE WHEN c & 128 <> 0 THEN -m ELSE m END AS y FROM (SELECT *, ((((c & 15) << 3) + 132) << ((c >> 4) & 7)) - 132 AS m FROM (SELECT *, 255 - b AS c FROM src)))"
ALAW_ENCODE = f"(SELECT *, xor(seg * 16 + ((m >> greatest(seg, 1)) & 15), CASE WHEN x >= 0 THEN 213 ELSE 85 END) AS b FROM (SELECT *, {_SEG('m', 32)} AS seg FROM (SELECT *, CASE WHEN x >= 0 THEN CAST(floor(x / 8.0) AS BIGINT) ELSE -CAST(floor(x / 8.0) AS BIGINT) - 1 END AS m FROM src)))"
ALAW_DECODE = "(SELECT *, CASE WHEN a & 128 <> 0 THEN m ELSE -m END AS y FROM (SELECT *, CASE WHEN (a >> 4) & 7 = 0 THEN (a & 15) * 16 + 8 ELSE ((a & 15) * 16 + 264) << (((a >> 4) & 7) - 1) END AS m FROM (SELECT *, xor(b, 85) AS a FROM src)))"
#: Mono samples with both signs.
SIGNED_SQL = f"(SELECT track, frame, CASE WHEN frame % 2 = 1 THEN -x ELSE x END AS x FROM {MONO_SQL})"


def signed(spark, d):
    return t.mono_tracks(spark, d).select("track", "frame", F.when(F.col("frame") % 2 == 1, -F.col("x")).otherwise(F.col("x")).alias("x"))


def add_companding(law: str, encode, decode, sql_encode: str, sql_decode: str):
    coded = f"(SELECT track, frame, x, b FROM {sql_encode.replace('src', SIGNED_SQL)})"

    @query(f"{law}_encode", f"SELECT track, frame, b FROM {coded}")
    def enc(spark, d):
        return signed(spark, d).select("track", "frame", encode(F.col("x")).alias("b"))

    @query(f"{law}_decode", f"SELECT event_id, y FROM {sql_decode.replace('src', BYTE_SQL)}")
    def dec(spark, d):
        return t.byte_rows(spark, d).select("event_id", decode(F.col("b")).alias("y"))

    @query(f"{law}_roundtrip_error", f"SELECT track, max(abs(x - y)) AS worst, count(*) AS n FROM {sql_decode.replace('src', coded)} GROUP BY track")
    def err(spark, d):
        back = decode(encode(F.col("x")))
        return signed(spark, d).groupBy("track").agg(F.max(F.abs(F.col("x") - back)).alias("worst"), F.count("*").alias("n"))


add_companding("ulaw", samples.ulaw_encode, samples.ulaw_decode, ULAW_ENCODE, ULAW_DECODE)
add_companding("alaw", samples.alaw_encode, samples.alaw_decode, ALAW_ENCODE, ALAW_DECODE)


# ADPCM


@query(
    "ima_initial_index",
    f"""WITH d AS (SELECT track, abs(x - lag(x) OVER (PARTITION BY track ORDER BY frame)) AS d FROM {MONO_SQL}),
    m AS (SELECT track, count(d) AS n, CASE WHEN count(d) = 0 THEN 0 ELSE CAST(sum(d) // count(d) AS BIGINT) END AS mean FROM d GROUP BY track)
    SELECT track, mean, CASE WHEN n = 0 THEN 0 ELSE (SELECT arg_min(i, abs(mean - s) * 100 + i) FROM {sql_values(list(enumerate(IMA_STEPS)), "i", "s")}) END AS index FROM m""",
)
def ima_initial_index(spark, d):
    return adpcm.initial_index(spark, t.mono_tracks(spark, d))


@query(
    "ima_decode_block",
    f"""WITH RECURSIVE s AS (SELECT i, s AS size FROM {sql_values(list(enumerate(IMA_STEPS)), "i", "s")}), mv AS (SELECT k, m FROM {sql_values(list(enumerate(IMA_MOVES)), "k", "m")}),
    n AS (SELECT track, frame, frame // 64 AS block, x % 16 AS nib FROM {MONO_SQL}),
    r AS (
      SELECT track, block, block * 64 - 1 AS frame, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS i FROM n GROUP BY track, block
      UNION ALL
      SELECT track, block, frame, p, least(greatest(i + m, 0), 88) FROM (
        SELECT n.track, n.block, n.frame, mv.m, r.i,
          least(greatest(r.p + CASE WHEN nib & 8 <> 0 THEN -1 ELSE 1 END * ((size >> 3) + CASE WHEN nib & 4 <> 0 THEN size ELSE 0 END + CASE WHEN nib & 2 <> 0 THEN size >> 1 ELSE 0 END + CASE WHEN nib & 1 <> 0 THEN size >> 2 ELSE 0 END), -32768), 32767) AS p
        FROM r JOIN n ON n.track = r.track AND n.block = r.block AND n.frame = r.frame + 1 JOIN s ON s.i = r.i JOIN mv ON mv.k = nib & 7))
    SELECT track, frame, p AS x FROM r WHERE frame >= block * 64""",
)
def ima_decode_block(spark, d):
    return adpcm.decode(t.mono_tracks(spark, d).select("track", "frame", (F.col("x") % 16).alias("nibble")))


@query(
    "coded_geometry",
    """SELECT p_partkey, c AS channels, block, CASE WHEN c = 0 THEN NULL ELSE block // c END AS g711, CASE WHEN c = 0 THEN NULL ELSE block // (34 * c) * 64 END AS ima_qt,
    CASE WHEN c > 0 AND block > 4 * c AND (block - 4 * c) % (4 * c) = 0 THEN (block - 4 * c) // c * 2 + 1 END AS ima_wav,
    CASE WHEN c > 0 AND block > 7 * c AND (block - 7 * c) % c = 0 THEN (block - 7 * c) // c * 2 + 2 END AS ms,
    CASE WHEN c = 0 THEN 'INVALID' WHEN block > 4 * c AND (block - 4 * c) % (4 * c) = 0 AND p_partkey % 3 * 505 IN (0, (block - 4 * c) // c * 2 + 1) THEN 'OK' ELSE 'CORRUPT' END AS ima_result
    FROM (SELECT p_partkey, p_size % 4 AS c, CAST(p_size * 8 AS BIGINT) AS block FROM part)""",
)
def coded_geometry(spark, d):
    p = t.read(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).cast("bigint").alias("channels"), (F.col("p_size") * 8).cast("bigint").alias("block"))
    codings = {"g711": "ulaw", "ima_qt": "ima-qt", "ima_wav": "ima-wav", "ms": "ms-adpcm"}
    own = headers.coded_geometry("ima-wav", F.col("block"), F.col("channels"), F.col("p_partkey") % 3 * 505)
    return p.select("*", *[headers.coded_frames(c, F.col("block"), F.col("channels")).alias(n) for n, c in codings.items()], own["result"].alias("ima_result"))


@query(
    "coded_tail_frames",
    """SELECT event_id, c AS channels, size, least(size // c, 2048) AS ulaw, CASE WHEN size >= 34 * c THEN 64 ELSE 0 END AS ima_qt,
    CASE WHEN size = 0 OR size < 4 * c THEN 0 WHEN size >= 256 * c THEN 505 ELSE 1 + (size - 4 * c) // (4 * c) * 8 END AS ima_wav,
    CASE WHEN size = 0 OR size < 7 * c THEN 0 WHEN size >= 256 * c THEN 500 ELSE 2 + (size - 7 * c) * 2 // c END AS ms
    FROM (SELECT event_id, event_id % 2 + 1 AS c, event_id * 7 % 600 AS size FROM events)""",
)
def coded_tail_frames(spark, d):
    e = t.read(spark, d, "events").select("event_id", (F.col("event_id") % 2 + 1).alias("channels"), (F.col("event_id") * 7 % 600).alias("size"))
    tail = lambda c: headers.tail_frames(c, F.col("size"), 256 * F.col("channels"), F.col("channels"))
    return e.select("*", tail("ulaw").alias("ulaw"), tail("ima-qt").alias("ima_qt"), tail("ima-wav").alias("ima_wav"), tail("ms-adpcm").alias("ms"))


@query("seek_coded", "SELECT event_id, CASE WHEN event_id % 3000 <= 2525 THEN 'OK' ELSE 'INVALID' END AS result, CASE WHEN event_id % 3000 <= 2525 THEN event_id % 3000 // 505 END AS block, CASE WHEN event_id % 3000 <= 2525 THEN event_id % 3000 % 505 END AS skip FROM events")
def seek_coded(spark, d):
    got = headers.seek_coded(F.col("event_id") % 3000, F.lit(505), F.lit(2525))
    return t.read(spark, d, "events").select("event_id", *[c.alias(n) for n, c in got.items()])


@query("add_track", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_partkey % 9 > 0 AND (p_partkey % 16 = 0 OR bit_count(CAST(p_partkey % 16 AS BIGINT)) = p_partkey % 9) AND p_size % 5 <> 0 THEN 'OK' ELSE 'INVALID' END AS result FROM part")
def add_track(spark, d):
    fmt = F.when(F.col("p_size") % 5 == 0, "s17").otherwise("s16")
    return t.read(spark, d, "part").select("p_partkey", headers.track_result(F.col("p_size") % 3 * 44100, F.col("p_partkey") % 16, F.col("p_partkey") % 9, fmt).alias("result"))


# Lossless prediction


def sql_residual(order: int) -> str:
    from math import comb

    terms = ["x"] + [f"({(-1) ** k * comb(order, k)}) * coalesce(lag(x, {k}) OVER w, 0)" for k in range(1, order + 1)]
    return f"(SELECT track, frame, {' + '.join(terms)} AS r FROM {MONO_SQL} WINDOW w AS (PARTITION BY track ORDER BY frame))"


def add_order(order: int):
    @query(f"fixed_residual_o{order}", f"SELECT * FROM {sql_residual(order)}")
    def res(spark, d):
        return predict.residual(t.mono_tracks(spark, d), order)

    if order:

        @query(f"fixed_reconstruct_o{order}", f"SELECT * FROM {MONO_SQL}")
        def rec(spark, d):
            return predict.reconstruct(predict.residual(t.mono_tracks(spark, d), order), order)


for _order in range(5):
    add_order(_order)

Z = "CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END"


@query("zigzag", f"SELECT track, frame, {Z} AS z FROM {sql_residual(2)}")
def zigzag(spark, d):
    return predict.residual(t.mono_tracks(spark, d), 2).select("track", "frame", samples.zigzag(F.col("r")).alias("z"))


@query("unzigzag", f"SELECT * FROM {sql_residual(2)}")
def unzigzag(spark, d):
    r = predict.residual(t.mono_tracks(spark, d), 2)
    return r.select("track", "frame", samples.unzigzag(samples.zigzag(F.col("r"))).alias("r"))


RICE_SQL = f"(SELECT track, frame // 16 AS block, k, CAST(sum((({Z}) >> k) + 1 + k) AS BIGINT) AS bits FROM {sql_residual(2)}, range(15) t(k) GROUP BY ALL)"


@query("rice_cost_by_k", f"SELECT * FROM {RICE_SQL}")
def rice_cost_by_k(spark, d):
    return predict.rice_costs(predict.residual(t.mono_tracks(spark, d), 2))


RESIDUAL_PLAN_SQL = f"""WITH d AS (SELECT track, frame // 32 AS block, frame % 32 AS pos, CASE WHEN track % 5 = 0 THEN 0 ELSE r END AS r FROM {sql_residual(2)}),
n AS (SELECT *, count(*) OVER (PARTITION BY track, block) AS size FROM d),
z AS (SELECT track, block, size, o, pos // (size // (1 << o)) AS place, CASE WHEN r < 0 THEN -2 * r - 1 ELSE 2 * r END AS z FROM n, range(9) t(o) WHERE size % (1 << o) = 0 AND size // (1 << o) > 2 AND pos >= 2),
a AS (SELECT track, block, size, o, place, count(*) AS c, max(z) AS top, sum(z) // count(*) AS mean FROM z GROUP BY ALL),
e AS (SELECT *, CASE WHEN mean = 0 THEN 0 ELSE floor(log2(mean)) + 1 END AS guess, CASE WHEN top = 0 THEN 0 WHEN top < 2 THEN 1 ELSE floor(log2(top // 2)) + 2 END AS width FROM a),
m AS (SELECT * FROM (VALUES (0, 4, 14), (1, 5, 30)) v(method, size_k, most)),
k AS (SELECT track, block, size, o, place, method, size_k, c, width, k, sum((z >> k) + 1 + k) AS bits FROM z JOIN e USING (track, block, size, o, place), m, range(31) t(k)
    WHERE k BETWEEN least(guess, most) - 2 AND least(least(guess, most) + 2, most) GROUP BY ALL),
b AS (SELECT track, block, size, o, place, method, size_k, c, width, min(bits) AS bits, arg_min(k, bits * 64 + k) AS k FROM k GROUP BY ALL),
p AS (SELECT track, block, size, o, place, method, size_k + CASE WHEN width <= 32 THEN least(bits, 5 + c * width) ELSE bits END AS bits, CASE WHEN width <= 32 AND 5 + c * width < bits THEN 'e' || CAST(width AS INT) ELSE CAST(k AS VARCHAR) END AS own FROM b),
w AS (SELECT track, block, size, o, method, sum(bits) + 6 AS bits, string_agg(own, ',' ORDER BY place) AS own FROM p GROUP BY ALL)
SELECT track, block, size, method, o AS partition_order, CAST(bits AS BIGINT) AS bits, own AS partitions FROM w QUALIFY row_number() OVER (PARTITION BY track, block ORDER BY bits, o, method) = 1"""


@query("residual_plan", RESIDUAL_PLAN_SQL)
def residual_plan(spark, d):
    """Blocks of 32 samples; the tracks of one in five are silent."""
    r = predict.residual(t.mono_tracks(spark, d), 2).withColumn("r", F.when(F.col("track") % 5 == 0, 0).otherwise(F.col("r")))
    got = predict.residual_plan(r, 2, 32)
    own = F.array_join(F.transform("partitions", lambda p: F.coalesce(p["k"].cast("string"), F.concat(F.lit("e"), p["width"]))), ",")
    return got.withColumn("partitions", own)


@query("best_rice_k", f"SELECT track, block, arg_min(k, bits * 16 + k) AS k, min(bits) AS bits FROM {RICE_SQL} GROUP BY track, block")
def best_rice_k(spark, d):
    return predict.best_rice(predict.residual(t.mono_tracks(spark, d), 2))


@query("midside_encode", f"SELECT track, frame, CAST(floor((l + r) / 2.0) AS BIGINT) AS mid, l - r AS side FROM {STEREO_SQL}")
def midside_encode(spark, d):
    return predict.mid_side(t.stereo_tracks(spark, d))


@query("midside_decode", f"SELECT track, frame, l, r FROM {STEREO_SQL}")
def midside_decode(spark, d):
    return predict.left_right(predict.mid_side(t.stereo_tracks(spark, d)))


@query(
    "stereo_assignment",
    f"""WITH c AS (SELECT track, frame // 16 AS block, sum(abs(l)) AS l, sum(abs(r)) AS r, sum(abs(l - r)) AS s, sum(abs(CAST(floor((l + r) / 2.0) AS BIGINT))) AS m FROM {STEREO_SQL} GROUP BY ALL),
    e AS (SELECT track, block, 0 AS plan, l + r AS cost FROM c UNION ALL SELECT track, block, 1, l + s FROM c UNION ALL SELECT track, block, 2, s + r FROM c UNION ALL SELECT track, block, 3, m + s FROM c)
    SELECT track, block, arg_min(plan, cost * 4 + plan) AS plan, CAST(min(cost) AS BIGINT) AS cost FROM e GROUP BY track, block""",
)
def stereo_assignment(spark, d):
    s = t.stereo_tracks(spark, d)
    return predict.stereo_assignment(s.withColumns({"mid": F.shiftright(F.col("l") + F.col("r"), 1), "side": F.col("l") - F.col("r")}))


@query(
    "block_facts",
    f"SELECT track, block, lo = hi AS constant, CASE WHEN a = 0 THEN 0 ELSE CAST(log2(a & -a) AS BIGINT) END AS wasted FROM (SELECT track, frame // 16 AS block, min(x * 4) AS lo, max(x * 4) AS hi, bit_or(x * 4) AS a FROM {MONO_SQL} GROUP BY ALL)",
)
def block_facts(spark, d):
    return predict.block_facts(t.mono_tracks(spark, d).withColumn("x", F.col("x") * 4))


# Identification

#: Texts as files: half of them get the head of a container.
HEADS = ["52494646000000005741564566", "464F524D0000000041494643", "664C614300", "4F676753" + "00" * 22 + "01" + "1E" + "01766F72626973", "4F676753" + "00" * 22 + "01" + "13" + "4F70757348656164", "664C614301", "52494646FFFFFFFF", ("FFFB9000" + "00" * 413) * 3]


def byte_files(spark, d):
    heads = F.array(*[F.unhex(F.lit(h)) for h in HEADS])
    head = F.when(F.col("doc_id") % 2 == 0, F.get(heads, (F.col("doc_id") % (2 * len(HEADS)) / 2).cast("int"))).otherwise(F.unhex(F.lit("")))
    return t.read(spark, d, "documents").select("doc_id", F.concat(head, F.col("text").cast("binary")).alias("content"))


FILES_SQL = "(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (CASE doc_id % {n} ".replace('{n}', str(2 * len(HEADS))) + " ".join(f"WHEN {2 * i} THEN '{h}'" for i, h in enumerate(HEADS)) + " END) ELSE '' END || hex(encode(text)) AS h FROM documents)"


@query(
    "probe_winner",
    f"""SELECT doc_id, codec, CASE WHEN codec IS NULL THEN 0 ELSE 100 END AS confidence FROM (SELECT doc_id, CASE
      WHEN h[1:8] IN ('52494646', '52463634', '42573634') AND h[17:24] = '57415645' THEN 'wav'
      WHEN h[1:8] = '464F524D' AND h[17:24] IN ('41494646', '41494643') THEN 'aiff'
      WHEN h[1:8] = '664C6143' AND h[9:10] IN ('00', '80') THEN 'flac'
      WHEN h[1:8] = '4F676753' AND h[53:54] = '01' AND h[57:66] = '7F464C4143' THEN 'ogg-flac'
      WHEN h[1:8] = 'FFFB9000' THEN 'mp3'
      WHEN h[1:8] = '4F676753' AND h[53:54] = '01' AND h[57:70] = '01766F72626973' THEN 'vorbis'
      WHEN h[1:8] = '4F676753' AND h[53:54] = '01' AND h[57:72] = '4F70757348656164' THEN 'opus' END AS codec FROM {FILES_SQL})""",
)
def probe_winner(spark, d):
    return probe.identify(byte_files(spark, d)).select("doc_id", "codec", "confidence")


@query("magic_match", f'SELECT doc_id, codec, o AS "offset" FROM {FILES_SQL} JOIN {sql_values([(c, o, h) for c, _, o, h in MAGICS], "codec", "o", "m")} ON substr(h, 2 * o + 1, length(m)) = m')
def magic_match(spark, d):
    return probe.magic_matches(spark, byte_files(spark, d)).select("doc_id", "codec", "offset")


# Coded headers

# The oracle's own tables, as the specification prints them: kbit/s by version, layer and index, and Hz by index.
_KBIT = """CASE WHEN v = 1 AND layer = 1 THEN 32 * least(bi, 14) WHEN v = 1 AND layer = 2 THEN [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384][least(bi, 14) + 1]
 WHEN v = 1 THEN [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][least(bi, 14) + 1] WHEN layer = 1 THEN [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256][least(bi, 14) + 1]
 ELSE [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160][least(bi, 14) + 1] END"""
_RATE = "[44100, 48000, 32000][least(ri, 2) + 1] // CASE version WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END"
MPEG_SQL = f"""(SELECT *, whole AND size <= 2880 AND (size = 0 OR size >= 4 + CASE WHEN crc = 0 THEN 2 ELSE 0 END + CASE WHEN layer <> 3 THEN 0 WHEN version = 1 THEN CASE channels WHEN 1 THEN 17 ELSE 32 END ELSE CASE channels WHEN 1 THEN 9 ELSE 17 END END) AS valid FROM (SELECT *, CASE WHEN kbit = 0 THEN 0 WHEN layer = 1 THEN (12000 * kbit // rate + pad) * 4 ELSE samples // 8 * 1000 * kbit // rate + pad END AS size FROM (
  SELECT *, {_KBIT} AS kbit, {_RATE} AS rate, CASE WHEN layer = 1 THEN 384 WHEN layer = 2 OR version = 1 THEN 1152 ELSE 576 END AS samples FROM (
    SELECT *, CASE vb WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 25 END AS version, CASE vb WHEN 3 THEN 1 ELSE 2 END AS v, 4 - lb AS layer,
      b0 = 255 AND vb <> 1 AND lb <> 0 AND bi <> 15 AND ri <> 3 AS whole FROM (
      SELECT *, (b1 >> 3) & 3 AS vb, (b1 >> 1) & 3 AS lb, (b2 >> 4) & 15 AS bi, (b2 >> 2) & 3 AS ri, (b2 >> 1) & 1 AS pad, CASE WHEN (b3 >> 6) & 3 = 3 THEN 1 ELSE 2 END AS channels, b1 & 1 AS crc FROM {HEADER_SQL})))))"""


@query(
    "mpeg_header_parse",
    "SELECT event_id, valid, "
    + ", ".join(f"CASE WHEN valid THEN CAST({x} AS BIGINT) END AS {n}" for n, x in [("version", "version"), ("layer", "layer"), ("bitrate", "kbit * 1000"), ("sample_rate", "rate"), ("channels", "channels"), ("samples", "samples"), ("frame_size", "size"), ("mode", "(b3 >> 6) & 3"), ("mode_extension", "(b3 >> 4) & 3"), ("emphasis", "b3 & 3")])
    + ", "
    + ", ".join(f"CASE WHEN valid THEN {x} END AS {n}" for n, x in [("crc_present", "crc = 0"), ("private", "b2 & 1 = 1"), ("copyright", "(b3 >> 3) & 1 = 1"), ("original", "(b3 >> 2) & 1 = 1")])
    + f" FROM {MPEG_SQL}",
)
def mpeg_header_parse(spark, d):
    return headers.with_mpeg_header(t.header_rows(spark, d), "b0", "b1", "b2", "b3").drop("b0", "b1", "b2", "b3", "side_info", "padding")


@query(
    "opus_toc",
    f"""SELECT event_id, CASE WHEN c < 12 THEN 'silk' WHEN c < 16 THEN 'hybrid' ELSE 'celt' END AS mode,
    CASE WHEN c < 12 THEN ['NB', 'MB', 'WB'][c // 4 + 1] WHEN c < 14 THEN 'SWB' WHEN c < 16 THEN 'FB' ELSE ['NB', 'WB', 'SWB', 'FB'][c // 4 % 4 + 1] END AS bandwidth,
    CASE WHEN c < 12 THEN [480, 960, 1920, 2880][c % 4 + 1] WHEN c < 16 THEN [480, 960][c % 2 + 1] ELSE [120, 240, 480, 960][c % 4 + 1] END AS frame_size,
    (b >> 2) & 1 = 1 AS stereo, b & 3 AS code FROM (SELECT *, b >> 3 AS c FROM {BYTE_SQL})""",
)
def opus_toc(spark, d):
    return t.byte_rows(spark, d).select("event_id", *[c.alias(n) for n, c in headers.opus_toc(F.col("b")).items()])


@query("opus_frames_preskip", "SELECT o_orderkey, greatest(CAST(floor(o_totalprice) AS BIGINT) - o_custkey % 4000, 0) AS frames FROM orders")
def opus_frames_preskip(spark, d):
    return t.read(spark, d, "orders").select("o_orderkey", headers.opus_frames(F.floor("o_totalprice"), F.col("o_custkey") % 4000).alias("frames"))


@query(
    "mpeg_length_source",
    f"SELECT event_id, CASE WHEN valid IS NOT TRUE THEN 'unknown' WHEN b3 % 4 = 0 THEN 'stated' WHEN b3 % 4 = 1 THEN 'counted' WHEN kbit > 0 THEN 'estimated' ELSE 'unknown' END AS source FROM {MPEG_SQL}",
)
def mpeg_length_source(spark, d):
    f = headers.mpeg_header(*[F.col(f"b{i}") for i in range(4)])
    kind = F.col("b3") % 4
    source = headers.length_source(f, kind == 0, kind == 1)
    return t.header_rows(spark, d).select("event_id", source.alias("source"))


@query("track_duration", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_custkey % 7 = 0 THEN -1.0::DOUBLE ELSE greatest(CAST(floor(o_totalprice) AS BIGINT) - 528 - o_custkey, 0) / 44100.0::DOUBLE END AS seconds FROM orders")
def track_duration(spark, d):
    frames = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice"))
    return t.read(spark, d, "orders").select("o_orderkey", headers.duration(frames, F.lit(528), F.col("o_custkey"), F.when(F.col("o_custkey") % 7 == 0, 0.0).otherwise(44100.0)).alias("seconds"))


# Tags


@query("id3v1_genre", f"SELECT event_id, b, genre FROM {BYTE_SQL} LEFT JOIN {sql_values(list(enumerate(GENRES)), 'code', 'genre')} ON code = b")
def id3v1_genre(spark, d):
    return tags.genre(spark, t.byte_rows(spark, d), "b")


# Keys as files spell them and what they mean, written out from the formats' descriptions; an empty tag: outside them.
TAG_KEYS = {
    "vorbis": """Title:title artist:artist ALBUM:album AlbumArtist:albumartist Album_Artist:albumartist date:date YEAR:date Tracknumber:tracknumber TRACKTOTAL:tracktotal totaltracks:tracktotal
     DISCNUMBER:discnumber DISCTOTAL:disctotal TotalDiscs:disctotal Genre:genre COMPOSER:composer performer:performer COPYRIGHT:copyright Description:comment comment:comment ORGANIZATION:organization
     label:organization Publisher:organization ENCODER:encoder isrc:isrc Lyrics:lyrics UnsyncedLyrics:lyrics bpm:bpm LANGUAGE:language REPLAYGAIN_TRACK_GAIN: MOOD: Titlé:""",
    "id3": """TIT2:title TPE1:artist TALB:album TPE2:albumartist TDRC:date TYER:date TRCK:tracknumber TPOS:discnumber TCON:genre TCOM:composer TPE3:performer TPE4:performer COMM:comment TCOP:copyright
     TSSE:encoder TSRC:isrc TLAN:language TPUB:organization USLT:lyrics TBPM:bpm TT2:title TP1:artist TAL:album TP2:albumartist TYE:date TRK:tracknumber TPA:discnumber TCO:genre TCM:composer
     TP3:performer TP4:performer COM:comment TCR:copyright TSS:encoder TRC:isrc TLA:language TPB:organization ULT:lyrics TBP:bpm TXXX: tit2: TDR: PRIV:""",
    "riff": """INAM:title IART:artist IPRD:album ICRD:date IDIT:date ITRK:tracknumber IPRT:tracknumber IGNR:genre IMUS:composer ISTR:performer ICMT:comment ISBJ:comment ICOP:copyright ISFT:encoder
     ILNG:language IPUB:organization inam: IENG:""",
}


def add_tag_map(scheme: str):
    pairs = [(k.replace("_", " ") if k == "Album_Artist" else k, v) for k, _, v in (x.partition(":") for x in TAG_KEYS[scheme].split())]

    @query(
        f"tag_map_{scheme}",
        f"SELECT event_id, event_type AS value, key, nullif(tag, '') AS tag, tag = '' AS custom FROM (SELECT *, event_id % {len(pairs)} AS i FROM events) JOIN {sql_values([(i, k, v) for i, (k, v) in enumerate(pairs)], 'place', 'key', 'tag')} ON place = i",
    )
    def mapped(spark, d):
        own = F.get(F.array(*[F.lit(k) for k, _ in pairs]), (F.col("event_id") % len(pairs)).cast("int"))
        return tags.normalise(spark, t.read(spark, d, "events").select("event_id", F.col("event_type").alias("value"), own.alias("key")), scheme)


for _scheme in TAG_KEYS:
    add_tag_map(_scheme)


@query("tag_add_unique", "SELECT conv_id, role, md5(text) AS value, min(turn) AS turn FROM conversations GROUP BY conv_id, role, text")
def tag_add_unique(spark, d):
    c = t.read(spark, d, "conversations").select("conv_id", "role", "turn", F.md5(F.col("text").cast("binary")).alias("value"))
    return tags.add_unique(c, "conv_id", "role", "value", "turn").select("conv_id", "role", "value", "turn")


@query("tags_multivalued", "SELECT conv_id, role, count(*) AS n, string_agg(left(md5(text), 6), ',' ORDER BY turn) AS \"values\" FROM conversations GROUP BY conv_id, role")
def tags_multivalued(spark, d):
    c = t.read(spark, d, "conversations").select("conv_id", "role", "turn", F.left(F.md5(F.col("text").cast("binary")), F.lit(6)).alias("v"))
    return tags.multivalued(c, "conv_id", "role", "v", "turn").withColumn("values", F.array_join("values", ","))


@query("tag_split_pair", "SELECT o_orderkey, nullif(split_part(p, '/', 1), '') AS number, nullif(split_part(p, '/', 2), '') AS total FROM (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN o_custkey || '/' WHEN 1 THEN o_custkey || '/' || o_orderkey ELSE '/' || o_orderkey END AS p FROM orders)")
def tag_split_pair(spark, d):
    c, o = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    p = F.when(F.col("o_custkey") % 3 == 0, F.concat(c, F.lit("/"))).when(F.col("o_custkey") % 3 == 1, F.concat(c, F.lit("/"), o)).otherwise(F.concat(F.lit("/"), o))
    return tags.split_pair(t.read(spark, d, "orders").select("o_orderkey", p.alias("p")), "p").drop("p")


@query("id3v1_fill_missing", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def id3v1_fill_missing(spark, d):
    return tags.fill_missing(t.read(spark, d, "labels"), t.read(spark, d, "documents").select("doc_id", "lang"), ["doc_id"])


# Positions


@query("seek_asof", f"WITH p AS (SELECT track, frame, x AS o FROM {MONO_SQL} WHERE frame % 10 = 0) SELECT a.track, a.frame, p.frame AS point, p.o AS \"offset\" FROM {MONO_SQL} a ASOF LEFT JOIN p ON a.track = p.track AND a.frame >= p.frame")
def seek_asof(spark, d):
    m = t.mono_tracks(spark, d)
    return seek.as_of(m.select("track", "frame"), m.where("frame % 10 = 0").select("track", "frame", F.col("x").alias("offset")))


LACING_SQL = "(SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 3 = 0 THEN 255 ELSE event_id % 256 END AS lace FROM events)"


@query(
    "ogg_packet_assembly",
    f'SELECT stream, packet, count(*) AS "values", CAST(sum(lace) AS BIGINT) AS bytes, max(CASE WHEN lace < 255 THEN 1 ELSE 0 END) AS whole FROM (SELECT *, CAST(coalesce(sum(CASE WHEN lace < 255 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS packet FROM {LACING_SQL}) GROUP BY stream, packet',
)
def ogg_packet_assembly(spark, d):
    e = F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lacing = t.read(spark, d, "events").select(F.col("user_id").alias("stream"), F.row_number().over(w).alias("n"), F.when(e % 3 == 0, 255).otherwise(e % 256).alias("lace"))
    return seek.packets(lacing, "stream", "n", "lace")


@query("ogg_last_granule", "SELECT user_id AS stream, arg_max(g, event_id) AS granule FROM (SELECT user_id, event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(floor(value * 100) AS BIGINT) END AS g FROM events) GROUP BY user_id")
def ogg_last_granule(spark, d):
    granule = F.when(F.col("event_id") % 4 == 3, -1).otherwise(F.floor(F.col("value") * 100))  # -1: nothing stated
    return seek.last_granule(t.read(spark, d, "events").select(F.col("user_id").alias("stream"), "event_id", granule.alias("granule")), "stream", "event_id")
