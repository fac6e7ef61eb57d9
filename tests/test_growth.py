"""What a task holds doesn't grow with the tables: rows are dealt, walks happen once, and groups are bounded."""

import struct

import duckdb

from wavelake.operators import containers, flac, ogg_flac, seek
from wavelake.plans import catalogue, files
from wavelake.sources import files as src
from wavelake.sources import flac_frames
from wavelake.sources import tables as t

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_dealt_to_tasks_that_grow_with_them(spark):
    tasks = lambda n: t.dealt(spark.range(n), "id", rows=20_000).rdd.getNumPartitions()
    assert [tasks(n) for n in (0, 10, 1500, 10_000, 170_000)] == [1, 1, 2, 4, 9]


def test_made_files_go_on_in_small_batches(spark):
    """Files of 50,000 bytes each: before, all of a task's were one batch."""
    made = src.each(spark.range(0, 200, 1, 1), ["id"], "content binary", lambda k: [(bytes(50_000),)])
    sizes = made.mapInPandas(lambda frames: (f.assign(rows=len(f))[["id", "rows"]] for f in frames), "id bigint, rows bigint")
    assert sizes.count() == 200
    assert len(files.opus_file(3, 50)) > 100_000
    assert plan(files.ogg_files(spark, SF)).count("MapInArrow") == 1


def test_scans_walk_a_file_once(spark):
    """A stream's pages and packets, and a file's frames, are folded in the walk, so no packet or frame is shuffled."""
    body = src.ogg_stream(7, [(b"OpusHead" + bytes([1, 2, 56, 1]) + bytes(7), 0), (b"OpusTags" + bytes(8), 0), (bytes(70_000), 960)])
    frame = bytes.fromhex("FFFB9000") + bytes(413)
    rows = spark.createDataFrame([("a", body + body), ("b", frame * 5), ("c", None)], "name string, content binary")
    ogg, mpeg = containers.ogg_scan(rows, ["name"]), containers.mpeg_scan(rows, ["name"])
    assert plan(ogg).count("MapInArrow") == plan(mpeg).count("MapInArrow") == 1
    assert "first" in src.ogg_stream_rows(rows).columns and "walked" in src.mpeg_track_rows(rows).columns
    assert [(r.name, r.serial, r.result, r.frames) for r in ogg.collect()] == [("a", 7, "OK", 960 - 312)]
    assert [(r.name, r.walked, r.frames) for r in mpeg.collect()] == [("b", 5, 5 * 1152)]


def parts_of(spark, folder, keys):
    rows = [(k, f"part {k}", "Brand", "TYPE", k % 50 + 1) for k in keys]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_flac_scan_of_more_frames_than_its_field_holds(spark, tmp_path):
    """36 bits hold the frames: p_partkey * 4294967 is more from 16,001 on."""
    d = parts_of(spark, tmp_path, [16_000, 16_001, 50_002, 119_999])
    got = {r.p_partkey: (r.result, r.depth, r.frames) for r in files.flac_scan(spark, d).collect() if r.result == "OK"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT p_partkey, result, depth, frames FROM ({catalogue.SQL['flac_scan']}) WHERE result = 'OK'").fetchall()}
    assert got == want and len(got) > 1
    assert max(f or 0 for _, _, f in got.values()) < 1 << 36


def test_flac_files_are_searched_once(spark):
    rows = spark.createDataFrame([(k, files._raw_file(k, 9)) for k in range(12)], "k bigint, content binary")
    index = flac.frame_index(rows, "k")
    assert plan(index).count("MapInArrow") == 1 and "Join" not in plan(index)
    assert index.count() == sum(k % 4 + 2 - (k % 10 == 0) for k in range(12))


def test_short_bytes_have_the_marks_of_long_ones():
    own = bytes(range(256)) * 8
    places = [0, 1, 63, 64, 65, 700, 1024]
    assert flac_frames.marks(own[:1024], places) == flac_frames.marks(own, places)
    assert flac_frames.crc8(b"123456789") == 0xF4


def test_samples_of_whole_frames_need_no_shuffle(spark):
    data = [(1, 0, 0, 4, 8, 16, 7, files._coded_frame(0, 30)), (1, 24, 4, 4, 8, 16, 7, files._coded_frame(1, 40)[:-4] + b"\xff\xff\0\0"), (2, 0, 0, 4, 8, None, 7, files._coded_frame(0, 1))]
    rows = spark.createDataFrame(data, "k bigint, offset bigint, first_sample bigint, block_size int, assignment int, depth int, header int, data binary")
    got = flac.whole_frame_samples(rows, "k")
    assert sorted(got.collect()) == sorted(flac.frame_samples(flac.channel_samples(flac.subframes(rows, "k")), "k").collect())
    assert "Aggregate" not in plan(got) and got.count() > 0


def test_frames_in_ogg_are_made_once(spark):
    got = ogg_flac.frames(ogg_flac.packets(files.ogg_flac_files(spark, SF)), "p_partkey")
    assert plan(got).count("MapInArrow") == 2 and "Join" not in plan(got)  # the files, and their packets


def test_mixed_files_are_no_join(spark):
    """Spark guessed the made files as small as their parts, and broadcast them all."""
    made = files.mixed_files(spark, SF)
    assert "Join" not in plan(made)
    assert made.count() == t.read(spark, SF, "part").count()


def test_rows_of_mpeg_files_are_never_broadcast(spark):
    physical = files.mpeg_seek(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in physical and "SortMergeJoin" in physical


def test_seek_points_are_read_once(spark):
    point = lambda *p: struct.pack(">qqH", *p)
    tables = [point(1, 0, 9) + point(5, 7, 9) + point(-1, 0, 0), point(5, 0, 9) + point(5, 7, 9), point(1, 0, 9)[:-1], point(-1, 0, 0), b"", None]
    rows = spark.createDataFrame([*enumerate(tables)], "k int, data binary")
    got = containers.seek_points(rows, ["k"])
    assert sorted(map(tuple, got.collect())) == [(0, 1, 0, 9), (0, 5, 7, 9)]
    assert plan(got).count("MapInArrow") == 1 and "shiftleft" not in plan(got)


def test_tracks_are_dealt_and_laid_out_in_one_sort(spark):
    physical = catalogue.layout_offsets(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1 and "Join" not in physical


def test_many_targets_of_a_key_are_looked_up_once_a_position(spark):
    """One stream and three positions for 30,000 targets: no window holds more than positions, and null ones stay."""
    targets = spark.range(30_000).selectExpr("id", "0 AS stream", "CASE WHEN id % 3 < 2 THEN id % 3 * 100 END AS granule")
    pages = spark.createDataFrame([(0, 0, 50, 100), (0, 50, 90, 200), (0, 90, 95, -1)], "stream int, offset bigint, next_offset bigint, granule bigint")
    got = seek.bisect(targets, pages, "stream")
    assert {tuple(r) for r in got.groupBy("granule", "landing").count().collect()} == {(0, 0, 10_000), (100, 50, 10_000), (None, 0, 10_000)}
    assert "Window" in plan(got) and "named_struct(id" not in plan(got)
    assert seek.bisect(targets.selectExpr("id", "1 AS stream", "granule"), pages, "stream").where("landing IS NULL").count() == 30_000
