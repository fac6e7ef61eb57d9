"""Files written by a job and read back, by this library and by Python's own reader; failed jobs leave nothing."""

import io
import os
import wave

import pytest
from pyspark.sql import functions as F

from wavelake.operators import adpcm, containers, encode
from wavelake.sources import files as src
from wavelake.sources import sink


def test_pcm_files(spark, tmp_path):
    rows = spark.range(40).withColumn("x", F.transform(F.sequence(F.lit(0), F.col("id")), lambda k: k * 300 - 5000))
    files = rows.select(F.concat(F.lit("t"), "id", F.lit(".wav")).alias("name"), containers.wav_bytes("s16", F.lit(1), F.lit(8000), containers.sample_bytes(F.col("x"), 2)).alias("content"))
    folder = str(tmp_path / "out")
    sink.save_files(files, folder, partitions=5)
    assert all(n.startswith("part-") for n in os.listdir(folder))
    found = {n: os.path.join(at, n) for at, _, names in os.walk(folder) for n in names}
    assert sorted(found) == sorted(f"t{k}.wav" for k in range(40))
    for k in (0, 7, 39):
        with wave.open(found[f"t{k}.wav"]) as w:
            assert (w.getnchannels(), w.getframerate(), w.getnframes()) == (1, 8000, k + 1)
            assert w.readframes(k + 1) == b"".join((i * 300 - 5000).to_bytes(2, "little", signed=True) for i in range(k + 1))
    got = containers.wav_scan(src.open_files(spark, folder + "/part-*"), ["path"])
    assert {(r.result, r.frames) for r in got.collect()} == {("OK", k + 1) for k in range(40)}
    sink.save_files(files.limit(0), folder)
    sink.save_files(files.where("name = 't3.wav'"), "file://" + folder)
    assert src.open_files(spark, folder + "/part-*").count() == 41


@pytest.mark.parametrize("bad", ["CAST(NULL AS STRING)", "''", "'a/b'", "'../x'", "'_x'", "'f3'", "raise_error('lost')"])
def test_failed_jobs_leave_nothing(spark, tmp_path, bad):
    files = spark.range(20).select(F.when(F.col("id") == 11, F.expr(bad)).otherwise(F.concat(F.lit("f"), "id")).alias("name"), F.lit(b"x").alias("content"))
    folder = tmp_path / "out"
    folder.mkdir()
    with pytest.raises(Exception):
        sink.save_files(files, str(folder), partitions=3)
    assert os.listdir(folder) == []


def test_never_replaces(spark, tmp_path):
    spark.dataSource.register(sink.Files)
    with pytest.raises(Exception, match="never replaced"):
        spark.createDataFrame([("a", b"x")], "name string, content binary").write.format("wavelake_files").option("path", str(tmp_path)).mode("overwrite").save()


@pytest.mark.parametrize("coding,channels", [("ima-wav", 1), ("ima-wav", 2), ("ms-adpcm", 1), ("ms-adpcm", 2), ("ulaw", 2), ("alaw", 1)])
def test_coded_wav(spark, coding, channels):
    rows = [(k, f, c, (f * 131 * (c + 1)) % 4000 - 2000) for k, n in ((0, 1), (1, 777), (2, 2049)) for f in range(n) for c in range(channels)]
    samples = spark.createDataFrame(rows, "track int, frame bigint, ch int, x int")
    blocks = encode.encode_blocks(samples, coding, channels)
    files = encode.coded_wav(blocks, coding, channels, 22_050)
    got = {r.track: r for r in containers.wav_scan(files.drop("frames"), ["track"]).collect()}
    assert {k: (r.result, r.coding, r.channels, r.sample_rate, r.frames) for k, r in got.items()} == {k: ("OK", coding, channels, 22_050, n) for k, n in ((0, 1), (1, 777), (2, 2049))}
    data = {r.track: bytes(r.data) for r in encode.coded_data(blocks).collect()}
    for r in files.collect():
        at = got[r.track].data_offset
        assert bytes(r.content)[at : at + len(data[r.track])] == data[r.track]
        assert int.from_bytes(bytes(r.content)[4:8], "little") == len(r.content) - 8
    with pytest.raises(ValueError):
        encode.coded_wav(blocks, "ima-qt", 1, 8000)


def test_written_blocks_decode(spark):
    rows = [(0, f, 0, (f * 40) % 3000) for f in range(505)]
    blocks = encode.encode_blocks(spark.createDataFrame(rows, "track int, frame bigint, ch int, x int"), "ima-wav")
    back = adpcm.ima_wav_block(blocks.withColumn("channels", F.lit(1)), block="data").orderBy("frame").collect()
    assert len(back) == 505 and io.BytesIO(bytes(blocks.first().data)).getbuffer().nbytes == 256
    assert sum(abs(r.x - want[3]) for r, want in zip(back, rows)) / 505 < 300
