"""Decoded feeds, logs that grow, and clips of frames."""

import os

import pytest
from pyspark.sql import functions as F

from athletrack.sources import feeds

SCHEMA = "session_id bigint, at double, who struct<name:string>"


def test_values_are_decoded_and_bad_ones_kept(spark):
    lines = ['{"session_id": 1, "at": 0.5, "who": {"name": "ä"}, "more": 1}', '{"session_id": "x", "at": 1.0}', '{"session_id": 2', "", "   ", "[1]", "7", "{}", None, '{"at": null}']
    feed = spark.createDataFrame([(k, None if v is None else v.encode(), k) for k, v in enumerate(lines)], "offset long, value binary, at int")
    got = {r["source"]["offset"]: r for r in feeds.decoded(feed, SCHEMA).collect()}
    assert len(got) == len(lines) and got[0]["source"].asDict() == {"offset": 0, "at": 0}
    assert (got[0]["session_id"], got[0]["at"], got[0]["who"]["name"], got[0]["malformed"]) == (1, 0.5, "ä", None)
    assert [k for k in got if got[k]["malformed"] is not None] == [1, 2, 3, 4, 5, 6]
    assert all(got[k]["malformed"] == lines[k] for k in range(1, 7))
    assert all(got[k][c] is None for k in range(1, 10) for c in ("session_id", "at", "who"))
    assert feeds.decoded(feed.limit(0), SCHEMA).count() == 0
    with pytest.raises(ValueError):
        feeds.decoded(feed, "source string")


def _add(path, name, text):
    with open(os.path.join(path, name), "ab") as f:
        f.write(text)


def _drain(spark, tmp_path, span):
    rows = feeds.read_log_stream(spark, str(tmp_path / "log"), span)
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r["log"], r["offset"], bytes(r["value"]).decode()) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def _plain(path):
    out = []
    for name in sorted(os.listdir(path)):
        at = 0
        for line in open(os.path.join(path, name), "rb").read().split(b"\n")[:-1]:
            out.append((name, at, line.decode()))
            at += len(line) + 1
    return out


@pytest.mark.parametrize("span", [1, 7, 1 << 20])
def test_a_restart_repeats_and_loses_nothing(spark, tmp_path, span):
    path = str(tmp_path / "log")
    os.mkdir(path)
    assert len(_batches(path)) == 0
    _add(path, "0", b"one\ntwo\n\n" + b"x" * 40 + b"\nhal")
    _add(path, "1", b"no end yet")
    got = _drain(spark, tmp_path, span)
    assert got == _plain(path) and len(got) == 4
    assert _drain(spark, tmp_path, span) == got  # nothing new
    _add(path, "0", "f äé\nlast\n".encode())
    _add(path, "1", b"\n")
    _add(path, "2", b"new\n")
    assert _drain(spark, tmp_path, span) == _plain(path) and ("1", 0, "no end yet") in _plain(path)


def _batches(path):
    reader = feeds.LogReader(path, 5)
    return reader.partitions(reader.initialOffset(), reader.latestOffset())


def test_a_log_that_shrinks_is_an_error(tmp_path):
    _add(str(tmp_path), "0", b"a\n" * 10)
    reader = feeds.LogReader(str(tmp_path), 5)
    assert reader.latestOffset() == {"0": 20} and len(_batches(str(tmp_path))) == 4
    with pytest.raises(ValueError):
        reader.partitions({"0": 30}, {"0": 20})
    assert feeds.LogReader(str(tmp_path / "none"), 5).latestOffset() == {}


def test_long_lines_and_tails(tmp_path):
    _add(str(tmp_path), "0", b"a" * 200_000 + b"\n" + b"b" * 150_000)
    reader = feeds.LogReader(str(tmp_path), 70_000)
    assert reader.latestOffset() == {"0": 200_001}
    spans = reader.partitions({}, {"0": 200_001})
    assert [sum(b.num_rows for b in reader.read(s)) for s in spans] == [1, 0, 0]


@pytest.fixture(scope="module")
def clips(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clips"))
    frames = spark.createDataFrame([(s, k, bytes([s, k]) * (k + 1)) for s in range(6) for k in (0, 1, 4, 10)] + [(None, 1, b"x"), (1, None, b"x"), (2, 3, None)], "session_id long, frame_index long, content binary")
    feeds.write_clips(frames, path, 10.0)
    return path


def test_clips_come_back_in_order(spark, clips):
    got = sorted((r["session_id"], r["frame_index"], r["sequence"], r["captured_at"], bytes(r["content"])) for r in feeds.read_clips(spark, clips).collect())
    assert got == [(s, k, n, n / 10, bytes([s, k]) * (k + 1)) for s in range(6) for n, k in enumerate((0, 1, 4, 10))]
    assert all(r["decode_seconds"] >= 0 for r in feeds.read_clips(spark, clips).collect())


def test_a_filter_opens_its_clips_only(spark, clips, tmp_path):
    import shutil

    some = str(tmp_path / "some")
    shutil.copytree(clips, some)
    for s in (0, 1, 4, 5):
        os.remove(f"{some}/{s}.tar")  # what is opened must be there
    one = feeds.read_clips(spark, some).where("session_id = 2")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 4
    both = feeds.read_clips(spark, some).where(F.col("session_id").isin(2, 3) & (F.col("frame_index") > 0))
    assert both.rdd.getNumPartitions() == 2 and both.count() == 6
    assert feeds.read_clips(spark, some).where("session_id = 77").count() == 0
    with pytest.raises(Exception, match="No such file"):
        feeds.read_clips(spark, some).count()


def test_an_empty_index_has_no_frames(spark, tmp_path):
    frames = spark.createDataFrame([], "session_id long, frame_index long, content binary")
    feeds.write_clips(frames, str(tmp_path), 10.0)
    assert feeds.read_clips(spark, str(tmp_path)).count() == 0


def test_many_short_clips_share_their_tasks(spark, tmp_path):
    frames = spark.range(300).selectExpr("id div 2 as session_id", "id % 2 as frame_index", "encode(cast(id as string), 'utf-8') as content")
    feeds.write_clips(frames, str(tmp_path), 10.0)
    for tasks, want in ((None, int(spark.conf.get("spark.sql.shuffle.partitions"))), (7, 7), (1000, 150)):
        rows = feeds.read_clips(spark, str(tmp_path), tasks)
        assert rows.rdd.getNumPartitions() == want
        assert sorted((r["session_id"], r["sequence"], int(bytes(r["content"]))) for r in rows.collect()) == [(k // 2, k % 2, k) for k in range(300)]
    with pytest.raises(Exception, match="at least 1"):
        feeds.read_clips(spark, str(tmp_path), 0).count()
