import json

import pytest

from sightline.sources import recordings as r

LINES = [json.dumps({"t": i / 10, "text": "é" * (i % 9)}, ensure_ascii=False) for i in range(400)]


def write(path, lines, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(("\n".join(lines) + end).encode())


def test_spec_names_a_device_or_a_recording():
    assert [r.device(s) for s in ("0", "02", "/dev/video3", 4)] == ["video0", "video2", "video3", "video4"]
    assert [r.device(s) for s in ("clip.jsonl", "/dev/sda", "s3://b/0", "/data/1", "")] == [None] * 5


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "", "\n\n"])
def test_recording_in_splits(spark, tmp_path, split, end):
    write(tmp_path / "a.jsonl", LINES[:150], end)
    df = r.open_source(spark, str(tmp_path / "a.jsonl"), "cam", split=split)
    rows = sorted(df.collect(), key=lambda x: x["place"])
    assert [x["body"] for x in rows] == LINES[:150] and {x["source"] for x in rows} == {"cam"} and not df.isStreaming
    assert df.rdd.getNumPartitions() == max(1, -(-(tmp_path / "a.jsonl").stat().st_size // split))


def test_folder_of_files_and_fields(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"d/{k}.jsonl", LINES[k * 100 : k * 100 + 100])
    write(tmp_path / "d/_SUCCESS", [""])
    df = r.open_source(spark, str(tmp_path / "d"), "cam", schema="t double, text string")
    rows = sorted(df.collect(), key=lambda x: (x["file"], x["place"]))
    assert [x["t"] for x in rows] == [i / 10 for i in range(300)] and df.columns == ["source", "file", "place", "t", "text"]


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        r.open_source(spark, str(tmp_path / "no.jsonl"), "cam")
    with pytest.raises(ValueError):
        r.open_source(spark, "0", "cam")
    (tmp_path / "none").mkdir()
    assert r.open_source(spark, str(tmp_path / "none"), "cam").count() == 0
    (tmp_path / "empty.jsonl").write_bytes(b"")
    assert r.open_source(spark, str(tmp_path / "empty.jsonl"), "cam").count() == 0


def test_a_restart_resumes_at_the_offset(spark, tmp_path):
    at = tmp_path / "live/video0"
    df = r.open_source(spark, "/dev/video0", "cam", live=str(tmp_path / "live"), split=300)
    assert df.isStreaming

    def trigger():
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        out = spark.read.schema(r.SCHEMA).parquet(str(tmp_path / "out"))
        return [x["body"] for x in sorted(out.collect(), key=lambda x: (x["file"], x["place"]))]

    at.mkdir(parents=True)
    assert trigger() == []  # the capture has not begun
    write(at / "00.jsonl", LINES[:50], "\n" + LINES[50][:4])  # the last line is not finished
    assert trigger() == LINES[:50]
    write(at / "00.jsonl", LINES[:60])
    write(at / "01.jsonl", LINES[60:90])
    assert trigger() == LINES[:90]
    assert trigger() == LINES[:90]
    write(at / "01.jsonl", LINES[60:95], "\n" + LINES[95][:1])
    write(at / "02.jsonl", ["x"], "")
    write(at / "01.jsonl", LINES[60:100])
    assert trigger() == LINES[:100]
    write(at / "02.jsonl", LINES[100:])
    assert trigger() == LINES
