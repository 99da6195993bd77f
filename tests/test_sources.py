from pyspark.sql import functions as F

from sightline.sources import tables


def test_master_list(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿ply_no,start,end,length_m,no_of_ply,item_number,item_description,packing_list\n 88 ,48.3,65.433,17,1-DW,007,± °,p\n,1,2,1,x,,,\n12,1,2,1\n", encoding="utf-8")
    rows = {r["ply_no"]: r for r in tables.master_list(spark, str(tmp_path / "m.csv")).collect()}
    assert set(rows) == {"88", "12"} and rows["88"]["item_number"] == "007" and rows["12"]["packing_list"] == ""


def test_clips_and_images(spark, tmp_path):
    for name in ("b/cam0.mp4", "a/cam0.mp4", "a/x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r["path"].rsplit("/", 2)[1] for r in tables.clips(spark, str(tmp_path)).collect()] == ["a", "b"]
    df = spark.createDataFrame([("a.JPG",), ("a.mp4",)], "p string")
    assert [r[0] for r in df.select(tables.is_image(F.col("p"))).collect()] == [True, False]
