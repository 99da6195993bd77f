"""Readers: tables as Parquet, reference lists as CSV, events with a clock in microseconds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASTER_COLUMNS = ["ply_no", "start", "end", "length_m", "no_of_ply", "item_number", "item_description", "packing_list"]
IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|bmp|tif|tiff|webp)$"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint directory. Only a local session without either, as in tests, has one folder of this machine, which goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = getattr(spark, "_sightline_shared", None)
        if folder is None:
            folder = spark._sightline_shared = tempfile.mkdtemp(prefix="sightline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that lost executors cost no recomputation. It stays until discarded() or discard_all()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sightline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    spark._sightline_stored = [*getattr(spark, "_sightline_stored", ()), path]
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discarded(df: DataFrame) -> None:
    """Remove what stored() wrote for df, once nothing reads it any more."""
    spark, path = df.sparkSession, df._stored_at
    _remove(spark, path)
    spark._sightline_stored = [p for p in getattr(spark, "_sightline_stored", ()) if p != path]


def discard_all(spark: SparkSession) -> None:
    """Remove all that stored() wrote in this session, once no result that reads it is needed."""
    for path in getattr(spark, "_sightline_stored", ()):
        _remove(spark, path)
    spark._sightline_stored = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t, microseconds since 1970 without a time zone."""
    df = table(spark, sf_dir, "events")
    return df.withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))


def master_list(spark: SparkSession, path: str) -> DataFrame:
    """A reference list: all text, trimmed, missing as "", rows without a code left out; a byte order mark is harmless."""
    raw = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in MASTER_COLUMNS]), enforceSchema=True, encoding="UTF-8")
    return clean_list(raw, MASTER_COLUMNS[0])


def clean_list(raw: DataFrame, key: str) -> DataFrame:
    tidy = raw.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in raw.columns))
    return tidy.where(F.col(key) != "")


def clips(spark: SparkSession, root: str, pattern: str = "*.mp4") -> DataFrame:
    """Files below root, in path order, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", "modificationTime").orderBy("path")


def is_image(path: Column) -> Column:
    """Whether a path names an image, by its suffix."""
    return path.rlike(IMAGE_SUFFIX)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def images(spark: SparkSession, root: str) -> DataFrame:
    """path and content of the image files below root; empty files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(is_image(F.col("path")) & (F.col("length") > 0)).select("path", "content")


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A report as CSV with a header, its columns in this order, missing values empty. Files in the folder follow one another in order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns).write.mode("overwrite").csv(path, header=True, emptyValue="", encoding="UTF-8")
