"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: One word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint directory. Only a local session without either, as in tests, gets a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = getattr(spark, "_sightline_shared", None)
        if folder is None:
            folder = spark._sightline_shared = tempfile.mkdtemp(prefix="sightline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


#: The folders written within the innermost scratch() of this thread or task.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: df as Parquet in the shared folder, read again. Survives lost executors; its size in bytes is known to the planner, which broadcasts it in a join only below spark.sql.autoBroadcastJoinThreshold."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sightline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if (held := _scope.get()) is not None:
        held.append(path)
    return out


#: Bytes in storage up to which sized() has a table broadcast; in memory it takes a few times as much.
BROADCAST_BYTES = 16 << 20


def sized(df: DataFrame) -> DataFrame:
    """df, which written() made, to be broadcast in a join if its measured bytes are at most BROADCAST_BYTES; beyond, the planner shuffles."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """Inner join on keys, right unique in them; counts has keys and n, how many left rows each holds. Keys of more than a HOT-th of all rows (fewer than HOT, so their broadcast is bounded) are spread over SALTS tasks, where their right row is repeated."""
    salt = free_name("salt", left, right)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(written(counts.where(F.col("n") > F.lit(max(1000, total // HOT))).select(*keys, F.lit(True).alias(salt))))
    dealt = F.when(F.col(salt), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(0).cast("int")
    every = F.when(F.col(salt), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(hot, keys, "left").withColumn(salt, dealt)
    b = right.join(hot, keys, "left").withColumn(salt, F.explode(every))
    return a.join(b, [*keys, salt]).drop(salt)


HOT, SALTS = 1000, 64


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete what written(df) wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._written_at)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end all that written() wrote within; results must be stored by then."""
    held: list[str] = []
    outer = _scope.set(held)
    try:
        yield
    finally:
        _scope.reset(outer)
        for path in held:
            remove(spark, path)


def free_name(stem: str, *frames: DataFrame) -> str:
    """A column name that no frame has, by any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def lower_words(raw: bytes) -> list[bytes]:
    """The words (WORD) of a UTF-8 text with A-Z lower-cased: bytes methods touch ASCII alone."""
    return raw.lower().split()


class Numbers(dict):
    """Numbers the words it is asked for, from 0; fresh lists those numbered since it was emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


#: What remembered() keeps in this worker: one thing at a time.
_memory: dict[tuple, object] = {}


def remembered(make: Callable, *args):
    """make(*args), which this worker keeps for its next tasks until it remembers something else or a task of map_rows, keep_rows or released() doesn't keep it."""
    key = (make.__module__, make.__qualname__, *args)
    if key not in _memory:
        _memory.clear()
        _memory[key] = make(*args)
    return _memory[key]


def released() -> None:
    """Give memory that this worker no longer uses back to the system: it is used again by other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def forgotten() -> None:
    """Drop what other stages remembered in this worker."""
    if _memory:
        _memory.clear()
        released()


def map_rows(df: DataFrame, columns: list[str], schema: str, rows: Callable[[Iterator[tuple]], Iterable[tuple]], flush: int = 2000, keeps: bool = False) -> DataFrame:
    """Stream the named columns of df through rows(iterator of tuples), in Arrow batches both ways.

    rows sees a whole partition as one iterator, holds what state it needs, and yields tuples of schema. keeps: it uses
    remembered(), so what the worker remembers stays.
    """
    names = [part.strip().split(" ", 1)[0].strip("`") for part in _fields(schema)]
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forgotten()

        def source() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)

        held: list[tuple] = []
        for row in rows(source()):
            held.append(row)
            if len(held) >= flush:
                yield _batch(held, names, target)
                held = []
        if held:
            yield _batch(held, names, target)
        held = []
        released()

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of df, all columns as they are, for which make()(values of the named column) says so; make is called once in each task. One pass in Arrow batches, no join."""
    at = df.columns.index(column)
    names = [f"c{i}" for i in range(len(df.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten()
        keep = make()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))
        del keep
        released()

    plain = df.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def _batch(held: list[tuple], names: list[str], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, type=target.field(i).type) for i, col in enumerate(zip(*held, strict=True))], schema=target)


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
