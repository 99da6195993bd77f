"""One spec string to a source: a recording is read whole, a device is a stream that a restart resumes.

A spec of digits or `/dev/video<n>` names a device, anything else a recording, as a path or URI. Both are JSON lines. A
recording is a file, or a folder of files in the order of their names, and is read in byte ranges. A device is what its
capture process appends to `<live>/video<n>/`: files in the order of their names, each only ever growing, and left alone
once a later one is there. The stream's offset is a file and a place in it behind a line's end, so a line is read once,
whether or not it was finished when the last trigger came.

Both formats give source, file, place (of the line in its file, in bytes) and body (the line); the pair of file and place
orders the lines of a source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, file string, place bigint, body string"
#: Bytes of a recording or of a device's lines that one task reads.
SPLIT = 64 << 20
_CHUNK = 1 << 20


def device(spec: str) -> str | None:
    """video<n> if a spec names a device."""
    found = re.fullmatch(r"(?:/dev/video)?([0-9]+)", str(spec))
    return f"video{int(found[1])}" if found else None


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """The files at a path by name, with their sizes; hidden ones are left out."""
    from pyarrow import fs

    store, at = _store(path)
    here = store.get_file_info(at)
    if here.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [here] if here.is_file else store.get_file_info(fs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._")


@dataclass
class Range(InputPartition):
    """Bytes of a file: the lines that begin at start or behind it and before end."""

    file: str
    start: int
    end: int


def _ranges(file: str, start: int, end: int, split: int) -> Iterator[Range]:
    for at in range(start, end, split):
        yield Range(file, at, min(end, at + split))


def _lines(path: str, part: Range) -> Iterator[tuple[int, str]]:
    """Place and text of the lines of a range: the line that its end cuts belongs to it, and the one that its start cuts does not."""
    store, _ = _store(path)
    with store.open_input_file(part.file) as f:
        at = part.start
        if at:
            f.seek(at - 1)
            while (piece := f.read(_CHUNK)) and (cut := piece.find(b"\n")) < 0:
                at += len(piece)
            if not piece:
                return
            at += cut
        f.seek(at)
        held = b""
        while at < part.end:
            piece = f.read(_CHUNK)
            *full, held = (held + piece).split(b"\n")
            if not piece and held:
                full, held = [held], b""
            for line in full:
                if at >= part.end:
                    return
                if line.strip():
                    yield at, line.decode("utf-8", "replace")
                at += len(line) + 1
            if not piece:
                return


class Recording(DataSource):
    """Options: path, source (a name for its rows), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)


class RecordingReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.source, self.split = options["path"], options.get("source", ""), int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        return [r for file, size in _files(self.path) for r in _ranges(file, 0, size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for place, body in _lines(self.path, partition) if partition.file else ():
            yield self.source, partition.file, place, body


class Live(DataSource):
    """Options: path (the device's folder), source, split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "live"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(self.options)


class LiveReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.source, self.split = options["path"], options.get("source", ""), int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {"file": "", "place": 0}

    def latestOffset(self) -> dict:
        try:
            file, size = _files(self.path)[-1]
        except (FileNotFoundError, IndexError):  # nothing captured yet
            return self.initialOffset()
        return {"file": file, "place": self._whole(file, size)}

    def _whole(self, file: str, size: int) -> int:
        """Where the last finished line ends."""
        store, _ = _store(self.path)
        with store.open_input_file(file) as f:
            while size:
                low = max(0, size - _CHUNK)
                f.seek(low)
                cut = f.read(size - low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1
                size = low
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, size in _files(self.path):
            if start["file"] <= file <= end["file"]:
                low = start["place"] if file == start["file"] else 0
                high = end["place"] if file == end["file"] else size
                out += _ranges(file, low, high, self.split)
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        for place, body in _lines(self.path, partition):
            yield self.source, partition.file, place, body

    def commit(self, end: dict) -> None:
        pass


def open_source(spark: SparkSession, spec: str, name: str, live: str | None = None, schema: str | None = None, split: int = SPLIT) -> DataFrame:
    """The rows of a spec, named source; a device's are a stream, whose captures lie in the folder live. schema: also the fields of the lines, as columns of their own."""
    spark.dataSource.register(Recording)
    spark.dataSource.register(Live)
    at = device(spec)
    if at is not None and live is None:
        raise ValueError(f"{spec} is a device: say where its captures are")
    if at is None:
        _files(str(spec))  # a recording that is not there is an error at once
        df = spark.read.format("recording").options(path=str(spec), source=name, split=split).load()
    else:
        df = spark.readStream.format("live").options(path=f"{live.rstrip('/')}/{at}", source=name, split=split).load()
    return df if schema is None else df.withColumn("_line", F.from_json("body", schema)).select("source", "file", "place", "_line.*")
