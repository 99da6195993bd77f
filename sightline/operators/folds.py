"""Hosting of folds: rows of a key in order, sorted by Spark (which spills), streamed to a plain function."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def fold_groups(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fold: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """fold(key, rows) for each key; rows are tuples of order and columns, in order. One shuffle by key; many small keys share a task."""
    names = [*keys, *order, *columns]
    target = to_arrow_schema(_parse_datatype_string(schema))
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True))
        held: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[:k]):
            for out in fold(key, (r[k:] for r in group)):
                held.append(out)
                if len(held) >= 4000:
                    yield _batch(held, target)
                    held = []
        if held:
            yield _batch(held, target)

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(held: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)
