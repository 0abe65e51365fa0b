"""Small helpers for Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows given to a function at once, and bytes in a batch between Spark and a worker, for sessions that don't say.
SLICE, BATCH_BYTES = 512, "4m"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What tasks leave in a worker for later tasks of their operator.
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps under ``key`` between tasks, made at need."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Free what other operators keep; for tasks that need the memory, since a worker outlives the stage that filled it."""
    _kept.clear()


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in small batches: rows here hold whole texts, and a batch is held several times over, on either side."""
    conf = df.sparkSession.conf
    if BATCH not in conf.getAll:
        conf.set(BATCH, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch; ``make`` runs once a task and returns it.

    The function returns the output columns in the order of ``schema``. It gets
    at most SLICE rows at once, which bounds what a worker holds besides the batch.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                yield batch(arrow, each(b.slice(at, SLICE)))

    return map_arrow(df, run, schema)


def texts(b: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in b.column(name).to_pylist()]
