"""Arrow helpers that the text operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pegtrail.session import importable

#: Most UTF-8 bytes of text that a Python worker holds as one slice (a single longer text is a slice of its own).
SLICE_BYTES = 2 << 20
#: Up to so many narrow rows (16 to 32 bytes each) are broadcast to a join; beyond it, both sides are shuffled.
BROADCAST_ROWS = 1_500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, for texts are long: rows here, bytes where the version has it."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder that the session names. Only a session within one machine may name none: it gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints/pegtrail")


def picked(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """The rows joined with `keys`, which are narrow and are broadcast if they are few."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, on, how)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that no slice of more than one row has over `limit` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def map_slices(df: DataFrame, columns: list[str], text: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over `columns`; `make` runs once a task and returns what turns a slice into the output columns.

    Only `columns` are read, so that other columns, whatever their names, never reach Python.
    """
    small_batches(df.sparkSession)
    fields = [(f.name, f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [(name, to_arrow_type(kind)) for name, kind in fields]
        step = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                out = step(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[name], pa.Array) else pa.array(x, kind) for name, kind in types], [name for name, _ in types])

    return df.select(*(F.col(c) for c in columns)).mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """Python strings; a null is an empty text."""
    return [x or "" for x in column.to_pylist()]
