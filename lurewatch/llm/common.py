"""What the operators share: columns computed from text, scratch tables, id keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lurewatch.session import shared_folder

SLICE_ROWS = 512
_BUILT: dict[str, tuple[Any, Any]] = {}


def once(kind: str, key: Any, build: Callable[[], Any]) -> Any:
    """A worker's copy of what is costly to build; one per kind, kept from task to task."""
    if kind not in _BUILT or _BUILT[kind][0] != key:
        _BUILT[kind] = (key, build())
    return _BUILT[kind][1]


def forget(kind: str) -> None:
    """Frees a worker's copy; for tasks of later stages, which the worker may run as well."""
    _BUILT.pop(kind, None)


def scratch(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage, survives lost executors.

    A later join on it gets an exchange of its own, which adaptive execution can
    split where a key is hot.
    """
    folder = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def drop_clashing(frame: DataFrame, names: list[str]) -> DataFrame:
    """Without the columns whose place the named results take (names ignore case, as in Spark)."""
    taken = {n.lower() for n in names}
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if c.lower() not in taken])


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Tables of texts that are written meanwhile go to Python in batches of SLICE_ROWS rows, whatever the session says."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(SLICE_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def add_from_text(
    frame: DataFrame, text: str, fields: str, compute: Callable[[], Callable[[list[str | None]], list[pa.Array]]]
) -> DataFrame:
    """The frame with columns that Python computes from one text column.

    `compute` is called once per task and gives a function from the texts of an
    Arrow batch to one Arrow array per field. Every other column passes through
    unchanged; a result column replaces an input column of its name.
    """
    added = T._parse_datatype_string(fields)
    kept = drop_clashing(frame, added.names)
    column = kept.columns.index(next(c for c in kept.columns if c.lower() == text.lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in slices(batches):
            results = work(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *results], names=[*batch.schema.names, *added.names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added.fields]))


def id_text(column: str) -> Column:
    """An id as text for hashing; a null id is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo a number: the split into training and held-out rows."""
    return F.crc32(id_text(column).cast("binary")) % modulus


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
