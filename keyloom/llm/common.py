"""What several corpus operators need: folds, columns, slices of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

from keyloom.staging import discard, scratch, staged  # noqa: F401

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, _UPPER, _UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of the id as text, divisible by 5. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """The batches in slices of at most ``rows`` rows: what Python makes of one stays small."""
    for b in batches:
        n = b.num_rows if isinstance(b, pa.RecordBatch) else len(b)
        for at in range(0, n, rows):
            yield b.slice(at, rows) if isinstance(b, pa.RecordBatch) else b.iloc[at : at + rows]


def add_columns(df: DataFrame, source: str, ddl: str, make: Callable[[list], list]) -> DataFrame:
    """``df`` with the columns of ``ddl``, made from batches of the column ``source``.

    ``make`` gets the values of a batch and returns one list for each new column. The other columns
    pass through as Arrow arrays: no value is converted.
    """
    added = StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = make(b.column(b.schema.get_field_index(source)).to_pylist())
            new = [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(made, added.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *added.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def packed(rows: DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows on the driver, in pieces: an array for each column. Columns are integers without nulls.

    Executors pack the values of a batch, so the driver holds their bytes and never an object a row, in Java or Python.
    """
    kinds = [to_arrow_type(f.dataType).to_pandas_dtype() for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in b.columns], names=b.schema.names)

    for piece in rows.mapInArrow(run, StructType([StructField(c, BinaryType()) for c in rows.columns])).collect():
        yield tuple(np.frombuffer(v, kind) for v, kind in zip(piece, kinds, strict=True))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
