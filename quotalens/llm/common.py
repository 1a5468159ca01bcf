"""Helpers shared by the operators: reading tables, and running numpy or plain Python over Arrow batches.

Task bodies travel by value, so executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import ctypes
import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotalens.session import materialize, shared_folder  # noqa: F401  (the operators take them from here)


def by_value(module: str) -> None:
    """Ship the functions of ``module`` to executors inside the task, not as an import."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


class Shared:
    """A broadcast of bounded size. Classes travel by value too; the object is made once per worker and kept beside it."""

    def __init__(self, df: DataFrame, value: object):
        self.held = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self.held, "made"):
            self.held.made = pickle.loads(self.held.value)
        return self.held.made


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task body that gives freed memory back to the system before and after.

    Workers outlive their tasks and wait beside those of other operators, so what they keep adds up in an executor.
    """

    def give_back():
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return body


def append_columns(
    df: DataFrame,
    column: str,
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[[list], list[list]]],
    keep: Sequence[str] | None = None,
    target: int = 16 << 20,
) -> DataFrame:
    """``df`` with columns computed from one string or binary column, batch by batch.

    ``start`` runs once per task and returns the function from a list of values to one list per field. Columns of
    ``df`` that bear the name of a new field are replaced. ``keep`` names the columns that stay (default: all). A part of a
    batch has about ``target`` bytes.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    free = "value"
    while free in {c.lower() for c in kept}:
        free += "_"
    source = df.select(*[F.col(c) for c in kept], F.col(column).alias(free))
    out = T.StructType([source.schema[c] for c in kept] + list(fields))
    types = [_arrow(f.dataType) for f in fields]
    names = [*kept, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for piece in slices(batch, target):
                results = work(piece.column(len(kept)).to_pylist())
                arrays = [pa.array(r, t) for r, t in zip(results, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *arrays], names=names)

    return source.mapInArrow(settled(run), out)


def slices(batch: pa.RecordBatch, target: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``target`` bytes, so that long texts don't add up; a row is never cut."""
    rows = max(1, int(batch.num_rows * target / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _arrow(kind: T.DataType) -> pa.DataType:
    plain = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(),
        T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return plain[kind]


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3).cast("int")


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 1


def sample_order(*columns: str) -> Column:
    """A fixed pseudo-random order that does not depend on how rows are partitioned."""
    return F.xxhash64(*[F.col(c).cast("string") for c in columns], F.lit(20))


def seeded(text: str) -> int:
    return crc32(text.encode())


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType, True)
