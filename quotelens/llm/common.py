"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Fixed by the contracts of the operators: the white space that separates words.
WHITE_SPACE = " \t\n\x0b\f\r"

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Cut the lineage with a parquet table in the shared checkpoint folder."""
    return materialize(df, f"llm-{name}", options)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_modulo(id_col: str, n: int, rest: int) -> Column:
    """Whether crc32(id as text) mod n is ``rest``; a NULL id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n == rest, F.lit(False))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (as --py-files does)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="quotelens-py-"), "quotelens_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "quotelens")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str,
                rows: int | None = None, as_lists: bool = True) -> DataFrame:
    """Arrow batches through ``fn`` (column lists in, column lists out), one task per partition.

    ``rows`` passes on at most so many rows at a time; without ``as_lists`` the
    columns come as Arrow arrays.
    """
    ship(df.sparkSession)
    names, arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows or max(1, whole.num_rows)):
                b = whole.slice(at, rows or whole.num_rows)
                out = fn({n: b.column(i).to_pylist() if as_lists else b.column(i) for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], type=t) for n, t in zip(names, arrow)], names=names)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str) -> tuple[list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    fields = T.StructType.fromDDL(schema).fields
    return [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
