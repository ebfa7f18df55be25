"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.sources.shared import new_path, shared_dir, stored  # noqa: F401

#: Bytes: A-Z to a-z, the rest as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes: A-Z to a-z and what is no word character ([0-9a-z] or beyond ASCII) to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def discard(df: DataFrame) -> None:
    """Deletes a stored table once its last reader is done."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sent_if_small(df: DataFrame, most: int) -> DataFrame:
    """A stored table, sent to every task if it has at most that many rows; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row even where body names it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def per_row(df: DataFrame, keep: Sequence[str], fields: Sequence[T.StructField], of: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """keep's columns and one column for each of fields, by of on Arrow batches; null ids stay null and no id turns into a float."""
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    kinds = [(f.name, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}[f.dataType.typeName().replace("integer", "int")]) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = of(b)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v, kind) for v, (_, kind) in zip(made, kinds, strict=True))], names=[*keep, *(n for n, _ in kinds)])

    return df.mapInArrow(run, schema)


def as_row(df: DataFrame) -> Column:
    """All columns of df as one struct, row: it travels under a name of its own, whatever the columns are called."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, as Spark compares names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, {"long": T.LongType, "string": T.StringType, "boolean": T.BooleanType, "double": T.DoubleType, "binary": T.BinaryType, "int": T.IntegerType}[kind]())
