"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reflexgrid.session import scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared checkpoint folder: what follows is computed from files that outlive any executor. The shuffle files of
    the job are of no further use and go with its end."""
    spark = df.sparkSession
    path = scratch(spark, name)
    given = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if given is None else spark.conf.set(CLEANUP, given)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables that `written` made, once nothing is computed from them any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text alone, so that columns of other names (or equal ones from elsewhere) never meet; a null text is empty."""
    return df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """`mapInArrow` in batches of about 4 MB. A batch is held several times (Spark's vectors and its message, the worker's copy and the
    strings made of it), and Spark's own bound is 64 MB. The bound is one of the session; one that is set already stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: T.StructType | str, each: Callable[[list, list], dict], step: int = 512) -> DataFrame:
    """Run `each(keys, texts) -> columns` over the batches of a (key, text) table, `step` rows at a time, so that a batch of very
    long texts takes little memory beyond its own."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = each(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.record_batch([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return in_arrow(df, run, kind)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    plain = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}
    return plain[type(kind)]


_HELD: dict = {}


def held(name: str, make: Callable | None = None):
    """What a worker keeps between tasks (a model with its caches), one thing at a time: workers are reused by later stages, which
    would otherwise run beside the caches of all stages before. Without `make` everything goes."""
    if name not in _HELD:
        _HELD.clear()
        if make is None:
            return None
        _HELD[name] = make()
    return _HELD[name]


class Recent(dict):
    """A cache of at most about 2 * size entries: when the young half is full, the old half goes. Read with `[]` only."""

    def __init__(self, make: Callable, size: int = 200_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
