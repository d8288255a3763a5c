"""What the operators of this package share on the Spark side."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Arrow batches are bounded by rows and bytes, so that a run of long texts can't fill a worker.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session already does."""
    for key, value, default in (("maxRecordsPerBatch", BATCH_ROWS, "10000"), ("maxBytesPerBatch", BATCH_BYTES, None)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now in (None, default) or key == "maxBytesPerBatch" and int(now.rstrip("bB") if now.rstrip("bB").isdigit() else 0) > 4 * BATCH_BYTES:
            spark.conf.set(name, str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a table or files in the shared folder."""
    return f"{shared_dir(spark)}/textloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, codec: str | None = None, path: str | None = None) -> DataFrame:
    """The frame, written to the shared folder and read again: it is computed once and its lineage ends there."""
    spark = df.sparkSession
    path = path or scratch(spark, what)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Each query in here deletes its shuffle files at its end, on all executors; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Keys with more than the HOT-th part of a join's rows are hot: there are fewer than HOT of them.
HOT = 4096


def hot_keys(counts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Of a table with each key's rows ``k``: the hot keys, and over how many ``parts`` each is to be dealt."""
    share = max(1.0, total / HOT)
    return counts.filter(F.col("k") > share).select(*keys, F.ceil(F.col("k") / share).cast("int").alias("parts"))


def part_of(unique: str):
    """The part of a row of the side with many rows a key; ``parts`` is null for keys that aren't hot."""
    return F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(unique), F.col("parts")).cast("int"))


def all_parts():
    """All parts of a row of the side with few rows a key."""
    return F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))


def join_one(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, unique: str, how: str = "inner") -> DataFrame:
    """Joins rows with a table of one row a key; hot keys are dealt over tasks by the column ``unique``. At every size it is a sort-merge join."""
    known = F.broadcast(hot)  # fewer than HOT rows
    left = many.join(known, keys, "left").withColumn("__part", part_of(unique)).drop("parts")
    right = one.join(known, keys, "left").withColumn("__part", all_parts()).drop("parts")
    return left.join(right.hint("merge"), [*keys, "__part"], how).drop("__part")


def schema_of(spec: str | StructType) -> StructType:
    return spec if isinstance(spec, StructType) else _parse_datatype_string(spec)


def give_back() -> None:
    """Returns what this worker has freed to the system: the worker lives on and its next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    def run(batches):
        yield from function(batches)
        give_back()

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema_of(schema))


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All columns under names of our own (c0, c1, ...), and the own name of each column."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())), own


def under_old_names(df: DataFrame, own: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for c, n in own.items()))


def rows_schema(docs: DataFrame, rest: list[str], added: str) -> StructType:
    """The columns ``rest`` of a frame, and those added."""
    return StructType([*docs.select(*rest).schema.fields, *schema_of(added).fields])


def rows_batch(arrow: pa.Schema, rows: pa.RecordBatch, rest: list[str], *columns) -> pa.RecordBatch:
    """The columns ``rest`` of a batch with further columns."""
    arrays = [*(rows.column(rows.schema.get_field_index(c)) for c in rest), *(x if isinstance(x, pa.Array) else pa.array(x, from_pandas=True) for x in columns)]
    return pa.RecordBatch.from_arrays([x if x.type == f.type else x.cast(f.type) for x, f in zip(arrays, arrow, strict=True)], schema=arrow)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(spec: str | StructType) -> pa.Schema:
    """The Arrow schema; short DDL is read here, since tasks have no Spark session to parse it."""
    if isinstance(spec, StructType):
        return to_arrow_schema(spec)
    kind = lambda t: pa.list_(kind(t[6:-1])) if t.startswith("array<") else _ARROW[t]
    return pa.schema([(name, kind(t)) for name, t in (x.split() for x in spec.split(", "))])


def batch(spec: str | StructType, *columns) -> pa.RecordBatch:
    """A record batch of the columns in the order and with the types of the schema."""
    schema = arrow_schema(spec)
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, from_pandas=True) for x in columns]
    return pa.RecordBatch.from_arrays([x if x.type == f.type else x.cast(f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns that are used, under names of our own; other columns don't matter, whatever their names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`") for c in more))
