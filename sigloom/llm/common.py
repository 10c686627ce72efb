"""Helpers that every operator of this subpackage uses: tables, Arrow passes and cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that cross to Python at once; texts may be very long, so batches are kept short.
ROWS_PER_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read ``columns`` of a Parquet table of the data folder, and only those."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, set here only where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sigloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: With this Spark removes a query's shuffle files as it ends, and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """What is written in here leaves no shuffle files: from then on the written table is read."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Cut:
    """Written tables that cut lineage; ``drop`` removes one that no plan needs any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths, self.names = spark, shared_dir(spark), {}, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/sigloom-{uuid.uuid4().hex}"
        with swept(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def write_by(self, df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
        """As ``write``, in buckets of ``key``: joins and groups by it needn't shuffle the table again."""
        name = f"sigloom_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with swept(self.spark):
            df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name)
        out = self.spark.table(name)
        self.paths[id(out)] = (path, out)
        self.names[id(out)] = name
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, _ = self.paths.pop(id(df), (None, None))
            if name := self.names.pop(id(df), None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if path:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


#: Cached functions whose results outlive a task in its Python worker.
HELD: list = []


def held(cached):
    """``cached``, from ``lru_cache``, known to ``fresh``."""
    HELD.append(cached)
    return cached


def fresh(keep=None) -> None:
    """Begin a piece of work in a Python worker: what other operators hold there goes, but for ``keep``, and freed memory
    goes back to the system.  Workers serve stage after stage, and C's allocator keeps what large arrays have left."""
    for cached in HELD:
        if cached is not keep:
            cached.cache_clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def arrow_pass(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Run ``work`` over column lists, batch by batch and in short batches, on the executors."""
    import pyspark.sql.types as T

    names = [f.name for f in T._parse_datatype_string(schema).fields]
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_BATCH):
                part = whole.slice(at, ROWS_PER_BATCH)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
