"""Tables in the shared folder that cut lineage: what a lost executor held is not needed again."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_made: set[str] = set()
_open: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="signalens-")
        atexit.register(shutil.rmtree, folder, True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/signalens-{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Few rows as a relation of known size. A list given to Spark goes through Python workers of its own, whenever it is read."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds), schema)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: later reads survive lost executors and don't recompute it."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    if _open:
        _open[-1].append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table made by written(), once nothing reads it any more."""
    for folder in _folders(df):
        p, fs = file_system(df.sparkSession, folder)
        fs.delete(p, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


@contextlib.contextmanager
def scratch():
    """Deletes at its end the tables that were written within it, but for those that a frame given to the function it yields reads;
    these are left to the scratch around it, if there is one."""
    mine: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()
    _open.append(mine)
    try:
        yield lambda *frames: kept.update(*[{x.rpartition("/")[2] for x in _folders(df)} for df in frames])
    finally:
        _open.remove(mine)
        for spark, path in mine:
            if path.rpartition("/")[2] in kept:
                if _open:
                    _open[-1].append((spark, path))
                continue
            p, fs = file_system(spark, path)
            fs.delete(p, True)


def tidy(f):
    """f, which returns a frame or a tuple of frames, without what it wrote and these don't read."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        with scratch() as keep:
            out = f(*args, **kwargs)
            keep(*(out if isinstance(out, tuple) else (out,)))
        return out

    return run


def numbered(df: DataFrame, *order, name: str = "position", first: int = 1) -> DataFrame:
    """df with the place of each row in an order: rows are sorted in ranges and written, ranges are counted, and the counts
    of those before are added. No task sees all rows; the one window is over a row a range."""
    here = df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    t = written(here, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = t.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return t.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_at") + F.lit(first)).drop("_part", "_at", "_before")
