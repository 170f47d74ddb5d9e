"""What the training-data operators share: reading tables, shared folders and cutting lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch at most, so that a batch of long texts stays small in the JVM and in its Python worker.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables; its rows go to Python in small batches from here on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where the session names none, a temporary one, and only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint; for small or iterated tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Removes what this application wrote to the shared folder, once no result that reads it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has Spark's cleaner drop what no plan refers to any more: broadcasts that executors hold in memory, and shuffles on disk.

    The cleaner learns of them when the driver's garbage is collected, by default every half hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system, as workers are used again for other work."""
    pa.default_memory_pool().release_unused()
    if (give_back := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # the C library of Linux has it
        give_back(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again; for tables that hold texts."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of them, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def same(a: Column | str, b: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).eqNullSafe(F.col(b) if isinstance(b, str) else b)


#: A key is hot if it holds more than one of so many parts of all rows, so fewer keys than that can be hot.
HOT_PARTS = 1000
#: No key is hot below this number of rows.
HOT_ROWS = 256


def by_key(rows: DataFrame, side: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to side on a key that both name, however many rows a key has; ``how`` is inner or left.

    side has one row a key, with the number ``size`` of rows that hold it, of ``total`` in all. Hot keys are fewer than
    HOT_PARTS, so that their rows of side are broadcast; all other keys hold a small part of the rows each. rows is
    read twice.
    """
    least = max(HOT_ROWS, total // HOT_PARTS)
    hot, cold = F.broadcast(side.filter(F.col(size) > least)), side.filter(F.col(size) <= least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))


#: Rows of a small table that is sent to every task.
FEW_ROWS = 10_000


def few(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has FEW_ROWS rows at most; df is read for that, so it is a written one."""
    return F.broadcast(df) if len(df.limit(FEW_ROWS + 1).select(F.lit(1)).collect()) <= FEW_ROWS else df


#: Bits of a map of marked hashes: 8 MB whatever is marked. Where it is full more rows pass than need be, none is lost.
MARK_BITS = 1 << 26
_PAGE = 32_768


def marks(hashes: DataFrame) -> DataFrame:
    """(page, marks): a bitmap of the 64-bit hashes in the only column, for a broadcast."""
    at = F.pmod(F.col(hashes.columns[0]), F.lit(MARK_BITS))
    own = hashes.select(at.alias("bit")).groupBy(F.floor(F.col("bit") / _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % _PAGE).alias("marks"))
    return cut(own)  # MARK_BITS / _PAGE rows at most


def marked(df: DataFrame, hashed: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """df with a boolean column: whether the bitmap has the mark of a row's hash, as it has of all marked ones and of a few others."""
    page, bits = free(df, "page", "marks")
    at = F.pmod(hashed, F.lit(MARK_BITS))
    out = df.join(F.broadcast(bitmap.toDF(page, bits)), F.floor(at / _PAGE) == F.col(page), "left")
    byte = F.conv(F.hex(F.substring(bits, F.floor(at % _PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return out.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(page, bits)
