"""Streaming ingestion of blocks: at least once from a folder, each block kept once, in any order of arrival.

Keys that were seen are Spark's own state (``dropDuplicates``), so a batch costs what it brings, not what was kept before.
A batch is written under its number, so a batch that is run again after a failure replaces what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans import chain
from ledgerloom.sources import files, precomputed

#: Reads of a file that is no JSON, after which it waits in quarantine to be looked at.
ATTEMPTS = 5
#: Files in quarantine that one batch reads again, those that were read least first.
RETRIES = 1000


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): whole block files as they arrive, the text of each one row; precomputed.py parses them."""
    return spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select("value", F.col("_metadata.file_name").alias("file"))


def ingest_files(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Takes all new block files of a folder, and once more those in quarantine; each block is kept once, in raw() form.

    A file that is no JSON goes to quarantine with the number of its reads; it costs no other file. Every call reads files
    of the quarantine again, up to ATTEMPTS times each, and takes those that are whole by then. What a batch keeps and
    what it leaves in quarantine are parts under its number, so a batch that runs again leaves the same.
    """

    def read(paths: list[str]) -> DataFrame:
        text = spark.read.text(paths, wholetext=True) if paths else spark.createDataFrame([], "value string")
        return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name")) if paths else text.select("value", F.lit("").alias("file"), F.lit("").alias("name"))

    def take(batch: DataFrame, number: str, before: DataFrame | None) -> None:
        again = [] if before is None else [r.file for r in before.filter(F.col("attempts") < ATTEMPTS).orderBy("attempts", "file").limit(RETRIES).collect()]
        had = spark.createDataFrame([], "file string, attempts int") if before is None else before
        both = batch.select("value", "file", "name").unionByName(read(again)).dropDuplicates(["file"])
        rows = files.named(both.withColumn("_metadata", F.struct(F.col("name").alias("file_name"))), "height", "state_hash").drop("_metadata", "name")
        fresh = precomputed.parsed(rows.select("network", "height", "state_hash", "value")).dropDuplicates(["state_hash"])
        if (known := kept_files(spark, out, number)) is not None:
            low, high = rows.agg(F.min("height"), F.max("height")).first()
            near = known.filter(F.col("height").between(low, high))  # copies have one height, so older parts are passed over
            fresh = fresh.join(near.select("state_hash"), "state_hash", "left_anti").select(fresh.columns)
        fresh.write.mode("overwrite").parquet(f"{out}/blocks/batch={number}")
        bad = rows.filter(F.try_parse_json("value").isNull()).select("file", "height", "state_hash")
        bad = bad.join(had.select("file", "attempts"), "file", "left").withColumn("attempts", (F.coalesce("attempts", F.lit(0)) + 1).cast("int"))
        rest = had.join(rows.select("file"), "file", "left_anti").select(bad.columns) if before is not None else bad.limit(0)
        bad.unionByName(rest).write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")

    def step(batch: DataFrame, number: int) -> None:
        take(batch.withColumn("name", F.element_at(F.split("file", "/"), -1)), _part(number), quarantined(spark, out, _part(number)))

    rows = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    before = _parts(spark, f"{out}/quarantine")
    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    after = _parts(spark, f"{out}/quarantine")
    if before and after == before and not quarantined(spark, out).filter(F.col("attempts") < ATTEMPTS).isEmpty():
        # No new files came: those in quarantine are read again as a part of their own, after the last batch's.
        last, _, again = after[-1].partition("-")
        take(read([]), f"{last}-{int(again or 0) + 1:06}", quarantined(spark, out))


def _part(number: int) -> str:
    return f"{number:012}"


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the finished parts of a folder, in order."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(at)] if system.exists(at) else []
    return sorted(p.getName().partition("=")[2] for p in found if p.getName().startswith("batch=") and system.exists(fs.Path(p, "_SUCCESS")))


def kept_files(spark: SparkSession, out: str, below: str | None = None) -> DataFrame | None:
    """The blocks that ingest_files() kept, in raw() form, or those of the parts below one; None before the first."""
    parts = [n for n in _parts(spark, f"{out}/blocks") if below is None or n < below]
    return spark.read.parquet(*[f"{out}/blocks/batch={n}" for n in parts]).select("network", "height", "state_hash", "version", "v") if parts else None


def quarantined(spark: SparkSession, out: str, below: str | None = None) -> DataFrame | None:
    """(file, height, state_hash, attempts): files that are no JSON so far, after the last part or the last below one."""
    parts = [n for n in _parts(spark, f"{out}/quarantine") if below is None or n < below]
    return spark.read.parquet(f"{out}/quarantine/batch={parts[-1]}") if parts else None


def ingest(rows: DataFrame, key: str, out: str, checkpoint: str, after=None) -> StreamingQuery:
    """Appends rows whose key is new to a Parquet folder, one part a batch; arrivals may repeat and come in any order.

    ``after(spark, batch_id)`` runs when a batch is kept, before the next begins; it may run twice for one batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if after:
            after(batch.sparkSession, number)

    return rows.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, out: str) -> DataFrame:
    """All rows that an ingestion kept."""
    return spark.read.parquet(out).drop("batch")


def missing_parents(blocks: DataFrame) -> DataFrame:
    """Heights at which a parent is missing: what to fetch next."""
    gaps = blocks.select(F.col("parent_hash").alias("hash"), (F.col("height") - 1).alias("height")).join(blocks.select(F.col("state_hash").alias("hash")), "hash", "left_anti")
    return gaps.filter("height >= 1").distinct()


def attached(blocks: DataFrame, root: DataFrame) -> DataFrame:
    """Blocks with ``attached``: whether their ancestors reach the root (a row with state_hash), or they dangle.

    A block that came before its parent dangles until the parent is there: each batch asks anew.
    """
    ready = chain.contracted(blocks)
    ends = chain._tops(ready)
    top = ends.join(root.select("state_hash"), "state_hash", "left_semi").select("top", F.lit(True).alias("attached"))
    return blocks.join(ends.join(top, "top", "left").select("state_hash", F.coalesce("attached", F.lit(False)).alias("attached")), "state_hash")


def tip_update(blocks: DataFrame, root: DataFrame, old: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The new best tip, and the blocks to unapply and to apply on the way from the old one (none: nothing is unapplied).

    Only attached blocks can be the tip, and only a strictly better one replaces it.
    """
    own = attached(blocks, root).filter("attached").drop("attached")
    best = chain._cut(chain.best_block(own))
    if old is None:
        passed = chain.ancestors(own, best).select("state_hash", F.lit("apply").alias("change"))
        return best, passed.join(own.select("state_hash", "height"), "state_hash").select("state_hash", "height", "change")
    return best, chain.reorganisation(own, old, best)
