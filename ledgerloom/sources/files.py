"""Smaller file sources: staking and genesis ledgers, locked supply, names; and what file names say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = r"^([^-]+)-([0-9]+)-([0-9A-Za-z]+)\.json(?:\.gz)?$"

#: A made-up flat form of blocks, one JSON object a file; precomputed.py reads the full files.
BLOCK = T.StructType([T.StructField("parent_hash", T.StringType()), T.StructField("creator", T.StringType()), T.StructField("global_slot", T.LongType()), T.StructField("vrf", T.StringType()), T.StructField("timestamp_ms", T.LongType())])
TIMING = "struct<initial_minimum_balance:string,cliff_time:string,cliff_amount:string,vesting_period:string,vesting_increment:string>"
ACCOUNT = f"pk string, balance string, delegate string, username string, token string, nonce string, voting_for string, receipt_chain_hash string, permissions map<string,string>, timing {TIMING}"


def named(df: DataFrame, number: str, digest: str) -> DataFrame:
    """Rows with what their file's name says: network, a number and a digest; files with another name are left out."""
    name = F.col("_metadata.file_name")
    out = df.select("*", F.regexp_extract(name, _NAME, 1).alias("network"), F.regexp_extract(name, _NAME, 2).alias(number), F.regexp_extract(name, _NAME, 3).alias(digest))
    return out.filter(F.col(number) != "").withColumn(number, F.col(number).cast("long"))


def blocks(spark: SparkSession, path: str, schema: T.StructType = BLOCK, above: int | None = None) -> DataFrame:
    """One row a flat block file, above a height; only the columns of the schema are parsed. Of equal hashes the smallest path counts."""
    files = named(spark.read.schema(schema).option("multiLine", True).json(path).select("*", "_metadata"), "height", "state_hash").withColumn("_file", F.col("_metadata.file_path"))
    first = files.groupBy("state_hash").agg(F.min("_file").alias("_file"))
    out = files.join(first, ["state_hash", "_file"]).drop("_file", "_metadata")
    return out if above is None else out.filter(F.col("height") > above)


def _nano(c: str) -> Column:
    return (F.col(c).cast("decimal(29,9)") * F.lit(10**9).cast("decimal(10,0)")).cast("long")


def _accounts(df: DataFrame) -> DataFrame:
    timing = F.struct(*[_nano(f"timing.{f}").alias(f) if f not in ("cliff_time", "vesting_period") else F.col(f"timing.{f}").cast("long").alias(f) for f in ("initial_minimum_balance", "cliff_time", "cliff_amount", "vesting_period", "vesting_increment")])
    return df.withColumns({"balance": _nano("balance"), "delegate": F.coalesce("delegate", "pk"), "nonce": F.coalesce(F.col("nonce").cast("long"), F.lit(0)), "timing": F.when(F.col("timing").isNotNull(), timing)})


def staking_accounts(spark: SparkSession, path: str, native: str | None = None) -> DataFrame:
    """One row an account of each staking ledger (a JSON array); with ``native``, rows of that token, or of none, only.

    Amounts are nanounits; an account without a delegate is its own.
    """
    out = _accounts(named(spark.read.schema(ACCOUNT).option("multiLine", True).json(path).select("*", "_metadata"), "epoch", "ledger_hash").drop("_metadata"))
    return out if native is None else out.filter(F.coalesce(F.col("token"), F.lit(native)) == native)


def genesis_accounts(spark: SparkSession, path: str) -> DataFrame:
    """One row an account of a genesis ledger (a JSON object with ``ledger.accounts``), in nanounits, with its place in the file."""
    fields = ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in ACCOUNT.split(", ")))
    schema = f"ledger struct<name:string,seed:string,accounts:array<struct<{fields}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("ledger.name").alias("ledger"), F.posexplode("ledger.accounts").alias("nth", "a"))
    return _accounts(rows.select("ledger", "nth", "a.*"))


def locked_supply(spark: SparkSession, path: str) -> DataFrame:
    """(slot, locked): the locked supply in nanounits from a slot on, from a CSV of whole units."""
    return spark.read.option("header", True).schema("slot long, locked long").csv(path).select("slot", (F.col("locked") * 10**9).alias("locked"))


def off_chain_names(spark: SparkSession, path: str) -> DataFrame:
    """(pk, username) from a CSV without a header; the last line of a key counts by its text."""
    rows = spark.read.schema("pk string, username string").csv(path)
    return rows.groupBy("pk").agg(F.max("username").alias("username"))
