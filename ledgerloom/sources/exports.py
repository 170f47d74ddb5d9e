"""CSV exports of commands, and blocks as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import iso_date


def commands_of(commands: DataFrame, pk: str) -> DataFrame:
    """Rows that an account sent and those that it received; a transfer to itself appears twice."""
    sent = commands.filter(F.col("sender") == pk).withColumn("side", F.lit("from"))
    return sent.unionAll(commands.filter(F.col("receiver") == pk).withColumn("side", F.lit("to")))


def csv(rows: DataFrame, path: str, order: list[Column]) -> None:
    """Rows as CSV with a header, in an order that runs on from one part file to the next."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def _named(rows: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def user_commands(commands: DataFrame, pk: str, path: str) -> None:
    """The commands of an account in the columns and the order of the format: the greatest height first, then the greatest nonce."""
    rows = commands_of(commands, pk).orderBy(F.col("height").desc(), F.col("nonce").desc(), "side")
    columns = {"Date": iso_date(F.col("date_time_ms")), "BlockHeight": "height", "BlockStateHash": "state_hash", "From": "sender", "To": "receiver", "Nonce": "nonce", "Hash": "txn_hash", "Fee": "fee", "Amount": "amount", "Memo": "memo", "Kind": "kind"}
    _named(rows, columns).write.mode("overwrite").option("header", True).csv(path)


def internal_commands(commands: DataFrame, pk: str, path: str) -> None:
    """What an account received inside blocks, in the columns and the order of the format: by height, kind and index, all descending."""
    rows = commands.filter(F.col("receiver") == pk).orderBy(F.col("height").desc(), F.col("kind").desc(), F.col("idx").desc())
    columns = {"Date": iso_date(F.col("date_time_ms")), "BlockHeight": "height", "BlockStateHash": "state_hash", "Recipient": "receiver", "Amount": "amount", "Kind": "kind"}
    _named(rows, columns).write.mode("overwrite").option("header", True).csv(path)


def dump(blocks: DataFrame, path: str, by: str = "height") -> None:
    """Blocks as lines of JSON, by height or global_slot and then by hash, in an order that runs on from file to file."""
    if by not in ("height", "global_slot"):
        raise ValueError("blocks are dumped by height or global_slot")
    blocks.orderBy(by, "state_hash").write.mode("overwrite").json(path)
