"""Query entry points: pages of each kind of row, what rows are decorated with, the count bundle and the chain summary."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, keys
from ledgerloom.plans import chain, predicates


class Root(NamedTuple):
    """What a page can be asked for, its orders with what breaks their ties (the first is the default), and what must be asked."""

    fields: predicates.Fields
    orders: Mapping[str, tuple[str, ...]]
    needed: tuple[str, ...] = ()


ROOTS: dict[str, Root] = {
    "blocks": Root(predicates.BLOCKS, {"height": ("height", "state_hash"), "global_slot": ("global_slot", "state_hash")}),
    "commands": Root(predicates.COMMANDS, {"height": ("height", "txn_hash", "state_hash"), "global_slot": ("global_slot", "txn_hash", "state_hash"), "date_time": ("date_time_ms", "txn_hash", "state_hash")}),
    "internal_commands": Root(predicates.INTERNAL, {"height": ("height", "state_hash", "kind", "receiver")}),
    "snarks": Root(predicates.SNARKS, {"height": ("height", "state_hash", "prover", "idx")}),
    "accounts": Root(predicates.ACCOUNTS, {"balance": ("balance", "pk", "token")}),
    "stakes": Root(predicates.STAKES, {"stake": ("total_delegated", "pk"), "balance": ("balance", "pk")}),
    "top_stakers": Root(predicates.TOP, {"canonical_blocks": ("canonical_blocks", "pk"), "slots": ("slots", "pk")}, ("epoch",)),
    "top_snarkers": Root(predicates.TOP, {"total": ("total", "prover"), "most": ("most", "prover")}),
    "tokens": Root(predicates.TOKENS, {"supply": ("supply", "token"), "holders": ("holders", "token"), "txns": ("txns", "token")}),
    "holders": Root(predicates.HOLDERS, {"balance": ("balance", "pk", "token")}),
    "staged_accounts": Root(predicates.ACCOUNTS, {"balance": ("balance", "nonce", "pk")}),
    "actions": Root(predicates.ACTIONS, {"height": ("height", "idx")}, ("pk",)),
}


def page(rows: DataFrame, root: str, query: Mapping[str, Any] | None = None, sort: str | None = None, ascending: bool = False, limit: int = 100, strict: bool = False) -> DataFrame:
    """A filter, an order and a limit; a descending order turns its ties around too. Spark keeps the first rows of each task alone.

    Unknown fields and orders, and a missing field that the root needs, are errors; with ``strict``, so is a key or hash in
    no known form, before anything is read. A limit of 0 of stakes of a ledger asks for its epoch alone.
    """
    known = ROOTS[root]
    if strict and (bad := keys.wrong(query)):
        raise ValueError("; ".join(bad))
    if root == "stakes" and limit == 0 and (query or {}).get("ledger_hash") is not None:
        return ledger_epoch(rows, query["ledger_hash"])
    missing = [n for n in known.needed if (query or {}).get(n) is None]
    if missing:
        raise ValueError(f"{root} must be asked for {', '.join(missing)}")
    sort = sort or next(iter(known.orders))
    if sort not in known.orders:
        raise ValueError(f"no order {sort}; there are {', '.join(known.orders)}")
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in known.orders[sort]]
    return predicates.listing(rows, query, order, limit, known.fields)


def ledger_epoch(rows: DataFrame, ledger_hash: Any) -> DataFrame:
    """One row at most, with the columns of rows (ledger_hash, epoch, ...): a ledger's hash and epoch, all else null."""
    own = rows.filter(F.col("ledger_hash") == F.lit(ledger_hash)).select("epoch", "ledger_hash").limit(1)
    return own.select(*[F.col(f.name) if f.name in ("epoch", "ledger_hash") else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def recent_blocks(blocks: DataFrame, limit: int | None = None, height: int | None = None) -> DataFrame:
    """The last blocks of the best chain from the tip down, or those at a height, the canonical one first; 10 unless asked for, 100 at most."""
    n = predicates.page_limit(limit)
    if height is not None:
        return blocks.filter(F.col("height") == height).orderBy(*predicates.canonical_first()).limit(n)
    near = chain.best_chain(blocks, max(1, n))
    return blocks.join(near.select("state_hash"), "state_hash", "left_semi").orderBy(F.col("height").desc()).limit(n)


def block(blocks: DataFrame, query: Mapping[str, Any] | None = None) -> DataFrame:
    """One row at most: the first block that the query holds for, canonical ones first at a height; without a query the best tip."""
    if not query:
        return chain.best_block(blocks)
    return blocks.filter(predicates.predicate(query, predicates.BLOCKS)).orderBy(*predicates.canonical_first()).limit(1)


def command(commands: DataFrame, blocks: DataFrame, txn_hash: Any) -> DataFrame:
    """One row at most: a command as the best of the blocks that hold it has it; blocks have what the fork choice looks at."""
    own = commands.filter(F.col("txn_hash") == F.lit(txn_hash))
    rank = blocks.select("state_hash", chain.preference(blocks).alias("_rank"))
    best = own.join(rank, "state_hash").agg(F.max_by(F.struct(*[F.col(c) for c in own.columns]), "_rank").alias("best"))
    return best.filter("best is not null").select("best.*")


def with_canonicity(rows: DataFrame, blocks: DataFrame, *also: str) -> DataFrame:
    """rows with ``canonical``, as their block (state_hash) has it, and other columns of the block; false (null) where the block is unknown."""
    known = blocks.select("state_hash", F.col("canonical").alias("_canonical"), *also)
    return rows.join(known, "state_hash", "left").withColumn("canonical", F.coalesce("_canonical", F.lit(False))).drop("_canonical")


def with_names(rows: DataFrame, names: DataFrame, **columns: str) -> DataFrame:
    """rows with the name (pk, username) of each column's key: ``with_names(df, names, sender="sender_name")``; null where it has none."""
    for key, name in columns.items():
        rows = rows.join(names.select(F.col("pk").alias(key), F.col("username").alias(name)), key, "left")
    return rows


def with_symbols(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows with the symbol of their token; null where the token is unknown."""
    return rows.join(tokens.select("token", "symbol"), "token", "left")


def tokens_used(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pk, token, owner, symbol): each token that a key has used, once, with its owner and symbol."""
    return rows.select("pk", "token").distinct().join(tokens.select("token", "owner", "symbol"), "token", "left").select("pk", "token", "owner", "symbol")


def public_keys(*rows: tuple[DataFrame, str]) -> DataFrame:
    """(state_hash, pk): the keys that a block names anywhere, each once; nulls are none. Rows are (table, column) pairs."""
    every = [df.select("state_hash", F.col(c).alias("pk")).filter("pk is not null").distinct() for df, c in rows]
    return reduce(DataFrame.unionAll, every).distinct()


def _counted(rows: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    return rows.groupBy("epoch").agg(*[c.alias(n) for n, c in measures.items()])


def _by_epoch(blocks: DataFrame, snarks: DataFrame, commands: DataFrame, internal: DataFrame) -> tuple[DataFrame, list[str]]:
    """A row of counts for each epoch: the rows of each table fold to one of each task and epoch before they move."""
    canonical, applied, zkapp, every = F.col("canonical"), F.col("applied"), F.col("is_zkapp"), F.lit(True)
    user = {"": every, "applied_": applied, "failed_": ~applied, "canonical_": canonical, "applied_canonical_": applied & canonical, "failed_canonical_": ~applied & canonical}
    parts = [
        _counted(blocks, {"blocks": F.count(every), "canonical_blocks": F.count_if(canonical), "supercharged_blocks": F.count_if("supercharged"), "slots": F.countDistinct("epoch_slot")}),
        _counted(snarks, {"snarks": F.count(every), "canonical_snarks": F.count_if(canonical)}),
        _counted(commands, {f"{n}user_commands": F.count_if(c) for n, c in user.items()} | {f"{n}zkapp_commands": F.count_if(c & zkapp) for n, c in user.items()}),
        _counted(internal, {"internal_commands": F.count(every), "canonical_internal_commands": F.count_if(canonical)}),
    ]
    names = [c for p in parts for c in p.columns if c != "epoch"]
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return wide.groupBy("epoch").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]), names


#: The counts of the bundle, of an epoch and in all; slots are of an epoch alone.
BUNDLE = ("blocks", "canonical_blocks", "supercharged_blocks", "snarks", "user_commands", "zkapp_commands", "internal_commands")


def count_bundle(blocks: DataFrame, snarks: DataFrame, commands: DataFrame, internal: DataFrame) -> DataFrame:
    """(epoch, epoch_*, total_*, epoch_slots): the fifteen counts of every epoch that has a row in one of the tables.

    blocks have epoch, epoch_slot, canonical and supercharged; snarks and internal commands epoch and canonical; user
    commands also applied and is_zkapp.
    """
    own, _ = _by_epoch(blocks, snarks, commands, internal)
    totals = own.agg(*[F.sum(n).alias(f"total_{n}") for n in BUNDLE])  # one row
    return own.crossJoin(F.broadcast(totals)).select("epoch", *[F.col(n).alias(f"epoch_{n}") for n in (*BUNDLE, "slots")], *[f"total_{n}" for n in BUNDLE])


def summary(blocks: DataFrame, snarks: DataFrame, commands: DataFrame, internal: DataFrame, accounts: DataFrame, native: Any, last: int = 500) -> DataFrame:
    """One row: the best tip, the supply, and the counts of its epoch and in all.

    Besides what count_bundle() takes, blocks have what the fork choice looks at, and global_slot, date_time_ms, creator
    and total_currency; accounts pk, token, is_zkapp and locked. Unique producers are those of all blocks of the last
    heights, at most 1000 of them. Each table is read once, but for blocks.
    """
    tip = chain.best_block(blocks).select(
        "state_hash", F.col("parent_hash").alias("previous_state_hash"), F.col("height").alias("blockchain_length"), amounts.iso_date(F.col("date_time_ms")).alias("date_time"),
        "epoch", "global_slot", amounts.epoch_slot(F.col("global_slot")).alias("slot"), "total_currency",
    )
    tip = chain._cut(tip)
    by_epoch, names = _by_epoch(blocks, snarks, commands, internal)
    ours = F.col("epoch") == F.col("_epoch")
    shown = [n for n in ("blocks", "canonical_blocks", "snarks", "user_commands", "zkapp_commands", "internal_commands")]
    counts = by_epoch.crossJoin(F.broadcast(tip.select(F.col("epoch").alias("_epoch"))))
    counts = counts.agg(*[F.sum(F.when(ours, F.col(n)).otherwise(0)).alias(f"epoch_{n}") for n in shown], *[F.sum(n).alias(f"total_{n}") for n in names if n != "slots"])
    at_home, zkapp = F.col("token") == F.lit(native), F.col("is_zkapp")
    held = accounts.agg(
        F.count(F.lit(1)).alias("total_accounts"), F.count_if(at_home).alias("total_native_accounts"), F.count_if(zkapp).alias("total_zkapp_accounts"),
        F.count_if(zkapp & at_home).alias("total_native_zkapp_accounts"), F.coalesce(F.sum(F.when(at_home, F.col("locked"))), F.lit(0)).alias("locked_supply"),
    )
    since = F.broadcast(tip.select((F.col("blockchain_length") - min(last, 1000)).alias("_since")))
    made = blocks.crossJoin(since).filter(F.col("height") > F.col("_since")).agg(F.countDistinct("creator").alias("unique_block_producers"))
    out = tip.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(held)).crossJoin(F.broadcast(made))  # a row each
    return out.withColumn("circulating_supply", F.col("total_currency") - F.col("locked_supply"))
