"""Contract accounts: state from account updates, numbered actions and events, and histories of tokens."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import NATIVE_TOKEN
from ledgerloom.plans import ledger

#: Fields that an update may set; null keeps what was there.
FIELDS = ("delegate", "verification_key", "permissions", "uri", "symbol", "timing", "voting_for")
#: Elements of a contract's state, which start as zeros (fixed values of the format).
STATE = 8
ZERO = "0x" + "0" * 64


def contract_state(updates: DataFrame, place: list[str], fields: tuple[str, ...] = FIELDS, state: int = STATE, zero: str = ZERO) -> DataFrame:
    """(pk, token, updates, *fields, app_state, proved) after all updates, taken in the order of ``place``.

    proved is true once an update was (without such a column it is false). updates have pk, token, the columns of place, which no two updates of an account share, the fields, and app_state, an
    array in which null keeps an element. A field that was never set is null, an element that was never set is ``zero``.
    The last values set are partial maxima, so a hot account is a row of each task, and no order of its updates is needed.
    """
    at = F.struct(*place)
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
    elements = [F.coalesce(last(F.get("app_state", F.lit(i))), F.lit(zero)).alias(f"_{i}") for i in range(state)]
    proved = F.coalesce(F.bool_or("proved"), F.lit(False)) if "proved" in updates.columns else F.bool_or(F.lit(False))
    out = updates.groupBy("pk", "token").agg(F.count(F.lit(1)).alias("updates"), proved.alias("proved"), *[last(F.col(c)).alias(c) for c in fields], *elements)
    return out.select("pk", "token", "updates", *fields, F.array(*[f"_{i}" for i in range(state)]).alias("app_state"), "proved")


def update_nonces(payers: DataFrame, increments: DataFrame, place: list[str], keys: tuple[str, ...] = ("pk", "token")) -> DataFrame:
    """(*keys, nonce): the last nonce that a command of the account set, raised by one for each later increment.

    payers have keys, place and nonce (what the command sets); increments keys and place. Without a command the count is all.
    """
    at = F.struct(*place)
    last = payers.groupBy(*keys).agg(F.max_by("nonce", at).alias("base"), F.max(at).alias("since"))
    more = increments.select(*keys, at.alias("at")).join(last.select(*keys, "since"), [*keys], "left")
    more = more.groupBy(*keys).agg(F.count_if(F.col("since").isNull() | (F.col("at") > F.col("since"))).alias("more"))
    out = last.join(more, [*keys], "full")
    return out.select(*keys, (F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("nonce"))


def update_diffs(updates: DataFrame, native: str = NATIVE_TOKEN) -> DataFrame:
    """The account changes of contract updates, as ``ledger.account_diffs`` has them: balance and delegate, after their command's own.

    What an update pays for the creation of its account (``creation_fee``, if there is such a column) is a change of its own
    before it, so that the floor of 0 holds for each.
    """
    token = F.when(F.col("token") == native, F.lit("native")).otherwise(F.col("token"))
    change = lambda kind, nth, delta, delegate: F.struct(F.lit(kind).alias("kind"), (2 * F.col("sub_seq") + nth).cast("int").alias("sub_seq"), delta.cast("long").alias("delta"), delegate.cast("string").alias("delegate"))
    fee = F.coalesce("creation_fee", F.lit(0)) if "creation_fee" in updates.columns else F.lit(0)
    own = change("Update", 2, F.col("delta"), F.col("delegate"))
    both = F.when(fee > 0, F.array(change("CreationFee", 1, -fee, F.lit(None)), own)).otherwise(F.array(own))
    rows = updates.select("state_hash", "height", F.col("pk").cast("string").alias("pk"), token.alias("token"), F.lit(0).alias("phase"), F.col("seq").cast("long").alias("seq"), F.explode(both).alias("d"))
    return rows.select("state_hash", "height", "pk", "token", "phase", "seq", "d.sub_seq", "d.kind", "d.delta", F.lit(None).cast("long").alias("nonce"), "d.delegate")


def accounts_with_updates(diffs: DataFrame, updates: DataFrame, height: int | None = None, native: str = NATIVE_TOKEN) -> DataFrame:
    """ledger.accounts() of all account changes and contract updates, in one order; an update may raise a nonce that was set before it.

    updates have state_hash, height, seq, sub_seq, pk, token, delta, delegate and increments, and may have creation_fee; null
    changes nothing.
    """
    place = ["height", "phase", "seq", "sub_seq"]
    own = updates if height is None else updates.filter(F.col("height") <= height)
    every = (diffs if height is None else diffs.filter(F.col("height") <= height)).unionByName(update_diffs(own, native))
    raised = update_diffs(own.filter("increments"), native).filter("kind = 'Update'").select("pk", "token", *place)
    nonces = update_nonces(every.filter("nonce is not null").select("pk", "token", *place, "nonce"), raised, place).withColumnRenamed("nonce", "_nonce")
    out = ledger.accounts(every).join(nonces, ["pk", "token"], "left")
    return out.withColumn("nonce", F.coalesce("_nonce", "nonce")).drop("_nonce")


def numbered(rows: DataFrame, keys: list[str], block: Column, order: list[str]) -> DataFrame:
    """rows with ``idx``, their number from 0 among the rows of their keys in order; ``block`` is a coarser form of its first column."""
    return ledger.running(rows, keys, block, order, {}, {}, {}).withColumn("idx", F.col("nth") - 1).drop("nth")


def in_context(rows: DataFrame, blocks: DataFrame, commands: DataFrame) -> DataFrame:
    """Actions or events with the block (state_hash) and the command (state_hash, seq) that hold them; those without either go."""
    return rows.join(blocks, "state_hash").join(commands, ["state_hash", "seq"])


def token_history(changes: DataFrame, block: Column, order: list[str]) -> DataFrame:
    """Token changes (token, delta, ...) with ``nth``, their number from 1, and the supply after each, however many a token has."""
    return ledger.running(changes, ["token"], block, order, {"supply": F.col("delta")}, {}, {})


def locked_total(accounts: DataFrame, locked: Column, native: Any = NATIVE_TOKEN) -> DataFrame:
    """One row: native accounts, and their total, locked and circulating amounts; accounts without a ``token`` are all native.

    What is locked is the sum of minimum balances, whatever the accounts hold; null where an account has no timing.
    """
    home = accounts.filter(F.col("token") == F.lit(native)) if "token" in accounts.columns else accounts
    own = home.agg(F.count(F.lit(1)).alias("accounts"), F.coalesce(F.sum("balance"), F.lit(0)).alias("total"), F.coalesce(F.sum(locked), F.lit(0)).alias("locked"))
    return own.withColumn("circulating", F.col("total") - F.col("locked"))
