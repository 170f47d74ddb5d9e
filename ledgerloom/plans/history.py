"""Accounts over time: their state after every change, look-ups as of a height, and how long each value held.

Everything here runs inside blocks of heights of a key and joins the blocks by a row each, so a key of any number of changes
is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import NATIVE_TOKEN, without_creation_fee
from ledgerloom.plans import ledger
from ledgerloom.plans.chain import _cut

PLACE = ("height", "phase", "seq", "sub_seq")


def _folded(rows: DataFrame, block: int, many: int) -> DataFrame:
    """rows (pk, token, *PLACE, delta, nonce, delegate, changed) with the account after each: _sum, _low, _nonce, _delegate, _changed.

    ``_next`` is the height of the account's next row in its block, null after its last one. All rows are sorted once.
    Accounts of more than ``many`` rows, which are few, are sorted in blocks of heights; a row for each block is then
    added to theirs.
    """
    keys, of = ["pk", "token"], F.col
    sizes = _cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    size = sizes.agg(F.sum("_n")).first()[0] or 0
    large = sizes.filter(of("_n") > many).select(*keys, F.lit(True).alias("_large"))
    at = rows.join(F.broadcast(large), keys, "left").withColumn("_block", F.when(of("_large"), F.floor(of("height") / block)).otherwise(0))
    own = Window.partitionBy(*keys, "_block").orderBy(*PLACE)
    whole = own.rowsBetween(Window.unboundedPreceding, 0)
    lasts = ("nonce", "delegate", "changed")
    at = ledger.spread(at, [*keys, "_block"], size).withColumns({"_sum": F.sum("delta").over(whole), "_next": F.lead("height").over(own), **{f"_{c}": F.last(c, True).over(whole) for c in lasts}})
    at = at.withColumn("_low", F.min("_sum").over(whole))
    if large.isEmpty():
        return at
    ends = at.filter("_large").groupBy(*keys, "_block").agg(F.sum("delta").alias("_all"), F.min("_low").alias("_least"), *[F.max_by(c, F.when(of(c).isNotNull(), F.struct(*PLACE))).alias(f"_b{c}") for c in lasts])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_start", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    before = ends.select(*keys, "_block", "_start", F.min(of("_start") + of("_least")).over(earlier).alias("_lowest"), *[F.last(f"_b{c}", True).over(earlier).alias(f"_b{c}") for c in lasts])
    start = F.coalesce("_start", F.lit(0))
    out = {"_sum": start + of("_sum"), "_low": F.least("_lowest", start + of("_low")), **{f"_{c}": F.coalesce(f"_{c}", f"_b{c}") for c in lasts}}
    return at.join(before, [*keys, "_block"], "left").withColumns(out)


def _changes(diffs: DataFrame, *more: str) -> DataFrame:
    return diffs.select("pk", "token", *PLACE, F.coalesce("delta", F.lit(0).cast("long")).alias("delta"), "nonce", "delegate", F.col("height").alias("changed"), *more)


def _shown() -> list[Column]:
    return [(F.col("_sum") - F.least(F.col("_low"), F.lit(0))).alias("balance"), F.coalesce("_nonce", F.lit(0).cast("long")).alias("nonce"), F.coalesce("_delegate", "pk").alias("delegate")]


def after_changes(diffs: DataFrame, block: int = 1024, many: int = ledger.MANY) -> DataFrame:
    """(state_hash, pk, token, height, phase, seq, sub_seq, balance, nonce, delegate): an account after each of its changes.

    diffs are those of ``ledger.account_diffs`` of one chain. A balance is the sum so far less the lowest sum so far, if
    that is negative: what a floor of 0 at each change leaves. Nonce and delegate are the last ones set.
    """
    return _folded(_changes(diffs, "state_hash"), block, many).select("state_hash", "pk", "token", *PLACE, *_shown())


def after_blocks(diffs: DataFrame, block: int = 1024, many: int = ledger.MANY) -> DataFrame:
    """(state_hash, pk, token, height, balance, nonce, delegate): an account after each block of one chain that changes it."""
    last = _folded(_changes(diffs, "state_hash"), block, many).filter(F.col("_next").isNull() | (F.col("_next") != F.col("height")))
    return last.select("state_hash", "pk", "token", "height", *_shown())


def accounts_at(requests: DataFrame, diffs: DataFrame, token: str = "native", block: int = 1024, many: int = ledger.MANY) -> DataFrame:
    """requests (id, pk, height) with balance, nonce and delegate of the account of a token after the last block at or below the height that changes it, and since, its height.

    Those of as_of() over after_blocks(), found in the order of changes itself; null where no block is so low.
    """
    null = lambda c: F.lit(None).cast(diffs.schema[c].dataType).alias(c)
    last = {"phase": F.lit(2**31 - 1), "seq": F.lit(0), "sub_seq": F.lit(0)}  # after all changes of the height
    asked = requests.select("pk", F.lit(token).alias("token"), "height", *[v.alias(c) for c, v in last.items()], F.lit(0).cast("long").alias("delta"), null("nonce"), null("delegate"), null("height").alias("changed"), "id", F.lit(True).alias("_asks"))
    held = _changes(diffs.filter(F.col("token") == F.lit(token))).withColumns({"id": F.lit(None).cast(requests.schema["id"].dataType), "_asks": F.lit(False)})
    found = _folded(asked.unionByName(held), block, many).filter("_asks").select("id", "pk", "height", *_shown(), F.col("_changed").alias("since"))
    return found.select("id", "pk", "height", *[F.when(F.col("since").isNotNull(), F.col(c)).alias(c) for c in ("balance", "nonce", "delegate")], "since")


def mismatches(after: DataFrame, accessed: DataFrame, paid: DataFrame | None = None, native: str = NATIVE_TOKEN) -> DataFrame:
    """(state_hash, pk, token, field, expected, found): what blocks' own records of accounts have otherwise than the fold.

    after are rows of after_blocks(), accessed of ``precomputed.accounts_accessed``. A native account without a row in paid
    (pk) has not paid for its creation, which its displayed balance leaves out. An account that the fold doesn't know is found as null.
    """
    token = lambda c: F.when(c == native, F.lit("native")).otherwise(c)
    known = after.select("state_hash", "pk", "token", *[F.col(c).alias(f"_{c}") for c in ("balance", "nonce", "delegate")])
    both = accessed.withColumn("token", token(F.col("token"))).join(known, ["state_hash", "pk", "token"], "left")
    both = both.join(paid.select("pk", F.lit(True).alias("_paid")).distinct(), "pk", "left") if paid is not None else both.withColumn("_paid", F.lit(False))
    shown = without_creation_fee(F.col("_balance"), F.col("token"), F.col("_paid"), "native")
    pair = lambda field, found: F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("expected"), found.cast("string").alias("found"))
    rows = both.select("state_hash", "pk", "token", F.explode(F.array(pair("balance", shown), pair("nonce", F.col("_nonce")), pair("delegate", F.col("_delegate")))).alias("f"))
    return rows.select("state_hash", "pk", "token", "f.*").filter(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("found")))


def displayed(accounts: DataFrame, paid: DataFrame | None = None) -> DataFrame:
    """Accounts (pk, token, balance) with balances as they are shown: native ones that have not paid for their creation less its fee, at least 0.

    paid has a row (pk) for each account that has, such as those of the first ledger.
    """
    both = accounts.join(paid.select("pk", F.lit(True).alias("_paid")).distinct(), "pk", "left") if paid is not None else accounts.withColumn("_paid", F.lit(False))
    return both.withColumn("balance", without_creation_fee(F.col("balance"), F.col("token"), F.col("_paid"), "native")).select(accounts.columns)


def as_of(requests: DataFrame, versions: DataFrame, keys: list[str], values: list[str], block: int = 1024) -> DataFrame:
    """requests (id, *keys, height) with the values of the last version (*keys, height, *values) of the key at or below the height.

    Both are put in one order of a key, so any number of requests is one pass; null where no version is so low.
    """
    mark = F.struct(F.col("height").alias("at"), *[F.col(v) for v in values])
    asked = requests.select(*keys, "height", F.lit(1).alias("_asks"), "id", F.lit(None).cast(versions.select(mark.alias("m")).schema["m"].dataType).alias("_version"))
    held = versions.select(*keys, "height", F.lit(0).alias("_asks"), F.lit(None).cast(requests.schema["id"].dataType).alias("id"), mark.alias("_version"))
    rows = ledger.running(asked.unionByName(held), keys, F.floor(F.col("height") / block), ["height", "_asks", "id"], {}, {"_last": F.col("_version")}, {})
    found = rows.filter("_asks = 1").select("id", *keys, "height", *[F.col(f"_last.{v}").alias(v) for v in values], F.col("_last.at").alias("since"))
    return found


def intervals(updates: DataFrame, keys: list[str], fields: list[str], place: list[str], block: int = 1024) -> DataFrame:
    """(*keys, field, value, since, until): how long each field of an account had a value, from height to height; until is null while it holds.

    updates are those of one chain, with null where a field is kept. Of several values that a block sets the last counts;
    since is the height that sets a value, until the one that sets the next.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = updates.select(*keys, *place, F.explode(pairs).alias("p")).filter("p.value is not null").select(*keys, *place, "p.*")
    last = rows.groupBy(*keys, "field", "height").agg(F.max_by("value", F.struct(*place)).alias("value"))
    out = ledger.neighbours(last, [*keys, "field"], "height", F.floor(F.col("height") / block))
    return out.select(*keys, "field", "value", F.col("height").alias("since"), F.col("following").alias("until"))


def at_height(held: DataFrame, height: int | Column) -> DataFrame:
    """(*keys, field, value, since) of the intervals that hold after the block at a height."""
    h = height if isinstance(height, Column) else F.lit(height)
    return held.filter((F.col("since") <= h) & (F.col("until").isNull() | (F.col("until") > h))).drop("until")


def reorganised(held: DataFrame, fork: int, updates: DataFrame, keys: list[str], fields: list[str], place: list[str]) -> DataFrame:
    """The intervals after all blocks above a height were taken back and a branch's updates above it applied.

    Values that were set above the height go, those that ended above it hold again, and each ends where the branch sets the
    next. Only intervals that reach above the height change; what the branch adds is all that is sorted.
    """
    kept = held.filter(F.col("since") <= fork).withColumn("until", F.when(F.col("until") <= fork, F.col("until")))
    new = intervals(updates.filter(F.col("height") > fork), keys, fields, place)
    first = new.groupBy(*keys, "field").agg(F.min("since").alias("_next"))
    closed = kept.join(first, [*keys, "field"], "left").withColumn("until", F.coalesce("until", "_next")).drop("_next")
    return closed.unionByName(new)

