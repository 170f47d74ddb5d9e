"""Scalar functions of ledgers: amounts, slots, epochs, dates, coinbases and vesting, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ledger format.
SCALE = 9
SLOT_MS = 180_000
SLOTS_PER_EPOCH = 7_140
#: The last slot before the fork, and the slots by which epochs are shifted after it.
LAST_SLOT_BEFORE_FORK = 564_479
FORK_SHIFT = 420
COINBASE = 720_000_000_000
CREATION_FEE = 1_000_000_000
NATIVE_TOKEN = "wSHV2S4qX9jFsLjQo8r1BsMLH2ZRKsZx6EJd1sbozGPieEC4Jf"


def units(nano: Column) -> Column:
    """Nanounits as a decimal string without trailing zeros."""
    text = (nano.cast("decimal(29,0)") / F.lit(10**SCALE).cast("decimal(10,0)")).cast("decimal(38,9)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def signed_units(nano: Column) -> Column:
    """A change of a balance in units with its sign, + for 0."""
    return F.concat(F.when(nano < 0, F.lit("-")).otherwise(F.lit("+")), units(F.abs(nano)))


def slot(ms: Column, genesis_ms: int) -> Column:
    return F.floor((ms - F.lit(genesis_ms)) / SLOT_MS).cast("long")


def epoch(global_slot: Column) -> Column:
    return F.floor(global_slot / SLOTS_PER_EPOCH).cast("long")


def epoch_slot(global_slot: Column) -> Column:
    """The slot inside its epoch, by shifted slots after the fork."""
    return F.when(global_slot <= LAST_SLOT_BEFORE_FORK, global_slot % SLOTS_PER_EPOCH).otherwise((global_slot - FORK_SHIFT) % SLOTS_PER_EPOCH).cast("long")


def _utc(ms: Column) -> tuple[Column, Column, Column]:
    """Date, seconds of the day and milliseconds of a time, by whole numbers alone: the session's zone takes no part."""
    seconds = F.floor(ms / 1000)
    return F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")), F.pmod(seconds, F.lit(86_400)), F.pmod(ms, F.lit(1000))


def _clock(seconds: Column) -> Column:
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds % 3600 / 60)), F.lit(":"), two(seconds % 60))


def iso_date(ms: Column) -> Column:
    """Milliseconds as ``2021-03-17T00:00:00.000Z``."""
    day, seconds, rest = _utc(ms)
    return F.concat(day.cast("string"), F.lit("T"), _clock(seconds), F.lit("."), F.lpad(rest.cast("string"), 3, "0"), F.lit("Z"))


def rfc2822_date(ms: Column) -> Column:
    """Milliseconds as ``Wed, 17 Mar 2021 00:00:00 +0000``."""
    day, seconds, _ = _utc(ms)
    name = lambda names, nth: F.element_at(F.array(*map(F.lit, names.split())), nth.cast("int"))
    months = name("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec", F.month(day))
    return F.concat(name("Sun Mon Tue Wed Thu Fri Sat", F.dayofweek(day)), F.lit(", "), F.dayofmonth(day).cast("string"), F.lit(" "), months, F.lit(" "), F.year(day).cast("string"), F.lit(" "), _clock(seconds), F.lit(" +0000"))


def coinbase(parts: Column, supercharged: Column) -> Column:
    """The reward of a block whose coinbase has 0, 1 or 2 parts: nothing without one, twice as much if supercharged."""
    return F.when(parts == 0, 0).when(F.coalesce(supercharged, F.lit(False)), 2 * COINBASE).otherwise(COINBASE).cast("long")


def without_creation_fee(balance: Column, token: Column, paid: Column, native: str = NATIVE_TOKEN) -> Column:
    """A balance less the fee for the account's creation, where that is due: native token (or none), not paid; at least 0."""
    due = balance.isNotNull() & (token.isNull() | (token == native)) & ~F.coalesce(paid, F.lit(False))
    return F.when(due, F.greatest(balance - CREATION_FEE, F.lit(0))).otherwise(balance)


def minimum_balance(at: Column, initial: Column, cliff: Column, period: Column, increment: Column, cliff_amount: Column | None = None) -> Column:
    """The locked part of a vesting account at a slot: all before the cliff, then less an increment for each whole period.

    The format's amount that is freed at the cliff is left out of account unless it is given. A period of 0 frees nothing more.
    """
    steps = F.when(period > 0, F.floor((at - cliff) / period)).otherwise(F.lit(0))
    freed = steps * increment if cliff_amount is None else cliff_amount + steps * increment
    return F.when(at < cliff, initial).otherwise(F.greatest(initial - freed, F.lit(0)))


def vrf_bytes(text: Column) -> Column:
    """URL-safe base64 as bytes, whose order is the order of outputs."""
    return F.unbase64(F.translate(text, "-_", "+/"))
