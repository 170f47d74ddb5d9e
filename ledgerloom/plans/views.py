"""Rows as an interface shows them: blocks with their commands, jobs and counts as nested columns, and command pages by dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts
from ledgerloom.plans import counters, listings


def _listed(rows: DataFrame, order: list[str], fields: dict[str, Column], name: str) -> DataFrame:
    """(state_hash, name): the rows of each block in order, as one array; a block's rows are all that meet."""
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*[c.alias(n) for n, c in fields.items()]).alias("row"))
    out = rows.groupBy("state_hash").agg(F.sort_array(F.collect_list(item)).alias("all"))
    return out.select("state_hash", F.transform("all", lambda x: x["row"]).alias(name))


def blocks(blocks_: DataFrame, commands: DataFrame, works: DataFrame, internal: DataFrame, bundle: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """A row a block, with everything it holds: who made it, what was paid, its counts, transactions and SNARK jobs.

    blocks_ have state_hash, parent_hash, height, global_slot, epoch, date_time_ms, creator and canonical, and may have more
    of ``precomputed.blocks``, which go to the state. commands have state_hash, seq, sender, fee, applied and is_zkapp, and may
    have more; works state_hash, idx, prover and fee; internal state_hash, kind, receiver and amount. bundle is
    ``listings.count_bundle``, names are (pk, username). Amounts are shown in units. Each table is shuffled once, by block.
    """
    rest = lambda df, known: {c: F.col(c) for c in df.columns if c not in known}
    own = _listed(commands, ["seq"], rest(commands, ("state_hash", "network", "height", "version")), "user_commands")
    jobs = _listed(works, ["idx"], {"prover": F.col("prover"), "fee": F.col("fee")}, "snark_jobs")
    inner = _listed(internal, ["kind", "receiver", "amount"], {"kind": F.col("kind"), "recipient": F.col("receiver"), "fee": amounts.units(F.col("amount"))}, "fee_transfer")
    fees = counters.block_fees(commands, works, blocks_)
    out = blocks_.join(own, "state_hash", "left").join(jobs, "state_hash", "left").join(inner, "state_hash", "left").join(fees, "state_hash")
    if bundle is not None:
        out = out.join(F.broadcast(bundle.withColumnsRenamed({c: f"num_{c}" for c in bundle.columns if c != "epoch"})), "epoch", "left")  # a row an epoch
    who = [c for c in ("creator", "winner", "coinbase_receiver") if c in blocks_.columns]
    if names is not None:
        out = listings.with_names(out, names, **{c: f"{c}_username" for c in who})
    list_ = lambda c: F.coalesce(c, F.array())
    counted = {
        "block_num_snarks": F.size(list_("snark_jobs")), "block_num_user_commands": F.size(list_("user_commands")),
        "block_num_zkapp_commands": F.size(F.filter(list_("user_commands"), lambda c: c["is_zkapp"])), "block_num_internal_commands": F.size(list_("fee_transfer")),
    }
    person = lambda c: F.struct(F.col(c).alias("public_key"), *([F.col(f"{c}_username").alias("username")] if names is not None else []))
    state = F.struct(F.col("parent_hash").alias("previous_state_hash"), "epoch", amounts.epoch_slot(F.col("global_slot")).alias("slot"), *[c for c in ("total_currency", "staged_ledger_hash", "staking_ledger_hash", "slot_since_fork") if c in blocks_.columns])
    return out.select(
        "state_hash", "canonical", F.col("height").alias("block_height"), F.col("global_slot").alias("global_slot_since_genesis"), amounts.iso_date(F.col("date_time_ms")).alias("date_time"),
        *[person(c).alias(c) for c in who], amounts.units(F.col("tx_fees")).alias("tx_fees"), amounts.units(F.col("snark_fees")).alias("snark_fees"),
        *[c.cast("long").alias(n) for n, c in counted.items()], *([F.col(f"num_{c}") for c in bundle.columns if c != "epoch"] if bundle is not None else []),
        state.alias("protocol_state"), F.struct(list_("user_commands").alias("user_commands"), list_("fee_transfer").alias("fee_transfer")).alias("transactions"), list_("snark_jobs").alias("snark_jobs"),
    )


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as one JSON object, fields of null left out."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


def commands_between(commands: DataFrame, blocks_: DataFrame, genesis_ms: int, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Commands (global_slot, ...) from one date to another, both included.

    A date is snapped to a produced slot: the start to the first at or after its slot, the end to the last at or before it.
    Where there is none no command is left.
    """
    slot = F.col("global_slot")
    at = [None if ms is None else F.lit((ms - genesis_ms) // amounts.SLOT_MS) for ms in (since_ms, until_ms)]
    least, most = (F.lit(None) if b is None else b for b in at)
    first, last = blocks_.agg(F.min(F.when(slot >= least, slot)), F.max(F.when(slot <= most, slot))).first()
    out = commands if since_ms is None else commands.filter(slot >= F.lit(first).cast("long"))
    return out if until_ms is None else out.filter(slot <= F.lit(last).cast("long"))
