"""Counters, fees, token tables and the account changes of blocks, each an aggregate that folds before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans import ledger


def top_per_epoch(rows: DataFrame, epoch: str, key: str, amount: Column, n: int = 10) -> DataFrame:
    """epoch, key, total, works, nth: the n greatest totals of each epoch, equal ones by key."""
    own = rows.groupBy(epoch, key).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("works"))
    nth = F.row_number().over(Window.partitionBy(epoch).orderBy(F.col("total").desc(), key))
    return own.withColumn("nth", nth.cast("long")).filter(F.col("nth") <= n)  # Spark keeps n rows an epoch in each task


def tokens(accounts: DataFrame, commands: DataFrame) -> DataFrame:
    """token, supply, holders, txns from accounts (token, balance) and commands (token); 0 where a side has none."""
    held = accounts.groupBy("token").agg(F.sum("balance").alias("supply"), F.count(F.lit(1)).alias("holders"))
    used = commands.groupBy("token").agg(F.count(F.lit(1)).alias("txns"))
    return held.join(used, "token", "full").select("token", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("supply", "holders", "txns")])


def payer_fees(commands: DataFrame, keys: list[str], fee: Column) -> DataFrame:
    """keys and their fees; those that pay none are left out."""
    return commands.groupBy(*keys).agg(F.sum(fee).alias("fees")).filter("fees <> 0")


def merged_transfers(rows: DataFrame) -> DataFrame:
    """receiver, amount, senders: transfers merged by sender and receiver, then by receiver."""
    pairs = rows.groupBy("sender", "receiver").agg(F.sum("amount").alias("amount"))
    return pairs.groupBy("receiver").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("senders"))


def containing_blocks(commands: DataFrame, rank: Column, part: Column | None = None) -> DataFrame:
    """txn_hash, state_hash, nth, blocks: the blocks that hold a command, best first; a command twice in a block is one.

    rank is a number; ``part`` a coarser form of it, so that a command of any number of blocks is spread.
    """
    own = commands.dropDuplicates(["txn_hash", "state_hash"]).select("txn_hash", "state_hash", (-rank).alias("_rank"), (-rank if part is None else -part).alias("_part"))
    many = own.groupBy("txn_hash").agg(F.count(F.lit(1)).alias("blocks"))
    out = ledger.running(own, ["txn_hash"], F.col("_part"), ["_rank", "state_hash"], {}, {}, {})
    return out.join(many, "txn_hash").select("txn_hash", "state_hash", "nth", "blocks")


def account_changes(commands: DataFrame, rewards: DataFrame) -> DataFrame:
    """(pk, height, phase, seq, delta, nonce): what blocks do to accounts, ordered by height, phase and seq.

    commands have height, seq, sender, receiver, amount, fee, nonce and applied; rewards height, kind, receiver and
    amount. Phase 0 holds commands, 1 coinbases, 2 fees. A failed command moves nothing, yet raises the nonce and pays.
    """
    nothing = F.lit(None).cast("long")
    row = lambda df, pk, phase, seq, delta, nonce=nothing: df.select(F.col(pk).alias("pk"), "height", phase.alias("phase"), seq.cast("long").alias("seq"), delta.cast("long").alias("delta"), nonce.cast("long").alias("nonce"))
    sent = row(commands, "sender", F.lit(0), F.col("seq"), F.when(F.col("applied"), -F.col("amount")).otherwise(0), F.col("nonce") + 1)
    got = row(commands.filter("applied"), "receiver", F.lit(0), F.col("seq"), F.col("amount"))
    paid = row(payer_fees(commands, ["height", "sender"], F.col("fee")), "sender", F.lit(2), F.lit(0), -F.col("fees"))
    reward = F.when(F.col("kind") == "coinbase", 1).otherwise(2)
    earned = row(rewards, "receiver", reward, F.lit(1), F.col("amount"))
    return sent.unionAll(got).unionAll(paid).unionAll(earned)


def folded(changes: DataFrame, height: int | Column | None = None, block: int = 1024) -> DataFrame:
    """pk, balance, nonce after the block at a height (None: the last), each account's changes added in their order.

    A debit beyond the balance leaves 0. A command credits before it debits, so at
    equal height, phase and seq the greater change comes first.
    """
    own = changes if height is None else changes.filter(F.col("height") <= height)
    return ledger.saturating_balance(own, ["pk"], "height", F.col("delta"), block, ("phase", "seq", -F.col("delta")), ("nonce",))


def produced_slots(blocks: DataFrame, slot: int) -> DataFrame:
    """One row: the produced slots next to a slot, at or before it and at or after it (null where there is none)."""
    at = F.col("global_slot")
    return blocks.agg(F.max(F.when(at <= slot, at)).alias("previous"), F.min(F.when(at >= slot, at)).alias("following"))


def grouped_counts(rows: DataFrame, measures: dict[str, Column], epoch: str = "epoch", pk: str = "pk") -> DataFrame:
    """(epoch, pk, *measures): counts by epoch and account, by epoch, by account and in all (null stands for all), in one shuffle.

    Each measure is a condition that is counted. Rows are counted by epoch and account first, and those counts are
    rolled up, so a common account or epoch is a few rows of each task.
    """
    fine = rows.groupBy(F.col(epoch).alias("epoch"), F.col(pk).alias("pk")).agg(*[F.count_if(c).alias(n) for n, c in measures.items()])
    return fine.cube("epoch", "pk").agg(*[F.sum(n).alias(n) for n in measures], F.grouping("epoch").alias("all_epochs"), F.grouping("pk").alias("all_pks"))


def new_works(works: DataFrame) -> DataFrame:
    """SNARK works without those that another block of the height holds: one row for each prover, height and place in the block."""
    return works.groupBy("prover", "height", "idx").agg(F.min("fee").alias("fee"), F.bool_or("canonical").alias("canonical"), F.min("epoch").alias("epoch"))


def prover_fees(works: DataFrame) -> DataFrame:
    """(epoch, prover, total, most, least, works): fees of canonical works by epoch, and in all (epoch null)."""
    own = works.filter("canonical").groupBy("epoch", "prover").agg(F.sum("fee").alias("total"), F.max("fee").alias("most"), F.min("fee").alias("least"), F.count(F.lit(1)).alias("works"))
    whole = own.groupBy("prover").agg(F.sum("total").alias("total"), F.max("most").alias("most"), F.min("least").alias("least"), F.sum("works").alias("works"))
    return own.unionByName(whole.withColumn("epoch", F.lit(None).cast(own.schema["epoch"].dataType)))


def top_provers(fees: DataFrame, by: str = "total", epoch: int | None = None, ascending: bool = False, limit: int = 100) -> DataFrame:
    """The first provers by total, most or least fee, or by works, of an epoch or of all time; equal ones by key."""
    own = fees.filter(F.col("epoch").isNull() if epoch is None else F.col("epoch") == epoch)
    return own.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), F.col("prover")).limit(limit)


def top_stakers(blocks: DataFrame, stakes: DataFrame, epoch: int, by: str = "canonical_blocks", ascending: bool = False, limit: int = 100) -> DataFrame:
    """pk, blocks, canonical_blocks, slots, delegated and delegators of an epoch's creators; those without delegations have 0."""
    own = blocks.filter(F.col("epoch") == epoch).groupBy(F.col("creator").alias("pk")).agg(F.count(F.lit(1)).alias("blocks"), F.count_if("canonical").alias("canonical_blocks"), F.countDistinct("epoch_slot").alias("slots"))
    held = stakes.filter(F.col("epoch") == epoch).groupBy(F.col("delegate").alias("pk")).agg(F.sum("balance").alias("delegated"), F.count(F.lit(1)).alias("delegators"))
    out = own.join(held, "pk", "left").na.fill(0, ["delegated", "delegators"])
    return out.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), F.col("pk")).limit(limit)


def stakes(accounts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Staking accounts with what is delegated to each, its delegators, its share of all stake, and its name."""
    held = ledger.delegations(accounts).withColumnRenamed("delegate", "pk")
    out = accounts.join(held, "pk", "left").na.fill(0, ["total_delegated", "delegators"]).na.fill(0.0, ["share"])
    return out if names is None else out.join(names, "pk", "left")


def delegators(accounts: DataFrame) -> DataFrame:
    """(delegate, nth, pk, balance): each delegate's delegators, the greatest balance first; a delegate of any number is spread."""
    order = [F.col("balance").desc(), F.col("pk")]
    own = ledger.ranged(accounts.select("delegate", "pk", "balance"), [F.col("delegate"), *order], "part")
    return ledger.running(own, ["delegate"], F.col("part"), order, {}, {}, {}).select("delegate", "nth", "pk", "balance")


def with_counters(accounts: DataFrame, counters: dict[str, DataFrame]) -> DataFrame:
    """Accounts (pk, ...) with a column of each counter (pk, n), 0 where it has none of the account.

    Counters are put together by one aggregate before the only join, however many there are.
    """
    rows = None
    for name, df in counters.items():
        own = df.select("pk", F.lit(name).alias("name"), F.col("n").cast("long").alias("n"))
        rows = own if rows is None else rows.unionAll(own)
    wide = rows.groupBy("pk").agg(*[F.sum(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in counters])
    return accounts.join(wide, "pk", "left").na.fill(0, list(counters))


def block_fees(commands: DataFrame, works: DataFrame, blocks: DataFrame) -> DataFrame:
    """(state_hash, tx_fees, snark_fees) of every block, 0 where it has none."""
    paid = commands.groupBy("state_hash").agg(F.sum("fee").alias("tx_fees"))
    earned = works.groupBy("state_hash").agg(F.sum("fee").alias("snark_fees"))
    return blocks.select("state_hash").join(paid, "state_hash", "left").join(earned, "state_hash", "left").na.fill(0, ["tx_fees", "snark_fees"])


def slots_of_heights(blocks: DataFrame) -> DataFrame:
    """(height, global_slot): each once; read either way, slots of a height or heights of a slot."""
    return blocks.select("height", "global_slot").distinct()


def snapped(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """bounds (id, slot) with ``following`` and ``previous``: the first produced slot at or after it, the last at or before it.

    Both are put into one order of slots and looked up inside blocks of slots, so no slot list is one task's.
    """
    width = 1 << 16
    marks = blocks.select(F.col("global_slot").alias("slot"), F.lit(None).cast("long").alias("id")).distinct()
    both = marks.unionByName(bounds.select(F.col("slot").cast("long").alias("slot"), F.col("id").cast("long").alias("id"))).withColumn("_block", F.floor(F.col("slot") / width))
    made = F.when(F.col("id").isNull(), F.col("slot"))
    ends = both.groupBy("_block").agg(F.min(made).alias("_low"), F.max(made).alias("_high"))
    order = Window.orderBy("_block")  # a row for each 65,536 slots
    ends = ends.select("_block", F.last("_high", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_low", True).over(Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    own = Window.partitionBy("_block").orderBy("slot")
    out = both.withColumns({"_p": F.max(made).over(own), "_f": F.min(made).over(Window.partitionBy("_block").orderBy(F.col("slot").desc()))})
    out = out.filter("id is not null").join(F.broadcast(ends), "_block")
    return out.select("id", "slot", F.coalesce("_p", "_before").alias("previous"), F.coalesce("_f", "_after").alias("following"))


def token_ledger(diffs: DataFrame) -> DataFrame:
    """(token, supply, owner, symbol, txns): token changes (token, height, seq, kind, delta, owner, symbol) folded in order.

    Supply changes are summed; the first owner and the last symbol that were set count.
    """
    place = F.struct("height", "seq")
    return diffs.groupBy("token").agg(
        F.coalesce(F.sum("delta"), F.lit(0)).alias("supply"),
        F.min_by("owner", F.when(F.col("owner").isNotNull(), place)).alias("owner"),
        F.max_by("symbol", F.when(F.col("symbol").isNotNull(), place)).alias("symbol"),
        F.count(F.lit(1)).alias("txns"),
    )


def names_of(claims: DataFrame) -> DataFrame:
    """(pk, username, changes): the last name that canonical payments claimed for each account."""
    return claims.groupBy("pk").agg(F.max_by("username", F.struct("height", "seq")).alias("username"), F.count(F.lit(1)).alias("changes"))


def stakes_of_blocks(blocks: DataFrame, ledgers: DataFrame) -> DataFrame:
    """(state_hash, epoch, ledger_hash, delegated, delegators, total, share): what was delegated to each block's creator in its epoch.

    blocks have state_hash, genesis_state_hash, epoch and creator; ledgers are staking accounts (ledger_hash, genesis_state_hash,
    epoch, pk, delegate, balance), one ledger for each genesis and epoch. Delegations fold to a row for each epoch and
    delegate before blocks meet them; a block of an epoch without a ledger keeps its row, of nulls.
    """
    keys = ["genesis_state_hash", "epoch"]
    held = ledgers.groupBy(*keys, F.coalesce("delegate", "pk").alias("creator")).agg(F.sum("balance").alias("delegated"), F.count(F.lit(1)).alias("delegators"))
    whole = ledgers.groupBy(*keys).agg(F.min("ledger_hash").alias("ledger_hash"), F.sum("balance").alias("total"))
    own = blocks.select("state_hash", *keys, "creator").join(whole, keys, "left").join(held, [*keys, "creator"], "left")
    known = lambda c: F.when(F.col("ledger_hash").isNotNull(), F.coalesce(c, F.lit(0))).alias(c)
    share = F.when(F.col("ledger_hash").isNotNull(), ledger.share(F.coalesce("delegated", F.lit(0)), F.col("total")))
    return own.select("state_hash", "epoch", "ledger_hash", known("delegated"), known("delegators"), "total", share.alias("share"))


#: What an account's own counters count, of its current epoch and in all.
COUNTED = ("blocks", "snarks", "user_commands", "zkapp_commands", "internal_commands")


def account_view(accounts: DataFrame, tables: dict[str, DataFrame], epoch: Column) -> DataFrame:
    """Accounts (pk, ...) with the twelve counters that an account's page shows.

    ``epoch_num_*`` and ``total_num_*`` of each of COUNTED, from tables of that name (pk, epoch), and the numbers of all
    accounts and of contract accounts (is_zkapp). A row in two roles of a command is two rows of its table. All tables fold by
    account in one aggregate before the only join.
    """
    rows = None
    for name in COUNTED:
        own = tables[name].select("pk", F.lit(name).alias("name"), (F.col("epoch") == epoch).alias("now"))
        rows = own if rows is None else rows.unionAll(own)
    is_ = lambda n: F.col("name") == n
    wide = rows.groupBy("pk").agg(*[F.count_if(is_(n) & F.col("now")).alias(f"epoch_num_{n}") for n in COUNTED], *[F.count_if(is_(n)).alias(f"total_num_{n}") for n in COUNTED])
    whole = accounts.agg(F.count(F.lit(1)).alias("total_num_accounts"), F.count_if("is_zkapp").alias("total_num_zkapp_accounts"))  # one row
    return accounts.join(wide, "pk", "left").na.fill(0, [c for c in wide.columns if c != "pk"]).crossJoin(F.broadcast(whole))


def signed(changes: DataFrame, rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """(*keys, *measures): what blocks that are applied add to sums, and blocks that are unapplied take back.

    changes are (state_hash, change) as ``chain.reorganisation`` has them, rows carry state_hash. Sums of 0 are left out.
    """
    sign = F.when(F.col("change") == "apply", 1).otherwise(-1)
    out = rows.join(changes.select("state_hash", "change"), "state_hash").groupBy(*keys).agg(*[F.sum(c.cast("long") * sign).alias(n) for n, c in measures.items()])
    return out.filter(" OR ".join(f"{n} <> 0" for n in measures))
