"""Block files of both versions as tables: blocks, user commands, internal commands, SNARK works, account changes.

Files are named ``network-height-hash.json``; network, height and state hash come from the name. Version 1 is flat,
version 2 has ``version`` and ``data`` around it. A file is read as one VARIANT value, so tagged arrays of mixed kinds
need no schema; amounts are in nanounits throughout.

Of files with one state hash the one of the smallest path that parses is taken. Files with another name are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import coinbase, vrf_bytes
from ledgerloom.plans.chain import _cut as cut
from ledgerloom.sources.files import named

_STATE = "$.protocol_state"
_CONSENSUS = f"{_STATE}.body.consensus_state"


def _texts(spark: SparkSession, path: str, above: int | None, least: int | None) -> DataFrame:
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    files = named(text.select("value", "_metadata"), "height", "state_hash").withColumn("file", F.col("_metadata.file_path")).drop("_metadata")
    if above is not None:
        files = files.filter(F.col("height") > above)
    if least is not None:
        files = files.filter(F.col("height") >= least)
    return files


def paths(spark: SparkSession, path: str, above: int | None = None, least: int | None = None) -> DataFrame:
    """(height, state_hash, network, file, bytes) of block files, by height and then by hash; no file is read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    files = named(names.select("_metadata", F.col("length").alias("bytes")), "height", "state_hash")
    if above is not None:
        files = files.filter(F.col("height") > above)
    if least is not None:
        files = files.filter(F.col("height") >= least)
    return files.select("height", "state_hash", "network", F.col("_metadata.file_path").alias("file"), "bytes").orderBy("height", "state_hash", "file")


def raw(spark: SparkSession, path: str, above: int | None = None, least: int | None = None) -> DataFrame:
    """(network, height, state_hash, version, v): one row a block, above a height (exclusive) or from one on (inclusive).

    Files that are no JSON are left out; ``unread`` names them. Copies are found by their names, without a look into the
    files, and only the copies are read twice. Several tables from many files are made faster from ``kept``.
    """
    files = _texts(spark, path, above, least)
    many = paths(spark, path, above, least).groupBy("state_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("state_hash")
    copies = files.join(many, "state_hash").select("state_hash", "file", F.try_parse_json("value").isNotNull().alias("whole"))
    first = copies.groupBy("state_hash").agg(F.min_by("file", F.struct(~F.col("whole"), "file")).alias("first"))
    others = copies.join(first, "state_hash").filter("file <> first").select("file")
    return parsed(files.join(others, "file", "left_anti"))


def parsed(files: DataFrame) -> DataFrame:
    """Block files (network, height, state_hash, value) as rows of raw(); what is no JSON is left out."""
    whole = files.withColumn("whole", F.try_parse_json("value")).filter("whole is not null")
    data = F.try_variant_get("whole", "$.data", "variant")
    return whole.select("network", "height", "state_hash", F.when(data.isNull(), 1).otherwise(2).alias("version"), F.coalesce(data, F.col("whole")).alias("v"))


def unread(spark: SparkSession, path: str) -> DataFrame:
    """(file, height, state_hash, bytes) of block files that are no JSON: cut ones, which may come in full later."""
    files = _texts(spark, path, None, None)
    return files.filter(F.try_parse_json("value").isNull()).select("file", "height", "state_hash", F.octet_length("value").cast("long").alias("bytes"))


def kept(raw_: DataFrame, path: str) -> DataFrame:
    """The same rows, written as Parquet once and read from there, so that files are parsed once for all tables made of them."""
    raw_.write.parquet(path)
    return raw_.sparkSession.read.schema(raw_.schema).parquet(path)


def get(path: str, kind: str = "string", of: str | Column = "v") -> Column:
    return F.try_variant_get(F.col(of) if isinstance(of, str) else of, path, kind)


def nano(units: Column) -> Column:
    """Decimal units as whole nanounits."""
    return (units.cast("decimal(29,9)") * F.lit(10**9).cast("decimal(10,0)")).cast("long")


def _diffs() -> Column:
    """The pre-diff and the post-diff, null where a block has none."""
    return get("$.staged_ledger_diff.diff", "array<variant>")


def blocks(raw_: DataFrame) -> DataFrame:
    """One row a block, without its commands."""
    slot = F.coalesce(get(f"{_CONSENSUS}.curr_global_slot.slot_number"), get(f"{_CONSENSUS}.curr_global_slot_since_hard_fork.slot_number"))
    kinds = F.transform(_diffs(), lambda d: get("$.coinbase[0]", of=d))
    parts = F.when(F.array_contains(kinds, "Two"), 2).when(F.array_contains(kinds, "One"), 1).otherwise(0)
    supercharged = get(f"{_CONSENSUS}.supercharge_coinbase", "boolean")
    return raw_.select(
        "network", "state_hash", "height", "version",
        get(f"{_STATE}.previous_state_hash").alias("parent_hash"),
        get(f"{_CONSENSUS}.global_slot_since_genesis").cast("long").alias("global_slot"),
        slot.cast("long").alias("slot_since_fork"),
        get(f"{_CONSENSUS}.epoch_count").cast("long").alias("epoch"),
        get(f"{_STATE}.body.genesis_state_hash").alias("genesis_state_hash"),
        get(f"{_STATE}.body.blockchain_state.timestamp").cast("long").alias("date_time_ms"),
        get("$.scheduled_time").cast("long").alias("scheduled_ms"),
        get(f"{_CONSENSUS}.block_creator").alias("creator"),
        get(f"{_CONSENSUS}.coinbase_receiver").alias("coinbase_receiver"),
        get(f"{_CONSENSUS}.block_stake_winner").alias("winner"),
        vrf_bytes(get(f"{_CONSENSUS}.last_vrf_output")).alias("vrf"),
        supercharged.alias("supercharge"),
        get(f"{_CONSENSUS}.total_currency").cast("decimal(20,0)").alias("total_currency"),
        get(f"{_STATE}.body.blockchain_state.staged_ledger_hash.non_snark.ledger_hash").alias("staged_ledger_hash"),
        get(f"{_CONSENSUS}.staking_epoch_data.ledger.hash").alias("staking_ledger_hash"),
        coinbase(parts, supercharged).alias("coinbase"),
    )


def _commands(raw_: DataFrame) -> DataFrame:
    """Rows of (network, height, state_hash, version, diff_idx, seq, c), pre-diff commands before post-diff ones."""
    both = F.flatten(F.transform(_diffs(), lambda d, i: F.transform(F.coalesce(get("$.commands", "array<variant>", d), F.array().cast("array<variant>")), lambda c: F.struct(i.alias("diff_idx"), c.alias("c")))))
    return raw_.select("network", "height", "state_hash", "version", F.posexplode(both).alias("seq", "own")).select("network", "height", "state_hash", "version", "own.diff_idx", "seq", "own.c")


def call_forest(raw_: DataFrame) -> DataFrame:
    """(height, state_hash, seq, path, u): every account update of contract commands, with its place among the calls.

    A path has the number of the update at the top, of the call in it, and so on, and paths sort in the order in which
    updates take effect: each is followed by its own calls. Calls are followed to any depth, one more in each round over
    those updates alone that the round before found; rounds are checkpoints, so plans stay short.
    """
    none = F.array().cast("array<variant>")
    rows = _commands(raw_).filter(get("$.data[0]", of="c") == "Zkapp_command")
    top = F.posexplode(F.coalesce(get("$.data[1].account_updates", "array<variant>", "c"), none)).alias("at", "u")
    front = cut(rows.select("height", "state_hash", "seq", top).select("height", "state_hash", "seq", F.array("at").alias("path"), "u"))
    levels = []
    while not front.isEmpty():
        levels.append(front)
        calls = F.posexplode(F.coalesce(get("$.elt.calls", "array<variant>", "u"), none)).alias("at", "call")
        inner = front.select("height", "state_hash", "seq", "path", calls)
        front = cut(inner.select("height", "state_hash", "seq", F.concat("path", F.array("at")).alias("path"), F.col("call").alias("u")))
    return reduce(DataFrame.unionAll, levels) if levels else front


def user_commands(raw_: DataFrame) -> DataFrame:
    """One row a command: kind (Payment, Delegation or Zkapp), sender, receivers, amount, fee, nonce, memo, applied and failure_reason."""
    c = F.col("c")
    signed = get("$.data[0]", of=c) == "Signed_command"
    body, common = "$.data[1].payload.body", "$.data[1].payload.common"
    kind = F.when(~signed, "Zkapp").when(get(f"{body}[0]", of=c) == "Payment", "Payment").otherwise("Delegation")
    payer = F.coalesce(get(f"{common}.fee_payer_pk", of=c), get("$.data[1].fee_payer.body.public_key", of=c))
    sender = F.coalesce(get(f"{body}[1].source_pk", of=c), get(f"{body}[1][1].delegator", of=c), payer)
    to = F.coalesce(get(f"{body}[1].receiver_pk", of=c), get(f"{body}[1][1].new_delegate", of=c))
    body_of = "$.elt.account_update.body"
    touched = F.struct("path", get(f"{body_of}.public_key", of="u").alias("pk"), get(f"{body_of}.token_id", of="u").alias("token"))
    touched = call_forest(raw_).groupBy(F.col("state_hash").alias("_of"), F.col("seq").alias("_seq")).agg(F.sort_array(F.collect_list(touched)).alias("_touched"))  # one command's
    reason = F.coalesce(F.get(F.flatten(F.flatten(get("$.status[1]", "array<array<array<string>>>", c))), F.lit(0)), get("$.status[1][0]", of=c))
    own = _commands(raw_).join(touched, (F.col("state_hash") == F.col("_of")) & (F.col("seq") == F.col("_seq")), "left")
    touched = F.transform(F.coalesce("_touched", F.array().cast("array<struct<path:array<int>,pk:string,token:string>>")), lambda t: F.struct(t["pk"].alias("pk"), t["token"].alias("token")))
    return own.select(
        "network", "height", "state_hash", "version", "diff_idx", "seq", kind.alias("kind"), sender.alias("sender"), payer.alias("fee_payer"),
        F.when(signed, F.array(F.struct(to.alias("pk"), F.lit(None).cast("string").alias("token")))).otherwise(touched).alias("receivers"),
        F.coalesce(get(f"{body}[1].amount", of=c).cast("long"), F.lit(0).cast("long")).alias("amount"),
        nano(F.coalesce(get(f"{common}.fee", of=c), get("$.data[1].fee_payer.body.fee", of=c))).alias("fee"),
        F.coalesce(get(f"{common}.nonce", of=c), get("$.data[1].fee_payer.body.nonce", of=c)).cast("long").alias("nonce"),
        F.coalesce(get(f"{common}.memo", of=c), get("$.data[1].memo", of=c)).alias("memo"),
        (get("$.status[0]", of=c) == "Applied").alias("applied"),
        F.when(get("$.status[0]", of=c) == "Failed", reason).alias("failure_reason"),
        (~signed).alias("is_zkapp"),
    )


def zkapp_updates(raw_: DataFrame) -> DataFrame:
    """One row an account update of an applied contract command: pk, token, signed balance change, the fields it sets (else null), events and actions as JSON.

    ``sub_seq`` is its place in the command, each update followed by its calls. ``creation_fee`` is what an update that
    pays the creation of its account implicitly takes from it first, as much as its balance change (a rule of the format).
    ``proved`` tells whether a proof authorised it and it was checked for its account's proved state.
    """
    u = F.col("u")
    at = "$.elt.account_update.body"
    applied = _commands(raw_).filter((get("$.data[0]", of="c") == "Zkapp_command") & (get("$.status[0]", of="c") == "Applied")).select("state_hash", "seq")
    one = Window.partitionBy("state_hash", "seq").orderBy("path")  # one command's
    rows = call_forest(raw_).join(applied, ["state_hash", "seq"], "left_semi").withColumn("sub_seq", F.row_number().over(one) - 1)
    change = get(f"{at}.balance_change.magnitude", of=u).cast("long")
    given = lambda field, path="", kind="string": F.when(get(f"{at}.update.{field}[0]", of=u) == "Set", get(f"{at}.update.{field}[1]{path}", kind, u))
    state = F.transform(get(f"{at}.update.app_state", "array<variant>", u), lambda e: F.when(get("$[0]", of=e) == "Set", get("$[1]", of=e)))
    return rows.select(
        "height", "state_hash", "seq", "sub_seq", get(f"{at}.public_key", of=u).alias("pk"), get(f"{at}.token_id", of=u).alias("token"),
        F.when(get(f"{at}.balance_change.sgn[0]", of=u) == "Neg", -change).otherwise(change).alias("delta"),
        F.when(get(f"{at}.implicit_account_creation_fee", "boolean", u), change).otherwise(F.lit(0).cast("long")).alias("creation_fee"),
        given("delegate").alias("delegate"), given("token_symbol").alias("symbol"), given("verification_key", ".hash").alias("verification_key"),
        F.to_json(given("permissions", kind="variant")).alias("permissions"), given("zkapp_uri").alias("uri"), F.to_json(given("timing", kind="variant")).alias("timing"),
        given("voting_for").alias("voting_for"), state.alias("app_state"), F.coalesce(get(f"{at}.authorization_kind[0]", of=u).isin("Proof", "Proof_") & (get(f"{at}.preconditions.account.proved_state[0]", of=u) == "Check"), F.lit(False)).alias("proved"), F.coalesce(get(f"{at}.increment_nonce", "boolean", u), F.lit(False)).alias("increments"),
        F.to_json(get(f"{at}.events", "variant", u)).alias("events"), F.to_json(get(f"{at}.actions", "variant", u)).alias("actions"),
    )


def accounts_accessed(raw_: DataFrame) -> DataFrame:
    """(height, state_hash, idx, pk, token, balance, nonce, delegate, symbol): accounts after a block as files of version 2 record them, in nanounits."""
    rows = raw_.select("height", "state_hash", F.explode(get("$.accounts_accessed", "array<variant>")).alias("a"))
    a = lambda field, kind="string": get(f"$[1].{field}", kind, "a")
    return rows.select("height", "state_hash", get("$[0]", "long", "a").alias("idx"), a("public_key").alias("pk"), a("token_id").alias("token"), a("balance").cast("long").alias("balance"), a("nonce").cast("long").alias("nonce"), a("delegate").alias("delegate"), a("token_symbol").alias("symbol"))


def accounts_created(raw_: DataFrame) -> DataFrame:
    """(height, state_hash, pk, token, fee): accounts that a block created, with the fee paid for it, of files of version 2."""
    rows = raw_.select("height", "state_hash", F.explode(get("$.accounts_created", "array<variant>")).alias("a"))
    return rows.select("height", "state_hash", get("$[0][0]", of="a").alias("pk"), get("$[0][1]", of="a").alias("token"), get("$[1]", of="a").cast("long").alias("fee"))


def snarks(raw_: DataFrame) -> DataFrame:
    """One row a completed work: state_hash, height, idx in the block, prover and fee."""
    works = F.flatten(F.transform(_diffs(), lambda d: F.coalesce(get("$.completed_works", "array<variant>", d), F.array().cast("array<variant>"))))
    rows = raw_.select("height", "state_hash", F.posexplode(works).alias("idx", "w"))
    return rows.select("height", "state_hash", "idx", get("$.prover", of="w").alias("prover"), nano(get("$.fee", of="w")).alias("fee"))


def fee_changes(commands: DataFrame, works: DataFrame, blocks_: DataFrame) -> DataFrame:
    """(height, state_hash, step, sender, receiver, amount): fees paid to the coinbase receiver, then SNARK fees paid by it.

    Fees of a payer are summed inside the pre-diff and the post-diff, SNARK fees of a prover over the block; a sum of 0
    is no change. Step orders them: pre-diff fees, post-diff fees, SNARK fees.
    """
    to = blocks_.select("state_hash", "coinbase_receiver")
    paid = commands.groupBy("height", "state_hash", "diff_idx", "fee_payer").agg(F.sum("fee").alias("amount")).join(to, "state_hash")
    paid = paid.select("height", "state_hash", F.col("diff_idx").alias("step"), F.col("fee_payer").alias("sender"), F.col("coinbase_receiver").alias("receiver"), "amount")
    earned = works.groupBy("height", "state_hash", "prover").agg(F.sum("fee").alias("amount")).join(to, "state_hash")
    earned = earned.select("height", "state_hash", F.lit(2).alias("step"), F.col("coinbase_receiver").alias("sender"), F.col("prover").alias("receiver"), "amount")
    return paid.unionByName(earned).filter("amount > 0")


def coinbase_transfers(raw_: DataFrame) -> DataFrame:
    """(state_hash, receiver, amount): the first fee transfer that a block's coinbase carries, of its greatest kind of coinbase."""

    def carried(d: Column) -> Column:
        one = F.struct(get("$.coinbase[1].receiver_pk", of=d).alias("receiver"), get("$.coinbase[1].fee", of=d).alias("fee"))
        two = F.struct(get("$.coinbase[1][0].receiver_pk", of=d).alias("receiver"), get("$.coinbase[1][0].fee", of=d).alias("fee"))
        flat_two = F.struct(get("$.coinbase[1].receiver_pk", of=d).alias("receiver"), get("$.coinbase[1].fee", of=d).alias("fee"))
        kind = get("$.coinbase[0]", of=d)
        return F.when(kind == "One", F.struct(F.lit(1).alias("rank"), one.alias("t"))).when(kind == "Two", F.struct(F.lit(2).alias("rank"), F.when(two["receiver"].isNotNull(), two).otherwise(flat_two).alias("t"))).otherwise(F.struct(F.lit(0).alias("rank"), one.alias("t")))

    most = F.array_max(F.transform(F.filter(_diffs(), lambda d: get("$.coinbase[0]", of=d).isNotNull()), carried))
    rows = raw_.select("state_hash", most.alias("most")).filter("most.rank > 0 and most.t.receiver is not null")
    return rows.select("state_hash", F.col("most.t.receiver").alias("receiver"), nano(F.col("most.t.fee")).alias("amount"))


def internal_commands(raw_: DataFrame) -> DataFrame:
    """(height, state_hash, kind, sender, receiver, amount): coinbases, fee transfers and those via the coinbase.

    Fee transfers with one sender and receiver are one command. The first fee transfer that the coinbase pays with the
    receiver and amount that it carries is a transfer via the coinbase instead, and is not merged with others.
    """
    own = blocks(raw_)
    base = own.filter("coinbase > 0").select("height", "state_hash", F.lit("Coinbase").alias("kind"), F.lit(None).cast("string").alias("sender"), F.col("coinbase_receiver").alias("receiver"), F.col("coinbase").alias("amount"))
    fees = fee_changes(user_commands(raw_), snarks(raw_), own)
    carried = coinbase_transfers(raw_).withColumn("via", F.lit(True)).join(own.select("state_hash", F.col("coinbase_receiver").alias("sender")), "state_hash")
    fees = fees.join(carried, ["state_hash", "sender", "receiver", "amount"], "left")
    # A prover is paid once in a block, and a payer at most in both diffs: the first of equal changes is replaced.
    first = F.col("via") & (F.row_number().over(Window.partitionBy("state_hash", "sender", "receiver", "amount").orderBy("step")) == 1)
    fees = fees.withColumn("kind", F.when(first, "Fee_transfer_via_coinbase").otherwise("Fee_transfer"))
    merged = fees.groupBy("height", "state_hash", "kind", "sender", "receiver").agg(F.sum("amount").alias("amount"))
    return base.unionByName(merged)
