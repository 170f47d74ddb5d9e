"""Queries of accounts over time and of stored ledgers over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators.analogues import _DIFFS, _FOLD, _cents, _diffs, _t, query
from ledgerloom.operators.roots import _ACCOUNTS, _BLOCKS, _COMMANDS, _INTERNAL, _WORKS, _accounts, _blocks, _commands, _internal, _works
from ledgerloom.plans import chain, counters, history, ledger, listings, views

#: Every change with the account after it, balances with the floor of 0.
_AFTER = f"""{_DIFFS}, s AS (SELECT *, sum(d) OVER w AS s, last_value(nonce IGNORE NULLS) OVER w AS n, last_value(delegate IGNORE NULLS) OVER w AS g FROM x WINDOW w AS (PARTITION BY pk ORDER BY h, phase, sub ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, (s - least(min(s) OVER (PARTITION BY pk ORDER BY h, phase, sub ROWS UNBOUNDED PRECEDING), 0))::BIGINT AS balance FROM s),
l AS (SELECT CAST(h AS VARCHAR) AS state_hash, CAST(pk AS VARCHAR) AS pk, h AS height, balance, coalesce(n, 0)::BIGINT AS nonce, CAST(coalesce(g, pk) AS VARCHAR) AS delegate FROM f QUALIFY row_number() OVER (PARTITION BY pk, h ORDER BY phase DESC, sub DESC) = 1)"""


@query(f"WITH {_AFTER} SELECT * FROM l")
def balances_after_blocks(spark, sf_dir):
    return history.after_blocks(_diffs(spark, sf_dir)).drop("token")


@query(f"WITH {_AFTER}, r AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS pk, event_id * 37 % (SELECT max(o_orderkey) FROM orders) AS height FROM events) SELECT id, r.pk, r.height, l.balance, l.nonce, l.delegate, l.height AS since FROM r ASOF LEFT JOIN l ON r.pk = l.pk AND r.height >= l.height")
def accounts_as_of(spark, sf_dir):
    """The account of every event's user at a height of its own."""
    diffs = _diffs(spark, sf_dir)
    top = F.broadcast(_t(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("top")))  # one row
    asked = _t(spark, sf_dir, "events").crossJoin(top).select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("pk"), (F.col("event_id") * 37 % F.col("top")).alias("height"))
    return history.accounts_at(asked, diffs)


_UPDATES = "u AS (SELECT user_id AS pk, event_id // 4 AS height, event_id % 4 AS seq, CASE WHEN event_id % 3 = 0 THEN event_type END AS symbol, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 9 AS VARCHAR) END AS uri FROM events)"
_INTERVALS = """p AS (SELECT pk, height, seq, 'symbol' AS field, symbol AS value FROM {u} WHERE symbol IS NOT NULL UNION ALL SELECT pk, height, seq, 'uri', uri FROM {u} WHERE uri IS NOT NULL),
q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY pk, field, height ORDER BY seq DESC) = 1)
SELECT pk, field, value, height AS since, lead(height) OVER (PARTITION BY pk, field ORDER BY height) AS until FROM q"""


def _updates(spark, sf_dir):
    at = F.col("event_id")
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("pk"), F.floor(at / 4).alias("height"), (at % 4).alias("seq"), F.when(at % 3 == 0, F.col("event_type")).alias("symbol"), F.when(at % 5 == 0, (at % 9).cast("string")).alias("uri"))


@query(f"WITH {_UPDATES}, {_INTERVALS.format(u='u')}")
def field_intervals(spark, sf_dir):
    return history.intervals(_updates(spark, sf_dir), ["pk"], ["symbol", "uri"], ["height", "seq"])


@query(f"WITH {_UPDATES}, m AS (SELECT max(height) - 1000 AS fork FROM u), v AS (SELECT u.* REPLACE (CASE WHEN height > fork AND symbol IS NOT NULL THEN 'branch' ELSE symbol END AS symbol) FROM u, m WHERE height <= fork OR seq <> 0), {_INTERVALS.format(u='v')}")
def field_intervals_after_reorganisation(spark, sf_dir):
    """The last 1000 heights are taken back; on the branch each block has one update less and other symbols."""
    own, place = _updates(spark, sf_dir), ["height", "seq"]
    fork = own.agg(F.max("height") - 1000).first()[0]
    branch = own.filter((F.col("height") > fork) & (F.col("seq") != 0)).withColumn("symbol", F.when(F.col("symbol").isNotNull(), F.lit("branch")))
    held = chain._cut(history.intervals(own, ["pk"], ["symbol", "uri"], place))
    return history.reorganised(held, fork, branch, ["pk"], ["symbol", "uri"], place)


_CHAIN = "o AS MATERIALIZED (SELECT o_orderkey AS id, o_orderkey - 1 - (o_orderkey % 7 = 3)::INT AS parent FROM orders), a(id, parent) AS (SELECT id, parent FROM o WHERE id = (SELECT max(id) FROM o) UNION ALL SELECT o.id, o.parent FROM o JOIN a ON o.id = a.parent)"


@query(f"WITH RECURSIVE {_DIFFS}, {_CHAIN} {_FOLD.format(rows='(SELECT x.* FROM x JOIN a ON a.id = h)')}")
def staged_from_nearest(spark, sf_dir):
    """The ledger after the last order, from the nearest ledger that was stored on its own branch."""
    k = F.col("o_orderkey")
    b = chain._cut(_t(spark, sf_dir, "orders").select(k.cast("string").alias("state_hash"), (k - 1 - (k % 7 == 3).cast("int")).cast("string").alias("parent_hash"), k.alias("height")))
    diffs = _diffs(spark, sf_dir)
    tip = chain._cut(b.agg(F.max_by("state_hash", "height").alias("state_hash"), F.max("height").alias("height")))
    on_chain = F.col("height") % 7 != 2  # every seventh order is left out
    on_chain = chain._cut(b.filter(on_chain).select("state_hash", "height"))
    ends = on_chain.filter(F.col("height") <= F.lit(tip.first().height) - 1000).orderBy(F.col("height").desc()).limit(1)
    at = ends.first()
    if at is None:
        return ledger.at_block(b, diffs, tip).drop("token")
    start = ledger.accounts(diffs.join(on_chain, ["state_hash", "height"], "left_semi"), at.height)
    kept = chain._cut(start.select(F.lit(at.state_hash).alias("state_hash"), F.lit(at.height).alias("height"), "*"))
    return ledger.at_block_from(b, diffs, tip, kept).drop("token")


@query(f"WITH {_DIFFS}, s AS (SELECT *, sum(d) OVER w AS s, last_value(nonce IGNORE NULLS) OVER w AS n, last_value(delegate IGNORE NULLS) OVER w AS g, min(h) OVER w AS since FROM x WINDOW w AS (PARTITION BY pk ORDER BY h, phase, sub ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, (s - least(min(s) OVER (PARTITION BY pk ORDER BY h, phase, sub ROWS UNBOUNDED PRECEDING), 0))::BIGINT AS balance FROM s), t AS (SELECT max(h) // 1000 * 500 AS at FROM x) SELECT CAST(pk AS VARCHAR) AS pk, balance, coalesce(n, 0)::BIGINT AS nonce, CAST(coalesce(g, pk) AS VARCHAR) AS delegate, since FROM f, t WHERE h <= t.at QUALIFY row_number() OVER (PARTITION BY pk ORDER BY h DESC, phase DESC, sub DESC) = 1")
def stored_ledger(spark, sf_dir):
    """The ledger stored about the middle of heights, from full-state snapshots of every 500."""
    diffs = _diffs(spark, sf_dir)
    at = diffs.agg(F.floor(F.max("height") / 1000) * 500).first()[0]
    return ledger.stored(ledger.snapshots(diffs, 500), at).drop("token")


@query("""WITH b AS (SELECT o_orderkey AS state_hash, year(o_orderdate)::BIGINT AS epoch, o_custkey AS creator FROM orders), l AS (SELECT year(s_.d)::BIGINT AS epoch, c_custkey AS pk, c_custkey % 40 + 1 AS delegate, CAST(round(c_acctbal * 100) AS BIGINT) + 1000000 + year(s_.d) AS balance FROM customer, (SELECT DISTINCT make_date(year(o_orderdate), 1, 1) AS d FROM orders WHERE year(o_orderdate) <> 1995) s_),
w AS (SELECT epoch, sum(balance)::BIGINT AS total FROM l GROUP BY 1), h AS (SELECT epoch, delegate, sum(balance)::BIGINT AS delegated, count(*) AS delegators FROM l GROUP BY 1, 2)
SELECT state_hash, b.epoch, CASE WHEN total IS NOT NULL THEN 'jx' || b.epoch END AS ledger_hash, CASE WHEN total IS NOT NULL THEN coalesce(delegated, 0) END::BIGINT AS delegated, CASE WHEN total IS NOT NULL THEN coalesce(delegators, 0) END::BIGINT AS delegators, total, CASE WHEN total IS NOT NULL THEN round_even(coalesce(delegated, 0) / total * 100, 2) END AS share FROM b LEFT JOIN w ON w.epoch = b.epoch LEFT JOIN h ON h.epoch = b.epoch AND h.delegate = b.creator""")
def stakes_of_block_epochs(spark, sf_dir):
    """Each order's stake in the ledger of its year; 1995 has none."""
    o = _t(spark, sf_dir, "orders")
    year = F.year("o_orderdate").cast("long")
    b = o.select(F.col("o_orderkey").alias("state_hash"), F.lit("g").alias("genesis_state_hash"), year.alias("epoch"), F.col("o_custkey").alias("creator"))
    epochs = o.select(year.alias("epoch")).distinct().filter("epoch <> 1995")  # one a year
    c = _t(spark, sf_dir, "customer").crossJoin(F.broadcast(epochs))
    held = c.select(F.concat(F.lit("jx"), F.col("epoch").cast("string")).alias("ledger_hash"), F.lit("g").alias("genesis_state_hash"), "epoch", F.col("c_custkey").alias("pk"), (F.col("c_custkey") % 40 + 1).alias("delegate"), (_cents("c_acctbal") + 1_000_000 + F.col("epoch")).alias("balance"))
    return counters.stakes_of_blocks(b, held)


_EPOCH = "(SELECT max(year(o_orderdate)) FROM orders)"
_COUNTED = ", ".join(f"count(*) FILTER (name = '{n}' AND epoch = {_EPOCH}) AS epoch_num_{n}, count(*) FILTER (name = '{n}') AS total_num_{n}" for n in counters.COUNTED)
_SHOWN = ", ".join(f"coalesce(epoch_num_{n}, 0) AS epoch_num_{n}, coalesce(total_num_{n}, 0) AS total_num_{n}" for n in counters.COUNTED)


@query(f"""WITH {_ACCOUNTS}, r AS (SELECT o_custkey AS pk, 'blocks' AS name, year(o_orderdate) AS epoch FROM orders UNION ALL SELECT l_suppkey, 'snarks', year(l_shipdate) FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_suppkey, 'user_commands', year(l_shipdate) FROM lineitem UNION ALL SELECT l_partkey, 'user_commands', year(l_shipdate) FROM lineitem
UNION ALL SELECT l_suppkey, 'zkapp_commands', year(l_shipdate) FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT l_partkey, 'internal_commands', year(l_shipdate) FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT pk, {_COUNTED} FROM r GROUP BY 1)
SELECT a.pk, greatest(balance - CASE WHEN token = 0 AND a.pk % 2 = 0 THEN 1000000000 ELSE 0 END, CASE WHEN token = 0 AND a.pk % 2 = 0 THEN 0 ELSE balance END) AS balance, username, {_SHOWN}, (SELECT count(*) FROM a) AS total_num_accounts, (SELECT count(*) FROM a WHERE is_zkapp) AS total_num_zkapp_accounts FROM a LEFT JOIN n USING (pk)""")
def account_view(spark, sf_dir):
    """Accounts with their twelve counters; those of odd keys have paid for their creation."""
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    year = lambda c: F.year(c).cast("long").alias("epoch")
    line = lambda pk, where="true": li.filter(where).select(F.col(pk).alias("pk"), year("l_shipdate"))
    tables = {
        "blocks": o.select(F.col("o_custkey").alias("pk"), year("o_orderdate")), "snarks": line("l_suppkey", "l_linenumber = 1"), "user_commands": line("l_suppkey").unionAll(line("l_partkey")),
        "zkapp_commands": line("l_suppkey", "l_quantity > 40"), "internal_commands": line("l_partkey", "l_linenumber <= 2"),
    }
    now = o.agg(F.max(F.year("o_orderdate"))).first()[0]
    own = _accounts(spark, sf_dir).withColumn("token", F.when(F.col("token") == 0, "native").otherwise(F.col("token").cast("string")))
    shown = history.displayed(own, own.filter("pk % 2 = 1").select("pk"))
    return counters.account_view(shown, tables, F.lit(now)).drop("token", "nonce", "is_zkapp", "locked")


_UNITS = "rtrim(rtrim(printf('%d.%09d', CAST({n} // 1000000000 AS BIGINT), CAST({n} % 1000000000 AS BIGINT)), '0'), '.')"


@query(f"""WITH {_BLOCKS}, {_COMMANDS}, {_WORKS}, {_INTERNAL}, cc AS (SELECT state_hash, count(*) AS n, count(*) FILTER (is_zkapp) AS z, sum(fee)::BIGINT AS fees, min(txn_hash) AS first FROM c GROUP BY 1), ww AS (SELECT state_hash, count(*) AS n, sum(fee)::BIGINT AS fees FROM w GROUP BY 1),
ii AS (SELECT state_hash, count(*) AS n, max(receiver) FILTER (kind = 'Fee_transfer') AS last FROM i GROUP BY 1), eb AS (SELECT epoch, count(*) AS n FROM b GROUP BY 1)
SELECT b.state_hash, b.canonical, b.height AS block_height, strftime(make_timestamp(date_time_ms * 1000), '%Y-%m-%dT%H:%M:%S.000Z') AS date_time, b.creator, s_name AS creator_name, {_UNITS.format(n='coalesce(cc.fees, 0)')} AS tx_fees, {_UNITS.format(n='coalesce(ww.fees, 0)')} AS snark_fees,
coalesce(ww.n, 0) AS block_num_snarks, coalesce(cc.n, 0) AS block_num_user_commands, coalesce(cc.z, 0) AS block_num_zkapp_commands, coalesce(ii.n, 0) AS block_num_internal_commands, eb.n AS epoch_blocks, cc.first AS first_command, ii.last AS last_transfer, b.parent_hash AS previous
FROM b LEFT JOIN cc USING (state_hash) LEFT JOIN ww USING (state_hash) LEFT JOIN ii USING (state_hash) LEFT JOIN eb ON eb.epoch = b.epoch LEFT JOIN supplier ON s_suppkey = b.creator""")
def block_views(spark, sf_dir):
    """Blocks as they are shown; of their nested parts the counts, the first command and the last fee transfer."""
    b, c, w, i = (f(spark, sf_dir) for f in (_blocks, _commands, _works, _internal))
    names = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pk"), F.col("s_name").alias("username"))
    shown = c.select("state_hash", F.col("txn_hash").alias("seq"), "txn_hash", "sender", "fee", "applied", "is_zkapp")
    out = views.blocks(b, shown, w, i.withColumn("amount", F.col("idx")), listings.count_bundle(b, w, c, i), names)
    last = F.array_max(F.transform(F.filter("transactions.fee_transfer", lambda t: t["kind"] == "Fee_transfer"), lambda t: t["recipient"]))
    return out.select(
        "state_hash", "canonical", "block_height", "date_time", F.col("creator.public_key").alias("creator"), F.col("creator.username").alias("creator_name"), "tx_fees", "snark_fees", "block_num_snarks", "block_num_user_commands", "block_num_zkapp_commands",
        "block_num_internal_commands", F.col("num_epoch_blocks").alias("epoch_blocks"), F.get("transactions.user_commands", F.lit(0))["txn_hash"].alias("first_command"), last.alias("last_transfer"), F.col("protocol_state.previous_state_hash").alias("previous"),
    )


@query(f"WITH {_BLOCKS}, {_COMMANDS}, m AS (SELECT max(global_slot) AS top FROM b), e AS (SELECT (SELECT min(global_slot) FROM b, m WHERE global_slot >= top // 3 + 1) AS low, (SELECT max(global_slot) FROM b, m WHERE global_slot <= top // 2 + 1) AS high) SELECT txn_hash, state_hash, global_slot FROM c, e WHERE global_slot BETWEEN low AND high")
def commands_by_date(spark, sf_dir):
    """Commands between two dates, each snapped to a produced slot."""
    b = _blocks(spark, sf_dir)
    top, genesis = b.agg(F.max("global_slot")).first()[0], 1_000
    found = views.commands_between(_commands(spark, sf_dir), b, genesis, genesis + (top // 3 + 1) * 180_000 + 5, genesis + (top // 2 + 1) * 180_000 + 179_999)
    return found.select("txn_hash", "state_hash", "global_slot")
