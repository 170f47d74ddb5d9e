"""Queries of the entry points over the driver's tables, beside those of ``analogues``, each with its SQL.

``orders`` stand for blocks, ``lineitem`` for commands and works, ``customer`` for accounts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.analogues import _DIFFS, _FOLD, _PAIRS, _cents, _diffs, _pairs, _t, query
from ledgerloom.plans import chain, contracts, ledger, listings

_BLOCKS = """b AS (SELECT o_orderkey AS state_hash, o_orderkey - 1 AS parent_hash, o_orderkey // 2 AS height, CAST(round(o_totalprice * 100) AS BIGINT) AS vrf, o_orderkey * 3 AS global_slot, o_orderkey * 3 AS slot_since_fork,
year(o_orderdate)::BIGINT AS epoch, day(o_orderdate)::BIGINT AS epoch_slot, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400000 AS date_time_ms, o_custkey AS creator, o_orderkey % 2 = 0 AS canonical, o_orderpriority = '1-URGENT' AS supercharged, o_orderkey * 1000 AS total_currency FROM orders)"""
_COMMANDS = """c AS (SELECT l_orderkey * 8 + l_linenumber AS txn_hash, l_orderkey AS state_hash, o.height, l_orderkey * 3 AS global_slot, o.date_time_ms, l_suppkey AS sender, l_partkey AS receiver, CAST(round(l_tax * 100) AS BIGINT) AS fee, year(l_shipdate)::BIGINT AS epoch, coalesce(o.canonical, false) AS canonical, l_returnflag <> 'R' AS applied, l_quantity > 40 AS is_zkapp FROM lineitem LEFT JOIN b o ON o.state_hash = l_orderkey)"""
_WORKS = "w AS (SELECT l_suppkey AS prover, l_orderkey AS state_hash, l_orderkey // 2 AS height, l_linenumber % 3 AS idx, min(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS fee, bool_or(l_linestatus = 'F') AS canonical, min(year(l_shipdate))::BIGINT AS epoch FROM lineitem GROUP BY 1, 2, 3, 4)"
_INTERNAL = "i AS (SELECT l_orderkey // 2 AS height, l_orderkey AS state_hash, CASE WHEN l_returnflag = 'A' THEN 'Coinbase' ELSE 'Fee_transfer' END AS kind, l_partkey AS receiver, l_linenumber AS idx, year(l_shipdate)::BIGINT AS epoch, l_linestatus = 'F' AS canonical FROM lineitem WHERE l_linenumber <= 2)"
_ACCOUNTS = "a AS (SELECT c_custkey AS pk, c_nationkey AS token, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, c_custkey % 7 AS nonce, c_mktsegment = 'BUILDING' AS is_zkapp, c_custkey % 11 * 10 AS locked, c_name AS username FROM customer)"


def _blocks(spark, sf_dir):
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(
        k.alias("state_hash"), (k - 1).alias("parent_hash"), F.floor(k / 2).alias("height"), _cents("o_totalprice").alias("vrf"), (k * 3).alias("global_slot"), (k * 3).alias("slot_since_fork"),
        F.year("o_orderdate").cast("long").alias("epoch"), F.dayofmonth("o_orderdate").cast("long").alias("epoch_slot"), (F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 86_400_000).alias("date_time_ms"),
        F.col("o_custkey").alias("creator"), (k % 2 == 0).alias("canonical"), (F.col("o_orderpriority") == "1-URGENT").alias("supercharged"), (k * 1000).alias("total_currency"),
    )


def _commands(spark, sf_dir):
    k = F.col("l_orderkey")
    own = _t(spark, sf_dir, "lineitem").select(
        (k * 8 + F.col("l_linenumber")).alias("txn_hash"), k.alias("state_hash"), (k * 3).alias("global_slot"), F.col("l_suppkey").alias("sender"), F.col("l_partkey").alias("receiver"), _cents("l_tax").alias("fee"),
        F.year("l_shipdate").cast("long").alias("epoch"), (F.col("l_returnflag") != "R").alias("applied"), (F.col("l_quantity") > 40).alias("is_zkapp"), F.array(F.struct(F.col("l_partkey").alias("pk"), F.lit("t").alias("token"))).alias("receivers"),
    )
    return listings.with_canonicity(own, _blocks(spark, sf_dir), "height", "date_time_ms")


def _works(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("prover"), F.col("l_orderkey").alias("state_hash"), F.floor(F.col("l_orderkey") / 2).alias("height"), (F.col("l_linenumber") % 3).alias("idx"), _cents(F.col("l_extendedprice") * F.col("l_discount")).alias("fee"), (F.col("l_linestatus") == "F").alias("canonical"), F.year("l_shipdate").cast("long").alias("epoch"))
    return li.groupBy("prover", "state_hash", "height", "idx").agg(F.min("fee").alias("fee"), F.bool_or("canonical").alias("canonical"), F.min("epoch").alias("epoch"))


def _internal(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "Coinbase").otherwise("Fee_transfer")
    return _t(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(F.floor(F.col("l_orderkey") / 2).alias("height"), F.col("l_orderkey").alias("state_hash"), kind.alias("kind"), F.col("l_partkey").alias("receiver"), F.col("l_linenumber").alias("idx"), F.year("l_shipdate").cast("long").alias("epoch"), (F.col("l_linestatus") == "F").alias("canonical"))


def _accounts(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_nationkey").alias("token"), _cents("c_acctbal").alias("balance"), (F.col("c_custkey") % 7).alias("nonce"), (F.col("c_mktsegment") == "BUILDING").alias("is_zkapp"), (F.col("c_custkey") % 11 * 10).alias("locked"), F.col("c_name").alias("username"))


def _sorted(rows: DataFrame, root: str, columns: list[str], asked: dict | None = None, limit: int = 100) -> DataFrame:
    """The page of every order of a root, both ways."""
    pages = [listings.page(rows, root, asked, sort, up, limit).withColumn("sorted", F.lit(f"{sort} {'asc' if up else 'desc'}")) for sort in listings.ROOTS[root].orders for up in (False, True)]
    return reduce(DataFrame.unionAll, pages).select(*columns, "sorted")


def _sql(tables: str, columns: str, source: str, orders: dict[str, str], limit: int = 100) -> str:
    page = "(SELECT {c}, '{n} {w}' AS sorted FROM {s} ORDER BY {o} LIMIT {l})"
    way = lambda keys, w: ", ".join(f"{k} {w}" for k in keys.split(", "))
    return f"WITH {tables} " + " UNION ALL ".join("SELECT * FROM " + page.format(c=columns, n=n, w=w, s=source, o=way(o, w), l=limit) for n, o in orders.items() for w in ("desc", "asc"))


@query(_sql(_BLOCKS, "state_hash, height, global_slot, creator", "b WHERE canonical AND height >= 10", {"height": "height, state_hash", "global_slot": "global_slot, state_hash"}))
def blocks_page(spark, sf_dir):
    return _sorted(_blocks(spark, sf_dir), "blocks", ["state_hash", "height", "global_slot", "creator"], {"canonical": True, "height_gte": 10})


@query(f"WITH {_BLOCKS} SELECT state_hash, height, creator FROM b WHERE height = 40 ORDER BY height DESC, canonical DESC, vrf DESC, state_hash DESC LIMIT 1")
def block_at_height(spark, sf_dir):
    return listings.block(_blocks(spark, sf_dir), {"height": 40}).select("state_hash", "height", "creator")


@query(_sql(f"{_BLOCKS}, {_COMMANDS}", "txn_hash, state_hash, height, canonical", "c WHERE applied AND NOT is_zkapp AND (fee >= 2 OR canonical)", {"height": "height, txn_hash, state_hash", "global_slot": "global_slot, txn_hash, state_hash", "date_time": "date_time_ms, txn_hash, state_hash"}))
def commands_page(spark, sf_dir):
    return _sorted(_commands(spark, sf_dir), "commands", ["txn_hash", "state_hash", "height", "canonical"], {"applied": True, "is_zkapp": False, "or": [{"fee_gte": 2}, {"canonical": True}]})


@query(f"WITH {_BLOCKS}, {_COMMANDS} SELECT txn_hash, state_hash, height, canonical, n.s_name AS sender_name FROM c LEFT JOIN supplier n ON n.s_suppkey = sender")
def commands_in_context(spark, sf_dir):
    names = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pk"), F.col("s_name").alias("username"))
    return listings.with_names(_commands(spark, sf_dir), names, sender="sender_name").select("txn_hash", "state_hash", "height", "canonical", "sender_name")


@query(f"WITH {_BLOCKS} SELECT l_partkey AS txn_hash, state_hash, l_suppkey AS sender FROM lineitem JOIN b ON state_hash = l_orderkey WHERE l_partkey = 7 ORDER BY height DESC, vrf DESC, state_hash DESC, l_suppkey DESC LIMIT 1")
def best_containing_block(spark, sf_dir):
    held = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("txn_hash"), F.col("l_orderkey").alias("state_hash")).agg(F.max("l_suppkey").alias("sender"))
    return listings.command(held, _blocks(spark, sf_dir), 7).select("txn_hash", "state_hash", "sender")


@query(_sql(_INTERNAL, "height, state_hash, kind, receiver", "i WHERE kind = 'Coinbase' AND height < (SELECT max(height) // 2 FROM i)", {"height": "height, state_hash, kind, receiver"}))
def internal_commands_page(spark, sf_dir):
    rows = _internal(spark, sf_dir)
    middle = rows.agg(F.floor(F.max("height") / 2)).first()[0] or 0
    return _sorted(rows, "internal_commands", ["height", "state_hash", "kind", "receiver"], {"kind": "Coinbase", "height_lt": middle})


@query(_sql(_WORKS, "height, state_hash, prover, idx, fee", "w WHERE canonical", {"height": "height, state_hash, prover, idx"}))
def snarks_page(spark, sf_dir):
    return _sorted(_works(spark, sf_dir), "snarks", ["height", "state_hash", "prover", "idx", "fee"], {"canonical": True})


@query(_sql(_ACCOUNTS, "pk, token, balance, username", "a WHERE balance <> 0 AND NOT is_zkapp", {"balance": "balance, pk, token"}))
def accounts_page(spark, sf_dir):
    return _sorted(_accounts(spark, sf_dir), "accounts", ["pk", "token", "balance", "username"], {"balance_ne": 0, "is_zkapp": False})


@query(_sql(_ACCOUNTS, "pk, token, balance", "a WHERE token = 3", {"balance": "balance, pk, token"}))
def holders_page(spark, sf_dir):
    return _sorted(_accounts(spark, sf_dir), "holders", ["pk", "token", "balance"], {"token": 3})


@query(_sql(_ACCOUNTS, "pk, nonce, balance", "a", {"balance": "balance, nonce, pk"}))
def staged_accounts_page(spark, sf_dir):
    return _sorted(_accounts(spark, sf_dir), "staged_accounts", ["pk", "nonce", "balance"])


@query(_sql(f"{_ACCOUNTS}, u AS (SELECT s_nationkey AS token, count(*) AS txns FROM supplier GROUP BY 1), t AS (SELECT token, sum(balance)::BIGINT AS supply, count(*) AS holders, coalesce(any_value(txns), 0) AS txns FROM a LEFT JOIN u USING (token) GROUP BY 1)", "token, supply, holders, txns", "t", {"supply": "supply, token", "holders": "holders, token", "txns": "txns, token"}, 5))
def tokens_page(spark, sf_dir):
    used = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("token")).agg(F.count(F.lit(1)).alias("txns"))
    held = _accounts(spark, sf_dir).groupBy("token").agg(F.sum("balance").alias("supply"), F.count(F.lit(1)).alias("holders"))
    return _sorted(held.join(used, "token", "left").na.fill(0, ["txns"]), "tokens", ["token", "supply", "holders", "txns"], limit=5)


@query(_sql(f"{_ACCOUNTS}, d AS (SELECT c_nationkey + 1 AS pk, sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS total FROM customer GROUP BY 1), s AS (SELECT pk, balance, coalesce(total, 0)::BIGINT AS total_delegated FROM a LEFT JOIN d USING (pk))", "pk, balance, total_delegated", "s", {"stake": "total_delegated, pk", "balance": "balance, pk"}))
def stakes_page(spark, sf_dir):
    own = _accounts(spark, sf_dir)
    held = ledger.delegations(own.select((F.col("token") + 1).cast("long").alias("delegate"), "balance")).select(F.col("delegate").alias("pk"), "total_delegated")
    return _sorted(own.join(held, "pk", "left").na.fill(0, ["total_delegated"]), "stakes", ["pk", "balance", "total_delegated"])


@query("SELECT DISTINCT c_custkey AS pk, c_nationkey AS token, n_regionkey AS owner, n_name AS symbol FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def tokens_used(spark, sf_dir):
    tokens = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("token"), F.col("n_regionkey").alias("owner"), F.col("n_name").alias("symbol"))
    return listings.tokens_used(_accounts(spark, sf_dir), tokens)


@query("SELECT o_orderkey AS state_hash, o_custkey AS pk FROM orders UNION SELECT l_orderkey, l_suppkey FROM lineitem UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 2")
def public_keys(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "state_hash")
    return listings.public_keys((_blocks(spark, sf_dir), "creator"), (li, "l_suppkey"), (_internal(spark, sf_dir), "receiver"))


_E = """eb AS (SELECT epoch, count(*) AS blocks, count(*) FILTER (canonical) AS canonical_blocks, count(*) FILTER (supercharged) AS supercharged_blocks, count(DISTINCT epoch_slot) AS slots FROM b GROUP BY 1),
es AS (SELECT epoch, count(*) AS snarks, count(*) FILTER (canonical) AS canonical_snarks FROM w GROUP BY 1), ei AS (SELECT epoch, count(*) AS internal_commands, count(*) FILTER (canonical) AS canonical_internal_commands FROM i GROUP BY 1),
ec AS (SELECT epoch, count(*) AS user_commands, count(*) FILTER (is_zkapp) AS zkapp_commands FROM c GROUP BY 1)"""
_FIVE = f"{_BLOCKS}, {_COMMANDS}, {_WORKS}, {_INTERNAL}"
_BUNDLE = listings.BUNDLE
_FOUND = ", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in (*_BUNDLE, "slots"))


@query(f"WITH {_FIVE}, {_E}, e AS (SELECT epoch, {_FOUND} FROM eb FULL JOIN es USING (epoch) FULL JOIN ec USING (epoch) FULL JOIN ei USING (epoch)) SELECT epoch, {', '.join(f'{n} AS epoch_{n}' for n in (*_BUNDLE, 'slots'))}, {', '.join(f'(sum({n}) OVER ())::BIGINT AS total_{n}' for n in _BUNDLE)} FROM e")
def count_bundle(spark, sf_dir):
    return listings.count_bundle(*(f(spark, sf_dir) for f in (_blocks, _works, _commands, _internal)))


_USER = {"user": "true", "applied_user": "applied", "failed_user": "NOT applied", "canonical_user": "canonical", "applied_canonical_user": "applied AND canonical", "failed_canonical_user": "NOT applied AND canonical"}
_TOTALS = ", ".join(f"(SELECT count(*) FROM c WHERE {w}) AS total_{n}_commands, (SELECT count(*) FROM c WHERE {w} AND is_zkapp) AS total_{n.replace('user', 'zkapp')}_commands" for n, w in _USER.items())
_OF_TIP = ", ".join(f"(SELECT count(*) FROM {t} WHERE epoch = tip.epoch AND {w}) AS epoch_{n}" for n, t, w in (("blocks", "b", "true"), ("canonical_blocks", "b", "b.canonical"), ("snarks", "w", "true"), ("user_commands", "c", "true"), ("zkapp_commands", "c", "is_zkapp"), ("internal_commands", "i", "true")))


@query(f"""WITH {_FIVE}, {_ACCOUNTS}, tip AS (SELECT * FROM b ORDER BY height DESC, vrf DESC, state_hash DESC LIMIT 1)
SELECT state_hash, parent_hash AS previous_state_hash, height AS blockchain_length, strftime(make_timestamp(date_time_ms * 1000), '%Y-%m-%dT%H:%M:%S.000Z') AS date_time, epoch, global_slot,
(CASE WHEN global_slot <= 564479 THEN global_slot % 7140 ELSE (global_slot - 420) % 7140 END)::BIGINT AS slot, total_currency, {_OF_TIP}, {_TOTALS},
(SELECT count(*) FROM b) AS total_blocks, (SELECT count(*) FROM b WHERE b.canonical) AS total_canonical_blocks, (SELECT count(*) FROM b WHERE b.supercharged) AS total_supercharged_blocks,
(SELECT count(*) FROM w) AS total_snarks, (SELECT count(*) FROM w WHERE w.canonical) AS total_canonical_snarks, (SELECT count(*) FROM i) AS total_internal_commands, (SELECT count(*) FROM i WHERE i.canonical) AS total_canonical_internal_commands,
(SELECT count(*) FROM a) AS total_accounts, (SELECT count(*) FROM a WHERE token = 0) AS total_native_accounts, (SELECT count(*) FROM a WHERE is_zkapp) AS total_zkapp_accounts, (SELECT count(*) FROM a WHERE is_zkapp AND token = 0) AS total_native_zkapp_accounts,
(SELECT coalesce(sum(locked), 0)::BIGINT FROM a WHERE token = 0) AS locked_supply, (SELECT count(DISTINCT b.creator) FROM b WHERE b.height > tip.height - 500) AS unique_block_producers, (total_currency - (SELECT coalesce(sum(locked), 0)::BIGINT FROM a WHERE token = 0))::BIGINT AS circulating_supply FROM tip""")
def chain_summary(spark, sf_dir):
    return listings.summary(*(f(spark, sf_dir) for f in (_blocks, _works, _commands, _internal, _accounts)), native=0)


@query(f"WITH RECURSIVE b AS MATERIALIZED ({_PAIRS}), t AS (SELECT id, height FROM b ORDER BY height DESC, id DESC LIMIT 1), a(id, parent, height) AS (SELECT id, parent, height FROM b WHERE id = (SELECT id FROM t) UNION ALL SELECT b.id, b.parent, b.height FROM b JOIN a ON b.id = a.parent) SELECT id AS state_hash, height, height = (SELECT height FROM t) - 10 AS is_root FROM a WHERE height > 20 AND height <= (SELECT height FROM t) - 10")
def canonical_update(spark, sf_dir):
    """The canonical root moves from height 20."""
    return chain.canonical_update(_pairs(spark, sf_dir).withColumn("vrf", F.lit(0)), 20)


@query(f"WITH RECURSIVE b AS MATERIALIZED ({_PAIRS}), a(id, parent, height, n) AS (SELECT * FROM (SELECT id, parent, height, 1 FROM b ORDER BY height DESC, id DESC LIMIT 1) UNION ALL SELECT b.id, b.parent, b.height, n + 1 FROM b JOIN a ON b.id = a.parent WHERE n < 50) SELECT id AS state_hash, height FROM a")
def best_chain(spark, sf_dir):
    return chain.best_chain(_pairs(spark, sf_dir).withColumn("vrf", F.lit(0)), 50).select("state_hash", "height")


@query(f"WITH RECURSIVE {_DIFFS}, o AS MATERIALIZED (SELECT o_orderkey AS id, o_orderkey - 1 - (o_orderkey % 7 = 3)::INT AS parent FROM orders), a(id, parent) AS (SELECT id, parent FROM o WHERE id = (SELECT max(id) FROM o) UNION ALL SELECT o.id, o.parent FROM o JOIN a ON o.id = a.parent) {_FOLD.format(rows='(SELECT x.* FROM x JOIN a ON a.id = h)')}")
def staged_at_block(spark, sf_dir):
    """The ledger after the last order, on a chain that leaves every seventh order out."""
    k = F.col("o_orderkey")
    b = _t(spark, sf_dir, "orders").select(k.cast("string").alias("state_hash"), (k - 1 - (k % 7 == 3).cast("int")).cast("string").alias("parent_hash"), k.alias("height"))
    tip = b.agg(F.max_by("state_hash", "height").alias("state_hash"))
    return ledger.at_block(b, _diffs(spark, sf_dir), tip).drop("token")


@query(f"""WITH {_DIFFS}, y AS (SELECT pk, h, phase, 0 AS seq, sub, d, nonce, delegate, false AS raised FROM x UNION ALL SELECT user_id, event_id // 100, 0, event_id % 100 + 1, 1, -CAST(round(value * 100) AS BIGINT), NULL, NULL, false FROM events WHERE event_id % 13 = 0 UNION ALL SELECT user_id, event_id // 100, 0, event_id % 100 + 1, 2, CAST(round(value * 100) AS BIGINT) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END, NULL, CASE WHEN event_id % 11 = 0 THEN event_id % 50 END, event_id % 3 = 0 FROM events),
z AS (SELECT *, h * 10000 + phase * 1000 + seq * 2 + sub AS ord FROM y), n AS (SELECT pk, arg_max(nonce, ord) FILTER (nonce IS NOT NULL) AS base, max(ord) FILTER (nonce IS NOT NULL) AS since FROM z GROUP BY 1), m AS (SELECT pk, count(*) FILTER (raised AND (since IS NULL OR ord > since)) AS more FROM z JOIN n USING (pk) GROUP BY 1),
f AS (SELECT *, sum(d) OVER (PARTITION BY pk ORDER BY ord ROWS UNBOUNDED PRECEDING) AS low FROM z)
SELECT CAST(pk AS VARCHAR) AS pk, (sum(d) - least(min(low), 0))::BIGINT AS balance, (coalesce(any_value(base), 0) + any_value(more))::BIGINT AS nonce, CAST(coalesce(arg_max(delegate, ord) FILTER (delegate IS NOT NULL), pk) AS VARCHAR) AS delegate, min(h) AS since FROM f JOIN n USING (pk) JOIN m USING (pk) GROUP BY pk""")
def accounts_with_updates(spark, sf_dir):
    at = F.col("event_id")
    updates = _t(spark, sf_dir, "events").select(at.cast("string").alias("state_hash"), F.floor(at / 100).alias("height"), (at % 100 + 1).alias("seq"), F.lit(0).alias("sub_seq"), F.col("user_id").alias("pk"), F.lit("native").alias("token"), (_cents("value") * F.when(at % 2 == 0, -1).otherwise(1)).alias("delta"), F.when(at % 11 == 0, at % 50).alias("delegate"), (at % 3 == 0).alias("increments"), F.when(at % 13 == 0, _cents("value")).alias("creation_fee"))
    return contracts.accounts_with_updates(_diffs(spark, sf_dir), updates).select("pk", "balance", "nonce", "delegate", "since")


@query(f"WITH {_DIFFS}, s AS (SELECT pk, h, phase, sub, d, (h + 999) // 1000 * 1000 AS upto, sum(d) OVER w AS s FROM x WINDOW w AS (PARTITION BY pk ORDER BY h, phase, sub ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, s - least(min(s) OVER (PARTITION BY pk ORDER BY h, phase, sub ROWS UNBOUNDED PRECEDING), 0) AS balance FROM s) SELECT CAST(pk AS VARCHAR) AS pk, upto::BIGINT AS height, balance::BIGINT AS balance FROM f QUALIFY row_number() OVER (PARTITION BY pk, upto ORDER BY h DESC, phase DESC, sub DESC) = 1")
def ledger_snapshots(spark, sf_dir):
    return ledger.snapshots(_diffs(spark, sf_dir)).select("pk", "height", "balance")
