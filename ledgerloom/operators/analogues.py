"""Queries over the driver's tables, one for each operator of the ledger engine, each with its SQL.

``events`` stands for the command stream (event_id the sequence, user_id the account), ``orders`` and ``lineitem`` for
blocks and their commands, ``customer`` and ``supplier`` for accounts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, codecs
from ledgerloom.plans import chain, contracts, counters, ledger
from ledgerloom.plans.predicates import ACTIONS, listing, predicate


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("long")


QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_id >= (SELECT max(event_id) // 10 FROM events) AND event_id < (SELECT max(event_id) // 10 * 9 FROM events) AND event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100")
def bounded_scan_top_k(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    tenth = e.agg(F.floor(F.max("event_id") / 10)).first()[0] or 0
    found = listing(e, {"event_id_gte": tenth, "event_id_lt": 9 * tenth, "event_type": "purchase"}, [F.col("ts").desc(), F.col("event_id")])
    return found.select("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type FROM events WHERE (event_type = 'error' OR (value >= 50 AND user_id < 10)) AND event_id <> 7")
def nested_predicate(spark, sf_dir):
    found = _t(spark, sf_dir, "events").filter(predicate({"or": [{"event_type": "error"}, {"value_gte": 50, "user_id_lt": 10}], "event_id_ne": 7}))
    return found.select("event_id", "user_id", "event_type")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE 'customer#00000001%'")
def username_prefix(spark, sf_dir):
    return _t(spark, sf_dir, "customer").filter(predicate({"c_name_prefix": "CUSTOMER#00000001"})).select("c_custkey", "c_name")


@query("SELECT o_custkey AS pk, o_orderkey AS block, 'from' AS side FROM orders UNION ALL SELECT l_suppkey, l_orderkey, 'to' FROM lineitem")
def from_to_union(spark, sf_dir):
    sent = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pk"), F.col("o_orderkey").alias("block"), F.lit("from").alias("side"))
    return sent.unionAll(_t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pk"), F.col("l_orderkey").alias("block"), F.lit("to").alias("side")))


@query("SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS epoch, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS total, max(value) AS most, min(value) AS least FROM events GROUP BY ALL")
def epoch_counters(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("epoch", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("long"))
    return e.groupBy("user_id", "epoch").agg(F.count(F.lit(1)).alias("n"), F.sum(_cents("value")).alias("total"), F.max("value").alias("most"), F.min("value").alias("least"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT hour(ts)) AS slots FROM events GROUP BY ALL")
def epoch_distinct_slots(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.countDistinct(F.hour("ts")).alias("slots"))


@query("SELECT count(DISTINCT user_id) AS producers FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500")
def unique_producers(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id")
    top = F.broadcast(e.agg(F.max("event_id").alias("top")))  # one row
    return e.join(top, F.col("event_id") > F.col("top") - 500).agg(F.countDistinct("user_id").alias("producers"))


@query("SELECT l_suppkey, sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT))::BIGINT AS fees, count(*) AS works FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_fees(spark, sf_dir):
    own = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(_cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("fees"), F.count(F.lit(1)).alias("works"))
    return own.orderBy(F.col("fees").desc(), "l_suppkey").limit(10)


@query("SELECT c_nationkey AS delegate, sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS total_delegated, count(*) AS delegators, round_even(sum(CAST(round(c_acctbal * 100) AS BIGINT)) / (SELECT sum(CAST(round(c_acctbal * 100) AS BIGINT)) FROM customer) * 100, 2) AS share FROM customer GROUP BY 1")
def delegation_shares(spark, sf_dir):
    return ledger.delegations(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("delegate"), _cents("c_acctbal").alias("balance")))


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def decorated_lookup(spark, sf_dir):
    o, c, n = (_t(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def anti_new_rows(spark, sf_dir):
    heavy = _t(spark, sf_dir, "lineitem").filter("l_quantity > 49")
    return _t(spark, sf_dir, "part").join(heavy, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_created(spark, sf_dir):
    done = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return _t(spark, sf_dir, "customer").join(done, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_account(spark, sf_dir):
    return ledger.latest(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("SELECT event_id, user_id, sum(CAST(round(value * 100) AS BIGINT)) OVER w::BIGINT AS total, max(value) OVER w AS most, min(value) OVER w AS least, row_number() OVER w AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_fees(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", _cents("value").alias("cents"), "value")
    out = ledger.running(e, ["user_id"], F.to_date("ts"), ["ts", "event_id"], {"total": F.col("cents")}, {"most": F.col("value")}, {"least": F.col("value")})
    return out.select("event_id", "user_id", "total", "most", "least", "nth")


@query("WITH d AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END * CAST(round(value * 100) AS BIGINT) AS d FROM events), s AS (SELECT user_id, d, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM d) SELECT user_id, (sum(d) - least(min(s), 0))::BIGINT AS balance FROM s GROUP BY 1")
def saturating_fold(spark, sf_dir):
    delta = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0) * _cents("value")
    return ledger.saturating_balance(_t(spark, sf_dir, "events"), ["user_id"], "event_id", delta, block=1024)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("event_id") % 7 == 3, F.col("event_id") - 2).otherwise(F.col("event_id") - 1)
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("state_hash"), parent.alias("parent_hash"), F.floor(F.col("event_id") / 2).alias("height"), F.col("value").alias("vrf"))


_TREE = "SELECT event_id AS id, CASE WHEN event_id % 7 = 3 THEN event_id - 2 ELSE event_id - 1 END AS parent, event_id // 2 AS height, value FROM events"
_BEST = "ORDER BY height DESC, value DESC, id DESC LIMIT 1"


@query(f"WITH RECURSIVE b AS MATERIALIZED ({_TREE}), a AS (SELECT id, parent FROM b WHERE id = (SELECT id FROM b {_BEST}) UNION ALL SELECT b.id, b.parent FROM b JOIN a ON b.id = a.parent) SELECT b.id AS state_hash, b.height, CASE WHEN a.id IS NOT NULL THEN 'Canonical' ELSE 'Orphaned' END AS canonicity FROM b LEFT JOIN a ON a.id = b.id")
def ancestor_walk(spark, sf_dir):
    return chain.canonicity(_blocks(spark, sf_dir)).select("state_hash", "height", "canonicity")


@query(f"WITH b AS ({_TREE}) SELECT id AS state_hash, height FROM b {_BEST}")
def fork_choice(spark, sf_dir):
    return chain.best_block(_blocks(spark, sf_dir)).select("state_hash", "height")


@query(f"WITH RECURSIVE b AS MATERIALIZED ({_TREE}), n AS (SELECT id, parent FROM b WHERE id = (SELECT id FROM b {_BEST}) UNION ALL SELECT b.id, b.parent FROM b JOIN n ON b.id = n.parent), o AS (SELECT id, parent FROM b WHERE id = (SELECT id FROM b WHERE id NOT IN (SELECT id FROM n) {_BEST}) UNION ALL SELECT b.id, b.parent FROM b JOIN o ON b.id = o.parent) SELECT id AS state_hash, 'unapply' AS change FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'apply' FROM n WHERE id NOT IN (SELECT id FROM o)")
def reorganisation(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    ready = chain.contracted(b)
    return chain.reorganisation(b, *chain.rivals(b, ready), ready).select("state_hash", "change")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_scalar(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT o_orderkey, (CASE WHEN d < 400 THEN 1000000 ELSE greatest(1000000 - (d - 400) // 30 * 12345, 0) END)::BIGINT AS locked FROM (SELECT o_orderkey, greatest(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate), 0) AS d FROM orders)")
def vesting(spark, sf_dir):
    day = F.greatest(F.datediff("o_orderdate", F.lit("1992-01-01")), F.lit(0))
    return _t(spark, sf_dir, "orders").select("o_orderkey", amounts.minimum_balance(day, F.lit(1_000_000), F.lit(400), F.lit(30), F.lit(12_345)).cast("long").alias("locked"))


@query("SELECT (SELECT count(*) FROM orders) AS blocks, (SELECT count(*) FROM lineitem) AS commands, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS failed, (SELECT max(o_orderkey) FROM orders) AS height, (SELECT sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT FROM customer) AS supply")
def summary(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("blocks"), F.max("o_orderkey").alias("height"))
    li = _t(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("commands"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    c = _t(spark, sf_dir, "customer").agg(F.sum(_cents("c_acctbal")).alias("supply"))
    return o.crossJoin(li).crossJoin(c).select("blocks", "commands", "failed", "height", "supply")  # a row each


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS applied_canonical, count(*) AS every FROM lineitem GROUP BY 1")
def applied_failed_counts(spark, sf_dir):
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(r == "R").alias("failed"), F.count_if((r != "R") & (s == "F")).alias("applied_canonical"), F.count(F.lit(1)).alias("every"))


@query("SELECT l_suppkey, count(*) AS works FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def deduplicated_works(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").dropDuplicates(["l_suppkey", "l_orderkey", "l_partkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("works"))


@query("SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous, min(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM events")
def neighbour_slots(spark, sf_dir):
    return ledger.neighbours(_t(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", F.floor(F.col("event_id") / 65_536))


@query("WITH g AS (SELECT year(l_shipdate) AS epoch, l_suppkey, sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT))::BIGINT AS total, count(*) AS works FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY total DESC, l_suppkey) AS nth FROM g QUALIFY nth <= 5")
def top_fees_per_epoch(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("epoch", F.year("l_shipdate").cast("long"))
    return counters.top_per_epoch(li, "epoch", "l_suppkey", _cents(F.col("l_extendedprice") * F.col("l_discount")), 5)


@query("WITH h AS (SELECT c_nationkey AS token, sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS supply, count(*) AS holders FROM customer GROUP BY 1), u AS (SELECT s_nationkey AS token, count(*) AS txns FROM supplier GROUP BY 1) SELECT token, coalesce(supply, 0) AS supply, coalesce(holders, 0) AS holders, coalesce(txns, 0) AS txns FROM h FULL JOIN u USING (token)")
def token_table(spark, sf_dir):
    held = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("token"), _cents("c_acctbal").alias("balance"))
    return counters.tokens(held, _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("token")))


@query("SELECT l_orderkey, l_linestatus, l_suppkey, sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT))::BIGINT AS fees FROM lineitem GROUP BY ALL HAVING fees <> 0")
def payer_fees(spark, sf_dir):
    return counters.payer_fees(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linestatus", "l_suppkey"], _cents(F.col("l_extendedprice") * F.col("l_tax")))


@query("SELECT l_suppkey AS receiver, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS amount, count(DISTINCT l_partkey) AS senders FROM lineitem GROUP BY 1")
def merged_transfers(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return counters.merged_transfers(li.select(F.col("l_partkey").alias("sender"), F.col("l_suppkey").alias("receiver"), _cents("l_extendedprice").alias("amount")))


@query("SELECT l_partkey AS txn_hash, l_orderkey AS state_hash, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC) AS nth, count(*) OVER (PARTITION BY l_partkey) AS blocks FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)")
def containing_blocks(spark, sf_dir):
    held = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("txn_hash"), F.col("l_orderkey").alias("state_hash"))
    return counters.containing_blocks(held, F.col("state_hash"), F.floor(F.col("state_hash") / 65_536))


@query("WITH c AS (SELECT o_orderkey AS h, o_custkey AS s, o_custkey % 100 + 1 AS r, CAST(round(o_totalprice * 100) AS BIGINT) AS a, o_orderstatus <> 'P' AS ok FROM orders), x AS (SELECT s AS pk, h, 0 AS phase, CASE WHEN ok THEN -a ELSE 0 END AS d, h + 1 AS n FROM c UNION ALL SELECT r, h, 0, a, NULL FROM c WHERE ok UNION ALL SELECT s, h, 2, -10, NULL FROM c UNION ALL SELECT s_suppkey, s_suppkey, 1, 72000, NULL FROM supplier), p AS (SELECT pk, d, n, sum(d) OVER (PARTITION BY pk ORDER BY h, phase, d DESC ROWS UNBOUNDED PRECEDING) AS low FROM x) SELECT pk, (sum(d) - least(min(low), 0))::BIGINT AS balance, max(n) AS nonce FROM p GROUP BY 1")
def staged_balances(spark, sf_dir):
    return counters.folded(_changes(spark, sf_dir))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), F.lit(0).alias("seq"), F.col("o_custkey").alias("sender"), (F.col("o_custkey") % 100 + 1).alias("receiver"), _cents("o_totalprice").alias("amount"), F.lit(10).alias("fee"), F.col("o_orderkey").alias("nonce"), (F.col("o_orderstatus") != "P").alias("applied"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("height"), F.lit("coinbase").alias("kind"), F.col("s_suppkey").alias("receiver"), F.lit(72_000).alias("amount"))
    return counters.account_changes(o, s)


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commands, one in each block: a payment, or a delegation where the priority is 1-URGENT; open ones fail."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Delegation").otherwise("Payment")
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("state_hash"), F.col("o_orderkey").alias("height"), F.lit(0).alias("seq"), kind.alias("kind"), F.col("o_custkey").alias("sender"), (F.col("o_custkey") % 100 + 1).alias("receiver"), _cents("o_totalprice").alias("amount"), F.col("o_orderkey").alias("nonce"), (F.col("o_orderstatus") != "O").alias("applied"))


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    fees = o.select(F.col("o_orderkey").cast("string").alias("state_hash"), F.col("o_orderkey").alias("height"), F.lit(0).alias("step"), F.col("o_custkey").alias("sender"), F.lit(7).alias("receiver"), F.lit(10).alias("amount"))
    made = o.select(F.col("o_orderkey").cast("string").alias("state_hash"), F.col("o_orderkey").alias("height"), F.lit("7").alias("coinbase_receiver"), F.when(F.col("o_orderkey") % 2 == 0, 720).otherwise(0).alias("coinbase"))
    return ledger.account_diffs(_commands(spark, sf_dir), fees, made)


_DIFFS = """c AS (SELECT o_orderkey AS h, o_custkey AS s, o_custkey % 100 + 1 AS r, CAST(round(o_totalprice * 100) AS BIGINT) AS a, o_orderstatus <> 'O' AS ok, o_orderpriority = '1-URGENT' AS del FROM orders),
x AS (SELECT r AS pk, h, 0 AS phase, 0 AS sub, a AS d, NULL AS nonce, NULL AS delegate FROM c WHERE ok AND NOT del UNION ALL SELECT s, h, 0, 1, -a, h + 1, NULL FROM c WHERE ok AND NOT del UNION ALL SELECT s, h, 0, 0, 0, h + 1, CASE WHEN ok THEN r END FROM c WHERE del OR NOT ok
UNION ALL SELECT 7, h, 1, 0, 720, NULL, NULL FROM c WHERE h % 2 = 0 UNION ALL SELECT 7, h, 2, 0, 10, NULL, NULL FROM c UNION ALL SELECT s, h, 2, 1, -10, NULL, NULL FROM c)"""
_FOLD = "SELECT CAST(pk AS VARCHAR) AS pk, (sum(d) - least(min(low), 0))::BIGINT AS balance, coalesce(max(nonce), 0)::BIGINT AS nonce, CAST(coalesce(arg_max(delegate, h) FILTER (delegate IS NOT NULL), pk) AS VARCHAR) AS delegate, min(h) AS since FROM (SELECT *, sum(d) OVER (PARTITION BY pk ORDER BY h, phase, sub ROWS UNBOUNDED PRECEDING) AS low FROM {rows}) GROUP BY pk"


@query(f"WITH {_DIFFS} {_FOLD.format(rows='x')}")
def account_fold(spark, sf_dir):
    return ledger.accounts(_diffs(spark, sf_dir)).drop("token")


@query(f"WITH {_DIFFS} {_FOLD.format(rows='x')}")
def staged_from_snapshot(spark, sf_dir):
    diffs = _diffs(spark, sf_dir)
    middle = _t(spark, sf_dir, "orders").agg(F.floor(F.max("o_orderkey") / 2)).first()[0]
    return ledger.from_snapshot(chain._cut(ledger.accounts(diffs, middle)), middle, diffs).drop("token")


@query(f"WITH {_DIFFS}, m AS (SELECT max(h) // 2 AS m FROM c), k AS ({_FOLD.format(rows='(SELECT x.* FROM x, m WHERE h <= m)')}), t AS (SELECT DISTINCT CAST(pk AS VARCHAR) AS pk FROM x, m WHERE h > m) SELECT t.pk, k.balance, k.nonce, k.delegate, k.since IS NULL AS gone FROM t LEFT JOIN k USING (pk)")
def apply_unapply(spark, sf_dir):
    middle = _t(spark, sf_dir, "orders").agg(F.floor(F.max("o_orderkey") / 2)).first()[0]
    return ledger.unapplied(_diffs(spark, sf_dir), middle).select("pk", "balance", "nonce", "delegate", "gone")


@query("SELECT CAST(o_custkey AS VARCHAR) AS pk, o_orderkey AS height, CAST(o_custkey % 100 + 1 AS VARCHAR) AS delegate, o_orderkey + 1 AS nonce FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O'")
def delegation_diff(spark, sf_dir):
    return _diffs(spark, sf_dir).filter("kind = 'Delegation'").select("pk", "height", "delegate", "nonce")


# A tree of two blocks a height, both above one of the height before.
_PAIRS = "SELECT event_id AS id, event_id // 2 AS height, CASE WHEN event_id // 2 > 0 THEN 2 * (event_id // 2 - 1) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END END AS parent FROM events"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = F.floor(F.col("event_id") / 2)
    parent = F.when(height > 0, 2 * (height - 1) + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0))
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("state_hash"), parent.alias("parent_hash"), height.alias("height"))


@query(f"WITH RECURSIVE b AS MATERIALIZED ({_PAIRS}), r(id, height, nth) AS (SELECT id, height, row_number() OVER (ORDER BY id) FROM b WHERE height = 0 UNION ALL SELECT b.id, b.height, row_number() OVER (ORDER BY r.nth, b.id) FROM r JOIN b ON b.parent = r.id AND b.height = r.height + 1), t AS (SELECT id AS tip, height AS top FROM r ORDER BY height DESC, nth DESC LIMIT 1), a(id, parent) AS (SELECT id, parent FROM b WHERE id = (SELECT tip FROM t) UNION ALL SELECT b.id, b.parent FROM b JOIN a ON b.id = a.parent) SELECT b.id AS state_hash, b.height, a.id IS NOT NULL AS on_chain, CASE WHEN b.height >= (SELECT top FROM t) - 9 THEN 'Recent' WHEN a.id IS NOT NULL THEN 'Canonical' ELSE 'Orphaned' END AS status FROM b LEFT JOIN a ON a.id = b.id")
def canonical_discovery(spark, sf_dir):
    return chain.discovery(_pairs(spark, sf_dir), F.lit(True)).select("state_hash", "height", "on_chain", "status")


_WORKS = "SELECT l_suppkey AS prover, l_orderkey AS height, l_linenumber % 3 AS idx, CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS fee, l_linestatus = 'F' AS canonical, year(l_shipdate)::BIGINT AS epoch FROM lineitem"


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("prover"), F.col("l_orderkey").alias("height"), (F.col("l_linenumber") % 3).alias("idx"), _cents(F.col("l_extendedprice") * F.col("l_discount")).alias("fee"), (F.col("l_linestatus") == "F").alias("canonical"), F.year("l_shipdate").cast("long").alias("epoch"))


@query(f"WITH w AS ({_WORKS}), n AS (SELECT prover, height, idx, bool_or(canonical) AS canonical, min(epoch) AS epoch FROM w GROUP BY ALL) SELECT epoch, prover AS pk, count(*) AS works, count(*) FILTER (canonical) AS canonical_works, grouping(epoch)::INT AS all_epochs, grouping(prover)::INT AS all_pks FROM n GROUP BY CUBE (epoch, prover)")
def snark_counts(spark, sf_dir):
    own = counters.new_works(_works(spark, sf_dir))
    return counters.grouped_counts(own, {"works": F.lit(True), "canonical_works": F.col("canonical")}, pk="prover").select("epoch", "pk", "works", "canonical_works", F.col("all_epochs").cast("int").alias("all_epochs"), F.col("all_pks").cast("int").alias("all_pks"))


@query("SELECT year(o_orderdate)::BIGINT AS epoch, o_custkey AS pk, count(*) AS every, count(*) FILTER (o_orderstatus <> 'O') AS applied, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderpriority = '1-URGENT') AS delegations, count(*) FILTER (o_orderkey % 2 = 0) AS canonical, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderstatus = 'O') AS failed_canonical, grouping(year(o_orderdate))::INT AS all_epochs, grouping(o_custkey)::INT AS all_pks FROM orders GROUP BY CUBE (year(o_orderdate), o_custkey)")
def command_counts(spark, sf_dir):
    failed, canonical = F.col("o_orderstatus") == "O", F.col("o_orderkey") % 2 == 0
    own = _t(spark, sf_dir, "orders").withColumn("epoch", F.year("o_orderdate").cast("long"))
    found = counters.grouped_counts(own, {"every": F.lit(True), "applied": ~failed, "failed": failed, "delegations": F.col("o_orderpriority") == "1-URGENT", "canonical": canonical, "failed_canonical": canonical & failed}, pk="o_custkey")
    return found.withColumns({"all_epochs": F.col("all_epochs").cast("int"), "all_pks": F.col("all_pks").cast("int")})


@query(f"WITH w AS ({_WORKS}), g AS (SELECT epoch, prover, sum(fee)::BIGINT AS total, max(fee) AS most, min(fee) AS least, count(*) AS works FROM w WHERE canonical GROUP BY ALL) SELECT * FROM g UNION ALL SELECT NULL, prover, sum(total)::BIGINT, max(most), min(least), sum(works)::BIGINT FROM g GROUP BY prover")
def prover_fees(spark, sf_dir):
    return counters.prover_fees(_works(spark, sf_dir)).select("epoch", "prover", "total", "most", "least", "works")


@query(f"WITH w AS ({_WORKS} WHERE l_linestatus = 'F'), g AS (SELECT prover, sum(fee)::BIGINT AS total, max(fee) AS most, min(fee) AS least, count(*) AS works FROM w GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, prover) AS a, row_number() OVER (ORDER BY total, prover) AS b, row_number() OVER (ORDER BY most DESC, prover) AS c, row_number() OVER (ORDER BY most, prover) AS d, row_number() OVER (ORDER BY least DESC, prover) AS e, row_number() OVER (ORDER BY least, prover) AS f FROM g) SELECT * EXCLUDE (a, b, c, d, e, f), 'total desc' AS sorted FROM r WHERE a <= 10 UNION ALL SELECT * EXCLUDE (a, b, c, d, e, f), 'total asc' FROM r WHERE b <= 10 UNION ALL SELECT * EXCLUDE (a, b, c, d, e, f), 'most desc' FROM r WHERE c <= 10 UNION ALL SELECT * EXCLUDE (a, b, c, d, e, f), 'most asc' FROM r WHERE d <= 10 UNION ALL SELECT * EXCLUDE (a, b, c, d, e, f), 'least desc' FROM r WHERE e <= 10 UNION ALL SELECT * EXCLUDE (a, b, c, d, e, f), 'least asc' FROM r WHERE f <= 10")
def top_snarkers(spark, sf_dir):
    fees = counters.prover_fees(_works(spark, sf_dir))
    tops = [counters.top_provers(fees, by, ascending=up, limit=10).withColumn("sorted", F.lit(f"{by} {'asc' if up else 'desc'}")) for by in ("total", "most", "least") for up in (False, True)]
    return reduce(DataFrame.unionAll, tops).select("prover", "total", "most", "least", "works", "sorted")


@query("WITH b AS (SELECT o_custkey AS pk, count(*) AS blocks, count(*) FILTER (o_orderkey % 2 = 0) AS canonical_blocks, count(DISTINCT day(o_orderdate)) AS slots FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), s AS (SELECT c_custkey % 50 + 1 AS pk, sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS delegated, count(*) AS delegators FROM customer GROUP BY 1) SELECT pk, blocks, canonical_blocks, slots, coalesce(delegated, 0) AS delegated, coalesce(delegators, 0) AS delegators FROM b LEFT JOIN s USING (pk) ORDER BY canonical_blocks DESC, pk LIMIT 100")
def top_stakers(spark, sf_dir):
    made = _t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("epoch"), F.col("o_custkey").alias("creator"), (F.col("o_orderkey") % 2 == 0).alias("canonical"), F.dayofmonth("o_orderdate").alias("epoch_slot"))
    held = _t(spark, sf_dir, "customer").select(F.lit(1995).alias("epoch"), (F.col("c_custkey") % 50 + 1).alias("delegate"), _cents("c_acctbal").alias("balance"))
    return counters.top_stakers(made, held, 1995)


@query("WITH o AS (SELECT o_custkey AS pk, count(*) AS sent, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderkey % 2 = 0) AS canonical FROM orders GROUP BY 1), l AS (SELECT l_suppkey AS pk, count(*) AS works, sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT))::BIGINT AS fees FROM lineitem GROUP BY 1) SELECT c_custkey AS pk, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, coalesce(sent, 0) AS sent, coalesce(failed, 0) AS failed, coalesce(canonical, 0) AS canonical, coalesce(works, 0) AS works, coalesce(fees, 0)::BIGINT AS fees FROM customer LEFT JOIN o ON o.pk = c_custkey LEFT JOIN l ON l.pk = c_custkey")
def account_counters(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pk")).agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("o_orderstatus") == "O").alias("failed"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("canonical"))
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pk")).agg(F.count(F.lit(1)).alias("works"), F.sum(_cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("fees"))
    of = lambda df, c: df.select("pk", F.col(c).alias("n"))
    held = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"), _cents("c_acctbal").alias("balance"))
    return counters.with_counters(held, {c: of(o, c) for c in ("sent", "failed", "canonical")} | {c: of(li, c) for c in ("works", "fees")})


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, strftime(ts, '%a, ') || day(ts)::VARCHAR || strftime(ts, ' %b %Y %H:%M:%S +0000') AS rfc FROM events")
def dates(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _t(spark, sf_dir, "events").select("event_id", amounts.iso_date(ms).alias("iso"), amounts.rfc2822_date(ms).alias("rfc"))


@query("SELECT o_orderkey, (CASE WHEN o_orderkey * 11 <= 564479 THEN o_orderkey * 11 % 7140 ELSE (o_orderkey * 11 - 420) % 7140 END)::BIGINT AS epoch_slot, (CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1440000000000 ELSE 720000000000 END)::BIGINT AS coinbase FROM orders")
def slots_and_coinbases(spark, sf_dir):
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", amounts.epoch_slot(k * 11).alias("epoch_slot"), amounts.coinbase(k % 3, k % 2 == 0).alias("coinbase"))


@query("SELECT event_id, (SELECT max(s) FROM (SELECT DISTINCT l_orderkey AS s FROM lineitem) WHERE s <= event_id * 3 + 1) AS previous, (SELECT min(s) FROM (SELECT DISTINCT l_orderkey AS s FROM lineitem) WHERE s >= event_id * 3 + 1) AS following FROM events")
def snapped_slots(spark, sf_dir):
    made = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("global_slot"))
    asked = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 3 + 1).alias("slot"))
    return counters.snapped(made, asked).select(F.col("id").alias("event_id"), "previous", "following")


@query("SELECT c_nationkey AS delegate, c_custkey AS pk, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(round(c_acctbal * 100) AS BIGINT) DESC, c_custkey) AS nth FROM customer")
def delegators(spark, sf_dir):
    return counters.delegators(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("delegate"), F.col("c_custkey").alias("pk"), _cents("c_acctbal").alias("balance")))


@query("SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS digest FROM orders")
def checked_texts(spark, sf_dir):
    """Bytes there and back through base58check, so that the digest of each number is its own."""
    text = codecs.base58check(F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary"))), 12)
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", F.lower(F.hex(codecs.from_base58check(F.col("t"))["data"])).alias("digest"))


_UPDATES = "SELECT user_id AS pk, event_type AS token, event_id AS place, CASE WHEN value >= 50 THEN CAST(event_id AS VARCHAR) END AS uri, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 100 AS VARCHAR) END AS symbol, CASE WHEN event_id % 3 = 0 THEN 's' || event_id::VARCHAR END AS first, CASE WHEN event_id % 5 = 0 THEN 't' || event_id::VARCHAR END AS second FROM events"


@query(f"WITH u AS ({_UPDATES}) SELECT pk, token, count(*) AS updates, arg_max(uri, place) FILTER (uri IS NOT NULL) AS uri, arg_max(symbol, place) FILTER (symbol IS NOT NULL) AS symbol, coalesce(arg_max(first, place) FILTER (first IS NOT NULL), '0') AS first, coalesce(arg_max(second, place) FILTER (second IS NOT NULL), '0') AS second FROM u GROUP BY pk, token")
def contract_state(spark, sf_dir):
    at = F.col("event_id")
    text = lambda c: c.cast("string")
    state = F.array(F.when(at % 3 == 0, F.concat(F.lit("s"), text(at))), F.when(at % 5 == 0, F.concat(F.lit("t"), text(at))))
    own = _t(spark, sf_dir, "events").select(F.col("user_id").alias("pk"), F.col("event_type").alias("token"), F.floor(at / 100).alias("height"), (at % 100).alias("seq"), F.when(F.col("value") >= 50, text(at)).alias("uri"), F.when(at % 7 == 0, text(at % 100)).alias("symbol"), state.alias("app_state"))
    found = contracts.contract_state(own, ["height", "seq"], ("uri", "symbol"), 2, "0")
    return found.select("pk", "token", "updates", "uri", "symbol", F.get("app_state", F.lit(0)).alias("first"), F.get("app_state", F.lit(1)).alias("second"))


@query("WITH p AS (SELECT user_id AS pk, max(event_id) AS since FROM events WHERE event_type = 'purchase' GROUP BY 1), i AS (SELECT user_id AS pk, event_id AS at FROM events WHERE event_type = 'click') SELECT pk, (coalesce(since + 1, 0) + (SELECT count(*) FROM i WHERE i.pk = k.pk AND (since IS NULL OR i.at > since)))::BIGINT AS nonce FROM (SELECT pk FROM p UNION SELECT pk FROM i) k LEFT JOIN p USING (pk)")
def update_nonces(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("pk"), F.floor(F.col("event_id") / 100).alias("height"), (F.col("event_id") % 100).alias("seq"), (F.col("event_id") + 1).alias("nonce"), "event_type")
    return contracts.update_nonces(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), ["height", "seq"], ("pk",))


@query("WITH n AS (SELECT event_id, user_id AS pk, event_type AS token, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS idx FROM events) SELECT n.pk, n.token, n.event_id AS height, n.idx, o_custkey AS creator, l_partkey AS command FROM n JOIN orders ON o_orderkey = n.event_id JOIN lineitem ON l_orderkey = n.event_id AND l_linenumber = 1 WHERE n.event_id >= 100 AND n.idx >= 1 AND n.idx < 40")
def actions(spark, sf_dir):
    """Actions are numbered over the whole table; the window is then taken from the numbered ones."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("state_hash"), F.lit(1).cast("long").alias("seq"), F.col("event_id").alias("height"), F.col("user_id").alias("pk"), F.col("event_type").alias("token"))
    own = contracts.numbered(e, ["pk", "token"], F.floor(F.col("height") / 1024), ["height"])
    own = own.filter(predicate({"start_height": 100, "start_index": 1, "end_index": 40}, ACTIONS))
    blocks = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("state_hash"), F.col("o_custkey").alias("creator"))
    commands = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("state_hash"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_partkey").alias("command"))
    return contracts.in_context(own, blocks, commands).select("pk", "token", "height", "idx", "creator", "command")


_TOKEN_CHANGES = "SELECT event_type AS token, event_id, CAST(round(value * 100) AS BIGINT) * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS delta, CASE WHEN event_id % 11 = 0 THEN user_id END AS owner, CASE WHEN event_id % 13 = 0 THEN CAST(event_id % 1000 AS VARCHAR) END AS symbol FROM events"


def _token_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id")
    return _t(spark, sf_dir, "events").select(F.col("event_type").alias("token"), "event_id", F.floor(at / 100).alias("height"), (at % 100).alias("seq"), (_cents("value") * F.when(at % 3 == 0, -1).otherwise(1)).alias("delta"), F.when(at % 11 == 0, F.col("user_id")).alias("owner"), F.when(at % 13 == 0, (at % 1000).cast("string")).alias("symbol"))


@query(f"SELECT token, event_id, delta, row_number() OVER w AS nth, sum(delta) OVER w::BIGINT AS supply FROM ({_TOKEN_CHANGES}) WINDOW w AS (PARTITION BY token ORDER BY event_id)")
def token_history(spark, sf_dir):
    return contracts.token_history(_token_changes(spark, sf_dir).select("token", "event_id", "delta"), F.floor(F.col("event_id") / 1024), ["event_id"]).select("token", "event_id", "delta", "nth", "supply")


@query(f"SELECT token, coalesce(sum(delta), 0)::BIGINT AS supply, arg_min(owner, event_id) FILTER (owner IS NOT NULL) AS owner, arg_max(symbol, event_id) FILTER (symbol IS NOT NULL) AS symbol, count(*) AS txns FROM ({_TOKEN_CHANGES}) GROUP BY token")
def token_ledger(spark, sf_dir):
    return counters.token_ledger(_token_changes(spark, sf_dir)).select("token", "supply", "owner", "symbol", "txns")


@query("SELECT user_id AS pk, arg_max(event_type, event_id) AS username, count(*) AS changes FROM events WHERE value >= 20 GROUP BY 1")
def name_changes(spark, sf_dir):
    claims = _t(spark, sf_dir, "events").filter("value >= 20").select(F.col("user_id").alias("pk"), F.col("event_type").alias("username"), F.floor(F.col("event_id") / 100).alias("height"), (F.col("event_id") % 100).alias("seq"))
    return counters.names_of(claims)


@query("WITH t AS (SELECT l_orderkey AS k, sum(CAST(round(l_tax * 100) AS BIGINT))::BIGINT AS fees FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), s AS (SELECT l_orderkey AS k, sum(CAST(round(l_discount * 100) AS BIGINT))::BIGINT AS fees FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey AS state_hash, coalesce(t.fees, 0)::BIGINT AS tx_fees, coalesce(s.fees, 0)::BIGINT AS snark_fees FROM orders LEFT JOIN t ON t.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey")
def block_fees(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    fees = lambda where, c: li.filter(where).select(F.col("l_orderkey").alias("state_hash"), _cents(c).alias("fee"))
    return counters.block_fees(fees("l_linestatus = 'O'", "l_tax"), fees("l_returnflag = 'R'", "l_discount"), _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("state_hash")))


@query("SELECT DISTINCT o_custkey AS height, year(o_orderdate)::BIGINT AS global_slot FROM orders")
def heights_and_slots(spark, sf_dir):
    return counters.slots_of_heights(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("height"), F.year("o_orderdate").cast("long").alias("global_slot")))


@query("WITH a AS (SELECT c_custkey AS pk, c_nationkey + 1 AS delegate, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer), d AS (SELECT delegate AS pk, sum(balance)::BIGINT AS total_delegated, count(*) AS delegators FROM a GROUP BY 1) SELECT pk, a.delegate, balance, coalesce(total_delegated, 0)::BIGINT AS total_delegated, coalesce(delegators, 0) AS delegators, s_name AS username FROM a LEFT JOIN d USING (pk) LEFT JOIN supplier ON s_suppkey = pk")
def stakes(spark, sf_dir):
    own = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"), (F.col("c_nationkey") + 1).alias("delegate"), _cents("c_acctbal").alias("balance"))
    names = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pk"), F.col("s_name").alias("username"))
    return counters.stakes(own, names).select("pk", "delegate", "balance", "total_delegated", "delegators", "username")


@query("SELECT year(l_shipdate)::BIGINT AS epoch, l_suppkey AS pk, count(*) AS every, count(*) FILTER (l_linestatus = 'F') AS canonical, count(*) FILTER (l_returnflag = 'R') AS coinbases, grouping(year(l_shipdate))::INT AS all_epochs, grouping(l_suppkey)::INT AS all_pks FROM lineitem GROUP BY CUBE (year(l_shipdate), l_suppkey)")
def internal_command_counts(spark, sf_dir):
    own = _t(spark, sf_dir, "lineitem").withColumn("epoch", F.year("l_shipdate").cast("long"))
    found = counters.grouped_counts(own, {"every": F.lit(True), "canonical": F.col("l_linestatus") == "F", "coinbases": F.col("l_returnflag") == "R"}, pk="l_suppkey")
    return found.withColumns({"all_epochs": F.col("all_epochs").cast("int"), "all_pks": F.col("all_pks").cast("int")})


@query("SELECT year(o_orderdate)::BIGINT AS epoch, o_custkey AS pk, count(*) AS blocks, count(*) FILTER (o_orderkey % 2 = 0) AS canonical, count(*) FILTER (o_orderpriority = '1-URGENT') AS supercharged, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0) AS canonical_supercharged, grouping(year(o_orderdate))::INT AS all_epochs, grouping(o_custkey)::INT AS all_pks FROM orders GROUP BY CUBE (year(o_orderdate), o_custkey)")
def block_counts(spark, sf_dir):
    canonical, charged = F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority") == "1-URGENT"
    own = _t(spark, sf_dir, "orders").withColumn("epoch", F.year("o_orderdate").cast("long"))
    found = counters.grouped_counts(own, {"blocks": F.lit(True), "canonical": canonical, "supercharged": charged, "canonical_supercharged": canonical & charged}, pk="o_custkey")
    return found.withColumns({"all_epochs": F.col("all_epochs").cast("int"), "all_pks": F.col("all_pks").cast("int")})


@query("WITH a AS (SELECT CAST(round(c_acctbal * 100) AS BIGINT) AS balance, c_nationkey * 1000 AS initial, c_nationkey % 4 AS token, c_custkey % 3 > 0 AS timed FROM customer), l AS (SELECT balance, CASE WHEN timed THEN greatest(initial - 100 * 20, 0) END AS locked FROM a WHERE token = 1) SELECT count(*) AS accounts, sum(balance)::BIGINT AS total, sum(locked)::BIGINT AS locked, (sum(balance) - sum(locked))::BIGINT AS circulating FROM l")
def locked_supply(spark, sf_dir):
    """Locked amounts at slot 300 of the accounts of token 1 whose cliff is 100, with a period of 10 and an increment of 100."""
    own = _t(spark, sf_dir, "customer").select(_cents("c_acctbal").alias("balance"), (F.col("c_nationkey") * 1000).alias("initial"), (F.col("c_nationkey") % 4).alias("token"), (F.col("c_custkey") % 3 > 0).alias("timed"))
    locked = amounts.minimum_balance(F.lit(300), F.col("initial"), F.lit(100), F.lit(10), F.lit(100)).cast("long")
    return contracts.locked_total(own, F.when(F.col("timed"), locked), 1)


@query("SELECT o_custkey AS pk, o_orderkey AS block, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders")
def account_ordinals(spark, sf_dir):
    own = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pk"), F.col("o_orderkey").alias("block"))
    return ledger.running(own, ["pk"], F.floor(F.col("block") / 1024), ["block"], {}, {}, {}).select("pk", "block", "nth")


@query("SELECT l_suppkey AS prover, l_orderkey AS height, o_custkey AS creator FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey")
def works_to_blocks(spark, sf_dir):
    works = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("prover"), F.col("l_orderkey").alias("height")).distinct()
    return works.join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), F.col("o_custkey").alias("creator")), "height").select("prover", "height", "creator")
