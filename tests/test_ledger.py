import datetime
import json
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, codecs, keys
from ledgerloom.operators import analogues, roots, states  # noqa: F401
from ledgerloom.plans import chain, contracts, counters, ledger, listings, predicates
from ledgerloom.plans.predicates import predicate
from ledgerloom.sources import exports, files, precomputed
from ledgerloom.streaming import ingest

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return str(v)
    return float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(analogues.QUERIES))
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = analogues.QUERIES[name](spark, DATA)
    cursor = db.execute(analogues.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = [{k: plain(v) for k, v in zip(names, row, strict=True)} for row in cursor.fetchall()]
    got = [{k: plain(v) for k, v in r.asDict().items()} for r in df.collect()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_predicates(spark):
    df = spark.createDataFrame([(1, "Ab", ["x"]), (2, "b", []), (3, None, ["y"])], "n int, s string, a array<string>")
    ids = lambda q: sorted(r.n for r in df.filter(predicate(q)).collect())
    assert ids({}) == ids(None) == ids({"n": None, "or": [], "and": []}) == [1, 2, 3]
    assert ids({"s_prefix": "a"}) == ids({"a_contains": "x"}) == [1]
    assert ids({"or": [{"n": 1}, {"n_gte": 3}], "and": [{"n_lt": 4}]}) == [1, 3]
    assert ids({"n_in": [1, 2], "n_ne": 1}) == [2]


def test_saturating_balance_is_the_ordered_fold(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, rnd.randint(-9, 8)) for i in range(400)]
    want = {"a": 0, "b": 0}
    for k, _, d in rows:
        want[k] = max(0, want[k] + d)
    got = ledger.saturating_balance(spark.createDataFrame(rows, "k string, i long, d long"), ["k"], "i", F.col("d"), block=16)
    assert {r.k: r.balance for r in got.collect()} == want


def test_chain(spark):
    rows = [("g", None, 1, b"a"), ("x", "g", 2, b"a"), ("y", "g", 2, b"b"), ("z", "x", 3, b"a")]
    b = spark.createDataFrame(rows, "state_hash string, parent_hash string, height int, vrf binary")
    assert {r.state_hash: r.canonicity for r in chain.canonicity(b).collect()} == {"g": "Canonical", "x": "Canonical", "y": "Orphaned", "z": "Canonical"}
    moves = chain.reorganisation(b, b.filter("state_hash = 'y'"), b.filter("state_hash = 'z'"))
    assert sorted((r.change, r.state_hash) for r in moves.collect()) == [("apply", "x"), ("apply", "z"), ("unapply", "y")]
    assert {(r.parent, r.child): r.nth for r in chain.children(b).collect()}[("g", "y")] == 1
    assert ingest.missing_parents(b.filter("state_hash <> 'x'")).collect() == [("x", 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_chain_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    parent, height = {0: None}, {0: 0}
    for i in range(1, 80):  # forks of several blocks
        parent[i] = rnd.choice([i - 1, max(0, i - rnd.randint(1, 12))])
        height[i] = height[parent[i]] + 1
    b = spark.createDataFrame([(i, p, height[i], rnd.randint(0, 3)) for i, p in parent.items()], "state_hash long, parent_hash long, height int, vrf int")
    rank = {r.state_hash: (r.height, r.vrf, r.state_hash) for r in b.collect()}

    def walk(i):
        return set() if i is None else {i} | walk(parent[i])

    best = max(rank, key=rank.get)
    off = max(set(rank) - walk(best), key=rank.get)
    assert {r.state_hash for r in chain.canonicity(b).collect() if r.canonicity == "Canonical"} == walk(best)
    old, new = chain.rivals(b)
    assert (old.first().state_hash, new.first().state_hash) == (off, best)
    moves = {(r.state_hash, r.change) for r in chain.reorganisation(b, old, new).collect()}
    assert moves == {(i, "unapply") for i in walk(off) - walk(best)} | {(i, "apply") for i in walk(best) - walk(off)}
    line = b.filter(F.col("state_hash").isin(walk(best)))
    assert chain.reorganisation(line, *chain.rivals(line)).filter("change = 'unapply'").count() == 0


def test_whole_chain_takes_every_event(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    rows = analogues.QUERIES["ancestor_walk"](spark, DATA).collect()
    assert len(rows) == events.count() > 600 and all(r.canonicity for r in rows)
    top = events.agg(F.max(F.floor(F.col("event_id") / 2))).first()[0]
    assert analogues.QUERIES["fork_choice"](spark, DATA).first().height == top


def test_functions(spark):
    one = spark.range(1)
    row = one.select(
        amounts.units(F.lit(1500000000)).alias("a"), amounts.units(F.lit(10000000000)).alias("b"), amounts.epoch(F.lit(7140)).alias("e"), amounts.slot(F.lit(360000), 0).alias("s"),
        amounts.minimum_balance(F.lit(25), F.lit(100), F.lit(5), F.lit(10), F.lit(20)).alias("m"), amounts.minimum_balance(F.lit(25), F.lit(100), F.lit(5), F.lit(10), F.lit(20), F.lit(10)).alias("c"), amounts.vrf_bytes(F.lit("_-8=")).alias("v"),
    ).first()
    assert (row.a, row.b, row.e, row.s, row.m, row.c, bytes(row.v)) == ("1.5", "10", 1, 2, 60, 50, b"\xff\xef")


def test_file_sources(spark, tmp_path):
    (tmp_path / "main-3-3Nabc.json").write_text(json.dumps({"parent_hash": "3Nx", "creator": "B", "global_slot": 4}))
    (tmp_path / "other.json").write_text("{}")
    assert [(r.height, r.state_hash, r.creator) for r in files.blocks(spark, str(tmp_path)).collect()] == [(3, "3Nabc", "B")]
    assert files.blocks(spark, str(tmp_path), above=3).count() == 0


def test_stream_keeps_each_block_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.ingest(ingest.stream(spark, str(tmp_path / "in"), rows.schema), "id", str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(60)
    assert sorted(r.id for r in ingest.kept(spark, str(tmp_path / "out")).collect()) == [1, 2]


def test_account_changes_follow_the_order_of_a_block(spark):
    commands = spark.createDataFrame([(1, 0, "a", "b", 5, 2, 0, True), (1, 1, "a", "c", 7, 2, 1, False), (2, 0, "b", "a", 1, 0, 4, True)], "height long, seq int, sender string, receiver string, amount long, fee long, nonce long, applied boolean")
    rewards = spark.createDataFrame([(1, "coinbase", "d", 9), (1, "fee_transfer", "d", 4)], "height long, kind string, receiver string, amount long")
    changes = counters.account_changes(commands, rewards)
    got = [(r.pk, r.phase, r.delta, r.nonce) for r in changes.filter("height = 1").orderBy("phase", "seq", "delta").collect()]
    assert got == [("a", 0, -5, 1), ("b", 0, 5, None), ("a", 0, 0, 2), ("d", 1, 9, None), ("a", 2, -4, None), ("d", 2, 4, None)]
    assert {r.pk: (r.balance, r.nonce) for r in counters.folded(changes, 2).collect()} == {"a": (1, 2), "b": (4, 5), "d": (13, None)}
    assert counters.folded(changes, 0).count() == 0


def test_folded_balances_are_the_ordered_fold(spark):
    rnd = random.Random(7)
    pks = ["a", "b", "c", None]
    commands = [(h, s, rnd.choice(pks), rnd.choice(pks), rnd.randint(0, 30), rnd.randint(0, 3), h, rnd.random() < 0.8) for h in range(60) for s in range(4)]
    rewards = [(h, "coinbase", rnd.choice(pks), 9) for h in range(60)]
    changes = counters.account_changes(spark.createDataFrame(commands, "height long, seq int, sender string, receiver string, amount long, fee long, nonce long, applied boolean"), spark.createDataFrame(rewards, "height long, kind string, receiver string, amount long"))
    for height in (20, None):
        want, nonce, fees = dict.fromkeys(pks, 0), dict.fromkeys(pks), {}
        for h in range(60 if height is None else height + 1):
            for _, _, s, r, amount, fee, n, ok in (c for c in commands if c[0] == h):
                if ok:
                    want[r] += amount
                    want[s] = max(0, want[s] - amount)
                nonce[s], fees[s] = n + 1, fees.get(s, 0) + fee
            want[rewards[h][2]] += 9
            want, fees = {k: max(0, v - fees.get(k, 0)) for k, v in want.items()}, {}
        assert {r.pk: (r.balance, r.nonce) for r in counters.folded(changes, height, block=8).collect()} == {k: (want[k], nonce[k]) for k in pks}
    assert counters.folded(changes, -1).count() == 0


def test_staged_balances_take_every_height(spark, tmp_path):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    read("orders").withColumn("o_orderkey", F.col("o_orderkey") * 100).write.parquet(str(tmp_path / "orders.parquet"))
    read("supplier").write.parquet(str(tmp_path / "supplier.parquet"))
    got = analogues.QUERIES["staged_balances"](spark, str(tmp_path)).collect()
    assert {r.pk for r in read("orders").selectExpr("o_custkey AS pk").collect()} <= {r.pk for r in got}
    assert max(r.nonce or 0 for r in got) == read("orders").agg(F.max("o_orderkey")).first()[0] * 100 + 1 > 3001
    assert min(r.balance for r in got) >= 0


def test_produced_slots_and_keys(spark):
    slots = spark.createDataFrame([(3,), (8,)], "global_slot long")
    assert [counters.produced_slots(slots, s).first() for s in (1, 3, 5, 9)] == [(None, 3), (3, 3), (3, 8), (8, None)]
    row = spark.createDataFrame([("3Nab",), ("4Nab",), ("3Na",), (None,)], "k string").select(keys.well_formed(F.col("k"), "3N", 4).alias("ok")).collect()
    assert [r.ok for r in row] == [True, False, False, False]


def test_csv_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "b", "c")], "height int, sender string, receiver string")
    exports.csv(exports.commands_of(rows, "a"), str(tmp_path / "out"), [F.col("height"), F.col("side").desc()])
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted((r.height, r.side) for r in back) == [("1", "from"), ("2", "from"), ("2", "to")]


def consensus(version, slot, creator="C", supercharge=False):
    at = "curr_global_slot" if version == 1 else "curr_global_slot_since_hard_fork"
    return {"blockchain_length": "1", "epoch_count": str(slot // 7140), "last_vrf_output": "_-8=", "total_currency": "890512012840039233", at: {"slot_number": str(slot % 7140)}, "global_slot_since_genesis": str(slot), "block_stake_winner": "W", "block_creator": creator, "coinbase_receiver": creator, "supercharge_coinbase": supercharge, "staking_epoch_data": {"ledger": {"hash": "jxL"}}}


def block_file(folder, height, name, parent, version=1, commands=(), works=(), coinbase=("One", None), post=None, slot=10, supercharge=False):
    diff = lambda c, w, b: {"commands": list(c), "completed_works": [{"fee": f, "prover": p} for p, f in w], "coinbase": list(b)}
    state = {"previous_state_hash": parent, "body": {"genesis_state_hash": "3Ngen", "blockchain_state": {"timestamp": "1643864400000", "staged_ledger_hash": {"non_snark": {"ledger_hash": "jxS"}}}, "consensus_state": consensus(version, slot, supercharge=supercharge)}}
    data = {"scheduled_time": "1643864545485", "protocol_state": state, "staged_ledger_diff": {"diff": [diff(commands, works, coinbase), None if post is None else diff(*post)]}}
    (folder / f"main-{height}-{name}.json").write_text(json.dumps(data if version == 1 else {"version": 3, "data": data}))


def signed(version, kind, sender, to, amount="5", fee="0.01", nonce="7", failed=None):
    common = {"fee": fee, "fee_payer_pk": sender, "nonce": nonce, "valid_until": "4294967295", "memo": "E4Y"}
    if kind == "Payment":
        body = ["Payment", {"receiver_pk": to, "amount": amount} | ({"source_pk": sender, "token_id": "1"} if version == 1 else {})]
    else:
        body = ["Stake_delegation", ["Set_delegate", {"new_delegate": to} | ({"delegator": sender} if version == 1 else {})]]
    bad = [failed] if version == 1 else [[[failed]], []]
    return {"data": ["Signed_command", {"payload": {"common": common, "body": body}, "signer": sender}], "status": ["Failed", bad] if failed else ["Applied"]}


def update(pk, change="0", sgn="Pos", calls=(), **sets):
    fields = {f: ["Set", sets[f]] if f in sets else ["Keep"] for f in ("delegate", "token_symbol")}
    return {"elt": {"account_update": {"body": {"public_key": pk, "token_id": "t", "update": fields, "balance_change": {"magnitude": change, "sgn": [sgn]}, "events": [["1"]], "actions": []}}, "calls": list(calls)}}


def test_block_files_of_version_1(spark, tmp_path):
    both = [signed(1, "Payment", "A", "B"), signed(1, "Payment", "A", "D", fee="0.5", failed="Too_little")]
    block_file(tmp_path, 3, "3Na", "3Np", commands=both, works=[("P", "0.2"), ("P", "0.1"), ("Q", "0")], post=([signed(1, "Delegation", "B", "E", nonce="1")], [], ["Zero"]), slot=7150, supercharge=True)
    (tmp_path / "copy").mkdir()
    block_file(tmp_path / "copy", 3, "3Na", "other")
    block_file(tmp_path, 4, "3Nb", "3Na", coinbase=("Zero",))
    (tmp_path / "notes.json").write_text("{}")
    raw = precomputed.raw(spark, str(tmp_path)).cache()
    b = {r.state_hash: r for r in precomputed.blocks(raw).collect()}
    r = b["3Na"]
    assert set(b) == {"3Na", "3Nb"} and r.parent_hash in ("3Np", "other")
    raw = precomputed.raw(spark, str(tmp_path / "*.json")).cache()
    r = {r.state_hash: r for r in precomputed.blocks(raw).collect()}["3Na"]
    assert (r.network, r.height, r.version, r.parent_hash, r.global_slot, r.slot_since_fork, r.epoch, r.creator) == ("main", 3, 1, "3Np", 7150, 10, 1, "C")
    assert (r.date_time_ms, r.supercharge, r.coinbase, int(r.total_currency), bytes(r.vrf)) == (1643864400000, True, 1_440_000_000_000, 890512012840039233, b"\xff\xef")
    own = precomputed.user_commands(raw).orderBy("seq").collect()
    assert [(c.diff_idx, c.seq, c.kind, c.sender, c.receivers[0].pk, c.amount, c.fee, c.nonce, c.applied, c.failure_reason) for c in own] == [
        (0, 0, "Payment", "A", "B", 5, 10_000_000, 7, True, None), (0, 1, "Payment", "A", "D", 5, 500_000_000, 7, False, "Too_little"), (1, 2, "Delegation", "B", "E", 0, 10_000_000, 1, True, None),
    ]
    assert [(w.idx, w.prover, w.fee) for w in precomputed.snarks(raw).orderBy("idx").collect()] == [(0, "P", 200_000_000), (1, "P", 100_000_000), (2, "Q", 0)]
    internal = sorted((c.kind, c.sender or "", c.receiver, c.amount) for c in precomputed.internal_commands(raw).collect())
    assert internal == [("Coinbase", "", "C", 1_440_000_000_000), ("Fee_transfer", "A", "C", 510_000_000), ("Fee_transfer", "B", "C", 10_000_000), ("Fee_transfer", "C", "P", 300_000_000)]
    assert precomputed.raw(spark, str(tmp_path / "*.json"), above=3).select("state_hash").collect() == [("3Nb",)]


def test_a_coinbase_carries_a_fee_transfer(spark, tmp_path):
    block_file(tmp_path, 3, "3Na", "3Np", works=[("P", "0.3"), ("Q", "0.1")], coinbase=("One", {"receiver_pk": "P", "fee": "0.3"}))
    got = sorted((c.kind, c.receiver, c.amount) for c in precomputed.internal_commands(precomputed.raw(spark, str(tmp_path))).collect())
    assert got == [("Coinbase", "C", 720_000_000_000), ("Fee_transfer", "Q", 100_000_000), ("Fee_transfer_via_coinbase", "P", 300_000_000)]


def test_block_files_of_version_2(spark, tmp_path):
    call = {"data": ["Zkapp_command", {"fee_payer": {"body": {"public_key": "F", "fee": "0.02", "nonce": "4"}}, "memo": "E4Z", "account_updates": [update("U", "9", "Neg", [update("V", "9", calls=[update("X")])], delegate="G"), update("Y", token_symbol="sym")]}], "status": ["Applied"]}
    block_file(tmp_path, 9, "3Nz", "3Ny", 2, [signed(2, "Payment", "A", "B"), signed(2, "Delegation", "A", "E", failed="Gone"), call], slot=564_500)
    raw = precomputed.raw(spark, str(tmp_path)).cache()
    r = precomputed.blocks(raw).first()
    assert (r.version, r.parent_hash, r.height, r.global_slot, r.creator) == (2, "3Ny", 9, 564_500, "C")
    own = precomputed.user_commands(raw).orderBy("seq").collect()
    assert [(c.kind, c.sender, c.fee, c.nonce, c.applied, c.failure_reason, c.is_zkapp) for c in own] == [("Payment", "A", 10_000_000, 7, True, None, False), ("Delegation", "A", 10_000_000, 7, False, "Gone", False), ("Zkapp", "F", 20_000_000, 4, True, None, True)]
    assert sorted(p.pk for p in own[2].receivers) == ["U", "V", "X", "Y"]
    assert precomputed.user_commands(raw).filter(predicates.predicate({"to": "X"}, predicates.COMMANDS)).count() == 1
    rows = {u.pk: (u.delta, u.delegate, u.symbol) for u in precomputed.zkapp_updates(raw).collect()}
    assert rows == {"U": (-9, "G", None), "V": (9, None, None), "X": (0, None, None), "Y": (0, None, "sym")}


def test_discovery_of_files(spark, tmp_path):
    for h in range(2, 22):
        block_file(tmp_path, h, f"3N{h}", f"3N{h - 1}")
    for h in (5, 15):
        block_file(tmp_path, h, f"3Nfork{h}", f"3N{h - 1}")
    b = precomputed.blocks(precomputed.raw(spark, str(tmp_path)))
    got = chain.discovery(b, F.col("genesis_state_hash") == "3Ngen").select("height", "state_hash", "status", "on_chain").collect()
    assert sorted(r.height for r in got if r.status == "Recent" and r.on_chain) == list(range(12, 22))
    assert sorted(r.height for r in got if r.status == "Canonical") == list(range(2, 12))
    assert {(r.state_hash, r.status) for r in got if not r.on_chain} == {("3Nfork5", "Orphaned"), ("3Nfork15", "Recent")}
    lost = chain.discovery(b, F.col("genesis_state_hash") == "none").select("status").distinct().collect()
    assert [r.status for r in lost] == ["Recent"]


def test_walks_over_several_segments_and_cycles(spark):
    rnd = random.Random(3)
    parent = {i: max(0, i - rnd.randint(1, 3)) for i in range(1, 300)} | {0: None}
    height = {0: 0}
    for i in range(1, 300):
        height[i] = height[parent[i]] + 1
    b = spark.createDataFrame([(i, p, height[i], rnd.randint(0, 3)) for i, p in parent.items()], "state_hash long, parent_hash long, height int, vrf int")
    ready = chain.contracted(b, 16)
    tips = b.filter("state_hash in (299, 298, 150)")
    got = {(r.tip, r.state_hash) for r in chain.ancestors(b, tips, ready).collect()}
    want = set()
    for t in (299, 298, 150):
        x = t
        while x is not None:
            want.add((t, x))
            x = parent[x]
    assert got == want
    assert {r.top for r in chain._tops(ready).collect()} == {0}
    for loop in ([(1, 1, 1, 0)], [(1, 40, 1, 0), (40, 1, 400, 0)]):
        with pytest.raises(Exception, match="its own ancestor"):
            df = spark.createDataFrame(loop, b.schema)
            chain.ancestors(df, df, chain.contracted(df, 1)).collect()


def test_accounts_fold_unapply_and_snapshot(spark):
    commands = spark.createDataFrame([("x", 1, 0, "Payment", "a", "b", 5, 0, True), ("x", 1, 1, "Delegation", "b", "c", 0, 3, True), ("y", 2, 0, "Payment", "b", "d", 2, 4, True), ("y", 2, 1, "Payment", "a", "b", 9, 1, False)], "state_hash string, height long, seq int, kind string, sender string, receiver string, amount long, nonce long, applied boolean")
    fees = spark.createDataFrame([("y", 2, 0, "b", "z", 1)], "state_hash string, height long, step int, sender string, receiver string, amount long")
    made = spark.createDataFrame([("x", 1, "z", 7), ("y", 2, "z", 0)], "state_hash string, height long, coinbase_receiver string, coinbase long")
    diffs = ledger.account_diffs(commands, fees, made)
    rows = lambda df: {r.pk: (r.balance, r.nonce, r.delegate, r.since) for r in df.collect()}
    whole = {"a": (0, 2, "a", 1), "b": (2, 5, "c", 1), "d": (2, 0, "d", 2), "z": (8, 0, "z", 1)}
    assert rows(ledger.accounts(diffs)) == whole
    assert rows(ledger.from_snapshot(ledger.accounts(diffs, 1), 1, diffs)) == whole
    back = {r.pk: (r.balance, r.nonce, r.gone) for r in ledger.unapplied(diffs, 1).collect()}
    assert back == {"a": (0, 1, False), "b": (5, 4, False), "d": (None, None, True), "z": (7, 0, False)}
    assert ledger.mismatches(ledger.accounts(diffs), spark.createDataFrame([("a", "native", 0), ("b", "native", 3)], "pk string, token string, balance long")).collect() == [("b", "native", 3, 2)]


def test_shares_are_rounded_half_to_even(spark):
    rows = spark.createDataFrame([(1250, 1_000_000), (3750, 1_000_000), (5, 0)], "part long, whole long")
    assert [r[0] for r in rows.select(ledger.share(F.col("part"), F.col("whole"))).collect()] == [0.12, 0.38, 0.0]


def test_predicates_by_field(spark):
    b = spark.createDataFrame([(1, 5, 5, "a"), (2, 6, 1, None)], "height int, global_slot int, slot_since_fork int, owner string")
    ask = lambda q, f: [r.height for r in b.filter(predicates.predicate(q, f)).collect()]
    assert ask({"global_slot": 5}, predicates.BLOCKS) == [1] and ask({"global_slot": 6}, predicates.BLOCKS) == []
    assert ask({"global_slot_gte": 5, "or": [{"height": 2}, {"height_lt": 1}]}, predicates.BLOCKS) == [2]
    assert ask({"owner": "a"}, predicates.TOKENS) == [1]
    with pytest.raises(ValueError, match="no field"):
        predicates.predicate({"hight": 1}, predicates.BLOCKS)
    assert [predicates.page_limit(n) for n in (None, 7, 1000)] == [10, 7, 100]


def test_codecs(spark):
    assert codecs.base58(b"\0\0hello") == "11Cn8eVZg" and codecs.from_base58("11Cn8eVZg") == b"\0\0hello" and codecs.from_base58("0") is None
    note = codecs.base58(bytes([20, 1, 5]) + b"Name:" + bytes(27) + b"abcd")
    df = spark.createDataFrame([(note,), ("0",), (None,)], "m string")
    assert [r[0] for r in df.select(codecs.memo(F.col("m"))).collect()] == ["Name:", "", None]
    text = df.limit(1).select(codecs.base58check(F.lit(b"xyz"), 12).alias("t")).select("t", codecs.from_base58check(F.col("t")).alias("u"), codecs.from_base58check(F.concat(F.col("t"), F.lit("1"))).alias("w")).first()
    assert (text.u.version, bytes(text.u.data), text.w) == (12, b"xyz", None)


def test_staking_and_genesis_ledgers(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "main-3-jxA.json").write_text(json.dumps([{"pk": "a", "balance": "1.5", "delegate": "b", "nonce": "4"}, {"pk": "b", "balance": "2", "token": "t", "timing": {"initial_minimum_balance": "1", "cliff_time": "5", "cliff_amount": "0", "vesting_period": "1", "vesting_increment": "0.1"}}]))
    got = {r.pk: r for r in files.staking_accounts(spark, str(tmp_path / "s")).collect()}
    assert (got["a"].balance, got["a"].delegate, got["a"].nonce, got["a"].epoch, got["a"].ledger_hash, got["a"].timing) == (1_500_000_000, "b", 4, 3, "jxA", None)
    assert (got["b"].delegate, got["b"].timing.vesting_increment, got["b"].timing.cliff_time) == ("b", 100_000_000, 5)
    assert [r.pk for r in files.staking_accounts(spark, str(tmp_path / "s"), "1").collect()] == ["a"]
    (tmp_path / "g.json").write_text(json.dumps({"genesis": {}, "ledger": {"name": "n", "accounts": [{"pk": "a", "balance": "3"}]}}))
    assert [(r.ledger, r.nth, r.pk, r.balance, r.delegate) for r in files.genesis_accounts(spark, str(tmp_path / "g.json")).collect()] == [("n", 0, "a", 3_000_000_000, "a")]


def test_stream_out_of_order_and_reorganisation(spark, tmp_path):
    root = spark.createDataFrame([(0,)], "state_hash long")
    b = spark.createDataFrame([(0, None, 0, 0), (1, 0, 1, 0), (2, 1, 2, 0), (3, 0, 1, 1), (4, 3, 2, 0), (5, 4, 3, 0)], "state_hash long, parent_hash long, height int, vrf int")
    out, old, moves = str(tmp_path / "out"), None, []
    for ids in ((0, 2), (1, 5), (3, 4)):  # 2 comes before its parent, 5 dangles until 3 and 4 are there
        b.filter(F.col("state_hash").isin(*ids)).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(ingest.stream(spark, str(tmp_path / "in"), b.schema), "state_hash", out, str(tmp_path / "state")).awaitTermination(60)
        old, passed = ingest.tip_update(ingest.kept(spark, out), root, old)
        moves.append((old.first().state_hash, sorted((r.state_hash, r.change) for r in passed.collect())))
    assert moves == [(0, [(0, "apply")]), (2, [(1, "apply"), (2, "apply")]), (5, [(1, "unapply"), (2, "unapply"), (3, "apply"), (4, "apply"), (5, "apply")])]


def test_a_batch_that_fails_midway_is_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    rows.write.parquet(str(tmp_path / "in"))

    def fail(_, number):
        raise RuntimeError("stopped")

    args = ("id", str(tmp_path / "out"), str(tmp_path / "state"))
    with pytest.raises(Exception, match="stopped"):
        ingest.ingest(ingest.stream(spark, str(tmp_path / "in"), rows.schema), *args, after=fail).awaitTermination(60)
    ingest.ingest(ingest.stream(spark, str(tmp_path / "in"), rows.schema), *args).awaitTermination(60)
    assert sorted(r.id for r in ingest.kept(spark, str(tmp_path / "out")).collect()) == [1, 2]


def test_contract_updates_of_files(spark, tmp_path):
    """Later updates win field by field, what is kept stays, and nested calls come after those above them."""

    def call(nonce, *updates):
        return {"data": ["Zkapp_command", {"fee_payer": {"body": {"public_key": "F", "fee": "0.02", "nonce": str(nonce)}}, "memo": "E4Z", "account_updates": list(updates)}], "status": ["Applied"]}

    def filled(pk, state=None, increments=False, calls=(), **fields):
        u = update(pk, calls=calls)
        body = u["elt"]["account_update"]["body"]
        body["update"] |= {k: ["Set", v] for k, v in fields.items()} | {"app_state": [["Keep"] if s is None else ["Set", s] for s in state or [None] * 8]}
        body["increment_nonce"] = increments
        return u

    first = call(4, filled("U", ["0x1", None, "0x3", *[None] * 5], True, zkapp_uri="a", verification_key={"data": "d", "hash": "h"}, calls=[filled("U", ["0x9", *[None] * 7], True)]), filled("V", zkapp_uri="v", voting_for="w"))
    block_file(tmp_path, 9, "3Nz", "3Ny", 2, [first, call(5, filled("U", zkapp_uri="b", timing={"cliff": 1}), filled("F", increments=True))], slot=564_500)
    own = precomputed.zkapp_updates(precomputed.raw(spark, str(tmp_path))).cache()
    place = ["height", "seq", "sub_seq"]
    rows = {r.pk: r for r in contracts.contract_state(own, place).collect()}
    assert rows["U"].app_state == ["0x9", contracts.ZERO, "0x3", *[contracts.ZERO] * 5]
    assert (rows["U"].updates, rows["U"].uri, rows["U"].verification_key, json.loads(rows["U"].timing), rows["U"].permissions) == (3, "b", "h", {"cliff": 1}, None)
    assert (rows["V"].uri, rows["V"].voting_for, rows["V"].delegate) == ("v", "w", None)
    payers = spark.createDataFrame([("F", "t", 9, 0, -1, 5), ("F", "t", 9, 1, -1, 6)], "pk string, token string, height long, seq int, sub_seq int, nonce long")
    nonces = contracts.update_nonces(payers, own.filter("increments"), place)
    assert {r.pk: r.nonce for r in nonces.collect()} == {"F": 7, "U": 2}
    assert contracts.contract_state(own.limit(0), place).count() == 0


def test_numbers_and_histories_of_hot_tokens(spark):
    """One token's rows over many blocks of the order, of an empty table, and amounts of no accounts."""
    changes = spark.range(5000).select(F.lit("t").alias("token"), (F.col("id") * 7).alias("at"), F.when(F.col("id") % 3 == 0, -2).otherwise(1).cast("long").alias("delta"))
    rows = contracts.token_history(changes, F.floor(F.col("at") / 256), ["at"]).orderBy("at").collect()
    supply = 0
    for i, r in enumerate(rows):
        supply += r.delta
        assert (r.nth, r.supply) == (i + 1, supply)
    numbers = contracts.numbered(changes, ["token"], F.floor(F.col("at") / 256), ["at"])
    assert [r.idx for r in numbers.orderBy("at").collect()] == list(range(5000))
    assert contracts.numbered(changes.limit(0), ["token"], F.floor(F.col("at") / 256), ["at"]).count() == 0
    none = spark.createDataFrame([], "balance long, locked long")
    assert contracts.locked_total(none, F.col("locked")).collect() == [(0, 0, 0, 0)]
    some = spark.createDataFrame([("n", 10, 4), ("n", 3, 9), ("t", 5, 1), ("n", 2, None)], "token string, balance long, locked long")
    assert contracts.locked_total(some, F.col("locked"), "n").collect() == [(3, 15, 13, 2)]
    assert contracts.locked_total(some.drop("token"), F.col("locked")).collect() == [(4, 20, 14, 6)]


def test_pages_name_what_they_know(spark):
    rows = spark.createDataFrame([("a", "t", 1), ("b", "t", 5), ("c", "u", 5)], "pk string, token string, balance long")
    assert [r.pk for r in listings.page(rows, "holders").collect()] == ["c", "b", "a"]
    assert [r.pk for r in listings.page(rows, "holders", {"token": "t"}, "balance", True, 1).collect()] == ["a"]
    assert listings.page(rows, "holders", limit=0).count() == 0
    for asked in ({"nothing": 1}, None):
        with pytest.raises(ValueError):
            listings.page(rows, "actions" if asked is None else "holders", asked)
    with pytest.raises(ValueError):
        listings.page(rows, "holders", sort="pk")


def test_decorations_keep_rows_without_a_match(spark):
    rows = spark.createDataFrame([(1, "x", "a", None), (2, "y", "b", "t")], "id int, state_hash string, pk string, token string")
    blocks = spark.createDataFrame([("x", True)], "state_hash string, canonical boolean")
    assert {r.id: r.canonical for r in listings.with_canonicity(rows, blocks).collect()} == {1: True, 2: False}
    names = spark.createDataFrame([("b", "bob")], "pk string, username string")
    assert {r.id: r.who for r in listings.with_names(rows, names, pk="who").collect()} == {1: None, 2: "bob"}
    tokens = spark.createDataFrame([("t", "o", "S")], "token string, owner string, symbol string")
    assert {r.id: r.symbol for r in listings.with_symbols(rows, tokens).collect()} == {1: None, 2: "S"}
    assert sorted(listings.tokens_used(rows.union(rows), tokens).collect(), key=repr) == [("a", None, None, None), ("b", "t", "o", "S")]
    assert sorted(listings.public_keys((rows, "pk"), (rows, "token")).collect()) == [("x", "a"), ("y", "b"), ("y", "t")]


def test_delegators_of_equal_balances_are_numbered_over_many_parts(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "d").otherwise(F.col("id").cast("string")).alias("delegate"), F.col("id").alias("pk"), F.lit(0).cast("long").alias("balance"))
    got = counters.delegators(rows).filter("delegate = 'd'").orderBy("nth").collect()
    assert [(r.nth, r.pk) for r in got] == [(i + 1, 3 * i) for i in range(1000)]
    assert counters.delegators(rows.limit(0)).count() == 0


def test_snapshots_and_stored_ledgers(spark):
    rnd = random.Random(3)
    rows = [("ab"[rnd.random() < 0.3], "t", h, 0, s, 0, rnd.randint(-9, 9)) for h in range(1, 60) for s in range(rnd.randint(0, 3))]
    diffs = spark.createDataFrame(rows, "pk string, token string, height long, phase int, seq long, sub_seq int, delta long")
    kept = ledger.snapshots(diffs, 10)
    for at in (0, 10, 25, 60):
        want = {}
        for pk, _, h, _, _, _, d in rows:
            if h <= at // 10 * 10:
                want[pk] = max(0, want.get(pk, 0) + d)
        assert {r.pk: r.balance for r in ledger.stored(kept, at).collect()} == want
    assert ledger.snapshots(diffs.limit(0)).count() == 0


def test_the_canonical_root_moves_below_the_tip(spark):
    rows = [(i, i - 1 if i else None, i, 0) for i in range(30)] + [(100, 20, 21, 9)]
    b = spark.createDataFrame(rows, "state_hash long, parent_hash long, height long, vrf int")
    assert sorted(chain.canonical_update(b, 15).collect()) == [(h, h, h == 19) for h in range(16, 20)]
    assert chain.canonical_update(b, 28).count() == 0
    assert sorted(r.height for r in chain.best_chain(b, 4).collect()) == [26, 27, 28, 29]
    assert chain.best_chain(b.limit(0)).count() == 0 and chain.canonical_update(b.limit(0), 0).count() == 0


def test_contract_commands_set_a_nonce_and_their_updates_follow(spark):
    commands = spark.createDataFrame([("x", 1, 0, "Zkapp", "F", None, 0, 4, True), ("x", 1, 1, "Payment", "F", "U", 3, 5, True), ("x", 1, 2, "Zkapp", "F", None, 0, 6, False)], "state_hash string, height long, seq int, kind string, sender string, receiver string, amount long, nonce long, applied boolean")
    fees = spark.createDataFrame([], "state_hash string, height long, step int, sender string, receiver string, amount long")
    made = spark.createDataFrame([("x", 1, "F", 10)], "state_hash string, height long, coinbase_receiver string, coinbase long")
    diffs = ledger.account_diffs(commands, fees, made)
    assert {(r.pk, r.kind, r.nonce) for r in diffs.filter("nonce is not null").collect()} == {("F", "PayerNonce", 5), ("F", "Debit", 6), ("F", "FailedNonce", 7)}
    given = "state_hash string, height long, seq int, sub_seq int, pk string, token string, delta long, delegate string, increments boolean"
    updates = spark.createDataFrame([("x", 1, 0, 0, "U", "native", 8, "D", True), ("x", 1, 0, 1, "U", "native", -2, None, True), ("x", 1, 0, 2, "U", "t", 1, None, False)], given)
    got = {(r.pk, r.token): (r.balance, r.nonce, r.delegate) for r in contracts.accounts_with_updates(diffs, updates).collect()}
    assert got == {("F", "native"): (10, 7, "F"), ("U", "native"): (9, 2, "D"), ("U", "t"): (1, 0, "U")}
    assert contracts.accounts_with_updates(diffs, updates.limit(0)).count() == 2
    assert contracts.accounts_with_updates(diffs, updates, 0).count() == 0


def test_exports_have_the_columns_of_the_format(spark, tmp_path):
    own = [(1, 5, "x", "a", "b", 1, 7, "h", 2, 3, "m", "Payment", 0), (1, 6, "y", "b", "a", 2, 8, "i", 2, 3, "m", "Payment", 1)]
    rows = spark.createDataFrame(own, "date_time_ms long, height long, state_hash string, sender string, receiver string, nonce long, n int, txn_hash string, fee long, amount long, memo string, kind string, idx int")
    exports.user_commands(rows, "a", str(tmp_path / "u"))
    exports.internal_commands(rows, "a", str(tmp_path / "i"))
    exports.dump(rows.select("height", "state_hash"), str(tmp_path / "j"))
    back = spark.read.option("header", True).csv(str(tmp_path / "u"))
    assert back.columns == ["Date", "BlockHeight", "BlockStateHash", "From", "To", "Nonce", "Hash", "Fee", "Amount", "Memo", "Kind"]
    assert sorted((r.BlockHeight, r.From, r.Date) for r in back.collect()) == [("5", "a", "1970-01-01T00:00:00.001Z"), ("6", "b", "1970-01-01T00:00:00.001Z")]
    inside = spark.read.option("header", True).csv(str(tmp_path / "i"))
    assert (inside.columns, inside.count()) == (["Date", "BlockHeight", "BlockStateHash", "Recipient", "Amount", "Kind"], 1)
    assert [r.height for r in spark.read.json(str(tmp_path / "j")).orderBy("height").collect()] == [5, 6]
    with pytest.raises(ValueError):
        exports.dump(rows, str(tmp_path / "k"), "fee")
