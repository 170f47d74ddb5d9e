"""Accounts over time, stored ledgers, call forests, quarantined files and the witness tree, against plain copies."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, codecs, keys
from ledgerloom.plans import chain, contracts, counters, history, ledger, listings, views
from ledgerloom.sources import files, precomputed
from ledgerloom.streaming import ingest, witness
from test_ledger import block_file, signed, update

DIFF = "state_hash string, height long, pk string, token string, phase int, seq long, sub_seq int, kind string, delta long, nonce long, delegate string"


def zkapp(*updates, status="Applied", nonce="4"):
    return {"data": ["Zkapp_command", {"fee_payer": {"body": {"public_key": "F", "fee": "0.02", "nonce": nonce}}, "memo": "E4Z", "account_updates": list(updates)}], "status": [status] if status == "Applied" else [status, [[["Bad"]]]]}


def test_calls_follow_their_update_at_any_depth(spark, tmp_path):
    forest = [update("A", calls=[update("A1")]), update("B", calls=[update("B1", calls=[update("B11")]), update("B2")])]
    deep = update("D20")
    for depth in reversed(range(20)):
        deep = update(f"D{depth:02}", calls=[deep])
    block_file(tmp_path, 9, "3Nz", "3Ny", 2, [signed(2, "Payment", "A", "B"), zkapp(*forest), zkapp(deep, nonce="5"), zkapp(update("no"), status="Failed"), zkapp()], slot=564_500)
    raw = precomputed.raw(spark, str(tmp_path))
    rows = precomputed.zkapp_updates(raw).orderBy("seq", "sub_seq").collect()
    assert [r.pk for r in rows if r.seq == 1] == ["A", "A1", "B", "B1", "B11", "B2"]
    assert [r.pk for r in rows if r.seq == 2] == [f"D{i:02}" for i in range(21)] and [r.sub_seq for r in rows if r.seq == 2] == list(range(21))
    assert {r.seq for r in rows} == {1, 2}
    commands = {c.seq: [p.pk for p in c.receivers] for c in precomputed.user_commands(raw).collect()}
    assert commands == {0: ["B"], 1: ["A", "A1", "B", "B1", "B11", "B2"], 2: [f"D{i:02}" for i in range(21)], 3: ["no"], 4: []}
    kept = precomputed.kept(raw, str(tmp_path / "kept"))
    assert precomputed.zkapp_updates(kept).count() == len(rows) and precomputed.call_forest(raw.filter("height = 0")).count() == 0


def test_creation_fees_and_proofs_of_updates(spark, tmp_path):
    pays = update("U", "100")
    pays["elt"]["account_update"]["body"] |= {"implicit_account_creation_fee": True, "authorization_kind": ["Proof", "x"], "preconditions": {"account": {"proved_state": ["Check", True]}}}
    free = update("U", "30")
    free["elt"]["account_update"]["body"] |= {"authorization_kind": ["Proof", "x"], "preconditions": {"account": {"proved_state": ["Ignore"]}}}
    block_file(tmp_path, 9, "3Nz", "3Ny", 2, [zkapp(pays, free, update("V", "5"))], slot=564_500)
    own = precomputed.zkapp_updates(precomputed.raw(spark, str(tmp_path))).cache()
    assert [(r.pk, r.delta, r.creation_fee, r.proved) for r in own.orderBy("sub_seq").collect()] == [("U", 100, 100, True), ("U", 30, 0, False), ("V", 5, 0, False)]
    assert {r.pk: r.proved for r in contracts.contract_state(own, ["height", "seq", "sub_seq"]).collect()} == {"U": True, "V": False}
    diffs = contracts.update_diffs(own).orderBy("sub_seq").collect()
    assert [(d.pk, d.kind, d.delta) for d in diffs] == [("U", "CreationFee", -100), ("U", "Update", 100), ("U", "Update", 30), ("V", "Update", 5)]
    start = spark.createDataFrame([("g", 1, "U", "t", 0, 0, 0, "Credit", 60, None, None)], DIFF)
    # 60 less 100 is 0, then 100 and 30 come.
    assert {r.pk: r.balance for r in contracts.accounts_with_updates(start, own).collect()} == {"U": 130, "V": 5}


def test_a_cut_file_costs_no_other_block(spark, tmp_path):
    for h in (3, 4, 5):
        block_file(tmp_path, h, f"3N{h}", f"3N{h - 1}")
    whole = (tmp_path / "main-4-3N4.json").read_text()
    (tmp_path / "main-4-3N4.json").write_text(whole[: len(whole) // 2])
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "main-5-3N5.json").write_text("{")
    assert sorted(r.state_hash for r in precomputed.blocks(precomputed.raw(spark, str(tmp_path))).collect()) == ["3N3", "3N5"]
    listed = [(r.height, r.state_hash) for r in precomputed.paths(spark, str(tmp_path)).collect()]
    assert listed == [(3, "3N3"), (4, "3N4"), (5, "3N5"), (5, "3N5")] and precomputed.paths(spark, str(tmp_path), above=4).count() == 2
    bad = precomputed.unread(spark, str(tmp_path)).orderBy("height").collect()
    assert [(r.height, r.state_hash) for r in bad] == [(4, "3N4"), (5, "3N5")]
    (tmp_path / "b" / "main-4-3N4.json").write_text(whole)
    assert precomputed.raw(spark, str(tmp_path)).count() == 3


def test_stream_of_files_takes_cut_ones_when_they_are_whole(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for h in (3, 4):
        block_file(folder, h, f"3N{h}", f"3N{h - 1}")
    text = (folder / "main-4-3N4.json").read_text()
    (folder / "main-4-3N4.json").write_text(text[:40])
    take = lambda: ingest.ingest_files(spark, str(folder), str(out), str(tmp_path / "ck"))
    take()
    got = lambda: sorted(r.state_hash for r in precomputed.blocks(ingest.kept_files(spark, str(out))).collect())
    assert got() == ["3N3"] and [r.state_hash for r in ingest.quarantined(spark, str(out)).collect()] == ["3N4"]
    block_file(folder, 5, "3N5", "3N4")
    take()
    assert got() == ["3N3", "3N5"]
    (folder / "main-4-3N4.json").write_text(text)
    take()
    assert got() == ["3N3", "3N4", "3N5"] and ingest.quarantined(spark, str(out)).count() == 0
    take()
    assert got() == ["3N3", "3N4", "3N5"]
    (folder / "main-9-3N9.json").write_text("{")
    for _ in range(ingest.ATTEMPTS + 1):
        take()
    assert ingest.quarantined(spark, str(out)).first().attempts == ingest.ATTEMPTS


def test_small_sources(spark, tmp_path):
    (tmp_path / "names.csv").write_text("B1,ann\nB2,bob\nB1,zoe\n")
    assert sorted(map(tuple, files.off_chain_names(spark, str(tmp_path / "names.csv")).collect())) == [("B1", "zoe"), ("B2", "bob")]
    (tmp_path / "locked.csv").write_text("slot,locked\n0,12\n7,5\n")
    assert sorted(map(tuple, files.locked_supply(spark, str(tmp_path / "locked.csv")).collect())) == [(0, 12 * 10**9), (7, 5 * 10**9)]
    block_file(tmp_path, 3, "3Na", "3Np")
    out, query = str(tmp_path / "out"), ingest.stream_files(spark, str(tmp_path))
    query.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    (row,) = spark.read.parquet(out).collect()
    assert row.file == "main-3-3Na.json" and json.loads(row.value)["scheduled_time"] == "1643864545485"


def test_small_functions(spark):
    df = spark.createDataFrame([(5, 1_500_000_000, "1", False), (6, 1_500_000_000, "1", True), (7, 10, None, None), (8, 1_500_000_000, "t", False)], "id int, b long, token string, paid boolean")
    shown = [r.s for r in df.orderBy("id").select(amounts.without_creation_fee(F.col("b"), F.col("token"), F.col("paid"), "1").alias("s")).collect()]
    assert shown == [500_000_000, 1_500_000_000, 0, 1_500_000_000]
    signs = spark.createDataFrame([(0,), (1_500_000_000,), (-1,)], "n long").select(amounts.signed_units(F.col("n")).alias("s")).collect()
    assert [float(r.s) for r in signs] == [0.0, 1.5, -1e-9] and [r.s[0] for r in signs] == ["+", "+", "-"]
    inputs = [b"", b"abc", b"x" * 300, None]
    digests = spark.createDataFrame([(x,) for x in inputs], "b binary").select(codecs.blake2b(F.col("b")).alias("d")).collect()
    assert [r.d for r in digests] == [None if x is None else hashlib.blake2b(x, digest_size=32).hexdigest() for x in inputs]
    service, prefix = codecs.NAME_SERVICES[0], codecs.NAME_PREFIX
    longest = "n" * (codecs.MEMO_BYTES - len(prefix))
    claims = [(prefix + "ann", service, True, "ann"), (prefix + "ann", "other", True, None), (prefix + "ann", service, False, None), ("name ann", service, True, None), (prefix + longest, service, True, longest), (prefix + longest + "n", service, True, None), (None, service, True, None)]
    got = spark.createDataFrame(claims, "memo string, to string, ok boolean, want string").select("want", codecs.claimed_name(F.col("memo"), F.col("to"), F.col("ok")).alias("name")).collect()
    assert all(r.name == r.want for r in got)


def random_diffs(seed, n=400, heights=60, keys="abc"):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        h = rnd.randint(1, heights)
        rows.append((f"s{h}", h, rnd.choice(keys), "native", rnd.choice([0, 0, 1, 2]), i, 0, "Credit", rnd.choice([5, -7, 3, -2, None]), rnd.choice([None, None, h]), rnd.choice([None, None, "d" + str(i % 4)])))
    return rows


def fold(rows):
    """Accounts after every height that changes them."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[4], r[5], r[6])):
        b, n, d = state.get(r[2], (0, 0, r[2]))
        state[r[2]] = (max(0, b + (r[8] or 0)), n if r[9] is None else r[9], r[10] or d)
        out[r[2], r[1]] = state[r[2]]
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_accounts_after_every_block(spark, block):
    rows = random_diffs(3)
    diffs = spark.createDataFrame(rows, DIFF)
    after = history.after_blocks(diffs, block).cache()
    want = fold(rows)
    assert {(r.pk, r.height): (r.balance, r.nonce, r.delegate) for r in after.collect()} == want
    asked = [(i, pk, h) for i, (pk, h) in enumerate((pk, h) for pk in "abcx" for h in (0, 1, 17, 17, 60, 99))]
    got = history.as_of(spark.createDataFrame(asked, "id int, pk string, height long"), after, ["pk"], ["balance", "nonce", "delegate"], block).collect()
    assert len(got) == len(asked)
    for r in got:
        last = max((h for pk, h in want if pk == r.pk and h <= r.height), default=None)
        assert (r.balance, r.nonce, r.delegate) == (want[r.pk, last] if last else (None, None, None)) and r.since == last


def test_records_of_accounts_against_the_fold(spark, tmp_path):
    block_file(tmp_path, 2, "3Nb", "3Na", 2, [signed(2, "Payment", "A", "B", amount="5000000000", nonce="0")], slot=564_500)
    at = tmp_path / "main-2-3Nb.json"
    data = json.loads(at.read_text())
    account = lambda pk, balance, nonce, delegate: {"public_key": pk, "token_id": amounts.NATIVE_TOKEN, "token_symbol": "", "balance": balance, "nonce": nonce, "delegate": delegate}
    data["data"]["accounts_accessed"] = [[0, account("A", "1000", "1", "A")], [1, account("B", "4000000000", "0", "B")], [2, account("C", "7", "0", None)]]
    data["data"]["accounts_created"] = [[["B", amounts.NATIVE_TOKEN], "1000000000"]]
    at.write_text(json.dumps(data))
    raw = precomputed.raw(spark, str(tmp_path))
    assert [tuple(r) for r in precomputed.accounts_created(raw).collect()] == [(2, "3Nb", "B", amounts.NATIVE_TOKEN, 1_000_000_000)]
    start = spark.createDataFrame([("3Na", 1, "A", "native", 0, 0, 0, "Credit", 5_000_001_000, None, None)], DIFF)
    paid = precomputed.user_commands(raw).select("state_hash", "height", "seq", "kind", "sender", F.col("receivers")[0]["pk"].alias("receiver"), "amount", "nonce", "applied")
    none = spark.createDataFrame([], "state_hash string, height long, step int, sender string, receiver string, amount long")
    diffs = start.unionByName(ledger.account_diffs(paid, none, spark.createDataFrame([], "state_hash string, height long, coinbase_receiver string, coinbase long")))
    wrong = history.mismatches(history.after_blocks(diffs), precomputed.accounts_accessed(raw), spark.createDataFrame([("A",)], "pk string")).collect()
    assert sorted((r.pk, r.field, r.expected, r.found) for r in wrong) == [("C", "balance", "7", None), ("C", "nonce", "0", None)]
    shown = history.displayed(ledger.accounts(diffs), spark.createDataFrame([("A",)], "pk string"))
    assert {r.pk: r.balance for r in shown.collect()} == {"A": 1000, "B": 4_000_000_000}


def test_stored_ledgers_and_the_nearest_one(spark):
    """A chain with a branch: heights 1 to 60 and another way from 33 on; ledgers are stored every ten heights of the chain."""
    name = lambda h, side="": f"s{h}{side}"
    b = [(name(h), name(h - 1), h) for h in range(1, 61)] + [(name(h, "x"), name(h - 1, "x" if h > 33 else ""), h) for h in range(33, 56)]
    blocks = spark.createDataFrame(b, "state_hash string, parent_hash string, height long")
    rows = random_diffs(9)
    side = [(f"{r[0]}x", *r[1:8], (r[8] or 0) + 1, *r[9:]) for r in rows if 33 <= r[1] < 56]
    diffs, on_chain = spark.createDataFrame(rows + side, DIFF), spark.createDataFrame(rows, DIFF)
    ends = blocks.filter("state_hash not like '%x'").select("state_hash", "height")
    stored = ledger.ledgers_at(on_chain, ends, 10).cache()
    for h in (10, 40, 60):
        have = {r.pk: (r.balance, r.nonce, r.delegate, r.since) for r in stored.filter(F.col("height") == h).collect()}
        assert have == {r.pk: (r.balance, r.nonce, r.delegate, r.since) for r in ledger.accounts(on_chain, h).collect()}
        assert {r.state_hash for r in stored.filter(F.col("height") == h).collect()} == {name(h)}
    held = stored.select("state_hash", "height").distinct()
    for tip, base, path in ((name(47), name(40), 7), (name(55, "x"), name(30), 25), (name(40), name(40), 0), (name(5), None, 5)):
        one = blocks.filter(F.col("state_hash") == tip)
        found, later = ledger.nearest_stored(blocks, one, held)
        assert (found and found.first().state_hash, later.count()) == (base, path)
        got = ledger.at_block_from(blocks, diffs, one.select("state_hash"), stored).collect()
        want = ledger.at_block(blocks, diffs, one.select("state_hash")).collect()
        assert sorted(got) == sorted(want)
    hashed = blocks.withColumn("staged_ledger_hash", F.concat(F.lit("j"), F.when(F.col("height") < 3, "same").otherwise(F.col("state_hash"))))
    assert sorted(ledger.at_ledger_hash(hashed, diffs, "jsame", stored).collect()) == sorted(ledger.accounts(on_chain, 1).collect())
    assert ledger.at_ledger_hash(hashed, diffs, "none", stored) is None


def test_ledgers_are_kept_once_made(spark, tmp_path):
    blocks = spark.createDataFrame([(f"s{h}", f"s{h - 1}", h) for h in range(1, 61)], "state_hash string, parent_hash string, height long")
    diffs, folder = spark.createDataFrame(random_diffs(9), DIFF), str(tmp_path / "ledgers")
    ledger.ledgers_at(diffs, blocks.select("state_hash", "height"), 10).write.partitionBy("height", "state_hash").parquet(folder)
    tip = blocks.filter("height = 47").select("state_hash", "height")
    for _ in range(2):
        assert sorted(ledger.memoized(blocks, diffs, tip, folder).select("pk", "balance", "nonce", "delegate", "since").collect()) == sorted(ledger.accounts(diffs, 47).drop("token").collect())
    heights = {r.height for r in spark.read.parquet(folder).select("height").distinct().collect()}
    assert heights == {10, 20, 30, 40, 47, 50, 60}


@pytest.mark.parametrize("seed", [1, 2])
def test_field_history_after_reorganisations(spark, seed):
    rnd = random.Random(seed)
    made = lambda low, tag: [(rnd.choice("pq"), rnd.randint(low, 50), i, rnd.choice([None, f"{tag}{i}"]), rnd.choice([None, None, f"{tag}{i % 3}"])) for i in range(80)]
    schema, keys, fields, place = "pk string, height long, seq int, symbol string, uri string", ["pk"], ["symbol", "uri"], ["height", "seq"]
    old, branch = made(1, "a"), made(31, "b")
    held = history.intervals(spark.createDataFrame(old, schema), keys, fields, place)
    new = history.reorganised(held, 30, spark.createDataFrame(branch, schema), keys, fields, place).cache()
    chain_ = [r for r in old if r[1] <= 30] + branch
    assert sorted(new.collect()) == sorted(history.intervals(spark.createDataFrame(chain_, schema), keys, fields, place).collect())
    for h in (0, 12, 30, 31, 44, 60):
        want = {}
        for r in sorted(chain_, key=lambda r: (r[1], r[2])):
            if r[1] <= h:
                want |= {(r[0], f): v for f, v in zip(fields, r[3:], strict=True) if v is not None}
        assert {(r.pk, r.field): r.value for r in history.at_height(new, h).collect()} == want


# The witness tree

BLOCK = "state_hash string, parent_hash string, height long, vrf binary"


def tree_of(seed, n=84):
    """A root and blocks that mostly extend the highest ones."""
    rnd = random.Random(seed)
    rows = [("root", "none", 1, b"\0")]
    for i in range(n):
        parent = rows[-1] if rnd.random() < 0.6 else rnd.choice(rows[-8:])
        rows.append((f"b{i:03}", parent[0], parent[2] + 1, bytes([rnd.randrange(256)])))
    return rows


def attached_of(rows, seen):
    have = {"root"}
    for h, p, _, _ in rows:  # parents come first
        if h in seen and p in have:
            have.add(h)
    return have


def test_witness_tree_over_shuffled_batches(spark, tmp_path):
    rows = tree_of(4)
    rnd = random.Random(4)
    order = sorted(range(1, len(rows)), key=lambda i: i + rnd.randint(0, 30))  # out of order, but not by far
    paid = [(h, "pq"[i % 2], i) for i, (h, *_) in enumerate(rows) for _ in range(2)]
    commands = spark.createDataFrame(paid, "state_hash string, pk string, fee long").cache()
    view = witness.View(lambda s, hashes: commands, ["pk"], {"commands": F.lit(1), "fees": F.col("fee")})
    make = lambda: witness.Tree(spark, f"file://{tmp_path}/tree", spark.createDataFrame(rows[:1], BLOCK), {"paid": view}, keep=40)
    parts = [order[i : i + 20] for i in range(0, len(order), 20)]
    seen, reorganised = set(), 0
    for number, part in enumerate(parts):
        arriving = [rows[i] for i in part] + [rows[part[0]]] + ([rows[i] for i in parts[number - 1][:3]] if number else [])
        tree = make()
        tree.step(spark.createDataFrame(arriving, BLOCK), number)
        if number == 2:  # a batch that runs again leaves the same
            tree.step(spark.createDataFrame(arriving, BLOCK), number)
        seen |= {rows[i][0] for i in part}
        have = attached_of(rows, seen)
        best = max((r for r in rows if r[0] in have), key=lambda r: (r[2], r[3], r[0]))
        up, at = {r[0]: r[1] for r in rows}, best[0]
        on_chain = set()
        while at in up:
            on_chain.add(at)
            at = up[at]
        tip = tree.tip().first()
        assert (tip.tip_hash, tip.root_hash in on_chain) == (best[0], True)
        flags = tree.flags().collect()
        assert len({r.state_hash for r in flags}) == len(flags)
        assert {r.state_hash: r.canonical for r in flags} == {h: h in on_chain for h in have}
        sums = {p: (sum(1 for h, q, _ in paid if q == p and h in on_chain), sum(f for h, q, f in paid if q == p and h in on_chain)) for p in "pq"}
        assert {r.pk: (r.commands, r.fees) for r in tree.view("paid").collect()} == {p: s for p, s in sums.items() if any(s)}
        changes = spark.read.parquet(tree.path("changes", number))
        reorganised += changes.filter("change = 'unapply'").count() > 0
        frontier = spark.read.parquet(tree.path("frontier", number))
        assert frontier.filter(F.col("height") <= tip.root_height - 40).count() == 0
        dangling = {r.state_hash for r in frontier.filter("not attached").collect()}
        assert dangling == seen - have
        missing = {r.hash for r in tree.missing().collect()}
        assert missing == {up[h] for h in dangling} - seen - {"root"}
    assert reorganised >= 1
    tree.vacuum()
    assert tree.numbers("frontier") == [len(parts) - 2, len(parts) - 1] and make().flags().count() == len(rows)


def test_witness_tree_as_a_stream(spark, tmp_path):
    rows = tree_of(7, 40)
    frame = spark.createDataFrame(rows[1:], BLOCK)
    for i, part in enumerate(frame.randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        tree = witness.Tree(spark, f"file://{tmp_path}/tree", spark.createDataFrame(rows[:1], BLOCK))
        tree.run(ingest.stream(spark, f"{tmp_path}/in", frame.schema), f"{tmp_path}/ck").awaitTermination()
        assert len(tree.numbers("tip")) == i + 1
    best = max(rows, key=lambda r: (r[2], r[3], r[0]))
    assert tree.tip().first().tip_hash == best[0]
    want = chain.canonicity(spark.createDataFrame(rows, BLOCK)).select("state_hash", (F.col("canonicity") == "Canonical").alias("canonical"))
    assert sorted(tree.flags().select("state_hash", "canonical").collect()) == sorted(want.collect())


def test_stakes_of_epochs_without_a_ledger(spark):
    b = spark.createDataFrame([("x", "g", 1, "a"), ("y", "g", 2, "a"), ("z", "h", 1, "a"), ("w", "g", 1, "n")], "state_hash string, genesis_state_hash string, epoch long, creator string")
    held = spark.createDataFrame([("l1", "g", 1, "p", "a", 30), ("l1", "g", 1, "a", None, 60), ("l1", "g", 1, "q", "b", 10)], "ledger_hash string, genesis_state_hash string, epoch long, pk string, delegate string, balance long")
    got = {r.state_hash: (r.ledger_hash, r.delegated, r.delegators, r.total, r.share) for r in counters.stakes_of_blocks(b, held).collect()}
    assert got == {"x": ("l1", 90, 2, 100, 90.0), "w": ("l1", 0, 0, 100, 0.0), "y": (None, None, None, None, None), "z": (None, None, None, None, None)}


def test_pages_check_keys_and_limits(spark):
    pk, state, held = "B62q" + "a" * 51, "3N" + "b" * 50, "jx" + "c" * 49
    assert keys.wrong({"pk": pk, "state_hash": state, "or": [{"ledger_hash": held}, {"token": "w" * 50}], "txn_hash": "5J" + "d" * 50, "username": "n" * 26, "creator": None}) == []
    bad = keys.wrong({"pk": pk[1:], "and": [{"state_hash": 5}, {"username": "ü" * 14}], "txn_hash": "5J" + "d" * 51})
    assert [m.split(":")[0] for m in bad] == ["pk", "state_hash", "username", "txn_hash"]
    rows = spark.createDataFrame([(pk, held, 4, 10, 7), ("q", held, 4, 20, 9), ("r", "other", 5, 1, 1)], "pk string, ledger_hash string, epoch long, balance long, total_delegated long")
    assert [tuple(r) for r in listings.page(rows, "stakes", {"ledger_hash": held}, limit=0, strict=True).collect()] == [(None, held, 4, None, None)]
    assert listings.page(rows, "stakes", {"ledger_hash": held[:-1] + "x"}, limit=0).collect() == []
    assert [r.pk for r in listings.page(rows, "stakes", {"ledger_hash": held}, strict=True).collect()] == ["q", pk]
    with pytest.raises(ValueError, match="pk"):
        listings.page(rows, "stakes", {"pk": "q"}, strict=True)
    blocks = spark.createDataFrame([(f"b{h:03}", f"b{h - 1:03}", h, b"a", True) for h in range(1, 131)] + [("x5", "b004", 5, b"b", False)], "state_hash string, parent_hash string, height long, vrf binary, canonical boolean")
    heights = lambda **k: [r.height for r in listings.recent_blocks(blocks, **k).collect()]
    assert heights() == list(range(130, 120, -1)) and heights(limit=3) == [130, 129, 128] and len(heights(limit=5000)) == 100 and heights(limit=0) == []
    assert [r.state_hash for r in listings.recent_blocks(blocks, height=5).collect()] == ["b005", "x5"]


def test_a_block_as_it_is_shown(spark, tmp_path):
    block_file(tmp_path, 3, "3Na", "3Np", commands=[signed(1, "Payment", "A", "B"), signed(1, "Payment", "A", "D", fee="0.5", failed="Too_little")], works=[("P", "0.2")], slot=7150)
    block_file(tmp_path, 4, "3Nb", "3Na", coinbase=("Zero",))
    raw = precomputed.kept(precomputed.raw(spark, str(tmp_path)), str(tmp_path / "kept"))
    own = precomputed.blocks(raw).withColumn("canonical", F.lit(True))
    shown = views.blocks(own, precomputed.user_commands(raw), precomputed.snarks(raw), precomputed.internal_commands(raw), names=spark.createDataFrame([("C", "carl")], "pk string, username string"))
    got = {r.state_hash: json.loads(r.json) for r in views.as_json(shown, "state_hash").collect()}
    a, b = got["3Na"], got["3Nb"]
    assert (a["creator"], a["tx_fees"], a["snark_fees"], a["block_num_user_commands"], a["block_num_internal_commands"]) == ({"public_key": "C", "username": "carl"}, "0.51", "0.2", 2, 3)
    assert [(c["receivers"][0]["pk"], c["applied"]) for c in a["transactions"]["user_commands"]] == [("B", True), ("D", False)]
    assert [(t["kind"], t["recipient"], t["fee"]) for t in a["transactions"]["fee_transfer"]] == [("Coinbase", "C", "720"), ("Fee_transfer", "C", "0.51"), ("Fee_transfer", "P", "0.2")]
    assert a["snark_jobs"] == [{"prover": "P", "fee": 200_000_000}] and a["protocol_state"]["slot"] == 10 and a["date_time"] == "2022-02-03T05:00:00.000Z"
    assert b["transactions"] == {"user_commands": [], "fee_transfer": []} and (b["tx_fees"], b["block_num_snarks"]) == ("0", 0)
    commands, slots = precomputed.user_commands(raw).withColumn("global_slot", F.lit(7150)), own.select("global_slot").limit(1)
    n = lambda since, until: views.commands_between(commands, slots, 0, since, until).count()
    at = 7150 * amounts.SLOT_MS
    assert [n(None, None), n(at, at), n(at + amounts.SLOT_MS, None), n(None, at - 1), n(0, at + 10**9)] == [2, 2, 0, 0, 2]
