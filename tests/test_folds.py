"""Folds of account changes: accounts of many rows against plain copies, and what a task has to sort."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.operators import analogues
from ledgerloom.plans import history, ledger

DATA = "/root/testdata/sf0.01"


@pytest.fixture
def few(monkeypatch):
    """Accounts of more than 40 changes are large, and 200 rows are enough for a task."""
    monkeypatch.setattr(ledger, "TASK_ROWS", 200)
    monkeypatch.setattr(history.accounts_at, "__defaults__", ("native", 64, 40))
    monkeypatch.setattr(history.after_blocks, "__defaults__", (64, 40))


def changes(spark, seed=5, n=900):
    rnd = random.Random(seed)
    rows, seen = [], set()
    for _ in range(n):
        at = (rnd.randrange(300), rnd.randrange(3), rnd.randrange(4), rnd.randrange(2))
        if at in seen:
            continue
        seen.add(at)
        pk = rnd.choice(["a", "a", "a", "b", "c", f"x{rnd.randrange(40)}"])
        rows.append((f"h{at[0]}", at[0], pk, rnd.choice(["native", "native", "t"]), *at[1:], rnd.choice([None, rnd.randrange(-50, 45)]), rnd.choice([None, rnd.randrange(9)]), rnd.choice([None, None, "d1", "d2"])))
    return rows, spark.createDataFrame(rows, "state_hash string, height long, pk string, token string, phase int, seq long, sub_seq int, delta long, nonce long, delegate string")


def plain(rows):
    """(pk, token) -> [(place, height, balance, nonce, delegate)] in order."""
    out = {}
    for _, h, pk, token, phase, seq, sub, d, nonce, delegate in sorted(rows, key=lambda r: (r[1], *r[4:7])):
        own = out.setdefault((pk, token), [])
        _, _, b, n, g = own[-1] if own else (None, None, 0, 0, pk)
        own.append(((h, phase, seq, sub), h, max(0, b + (d or 0)), n if nonce is None else nonce, g if delegate is None else delegate))
    return out


@pytest.mark.parametrize("many", [0, 40, 10**6])
def test_accounts_after_changes_and_at_heights(spark, many):
    rows, diffs = changes(spark)
    want = plain(rows)
    got = history.after_changes(diffs, 16, many).collect()
    assert {(r.pk, r.token, r.height, r.phase, r.seq, r.sub_seq): (r.balance, r.nonce, r.delegate) for r in got} == {(*k, *v[0]): v[2:] for k, own in want.items() for v in own}
    after = {(r.pk, r.token, r.height): (r.balance, r.nonce, r.delegate) for r in history.after_blocks(diffs, 16, many).collect()}
    assert after == {(*k, v[1]): v[2:] for k, own in want.items() for v in own}  # the last of a height stays
    asked = [(i, random.Random(i).choice(["a", "b", "x3", "none"]), h) for i, h in enumerate([*range(-1, 310, 7), 0, 0, 299, 5000])]
    found = history.accounts_at(spark.createDataFrame(asked, "id long, pk string, height long"), diffs, block=16, many=many).collect()
    assert len(found) == len(asked)
    for r in found:
        own = [v for v in want.get((r.pk, "native"), []) if v[1] <= r.height]
        assert (r.balance, r.nonce, r.delegate, r.since) == ((*own[-1][2:], own[-1][1]) if own else (None,) * 4)


def test_ledger_is_folded_by_one_sort_of_changes(spark, monkeypatch):
    rows, diffs = changes(spark, 6)
    want = {k: (*own[-1][2:], own[0][1]) for k, own in plain(rows).items()}
    for task_rows in (ledger.TASK_ROWS, 20):
        monkeypatch.setattr(ledger, "TASK_ROWS", task_rows)
        out = ledger.accounts(diffs, block=16)
        assert {(r.pk, r.token): (r.balance, r.nonce, r.delegate, r.since) for r in out.collect()} == want
    plan = out._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "Join" not in plan  # tasks grow in number, and changes are read in one pass


@pytest.mark.parametrize("name", ["accounts_as_of", "balances_after_blocks", "account_fold", "staged_at_block", "staged_from_snapshot", "apply_unapply"])
def test_queries_with_large_accounts_and_many_tasks_against_sql(spark, few, name):
    con = duckdb.connect()
    for t in ("orders", "events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = entry.queries()[name](spark, DATA)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({analogues.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
