"""Filters from nested inputs: every listing query is a scan, a conjunction of optional conditions, an order and a limit."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUFFIXES = {
    "gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v, "ne": lambda c, v: c != v,
    "in": lambda c, v: c.isin(list(v)), "prefix": lambda c, v: F.lower(c).startswith(str(v).lower()), "contains": lambda c, v: F.array_contains(c, v),
}

Fields = Mapping[str, Callable[[Any], Column]]


def predicate(query: Mapping[str, Any] | None, fields: Fields | None = None) -> Column:
    """A condition from ``{"height_gte": 3, "creator": "x", "or": [{...}, {...}]}``.

    A value of None is no constraint; ``and`` holds if all do, ``or`` if any does, and an empty list of either is no
    constraint. With ``fields`` only its names are known, and another one is an error. Without, a name ends in one of
    the suffixes, or else stands for equality.
    """
    parts: list[Column] = []
    for name, value in (query or {}).items():
        if value is None:
            continue
        if name in ("and", "or"):
            if value:
                parts.append(reduce(and_ if name == "and" else or_, [predicate(q, fields) for q in value]))
            continue
        if fields is not None:
            if name not in fields:
                raise ValueError(f"no field {name}; there are {', '.join(sorted(fields))}")
            parts.append(fields[name](value))
            continue
        column, _, suffix = name.rpartition("_")
        if column and suffix in _SUFFIXES:
            parts.append(_SUFFIXES[suffix](F.col(column), value))
        else:
            parts.append(F.col(name) == F.lit(value))
    return reduce(and_, parts, F.lit(True))


def _equal(*names: str) -> Fields:
    return {n: (lambda v, n=n: F.col(n) == F.lit(v)) for n in names}


def _ranges(name: str, column: str | None = None) -> Fields:
    return {f"{name}_{s}" if s else name: (lambda v, s=s: (_SUFFIXES[s](F.col(column or name), v) if s else F.col(column or name) == F.lit(v))) for s in ("", "gt", "gte", "lt", "lte")}


def _window(name: str, start: str, end: str) -> Fields:
    return {start: lambda v: F.col(name) >= v, end: lambda v: F.col(name) < v}


#: What each listing can be asked for. A block's slot must be equal in both of its columns; a token's owner of null equals
#: nothing; a contract command is to whoever one of its updates touches.
BLOCKS: Fields = {
    **_equal("canonical", "state_hash", "epoch", "genesis_state_hash", "winner", "creator", "coinbase_receiver"),
    **_ranges("height"), **_ranges("global_slot"),
    "global_slot": lambda v: (F.col("global_slot") == v) & (F.col("slot_since_fork") == v),
}
COMMANDS: Fields = {
    **_equal("txn_hash", "state_hash", "canonical", "kind", "memo", "failure_reason", "applied", "is_zkapp"),
    **_ranges("fee"), **_ranges("amount"), **_ranges("height"), **_ranges("global_slot"), **_ranges("date_time_ms"), **_ranges("nonce"),
    "from": lambda v: F.col("sender") == v, "to": lambda v: F.exists("receivers", lambda r: r["pk"] == v), "token": lambda v: F.exists("receivers", lambda r: r["token"] == v),
}
SNARKS: Fields = {**_equal("state_hash", "prover", "canonical"), **_ranges("height")}
INTERNAL: Fields = {**_equal("state_hash", "canonical", "kind"), "recipient": lambda v: F.col("receiver") == v, **_ranges("height")}
ACCOUNTS: Fields = {
    **_equal("pk", "delegate", "token", "is_zkapp"), **_ranges("balance"), "balance_ne": lambda v: F.col("balance") != v,
    "username": lambda v: F.lower("username").startswith(str(v).lower()),
}
STAKES: Fields = {**_equal("pk", "username", "delegate", "ledger_hash", "genesis_state_hash", "epoch"), "stake_lte": lambda v: F.col("total_delegated").cast("double") / 1e9 <= float(v)}
TOP: Fields = _equal("pk", "username", "epoch")
TOKENS: Fields = {**_equal("token", "symbol", "supply"), "owner": lambda v: F.coalesce(F.col("owner") == F.lit(v), F.lit(False))}
HOLDERS: Fields = {**_equal("token"), "holder": lambda v: F.col("pk") == v}
ACTIONS: Fields = {**_equal("pk", "token"), **_window("height", "start_height", "end_height"), **_window("idx", "start_index", "end_index")}


def listing(df: DataFrame, query: Mapping[str, Any] | None, order: list[Column], limit: int = 100, fields: Fields | None = None) -> DataFrame:
    """Filter, order and limit; Spark keeps the top rows of each partition only."""
    return df.filter(predicate(query, fields)).orderBy(*order).limit(limit)


def page_limit(n: int | None) -> int:
    """The number of rows of a page: 10 unless asked for, at most 100 (fixed values)."""
    return 10 if n is None else max(0, min(n, 100))


def canonical_first(limit_to: str = "height") -> list[Column]:
    """The order of blocks at one height: canonical ones first, then by the fork choice."""
    return [F.col(limit_to).desc(), F.col("canonical").desc_nulls_last(), F.col("vrf").desc(), F.col("state_hash").desc()]
