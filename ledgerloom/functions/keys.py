"""Checks of textual keys and hashes, of columns and of what queries ask for."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes and length of each form (fixed values of the format).
FORMS: dict[str, tuple[tuple[str, ...], int]] = {
    "public key": (("B62q",), 55),
    "state hash": (("3N",), 52),
    "ledger hash": (("jx", "jw", "jy", "jz"), 51),
    "token": (("",), 50),
    "transaction hash": (("Ckp",), 53),
    "new transaction hash": (("5J",), 52),
}
#: Bytes of a user name at most.
NAME_BYTES = 26
#: The forms that a field of a query may have; other fields are not checked.
FIELDS: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("pk", "from", "to", "sender", "creator", "coinbase_receiver", "winner", "prover", "delegate", "holder", "recipient", "owner"), ("public key",)),
    **dict.fromkeys(("state_hash", "genesis_state_hash"), ("state hash",)),
    "ledger_hash": ("ledger hash",),
    "token": ("token",),
    "txn_hash": ("transaction hash", "new transaction hash"),
}


def well_formed(c: Column, prefix: str, length: int) -> Column:
    """Whether a key has its prefix and its length; null is not well formed."""
    return F.coalesce(c.startswith(prefix) & (F.length(c) == length), F.lit(False))


def is_form(value: str, form: str) -> bool:
    """Whether a text has a form's prefix and length."""
    prefixes, length = FORMS[form]
    return len(value) == length and value.startswith(prefixes)


def wrong(query: Mapping[str, Any] | None) -> list[str]:
    """What a query asks for in no known form, one message a value; ``and`` and ``or`` hold queries of their own, null asks for nothing."""
    found: list[str] = []
    for field, value in (query or {}).items():
        if field in ("and", "or"):
            found += [m for q in value or [] for m in wrong(q)]
        elif value is not None and field in FIELDS:
            if not isinstance(value, str) or not any(is_form(value, f) for f in FIELDS[field]):
                found.append(f"{field}: {value!r} is no {' or '.join(FIELDS[field])}")
        elif value is not None and field == "username" and len(str(value).encode()) > NAME_BYTES:
            found.append(f"{field}: {value!r} is longer than {NAME_BYTES} bytes")
    return found
