"""Base58check texts, memos and digests: no built-in function decodes base 58, so these are Arrow functions."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: the digits of base 58, and addresses and prefix of memos that name an account.
_DIGITS = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
NAME_SERVICES = ("B62qjzJvc59DdG9ahht9rwxkEz7GedKuUMsnaVTuXFUeANKqfBeWpRE", "B62qjMINASEARCHMINASEARCHMINASEARCHMINASEARCHMINASEARCH")
NAME_PREFIX = "Name: "
MEMO_BYTES = 32

_VALUE = {c: i for i, c in enumerate(_DIGITS)}


def base58(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), []
    while n:
        n, r = divmod(n, 58)
        out.append(_DIGITS[r])
    return _DIGITS[0] * (len(data) - len(data.lstrip(b"\0"))) + "".join(reversed(out))


def from_base58(text: str) -> bytes | None:
    """The bytes of a text, or None if it holds another character."""
    n = 0
    for c in text:
        if c not in _VALUE:
            return None
        n = n * 58 + _VALUE[c]
    return bytes(len(text) - len(text.lstrip(_DIGITS[0]))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def _check(data: bytes) -> bytes:
    return hashlib.sha256(hashlib.sha256(data).digest()).digest()[:4]


def base58check(data: Column, version: int) -> Column:
    """Bytes behind a version byte, with four bytes of checksum, in base 58; null stays null."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        whole = [None if v is None else bytes([version]) + v for v in values.to_pylist()]
        return pa.array([None if w is None else base58(w + _check(w)) for w in whole], pa.string())

    return run(data)


def from_base58check(text: Column) -> Column:
    """(version, data) of a base58check text; null where the text or its checksum is wrong."""

    @F.arrow_udf("struct<version:int,data:binary>")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for text in values.to_pylist():
            whole = None if text is None else from_base58(text)
            good = whole is not None and len(whole) >= 5 and _check(whole[:-4]) == whole[-4:]
            out.append({"version": whole[0], "data": whole[1:-4]} if good else None)
        return pa.array(out, pa.struct([("version", pa.int32()), ("data", pa.binary())]))

    return run(text)


def memo(text: Column) -> Column:
    """The text of a base58check memo: version, tag and length bytes, then so many bytes of UTF-8.

    What is no memo, or no UTF-8, is the empty text; null stays null.
    """

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for text in values.to_pylist():
            whole = None if text is None else from_base58(text)
            if text is None or whole is None or len(whole) < 3:
                out.append(None if text is None else "")
                continue
            try:
                out.append(whole[3 : 3 + whole[2]].decode())
            except UnicodeDecodeError:
                out.append("")
        return pa.array(out, pa.string())

    return run(text)


def blake2b(data: Column) -> Column:
    """The digest of 32 bytes as lower-case hex digits, as of VRF outputs; null stays null."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else hashlib.blake2b(v, digest_size=32).hexdigest() for v in values.to_pylist()], pa.string())

    return run(data)


def claimed_name(memo_text: Column, receiver: Column, applied: Column) -> Column:
    """The name that an applied payment to a name service claims, null otherwise; at most 26 bytes, as a memo's rest."""
    name = F.substring(memo_text, len(NAME_PREFIX) + 1, MEMO_BYTES)
    claims = applied & memo_text.startswith(NAME_PREFIX) & receiver.isin(*NAME_SERVICES)
    return F.when(claims & (F.octet_length(name) <= MEMO_BYTES - len(NAME_PREFIX)), name)
