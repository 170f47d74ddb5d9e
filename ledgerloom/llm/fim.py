"""Fill-in-the-middle rewriting of documents: a text cut at unit ends, its parts put into another order behind sentinels.

A unit is what ``unit`` matches, a line by default. Of one text only the ends of its units are kept, in a compact array;
two of them cut the text into prefix, middle and suffix, so a text of any length costs itself and eight bytes a unit.
Where it is cut, and into which form it goes, follows from a digest of the seed and the id, so reruns agree. Rows go to
Python in Arrow batches and nothing is shuffled.

Defined cases: a null text is the empty one; an empty text, and one that holds a sentinel, stays plain and has no prefix
or middle; a null ``doc_id`` is digested as the empty text; repeated rows are rewritten alike; other columns are kept by
``transformed`` (of those that it adds, ones with the same name are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free

UNIT = r"[^\n]*\n|[^\n]+"
#: What stands before the prefix, the suffix and the middle (fixed values of the format).
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that are rewritten, and percent of those that have the suffix first.
RATE, SPM_RATE = 100, 50
SEED = 7

_RESULT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """0 and the end of each unit, in code points."""
    ends = array("q", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of an id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def rewritten(text: str, doc_id: int | None, unit: regex.Pattern, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and the text in that form."""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = numbers(doc_id, seed)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low], ends[high]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: str, form: str) -> str:
    """The text that was rewritten, from what became of it alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    a, _, rest = output.removeprefix(first).partition(second)
    b, _, middle = rest.partition(MIDDLE)
    return "".join((b, middle, a) if form == "spm" else (a, middle, b))


def transformed(docs: DataFrame, unit: str = UNIT, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and ``output``, the rewritten text."""

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(unit)
        rows = [rewritten(text or "", None if pd.isna(i) else int(i), pattern, rate, spm_rate, seed) for text, i in zip(texts, ids, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    # Ids go as text: a nullable integer column would come as floating-point numbers.
    (made,) = free(docs, "fim")
    own = docs.withColumn(made, run(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long").cast("string")))
    return own.withColumns({c: F.col(f"{made}.{c}") for c in ("n", "form", "prefix_chars", "middle_chars", "output")}).drop(made)


def digests(output: str, form: str) -> Column:
    """SHA-256 of rewritten texts, and of the texts that are rebuilt from them, of two columns."""

    @F.pandas_udf("struct<output_sha256:string,restored_sha256:string>")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        return pd.DataFrame({"output_sha256": [sha(o) for o in outputs], "restored_sha256": [sha(restored(o, f)) for o, f in zip(outputs, forms, strict=True)]}, dtype="object")

    return run(output, form)
