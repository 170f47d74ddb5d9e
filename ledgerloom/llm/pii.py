"""Personal data in whole texts: fixed base patterns, and candidates that a boosted-tree classifier selects.

Base spans (email, ip, card, phone) follow their patterns and checks exactly and are always redacted. High-recall
generators propose further, overlapping spans: spelled-out addresses, digit groups without a plus sign, account
numbers and assigned secrets. Boosted trees score each by its format and its context; scores are calibrated on one part
of the examples that is kept aside, and each kind's threshold on another: of those that keep the wanted precision the one
of the best balance with recall. Forms that may be either are told by their context: a bare number, or a spelled-out
address without brackets, counts where a word before it says so. Selected spans that overlap a base span, or a longer one
(of equal ones that of the higher score), are dropped. The classifier is fitted on generated examples with a fixed seed, so
it is the same on every machine; its few kilobytes go to every task.

Every pattern is anchored on a rare character or takes its runs whole, so that a text of any length takes linear time
and a value of any length is one candidate.

Defined cases: a null text is empty and has no spans; repeated rows each get their own; a null ``doc_id`` is
carried; other columns are kept by ``redacted`` and never read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.boosting import Boosted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "number", "account", "secret")
PRECISION = 0.98
#: Generated texts that the trees, their calibration and the thresholds are fitted on.
EXAMPLES = 6000
CONTEXT = 24
#: Characters of a candidate that are scored, the first of a secret and the last of an address; its span is whole.
SCORED = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_ADDRESS = re.compile(r"(?: ?[(\[{]at[)\]}] ?| at )([\w-]++(?:(?: ?[(\[{]dot[)\]}] ?| dot |\.)[\w-]{2,}+)++)", re.I)
_NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9][0-9 ().\-/]{6,}+")
#: Digits of a part of a digit run, between spaces, that is proposed beside the run.
PART_DIGITS = 7
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*+[:=]\s*+[\"']?([^\s\"']{6,})", re.I)
_HINT = re.compile(r"(?<![^\W_])(?:password|passwd|pwd|secret|token|(?:api|access)[_-]?key|key|phone|tel|call|mobile|fax|ssn|social|iban|account|card|mail|contact|reach|write)s?(?![^\W_])", re.I)
_AGAINST = re.compile(r"(?<![^\W_])(?:version|isbn|page|chapter|order|invoice|price|total|since|between|score|id|no)s?(?![^\W_])", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping within a kind, sorted."""
    out = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _digit_runs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A run of digits and separators, and its parts between spaces that hold enough digits; ends are digits, and no letter follows."""
    if end < len(text) and (text[end].isalnum() or text[end] == "_"):
        while end > start and text[end - 1].isdigit():
            end -= 1
    while end > start and not text[end - 1].isdigit():
        end -= 1
    if end - start >= 7:
        yield start, end
        parts = [p for p in re.finditer(r"[^ ]+", text[start:end])]
        if len(parts) > 1:
            for p in parts:
                digits = p[0].rstrip("().-/")
                if len(_digits(digits)) >= PART_DIGITS:
                    yield start + p.start(), start + p.start() + len(digits)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) proposed by the generators; they may overlap."""
    out = []
    lower = text.lower()
    if " at " in lower or "at)" in lower or "at]" in lower or "at}" in lower:
        for m in _ADDRESS.finditer(text):
            start = m.start()
            while start > 0 and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 4, m.end(1)))
    for m in _NUMBER.finditer(text):
        out += [(s, 5, e) for s, e in _digit_runs(text, m.start(), m.end())]
    out += [(m.start(), 6, m.end()) for m in _ACCOUNT.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(1), 7, m.end(1)) for m in _SECRET.finditer(text)]
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    own = text[max(start, end - SCORED) : end] if kind == 4 else text[start : min(end, start + SCORED)]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = _digits(own)
    groups = re.findall(r"[0-9]+", own)
    counts = Counter(own)
    entropy = -sum(n / len(own) * math.log2(n / len(own)) for n in counts.values())
    return [
        float(kind), len(own), len(digits), len(digits) / len(own), sum(c.isalpha() for c in own) / len(own), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), entropy,
        sum(own.count(c) for c in "-"), sum(own.count(c) for c in ". "), own.count("/"), own.count("("), float(bool(_HINT.search(before))), float(bool(_AGAINST.search(before))), float(bool(re.search(r"[(\[{](?:at|dot)", own, re.I))), float(" dot " in own.lower()),
        float(len(digits) in (9, 10, 11)), float(13 <= len(digits) <= 19 and luhn(digits)), float(after[:1].isalnum()), float(sum(map(str.isupper, own)) / len(own)), float(any(c.isdigit() for c in own) and any(c.isalpha() for c in own)), len(set(own)) / len(own),
    ]


def _examples(seed: int = 11, count: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates with labels: spans that hold personal data, and look-alikes that don't."""
    rnd = random.Random(seed)
    pick, letters = rnd.choice, "abcdefghijklmnopqrstuvwxyz"
    word = lambda a=3, b=9: "".join(pick(letters) for _ in range(rnd.randint(a, b)))
    num = lambda n: "".join(pick("0123456789") for _ in range(n))
    hexes = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(pick(letters + letters.upper() + "0123456789") for _ in range(n - 2)) + pick("0123456789") + pick(letters)
    unclear = lambda: pick([f"{num(3)} {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", num(10), f"{num(4)} {num(6)}"])
    good = [
        lambda: f"{pick(['mail', 'contact', 'write to', 'reach me:'])} {word()}.{word()} {pick(['(at)', '[at]', '{at}'])} {word()} {pick(['(dot)', '[dot]', '.'])} {pick(['com', 'org', 'net', 'de'])} ",
        lambda: f"{pick(['mail me', 'contact', word()])} {word()}{num(2)} at {word()} dot {pick(['com', 'org', 'net'])} ",
        lambda: f"{pick(['call', 'phone', 'tel', 'mobile', 'fax'])}{pick([':', '', ' me on'])} {pick([f'({num(3)}) {num(3)}-{num(4)}', f'{num(3)}-{num(3)}-{num(4)}', f'{num(3)} {num(3)} {num(4)}', f'0{num(3)} {num(7)}', f'{num(3)}.{num(3)}.{num(4)}'])} ",
        lambda: f"{word()} ({num(3)}) {num(3)}-{num(4)} {word()}",
        lambda: f"{pick(['call', 'mobile', 'phone', 'tel', 'reach me on'])} {unclear()} {word()}",
        lambda: f"{pick(['mail', 'contact', 'write to', 'reach'])} {word()} {pick(['at', '(at)', '[at]'])} {word()}.{pick(['com', 'org', 'net'])} {word()}",
        lambda: f"{word()} {word()}{pick(['.', '_', ''])}{word()} {pick(['(at)', '[at]', '{at}'])} {word()}.{pick(['com', 'org', 'net', 'de'])} {word()}",
        lambda: f"{word()} {pick(['password', 'token', 'secret'])}{pick(['=', ': '])}{pick([mixed(8), mixed(10), hexes(8)])} ",
        lambda: f"{pick(['ssn', 'social security'])} {pick(['', 'number '])}{num(3)}-{num(2)}-{num(4)} ",
        lambda: f"{pick(['iban', 'account'])} {pick(['DE', 'FR', 'ES', 'GB'])}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)} ",
        lambda: f"{word()} {pick(['password', 'pwd', 'api_key', 'token', 'secret'])}{pick(['=', ': ', ' = '])}{pick(['', chr(34)])}{pick([hexes(20), hexes(32), hexes(40), mixed(16), mixed(24)])}{chr(34)} ",
    ]
    bad = [
        lambda: f"{word()} at {word()}.{word()} {word()}. {word()}",
        lambda: f"{word()} at the {word()} dot {word()} ",
        lambda: f"{pick(['version', 'chapter', 'page', 'between', 'since'])} {num(4)}-{num(4)} ",
        lambda: f"{word()} {pick([f'19{num(2)}-{num(2)}-{num(2)}', f'20{num(2)}/{num(2)}/{num(2)}', f'{num(2)}.{num(2)}.20{num(2)}', f'19{num(2)} - 20{num(2)}'])} {word()}",
        lambda: f"{pick(['order', 'invoice', 'isbn', 'price', 'total'])} {pick([num(8), num(10), num(13), f'{num(3)} {num(3)} {num(3)}', f'978-{num(1)}-{num(4)}-{num(4)}-{num(1)}'])} ",
        lambda: f"{word()} {pick([num(16), num(8), num(12), f'{num(1)} {num(1)} {num(1)} {num(1)}', f'{num(3)}.{num(4)}.{num(2)}', f'{num(2)} {num(2)} {num(2)} {num(2)}'])} {word()}",
        lambda: f"{word().upper()} AB{num(2)} {word(4, 4).upper()} {word(4, 4).upper()} {word(4, 4).upper()} ",
        lambda: f"the {pick(['password', 'token', 'secret', 'pwd'])}{pick([': ', '= ', ' = '])}{pick([word(6, 12), word(6, 9) + ',', word(6, 9) + '.', 'required', 'optional', '********', '<password>', '${TOKEN}'])} ",
        lambda: f"{word()} {pick(['table', 'row', 'value'])} {num(5)}.{num(5)} {word()}",
        lambda: f"{pick([word(), word(), 'part', 'order'])} {unclear()} {word()}",
        lambda: f"{word()} at {word()}.{pick(['com', 'org', word(2, 6)])} {word()}",
        lambda: f"{word()} {pick(['token', 'key', 'secret'])}{pick(['=', ': '])}{pick([word(8, 10), word(6, 8) + num(1), word(3, 5) + '_' + word(3, 5), word(6, 9).capitalize()])} ",
        lambda: f"{pick([word(), word(3, 5) + 'tel' + word(2, 4), 're' + 'call' + word(1, 3), 'e' + 'mail' + num(1)])} {num(16)} {word()}",
    ]
    xs, ys = [], []
    for i in range(count):
        label = i % 2
        text = " ".join(word() for _ in range(4)) + " " + pick(good if label else bad)() + " ".join(word() for _ in range(4))
        taken = base_spans(text)
        for start, kind, end in candidates(text):
            if not any(start < e and s < end for s, _, e in taken):
                xs.append(features(text, start, kind, end))
                ys.append(float(label))
    return np.array(xs), np.array(ys)


@lru_cache(1)
def model() -> tuple[Boosted, dict[int, float]]:
    """The fitted trees, and each kind's threshold on calibrated probabilities."""
    x, y = _examples()
    fold = np.arange(len(x)) % 4
    own = fold != 3
    trees = Boosted().fit(x[own], y[own])
    p, aside = trees.probability(x), fold == 3
    least = {}
    for kind in range(len(BASE), len(KINDS)):
        mine = aside & (x[:, 0] == kind)
        order = np.argsort(-p[mine], kind="stable")
        ranked = p[mine][order]
        precise = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1) >= PRECISION
        # A threshold lies between two different probabilities, with all equal ones on one side.
        precise[:-1] &= ranked[1:] < ranked[:-1]
        # Of those that are precise enough, the one of the best balance of precision and recall.
        balance = np.where(precise, np.cumsum(y[mine][order]) / (np.arange(1, mine.sum() + 1) + y[mine].sum()), -1.0)
        at = int(np.argmax(balance)) if precise.any() else None
        least[kind] = 2.0 if at is None else float(ranked[at] + (ranked[at + 1] if at + 1 < len(ranked) else 0)) / 2
    return trees, least


def all_spans(text: str, base: list[tuple[int, int, int]], trees: Boosted, least: dict[int, float]) -> list[tuple[int, int, int]]:
    """Base spans and the selected candidates, sorted."""
    taken = sorted((s, e) for s, _, e in base)
    tops: list[int] = []
    for _, e in taken:
        tops.append(max(e, tops[-1] if tops else 0))
    starts = [s for s, _ in taken]

    def clear(start: int, end: int) -> bool:
        i = bisect_left(starts, end)
        return i == 0 or tops[i - 1] <= start

    open_ = [c for c in candidates(text) if clear(c[0], c[2])]
    if not open_:
        return base
    p = trees.probability(np.array([features(text, *c) for c in open_]))
    chosen: list[tuple[int, int, int]] = []
    used: list[tuple[int, int]] = []
    likely = [(start - end, -score, start, kind, end) for score, (start, kind, end) in zip(p.tolist(), open_, strict=True) if score >= least[kind]]
    for _, _, start, kind, end in sorted(likely):
        i = bisect_left(used, (start, end))
        if (i == 0 or used[i - 1][1] <= start) and (i == len(used) or used[i][0] >= end):
            used.insert(i, (start, end))
            chosen.append((start, kind, end))
    return sorted(base + chosen)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    sent = docs.sparkSession.sparkContext.broadcast(model())  # 40 trees of at most 15 nodes

    @F.arrow_udf(f"struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            text = text.as_py() or ""
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            rows.append({**{f"n_{name}": kinds.count(i) for i, name in enumerate(BASE)}, "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(all_spans(text, base, *sent.value))})
        return pa.array(rows, pa.struct([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in _FIELDS.split(", ")]))

    return docs.select("doc_id", run(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, with every span of a text replaced by its kind in brackets; n_chars follows."""
    sent = docs.sparkSession.sparkContext.broadcast(model())

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if (text := t.as_py()) is None else redact(text, all_spans(text, base_spans(text), *sent.value)) for t in texts], pa.string())

    out = docs.withColumn("text", run(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans are replaced together, under the first one's kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
