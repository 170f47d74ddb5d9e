"""Quality: tokens and scores of whole texts against plain copies, word by word."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerloom.llm import quality
from ledgerloom.llm.shingles import hashes, mix

DATA = "/root/testdata/sf0.01"


def number(parts, how):
    """The 64-bit number of a token, by the library's hash of one word and its mixing of numbers."""
    flat = np.frombuffer(parts.encode("utf-8", "surrogatepass") if isinstance(parts, str) else parts, np.uint8)
    return int(hashes(flat, np.array([0]), np.array([len(flat)]))[0]) ^ how


def plain_mix(x):
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def plain_tokens(text):
    """Counter of (feature, family) and each family's size."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    lower = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]

    def shape(w):
        marks = [ord("0") if 48 <= c <= 57 else ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 else ord("e") if c >= 128 else c for c in w]
        return bytes(c for i, c in enumerate(marks) if i == 0 or c != marks[i - 1])

    h, s = [number(w, 0) for w in lower], [number(shape(w), 0x5851F42D4C957F2D) for w in words]
    pair = lambda a, b, k: plain_mix(a * 0x9E3779B97F4A7C15 + b + k)
    families = [[plain_mix(x) for x in h], [pair(a, b, 1) for a, b in zip(h, h[1:], strict=False)], [plain_mix(x) for x in s], [pair(a, b, 2) for a, b in zip(s, s[1:], strict=False)], [plain_mix((a == b) + 0xD1B54A32D192ED03) for a, b in zip(h, h[1:], strict=False)]]
    total = Counter()
    for family in families:
        for x in family:
            total[x >> (64 - quality.BITS)] += quality.SCALE / len(family)
    return total


def texts_of(seed=4, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abAB09-.,éß日") for _ in range(rnd.choice([1, 2, 5, 20])))
    out = [rnd.choice([" ", "\t", "  \n"]).join(rnd.choice([word(), "the", "The", "a1"]) for _ in range(rnd.choice([0, 1, 2, 3, 40]))) for _ in range(n)]
    return [*out, None, "", " ", "same same same", "x" * 5000]


def test_tokens_against_a_plain_copy():
    texts = texts_of()
    feature, doc, weight = quality.tokens(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        got = Counter()
        for f, w in zip(feature[doc == i].tolist(), weight[doc == i].tolist(), strict=True):
            got[f] += w
        want = plain_tokens(text)
        assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], rel_tol=1e-9) for f in want)


def test_scores_against_a_plain_copy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 300"), spark.read.parquet(f"{DATA}/labels.parquet")
    more = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate(texts_of())], docs.schema))
    x, w, bias = quality.trained(more, labels)
    weight = dict(zip(x.tolist(), w.tolist(), strict=True))
    text = {r.doc_id: r.text for r in more.collect()}
    rows = quality.scored(more, labels).collect()
    assert len(rows) == len(text)
    for r in rows:
        margin = bias + sum(v * weight.get(f, 0.0) for f, v in plain_tokens(text[r.doc_id]).items())
        assert math.isclose(r.score, 1 / (1 + math.exp(-margin)), rel_tol=1e-6) and r.predicted == int(r.score >= 0.3)
    kept = {r.doc_id for r in quality.filtered(more, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in rows if r.score >= 0.3}


def test_features_of_a_batch_hold_the_tokens_of_a_few_texts_at_once():
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([0, 5, 300, 900]))) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([1] * 1000, pa.int32()), pa.array(texts)], ["rank", "quality", "text"])
    tracemalloc.start()
    got = list(quality.featured(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all texts at once take more than 100 MB
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["rank"] for r in rows] == list(range(1000))
    for i in (0, 63, 64, 500, 999):
        want = plain_tokens(texts[i])
        found = dict(zip(np.frombuffer(rows[i]["x"], "<i4").tolist(), np.frombuffer(rows[i]["v"], "<f4").tolist(), strict=True))
        assert found.keys() == want.keys() and all(math.isclose(found[f], want[f], rel_tol=1e-5) for f in want)
