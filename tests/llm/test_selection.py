"""Importance resampling, fill-in-the-middle and exact top-k search against plain copies of their definitions."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import checksums, fim, importance, queries, topk

DATA = "/root/testdata/sf0.001"


def compared(spark, name, data=DATA):
    """A query's rows and those of its SQL, both sorted."""
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    return sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))), sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    got, want = compared(spark, name)
    assert got == want


# Importance


def plain_importance(docs, bench):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = [0] * 10000, [0] * 10000
    for _, text in docs:
        for b in runs(text)[1]:
            s[b] += 1
    for text in bench:
        for b in runs(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        n, own = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((-r[3], r[0] is None, r[0] or 0, r[2], r[1], k) for k, r in enumerate(out) if r[4] >= 20)
    rank = {a[-1]: j + 1 for j, a in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(out)]


def check_importance(spark, docs, bench):
    got = importance.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(b,) for b in bench], "text string"))
    rows = sorted(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", F.coalesce("rank", F.lit(0))).collect() if r[0] is not None)
    assert rows == sorted((*r[:4], r[4] or 0) for r in plain_importance(docs, bench) if r[0] is not None)
    return got


def test_importance_of_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_importance(spark, docs, [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])


def test_importance_of_odd_texts(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abAB9üß日") for _ in range(rnd.choice([1, 2, 3, 70, 130])))
    text = lambda n: rnd.choice([" ", "-", "\n\0", "_"]).join(word() for _ in range(n))
    docs = [(i, text(rnd.choice([0, 1, 2, 19, 20, 21, 60]))) for i in range(400)] + [(500, None), (501, ""), (502, " -- "), (503, "x" * 100_000), (504, "Ärger " * 5000)]
    docs += [(600, "the same text " * 10)] * 40 + [(i, "the same text " * 10) for i in range(601, 640)] + [(None, "the same text " * 10)]
    got = check_importance(spark, docs, [text(30) for _ in range(5)] + [None, ""])
    assert got.count() == len(docs)
    ranks = sorted(r[0] for r in got.filter("rank is not null").select("rank").collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_importance_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, none.select("text")).count() == 0
    one = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, rank string, score int")
    row = importance.resampled(one, none.select("text")).first()
    assert (row.doc_id, row.n_features, row["rank"]) == (1, 3, None) and importance.resampled(one, none.select("text")).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    # With only repeated rows, a draw takes whole runs of them.
    same = spark.createDataFrame([(7, "w " * 30)] * 100, "doc_id long, text string")
    assert sorted(r["rank"] for r in importance.resampled(same, none.select("text"), percent=50).collect() if r["rank"]) == list(range(1, 51))


def test_checksums():
    rnd = random.Random(1)
    parts = [bytes(rnd.randrange(256) for _ in range(n)) for n in [0, 1, 2, 63, 64, 65, 200, 1000, 5, 128, 64 * 64 + 1]]
    flat, at = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    crc = checksums.of_slices(flat, at[:-1], at[1:])
    assert crc.tolist() == [zlib.crc32(p) for p in parts]
    assert checksums.joined(crc[:-1], crc[1:], np.diff(at)[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(parts[:-1], parts[1:], strict=True)]
    assert importance.features(pa.array([], pa.string()))[2].tolist() == []


# Fill in the middle


def test_fim_of_odd_texts(spark):
    texts = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "has <P> in it\nb\n", "<M>", "ü\n日本\r\n\x0bß", "<P\n>", "line\n" * 20_000, "x" * 300_000]
    rows = [(i, texts[i % len(texts)], "kept", i) for i in range(200)] + [(None, "a\nb\n", "kept", 1), (3, "a\nb\n", "kept", 1), (3, "a\nb\n", "kept", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, N int")
    got = fim.transformed(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        h = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
        plain = not text or any(s in text for s in ("<P>", "<S>", "<M>"))
        form = "plain" if plain else "spm" if h[3] % 100 < 50 else "psm"
        assert (r["n"], r.form, r.source) == (len(lines), form, "kept")
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if plain else (len(prefix), len(middle)))
        assert r.output == {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        assert fim.restored(r.output, r.form) == text
    assert fim.transformed(docs.limit(0)).count() == 0
    few = [r.form for r in fim.transformed(docs.filter("text = 'a\\nb\\nc'"), rate=0).collect()]
    assert few and set(few) == {"plain"}


# Exact search


def plain_nearest(rows, k=5):
    vec = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, (i, q) in enumerate(vec):
        if i is not None and i % 50 == 0:
            found = sorted((-clip(sum(x * y for x, y in zip(q, e, strict=True))), j is None, j or 0) for b, (j, e) in enumerate(vec) if b != a and len(e) == len(q))
            out += [(i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(found[:k])]
    return out


def check_nearest(spark, rows, k=5):
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=k)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_nearest(rows, k)))


@pytest.mark.parametrize(("group", "chunk", "tile"), [(8192, 16_384, 1024), (3, 100, 2)])
def test_nearest_against_brute_force(spark, monkeypatch, group, chunk, tile):
    for name, value in {"QUERIES": group, "CHUNK": chunk, "TILE": tile}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    near = base[rng.integers(0, 12, 700)] + rng.standard_normal((700, 16)) * rng.choice([0.0, 0.001, 0.05, 2.0], (700, 1))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(near)] + [(-50, near[0].tolist()), (1000, near[1].tolist())] + [(1050 + i, near[2].tolist()) for i in range(60)]
    check_nearest(spark, rows)


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (50, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [1.0, 0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0])]
    rows += [(5, [1.0]), (100, [2.0]), (150, []), (6, []), (200, [1.0, 2.0, 3.0]), (250, [0.0, 0.0]), (7, [-0.001, 0.001]), (8, [1e6, -1e6]), (300, [-1e6, 3.5])]
    check_nearest(spark, rows)
    check_nearest(spark, rows, k=1)
    check_nearest(spark, [(0, [1e17, 1.0]), (1, [-1e17, 5.0]), (2, [1e17, 2.0]), (50, [3e18, 3e18])])
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, rank int, score string")
    assert topk.nearest(none).collect() == []


def test_nearest_looks_at_few_exact_vectors(spark):
    rng = np.random.default_rng(8)
    vec = np.floor(256 * (x := rng.standard_normal((20_000, 64))) / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    shift, cells = topk.approximated(vec)
    group, read = topk.Queries(vec[:50], 6), []
    real = group.exact
    group.exact = lambda q, e: (read.append(len(q)), real(q, e))[1]
    for lo in range(0, len(vec), 1024):
        group.scan(np.arange(lo, min(lo + 1024, len(vec))), [[i] for i in range(lo, min(lo + 1024, len(vec)))], shift[lo : lo + 1024], cells[lo : lo + 1024], vec[lo : lo + 1024])
    assert sum(read) < 0.05 * 50 * len(vec)
    _, score, ids, _ = group.best()
    want = vec[:50] @ vec.T
    assert score.tolist() == [want[q, i] for q in range(50) for i in np.lexsort((np.arange(len(vec)), -want[q]))[:6]] and len(ids) == 300
