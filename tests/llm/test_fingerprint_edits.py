"""Fingerprints of edited texts inside crowded buckets, and repeated rows over many blocks."""

import hashlib
import random

from pyspark.sql import functions as F

from ledgerloom.llm import fingerprint


def test_equal_texts_have_equal_fingerprints_in_a_crowded_bucket(spark):
    """Every digest is the same, so buckets tell texts apart; a document of one character is its own edited text."""
    rows = [(i, t) for i, t in enumerate(["a", "b", "c", "ab", "b", "B", "", None, "ba", "xb"])]
    got = fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), digest_of=lambda c: F.lit("0" * 32)).collect()
    assert len(got) == len(rows)
    by_id = sorted(rows, key=lambda r: -r[0])
    edited = {}
    for (i, t), (_, n) in zip(by_id, by_id[1:] + by_id[:1], strict=True):
        t, n = t or "", n or ""
        edited[i] = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
    known = {(t or "").lower(): r.fingerprint for r in got for i, t in rows if i == r.doc_id}
    assert len(set(known.values())) == len(known) == 7
    for r in got:
        assert r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest()
        if edited[r.doc_id].lower() in known:
            assert r.edited_fingerprint == known[edited[r.doc_id].lower()]
        assert r.near_edited == float(edited[r.doc_id].lower() == (dict(rows)[r.doc_id] or "").lower())


def test_rows_that_repeat_one_id_and_text(spark):
    rnd = random.Random(5)
    rows = [(7, "the same text")] * 300 + [(7, "another text")] * 3 + [(i, f"text {rnd.randint(0, 9)}") for i in range(100) if i != 7] + [(None, "none")] * 60 + [(None, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprint.edited_fingerprints(df, block_rows=20).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r.doc_id == 7 and r.near_next == 1.0]
    assert len(same) >= 299  # each is followed by its like but for the last of each run
    nexts = fingerprint.with_next(fingerprint.fingerprints(df), 20).collect()
    assert sorted(r.next_text for r in nexts) == sorted(r.text for r in nexts)
    order = sorted((t for i, t in rows if i is not None and i < 7), reverse=True)
    assert len(order) == 7
    # Without repeats in blocks the same rows are found as in one block.
    whole = fingerprint.edited_fingerprints(df, block_rows=10_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole))
