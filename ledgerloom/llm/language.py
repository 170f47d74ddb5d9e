"""Language identification by the nearest of several centroids per language.

A text is a vector of TF-IDF weighted n-grams of its lower-cased UTF-8 bytes (letters and bytes above ASCII, all else
a space), hashed to ``DIM`` places, scaled to unit length. Document frequencies are counted over all labelled texts
outside the held-out fold. Each language's centroids come from spherical k-means over at most about ``TRAIN_ROWS`` of
its texts. A text gets the language of the centroid of the largest cosine; one that is farther from it than almost all
texts that the centroid was made from is marked ``rejected`` and its score is halved.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without labelled rows so is every text;
rows with a null lang or a null doc_id are not learnt from; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut
from ledgerloom.llm.shingles import bytes_of

DIM = 8192
GRAMS = (2, 3, 4)
#: Bound of the texts of a language that its centroids are fitted on.
TRAIN_ROWS = 768
CLUSTERS = 4
ROUNDS = 8
#: Share of a centroid's own texts that are nearer than its rejection distance.
NEARER = 0.995
UNKNOWN = "und"
PART = 128

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def counts(texts: pa.Array) -> np.ndarray:
    """(texts x DIM) counts of hashed n-grams."""
    flat, at = bytes_of(pc.utf8_lower(texts))
    flat = _LETTER[flat].astype(np.uint64)
    out = np.zeros(len(texts) * DIM)
    for n in GRAMS:
        if flat.size < n:
            continue
        code = np.zeros(flat.size - n + 1, np.uint64)
        blank = np.zeros(flat.size - n + 1, np.int8)
        for i in range(n):
            part = flat[i : flat.size - n + 1 + i]
            code = (code << np.uint64(8)) | part
            blank += part == 32
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        inside = (doc[: len(code)] == doc[n - 1 :]) & (blank < n - 1)
        with np.errstate(over="ignore"):
            place = ((code[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 13)).astype(np.int64)
        out += np.bincount(doc[: len(code)][inside] * DIM + place, minlength=len(out))
    return out.reshape(len(texts), DIM)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(found) * idf).astype("f4")
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def clusters(x: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by spherical k-means, first ones picked as far apart as can be, and their rejection cosines."""
    picked = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        picked.append(x[int(np.argmin(np.max(x @ np.stack(picked).T, axis=1)))])
    c = np.stack(picked)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    cosine = x @ c.T
    own = np.argmax(cosine, axis=1)
    least = np.array([np.quantile(cosine[own == i, i], 1 - NEARER) if (own == i).any() else 1.0 for i in range(len(c))])
    return c, least


def trained(docs: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Inverse document frequencies, and each centroid's language, place and rejection cosine."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and doc_id is not null and text is not null").filter(fold(F.col("doc_id")) != 2)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, PART):
                part = batch["text"].slice(lo, PART)
                total += (counts(part) > 0).sum(0)
                texts += len(part)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM, dtype="i4")), pa.array(np.concatenate([[texts], total]))], ["place", "n"])

    summed = dict(rows.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect())  # DIM + 1 rows at most
    idf = np.log((1 + summed.get(-1, 0)) / (1 + np.array([summed.get(i, 0) for i in range(DIM)]))) + 1
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of"))
    rank = F.pmod(F.xxhash64("doc_id", F.lit(37)), F.lit(1 << 30))
    sample = rows.join(F.broadcast(cut(sizes).withColumnRenamed("lang", "l")), F.col("lang") == F.col("l")).filter(rank < F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(float(most)) / F.col("of")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        texts = pa.array(pdf["text"], pa.string())
        x = np.concatenate([vectors(counts(texts.slice(lo, PART)), idf) for lo in range(0, len(texts), PART)])
        c, least = clusters(x)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "nth": range(len(c)), "place": [v.astype("<f4").tobytes() for v in c], "least": least})

    found = sample.select("doc_id", "text", "lang").groupBy("lang").applyInPandas(fit, "lang string, nth int, place binary, least double").orderBy("lang", "nth").collect()  # CLUSTERS rows a language
    places = np.stack([np.frombuffer(r["place"], "<f4") for r in found]) if found else np.zeros((0, DIM), "f4")
    return idf, [r["lang"] for r in found], places, np.array([r["least"] for r in found])


def identified(docs: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, most))

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        idf, langs, places, least = sent.value
        names, of = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True) if langs else (np.zeros(0, str), None)
        out = []
        for lo in range(0, len(texts), PART):
            part = texts.slice(lo, PART)
            letters = pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            cosine = vectors(counts(part), idf) @ places.T if langs else None
            for i in range(len(part)):
                if not letters[i] or not langs:
                    out.append({"lang": UNKNOWN, "score": 0.0, "rejected": True})
                    continue
                best = int(np.argmax(cosine[i]))
                score, far = float(np.clip(cosine[i, best], 0, 1)), bool(cosine[i, best] < least[best])
                out.append({"lang": str(names[of[best]]), "score": score / 2 if far else score, "rejected": far})
        return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), run(F.col("text").cast("string")).alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))
