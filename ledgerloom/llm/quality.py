"""Quality scores by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are lower-cased words, word pairs, word shapes (runs of upper case, lower case, digits, accented letters and
each punctuation mark folded to one character), shape pairs, and repeats of the previous word. Each family's tokens
are counted by a hash of ``BITS`` bits and divided by the family's size, so a text's length does not move its score;
a score is then a sparse dot product. The model is fitted by one task over at most about ``TRAIN_ROWS`` labelled
rows, chosen by a hash of their ids; weights (a megabyte at most) are broadcast and every text is scored whole.

Defined cases: an empty or null text has no tokens, its score is that of the bias; rows without a label, or with a
null one, are not learnt from; repeated rows count each time; without labelled rows every score is 0.5; other
columns are kept by ``filtered`` and never read by the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import trim
from ledgerloom.llm.shingles import _LOWER, bytes_of, hashes, mix, words

BITS = 18
#: Bound of the labelled rows that the classifier is fitted on.
TRAIN_ROWS = 12_000
EPOCHS = 4
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Weight of a family's mean against the bias.
SCALE = 8.0
#: Texts whose tokens are held at once: some two hundred bytes a token.
SLICE = 64

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = ord("0"), ord("A"), ord("a"), ord("e")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and text numbers of all tokens, and each token's weight (SCALE over its family's size)."""
    raw, at = bytes_of(texts)
    start, end, doc = words(raw, at)
    word = hashes(_LOWER[raw], start, end)
    shape_of = _SHAPE[raw]
    keep = np.ones(raw.size, bool)
    keep[1:] = shape_of[1:] != shape_of[:-1]
    keep[start] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = hashes(shape_of[keep], place[start], place[end]) ^ np.uint64(0x5851F42D4C957F2D)
    next_same = doc[1:] == doc[:-1]
    owner = doc[1:][next_same]
    with np.errstate(over="ignore"):
        pairs = lambda x, k: mix(x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] + np.uint64(k))[next_same]
        repeat = mix((word[1:] == word[:-1])[next_same].astype(np.uint64) + np.uint64(0xD1B54A32D192ED03))
        families = [(mix(word), doc), (pairs(word, 1), owner), (mix(shape), doc), (pairs(shape, 2), owner), (repeat, owner)]
    n = len(texts)
    weight = [SCALE / np.maximum(1, np.bincount(d, minlength=n))[d] for _, d in families]
    feature = np.concatenate([x for x, _ in families]) >> np.uint64(64 - BITS)
    return feature.astype(np.int64), np.concatenate([d for _, d in families]), np.concatenate(weight)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by per-coordinate follow-the-regularised-leader updates over (features, values, label) rows."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for feature, value, label in rows:
            value = value.astype("f8")
            w = weights(feature)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            root = np.sqrt(n[feature])
            n[feature] += g * g
            z[feature] += g - (np.sqrt(n[feature]) - root) / ALPHA * w
    w = weights(slice(None))
    return w[:-1], float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(text, quality) of labelled rows outside the held-out fold, about ``most`` of them at the most."""
    found = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").alias("of"), F.col("quality").cast("int").alias("quality"))
    found = found.filter(fold(F.col("of")) != 0).withColumn("rank", F.pmod(F.xxhash64("of", F.lit(23)), F.lit(1 << 30)))
    share = min(1.0, most / max(1, found.count()))
    found = found.filter(F.col("rank") < int(share * (1 << 30)))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(found, F.col("doc_id") == F.col("of")).select("rank", "text", "quality")


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, quality, x, v): each text's distinct features and the sums of their weights."""
    for whole in batches:
        for lo in range(0, whole.num_rows, SLICE):
            batch = whole.slice(lo, SLICE)
            feature, doc, weight = tokens(batch["text"])
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
            xs, vs = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x, at = np.unique(feature[order[a:b]], return_inverse=True)
                xs.append(x.astype("<i4").tobytes())
                vs.append(np.bincount(at, weight[order[a:b]], len(x)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch["rank"], batch["quality"], pa.array(xs, pa.binary()), pa.array(vs, pa.binary())], ["rank", "quality", "x", "v"])
    trim()


def trained(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Numbers and values of the weights that are not 0, and the bias; None without labelled rows."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = np.array([1 << BITS], "<i4"), np.ones(1, "<f4")
        rows = [(np.append(np.frombuffer(x.as_buffer(), "<i4"), last), np.append(np.frombuffer(v.as_buffer(), "<f4"), one), y.as_py()) for b in batches for x, v, y in zip(b["x"], b["v"], b["quality"], strict=True)]
        if rows:
            w, bias = fit(rows)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()]), pa.array([w[at].astype("<f4").tobytes()]), pa.array([bias])], ["x", "w", "bias"])
        del rows
        trim()

    ready = training_rows(docs, labels, most).mapInArrow(featured, "rank long, quality int, x binary, v binary")
    model = ready.repartition(1).sortWithinPartitions("rank", "quality", "x").mapInArrow(fitted, "x binary, w binary, bias double").first()  # one bounded sample
    return None if model is None else (np.frombuffer(model[0], "<i4"), np.frombuffer(model[1], "<f4"), model[2])


def scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray, float] | None):
    """An Arrow function from texts to scores between 0 and 1."""
    sent = spark.sparkContext.broadcast(model)  # a number and a value for each of 2**BITS features at most

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if sent.value is None:
            return pa.array(np.full(len(texts), 0.5))
        w, bias = dense(sent)
        out = []
        for lo in range(0, len(texts), SLICE):
            part = texts.slice(lo, SLICE)
            feature, doc, weight = tokens(part)
            out.append(np.bincount(doc, w[feature] * weight, len(part)) + bias)
        trim()
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *out]), -35, 35))))

    return score


@lru_cache(1)
def dense(sent) -> tuple[np.ndarray, float]:
    x, v, bias = sent.value
    w = np.zeros(1 << BITS)
    w[x] = v
    return w, bias


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = scorer(docs.sparkSession, trained(docs, labels))
    out = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def filtered(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept."""
    score = scorer(docs.sparkSession, trained(docs, labels))
    return docs.filter(score(F.col("text").cast("string")) >= threshold)
