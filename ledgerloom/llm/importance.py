"""Importance resampling towards the distribution of a target table, by exact ranks of integer scores.

1. Features of a text are its runs of one to three words, each in a bucket by CRC-32. Every task counts its buckets in
   an array; a row a bucket and task is summed. A bucket's gain compares the target's count with the documents'.
2. The gains, one array of ``BUCKETS`` numbers, go to every task, and a text's weight is the sum of its features' gains.
   The score adds a Gumbel number from a digest of the id, so that the highest scores are a draw by weight.
3. Scores that enough words earned are counted, a row a score, in ranges of scores. A range's count is added to those of
   the ranges below it, and inside a range to those of lower scores, so each score knows how many rows stand above it:
   the suffix sum from which the ranks of its own rows start. The cutoff is the last score that starts within the draw.
4. Only rows at or above the cutoff are numbered, by id within each score. Repeated rows are folded before that and
   unfolded after. Integer scores spread even texts of equal weight: by the Gumbel density a score holds fewer than a
   two-thousandth of rows with different ids.

Texts are read twice, and neither they nor their features are shuffled.

Defined cases: a null text has no words, weight 0 and is not drawn; a null ``doc_id`` draws by the empty text and comes
last among equal scores; repeated rows are documents of their own and take ranks next to each other (of rows with one id
and score but different texts that of less weight, then of fewer features, comes first); a document with no features is
scored by its draw alone; an empty table gives an empty result, an empty target gains of its counts of 0; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.checksums import joined, of_slices
from ledgerloom.llm.common import cut, written
from ledgerloom.llm.shingles import _LOWER, bytes_of, words

BUCKETS = 10_000
#: Words in a row that make a feature, at most.
RUN = 3
#: Words that a document must have to be drawn.
LEAST_WORDS = 20
#: Percent of those documents that are drawn.
PERCENT = 5
SEED = 42

#: Bytes that lie between words, once A-Z are lower-cased: all of ASCII but digits and letters.
_GAPS = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
_SPACE = of_slices(np.array([32], np.uint8), np.array([0]), np.array([1]))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the text that each belongs to, and the number of words of each text."""
    flat, at = bytes_of(texts)
    flat = _LOWER[flat]
    start, end, doc = words(flat, at, _GAPS)
    size, crc = end - start, of_slices(flat, start, end)
    run, buckets, owner = crc, [crc % BUCKETS], [doc]
    for n in range(1, RUN):
        same = doc[n:] == doc[: len(doc) - n]
        run = joined(joined(run[: len(run) - 1], _SPACE, np.ones(1, np.int64)), crc[n:], size[n:])
        buckets.append(run[same] % BUCKETS)
        owner.append(doc[n:][same])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owner), np.bincount(doc, minlength=len(texts))


def bucket_counts(table: DataFrame) -> DataFrame:
    """(bucket, n): features of all texts, one row a bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(features(batch["text"])[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return table.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket: the floor of 1000 times the logarithm of how much likelier it is in the target."""

    def counts(table: DataFrame) -> list[int]:
        out = [0] * BUCKETS
        for r in bucket_counts(table).collect():  # BUCKETS rows at most
            out[r.bucket] = r.n
        return out

    s, t = counts(documents), counts(target)
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((float(t[b] + 1) * (all_s + BUCKETS)) / (float(s[b] + 1) * (all_t + BUCKETS)))) for b in range(BUCKETS)], np.int64)


def draw(doc_id: int | None, seed: int = SEED) -> int:
    """A Gumbel number of an id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, enough) of every document; enough: it has the words to be drawn."""
    sent = documents.sparkSession.sparkContext.broadcast(gains(documents, target))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, owner, n = features(batch["text"])
            weight, many = np.zeros(len(n), np.int64), np.bincount(owner, minlength=len(n))
            np.add.at(weight, owner, sent.value[bucket])
            score = weight + np.array([draw(i, seed) for i in batch["doc_id"].to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(many), pa.array(weight), pa.array(score), pa.array(n >= LEAST_WORDS)], ["doc_id", "n_features", "weight", "score", "enough"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_features long, weight long, score long, enough boolean")


def offsets(rows: DataFrame) -> DataFrame:
    """(score, n, above): the rows of each score, and the rows of all higher scores."""
    counts = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Ranges of scores, numbered from the highest down; checkpointed, so that a lost task can't number them anew.
    ranges = cut(counts.repartitionByRange(F.col("score").desc()).withColumn("range", F.spark_partition_id()))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = ranges.groupBy("range").agg(F.sum("n").alias("all")).select("range", F.coalesce(F.sum("all").over(order), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.withColumn("inside", inside).join(F.broadcast(before), "range").select("score", "n", (F.col("before") + F.col("inside")).alias("above"))


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    rows = written(scored(documents, target, seed), "scored")
    columns = ["doc_id", "n_features", "weight", "score"]
    can = rows.filter("enough")
    wanted = percent * can.count() // 100
    starts = cut(offsets(can).filter(F.col("above") < wanted))
    cutoff = starts.agg(F.min("score")).first()[0]
    if cutoff is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = F.col("enough") & (F.col("score") >= cutoff)
    folded = rows.filter(drawn).groupBy(*columns).agg(F.count(F.lit(1)).alias("times")).join(starts, "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("above") + F.coalesce(F.sum("times").over(order), F.lit(0)) + 1
    numbered = folded.withColumn("first", first).select(*columns, F.explode(F.sequence("first", F.col("first") + F.col("times") - 1)).alias("rank"))
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return rows.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(numbered)
