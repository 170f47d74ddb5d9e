"""Embedding near-duplicates by p-stable hashing, with exact cosines inside the buckets.

Vectors are scaled to unit length; each of several tables quantises several Gaussian projections in steps of ``STEP``.
The published collision probability gives how many: with more vectors more projections, so that a vector meets about
``CANDIDATES`` unrelated ones whatever their number, and so many tables that a pair of the wanted cosine shares one
with probability ``RECALL`` (the more alike, the surer). Tables are bounded by ``MOST_TABLES``, about 10 million vectors
at cosine 0.9; beyond that unrelated candidates grow slowly, recall stays. Equal vectors are one class first. A bucket of
more than ``BLOCK`` classes is cut into blocks and each pair of blocks is a cell, so no bucket is one task's; inside a
cell cosines are exact, in double precision. The pairs of all small cells of a batch are compared at once. A pair is
counted in the first table that it shares alone, so sums need no list of pairs, and a cell returns a row a class at most.
Hot buckets and common vectors are joined by ``by_key``. Classes are numbered when they are written, whatever their ids.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths do not link; repeated rows are vectors of their own; a null ``vec_id`` counts as a link of others
and has no component of its own unless linked to an id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_key, cut, written
from ledgerloom.llm.components import components
from ledgerloom.llm.shingles import seeded

COSINE = 0.9
#: Probability that a pair of the wanted cosine is found.
RECALL = 0.995
#: Unrelated vectors that a vector is compared with, about, over all tables.
CANDIDATES = 256
MOST_TABLES = 512
STEP = 2.0
BLOCK = 1024
SEED = 29
#: Cells of so many classes at most are compared with others of the batch at once.
SMALL = 16
_TABLE_MASK = 1023


def collides(distance: float) -> float:
    """Probability that a quantised projection of two vectors at a distance is the same."""
    t = STEP / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * -math.expm1(-t * t / 2)


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Tables, and projections of each, for n vectors: unrelated ones are at right angles."""
    near, far = collides(math.sqrt(max(1e-9, 2 - 2 * cosine))), collides(math.sqrt(2))
    found = (1, 1)
    for k in range(1, 64):
        tables = math.ceil(math.log(1 - RECALL) / math.log1p(-(near**k)))
        if tables > MOST_TABLES and k > 1:
            break
        found = (tables, k)
        if n * far**k * tables <= CANDIDATES:
            break
    return found


@lru_cache(8)
def planes(dim: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, STEP, tables * projections)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys(u: np.ndarray, tables: int, projections: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """(vectors x tables) bucket numbers, of tables lo to hi alone; the table can be told from the low bits."""
    hi = tables if hi is None else hi
    a, b = (p[..., lo * projections : hi * projections] for p in planes(u.shape[1], tables, projections))
    q = np.floor((u @ a + b) / STEP).astype(np.int64).astype(np.uint64).reshape(len(u), hi - lo, projections)
    number = np.arange(lo, hi, dtype=np.uint64)
    key = np.broadcast_to(seeded(number, u.shape[1]), q.shape[:2])
    for i in range(projections):
        key = seeded(key ^ q[:, :, i], 31 + i)
    return (key & ~np.uint64(_TABLE_MASK)) | number


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """Consecutive runs of vectors of one length, as matrices in double precision."""
    at = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))]) if len(column) else np.zeros(1, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    dims = np.diff(at)
    cuts = [0, *(1 + np.flatnonzero(dims[1:] != dims[:-1])).tolist(), len(dims)]
    return [flat[at[a] : at[b]].reshape(b - a, dims[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def buckets(classes: DataFrame, tables: int, projections: int) -> DataFrame:
    """(key, rep): one row per table of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for x in rows_of(batch["vec"]):
                found = keys(unit(x), tables, projections)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(batch["rep"].to_numpy()[lo : lo + len(x)], tables))], ["key", "rep"])
                lo += len(x)

    return classes.select("rep", "vec").mapInArrow(run, "key long, rep long")


def small_links(cell: np.ndarray, table: np.ndarray, rep: np.ndarray, w: np.ndarray, mine: np.ndarray, across: np.ndarray, u: np.ndarray, cosine: float, shape: tuple[int, int]) -> tuple[np.ndarray, ...] | None:
    """(rep, links, label) of the classes of many cells that have links; rows of a cell follow each other, SMALL at most."""
    a, b = [], []
    for step in range(1, SMALL):
        i = np.flatnonzero(cell[step:] == cell[:-step])
        i = i[~across[i] | (mine[i] != mine[i + step])]
        if not len(i):
            continue
        i = i[np.einsum("ij,ij->i", u[i], u[i + step]) >= cosine]
        a.append(i)
        b.append(i + step)
    if not any(map(len, a)):
        return None
    i, j = np.concatenate(a), np.concatenate(b)
    # Keys again, of linked vectors alone: in which table do both meet first?
    some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    _, one, back = np.unique(rep[some], return_index=True, return_inverse=True)
    own = keys(u[some[one]], *shape)
    at = back[place]
    first = (own[at[: len(i)]] == own[at[len(i) :]]).argmax(1) == table[i]
    links = np.concatenate([np.where(first, w[j], 0), np.where(first, w[i], 0)])
    return np.concatenate([rep[i], rep[j]]), links, np.tile(np.minimum(rep[i], rep[j]), 2)


def cell_links(table: int, rep: np.ndarray, w: np.ndarray, mine: np.ndarray, across: bool, u: np.ndarray, cosine: float, shape: tuple[int, int]) -> tuple[np.ndarray, ...] | None:
    """(rep, links, label) of a cell's classes that have links: counts of pairs first met in this table, and a member they join."""
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    if across:
        near &= mine[:, None] != mine[None, :]
    some = np.flatnonzero(near.any(1))
    if not len(some):
        return None
    near, rep, w = near[np.ix_(some, some)], rep[some], w[some]
    first = near.copy()
    for lo in range(0, table, 2):  # most pairs of near copies share one of the first tables
        own = keys(u[some], *shape, lo, min(lo + 2, table))
        for t in range(own.shape[1]):
            first &= own[:, t][:, None] != own[:, t][None, :]
        if not first.any():
            break
    label, last = rep.copy(), None
    while last is None or (label != last).any():
        last = label
        label = np.minimum(last, np.where(near, last[None, :], np.iinfo(np.int64).max).min(1))
    return rep, first @ w, label


def linked(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(rep, links, label): partial sums of links, and joins, of classes that link with others."""
    shape = plan(classes.count(), cosine)
    hashed = written(buckets(classes, *shape), "buckets")
    shared = hashed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    cells = by_key(hashed, shared, "key", "m", hashed.count()).withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "rep")
    cells = cells.join(classes.select("rep", "w", "vec", F.size("vec").alias("dim")), "rep").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        done = False
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done and not batch.num_rows:
                continue
            both = batch if held is None else held if done else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if both is None:
                return
            key, p, q, dim, mine, rep, w = (both[c].to_numpy() for c in ("key", "p", "q", "dim", "mine", "rep", "w"))
            cuts = [0, *(1 + np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (dim[1:] != dim[:-1]))).tolist(), both.num_rows]
            held, last = (None, len(cuts) - 1) if done else (both.slice(cuts[-2]), len(cuts) - 2)
            vec = both["vec"]
            at = vec.offsets.to_numpy()
            flat = vec.values.to_numpy(zero_copy_only=False)
            starts, sizes = np.array(cuts[:last], np.int64), np.diff(cuts[: last + 1])
            small = (sizes > 1) & (sizes <= SMALL)
            found = []
            for d in np.unique(dim[starts][small]).tolist():
                few = np.flatnonzero(small & (dim[starts] == d))
                cell = np.repeat(few, sizes[few])
                row = np.arange(len(cell)) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few]) + starts[cell]
                u = unit(flat[at[row][:, None] + np.arange(d)].astype("f8"))
                found.append(small_links(cell, key[row] & _TABLE_MASK, rep[row], w[row], mine[row], p[row] != q[row], u, cosine, shape))
            for i in np.flatnonzero(sizes > SMALL).tolist():
                a, b = cuts[i], cuts[i + 1]
                u = unit(flat[at[a] : at[b]].astype("f8").reshape(b - a, -1))
                found.append(cell_links(int(key[a]) & _TABLE_MASK, rep[a:b], w[a:b], mine[a:b], bool(p[a] != q[a]), u, cosine, shape))
            found = [f for f in found if f is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]).astype("int64")) for i in range(3)], ["rep", "links", "label"])

    return cells.select("key", "p", "q", "dim", "mine", "rep", "w", "vec").mapInArrow(run, "rep long, links long, label long")


def grouped(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links and component_id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    e = F.col("vec")
    valid = F.coalesce((F.size(e) > 0) & F.forall(e, finite) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    folded = rows.filter(valid).groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"))
    classes = written(folded.withColumn("rep", F.monotonically_increasing_id()), "classes")
    parts = written(linked(classes, cosine).groupBy("rep", "label").agg(F.sum("links").alias("links")), "links")
    labels = cut(components(parts.filter("rep != label").select(F.col("rep").alias("a"), F.col("label").alias("b"))).withColumnRenamed("v", "rep"))
    # The smallest id of each component, which may hold most classes.
    tops = labels.join(classes.select("rep", "least"), "rep").groupBy("label").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("m"))
    tops = by_key(labels, tops, "label", "m", labels.count()).select("rep", "top")
    sums = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    out = classes.join(sums, "rep", "left").join(tops, "rep", "left")
    out = out.select("vec", "w", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("top", "least").alias("top"))
    found = by_key(rows, out, "vec", "w", rows.count(), "left")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("top", "vec_id").alias("component_id"))
