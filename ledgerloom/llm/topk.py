"""Exact top-k search by inner product over vector-approximation files.

Components are scaled to whole numbers (``SCALE`` times, rounded down). Equal vectors are one class, of which the
smallest ids are kept. Each class has an approximation of a byte a component: the cell of ``2 ** shift`` values that it
lies in, with ``SHIFT`` for usual vectors and more where components would not fit. A cell bounds a component from both
sides, so approximations bound every score.

Query vectors in groups of ``QUERIES`` meet classes in chunks, a task's cells one after another; the chunk is streamed,
so a task holds a group's queries and a batch of classes whatever their numbers. For each batch the approximations are
scanned alone. A class whose upper bound is below what a query surely has k times is passed over; the others' exact
vectors are read in the order of their bounds, the best first, in rounds, and a query stops once its kth score is
certain. A cell returns k + 1 rows a query at most, since one of them may be the query itself; the best of those are
taken by a window that keeps k + 1 rows of each task.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths are
not compared, and empty ones only with each other (score 0); repeated rows are candidates of their own and a query leaves
out one row, its own; rows with a null ``vec_id`` are candidates, last among ties, and no queries; scaled components and
scores beyond a long are its limits; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_key, written

K = 5
SCALE = 256
#: Every so-manieth id is a query.
EVERY = 50
#: Cells hold ``2 ** SHIFT`` values.
SHIFT = 2
#: Queries of a group, classes of a chunk at least, and chunks at most.
QUERIES, CHUNK, MOST_CHUNKS = 8192, 16_384, 512
#: Queries whose bounds are held at once.
TILE = 1024
_LONG = (1 << 63) - 1
_NONE = -(1 << 63)


def approximated(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shift of each vector, cells as signed bytes)."""
    top = np.maximum(vec.max(1, initial=0), -1 - vec.min(1, initial=0)).astype(np.float64)
    shift = np.maximum(SHIFT, np.ceil(np.log2(top + 1)) - 7).astype(np.int64)
    cells = vec >> shift[:, None]
    while (wide := (np.abs(2 * cells + 1) > 255).any(1)).any():  # a logarithm may be rounded down
        shift[wide] += 1
        cells = vec >> shift[:, None]
    return shift, cells.astype(np.int8)


class Queries:
    """Vectors of a group with the best that each has met: k scores with their classes, and the exact products."""

    def __init__(self, vec: np.ndarray, k: int):
        self.vec, self.k = vec, k
        self.scores = np.full((len(vec), k), _NONE, np.int64)
        self.ids = np.full((len(vec), k), _NONE, np.int64)
        self.reps = np.full((len(vec), k), -1, np.int64)
        self.float = vec.astype(np.float64)
        self.plus, self.minus = np.maximum(self.float, 0).sum(1), np.minimum(self.float, 0).sum(1)
        self.size = np.abs(self.float).max(initial=0)

    def exact(self, q: np.ndarray, vec: np.ndarray) -> np.ndarray:
        """Scores of pairs: of query q[i] and the vector vec[i]."""
        own = self.vec[q]
        if self.size * np.abs(vec.astype(np.float64)).max(initial=0) * max(1, vec.shape[1]) < 2.0**62:
            return np.einsum("ij,ij->i", own, vec)
        return np.array([max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(x, y, strict=True)))) for x, y in zip(own.tolist(), vec.tolist(), strict=True)], np.int64)

    def bounds(self, lo: int, hi: int, shift: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of queries lo to hi with approximated vectors; products of cells alone."""
        small = self.size * 128 * max(1, cells.shape[1]) < 2.0**24
        kind = np.float32 if small else np.float64
        step = 2.0**shift
        product = (self.vec[lo:hi].astype(kind) @ cells.astype(kind).T).astype(np.float64) * step
        low, high = product + self.minus[lo:hi, None] * (step - 1), product + self.plus[lo:hi, None] * (step - 1)
        if self.size * 2.0 ** (shift.max(initial=0) + 8) * max(1, cells.shape[1]) < 2.0**52:
            return low, high
        slack = np.abs(self.float[lo:hi]).sum(1)[:, None] * step * 2.0**-30  # sums are rounded: bounds make room for it
        return low - slack, high + slack

    def add(self, q: np.ndarray, score: np.ndarray, rep: np.ndarray, ids: list[list[int]]) -> None:
        """Takes pairs of queries and classes, with the ids of each class, into the best k of each query."""
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.repeat(np.arange(len(q)), many)
        flat = np.fromiter((i for own in ids for i in own), np.int64, int(many.sum()))
        touched = np.unique(q)
        old = np.repeat(touched, self.k)
        all_q = np.concatenate([q[at], old])
        all_s = np.concatenate([score[at], self.scores[touched].ravel()])
        all_i = np.concatenate([flat, self.ids[touched].ravel()])
        all_r = np.concatenate([rep[at], self.reps[touched].ravel()])
        real = all_r >= 0
        order = np.lexsort((all_i, ~all_s, ~real, all_q))
        begins = np.searchsorted(all_q[order], touched)
        take = order[begins[:, None] + np.arange(self.k)]  # a query's old places are k, so it has k rows at least
        self.scores[touched], self.ids[touched], self.reps[touched] = all_s[take], all_i[take], all_r[take]

    def scan(self, rep: np.ndarray, ids: list[list[int]], shift: np.ndarray, cells: np.ndarray, exact: np.ndarray) -> None:
        """Meets a batch of classes."""
        for lo in range(0, len(self.vec), TILE):
            hi = min(lo + TILE, len(self.vec))
            low, high = self.bounds(lo, hi, shift, cells)
            full = self.reps[lo:hi, -1] >= 0
            sure = np.where(full, self.scores[lo:hi, -1].astype(np.float64), -np.inf)
            if len(rep) >= self.k:  # k classes surely have as much as the kth lower bound
                sure = np.maximum(sure, np.partition(low, len(rep) - self.k, 1)[:, len(rep) - self.k])
            q, c = np.nonzero(high >= sure[:, None])
            if not len(q):
                continue
            bound = high[q, c]
            order = np.lexsort((-bound, q))
            q, c, bound = q[order] + lo, c[order], bound[order]
            place, done = np.arange(len(q)) - np.searchsorted(q, q), 0
            step = self.k
            while len(q):
                now = place < done + step
                self.add(q[now], self.exact(q[now], exact[c[now]]), rep[c[now]], [ids[i] for i in c[now]])
                kth = np.where(self.reps[:, -1] >= 0, self.scores[:, -1].astype(np.float64), -np.inf)
                left = ~now & (bound >= kth[q])
                q, c, bound, place = q[left], c[left], bound[left], place[left]
                done, step = done + step, 2 * step

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id, class) of what is held."""
        q, j = np.nonzero(self.reps >= 0)
        return q, self.scores[q, j], self.ids[q, j], self.reps[q, j]


def classes(vectors: DataFrame, k: int, scale: int) -> DataFrame:
    """(rep, vec, n, ids): distinct scaled vectors with the number of their rows and their k smallest ids, null as the greatest long."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter(F.coalesce(F.forall("x", finite), F.lit(False)))
    own = own.select(F.coalesce("vec_id", F.lit(_LONG)).alias("id"), F.transform("x", lambda x: F.floor(x * scale)).alias("vec"))
    # The ids of a vector fold to k rows of each task before they move.
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("nth") <= k)
    folded = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k at most
    return written(folded.withColumn("rep", F.monotonically_increasing_id()), "classes")


def approximations(classes_: DataFrame) -> DataFrame:
    """The vector-approximation file: classes with ``dim``, ``shift`` and ``cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, vec in matrices(batch["vec"]):
                shift, cells = approximated(vec)
                part = batch.slice(a, len(vec))
                yield pa.RecordBatch.from_arrays([part["rep"], part["ids"], part["vec"], pa.array(np.full(len(vec), vec.shape[1], np.int32)), pa.array(shift.astype(np.int32)), pa.array([c.tobytes() for c in cells], pa.binary())], ["rep", "ids", "vec", "dim", "shift", "cells"])

    return written(classes_.select("rep", "ids", "vec").mapInArrow(run, "rep long, ids array<long>, vec array<long>, dim int, shift int, cells binary"), "approximations")


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) of runs of vectors of one length."""
    ends = column.offsets.to_numpy()
    flat, dims = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    cuts = [0, *(1 + np.flatnonzero(dims[1:] != dims[:-1])).tolist(), len(dims)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield a, flat[ends[a] : ends[b]].reshape(b - a, dims[a])


def searched(queries: DataFrame, file: DataFrame, k: int) -> DataFrame:
    """(query, score, id, rep): what each cell found, k rows a query and cell at most. queries have rep, dim and vec."""
    groups = max(1, -(-queries.count() // QUERIES))
    chunks = max(1, min(MOST_CHUNKS, -(-file.count() // CHUNK)))
    part = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    asked = queries.select("dim", part(groups, 3).alias("r"), every(chunks).alias("c"), F.lit(0).alias("kind"), "rep", "vec", none("array<long>").alias("ids"), none("int").alias("shift"), none("binary").alias("cells"))
    held = file.select("dim", every(groups).alias("r"), part(chunks, 5).alias("c"), F.lit(1).alias("kind"), "rep", "vec", "ids", "shift", "cells")
    cell = ["dim", "r", "c"]
    rows = asked.unionByName(held).repartition(*cell).sortWithinPartitions(*cell, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        names: np.ndarray = np.zeros(0, np.int64)
        group: Queries | None = None

        def result() -> Iterator[pa.RecordBatch]:
            if group is not None:
                q, score, ids, rep = group.best()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[q], score, ids, rep)], ["query", "score", "id", "rep"])

        for batch in batches:
            dim, r, c, kind, rep = (batch[x].to_numpy() for x in (*cell, "kind", "rep"))
            change = (dim[1:] != dim[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1]) | (kind[1:] != kind[:-1])
            cuts = [0, *(1 + np.flatnonzero(change)).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                here = (int(dim[a]), int(r[a]), int(c[a]))
                if here != at:
                    yield from result()
                    at, waiting, group = here, [], None
                column = batch["vec"].slice(a, b - a)
                vec = column.flatten().to_numpy(zero_copy_only=False).reshape(b - a, here[0])
                if kind[a] == 0:
                    waiting.append((rep[a:b], vec))
                    continue
                if group is None and waiting:
                    names = np.concatenate([n for n, _ in waiting])
                    group = Queries(np.concatenate([v for _, v in waiting]), k)
                if group is not None:
                    cells = np.frombuffer(b"".join(batch["cells"].slice(a, b - a).to_pylist()), np.int8).reshape(b - a, here[0])
                    group.scan(rep[a:b], batch["ids"].slice(a, b - a).to_pylist(), batch["shift"].slice(a, b - a).to_numpy().astype(np.int64), cells, vec)
        yield from result()

    return rows.mapInArrow(run, "query long, score long, id long, rep long")


def nearest(vectors: DataFrame, queries: Column | None = None, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query among all rows but its own, ties to smaller ids.

    ``queries`` tells which rows of (vec_id, embedding) ask; every EVERYth id by default.
    """
    asks = F.pmod(F.col("vec_id").cast("long"), F.lit(EVERY)) == 0 if queries is None else queries
    own = classes(vectors, k + 1, scale)
    file = approximations(own)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    x = F.col("embedding").cast("array<double>")
    asking = vectors.filter(asks & F.col("vec_id").isNotNull() & F.coalesce(F.forall(x, finite), F.lit(False)))
    asking = asking.select(F.col("vec_id").cast("long").alias("query_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("vec"))
    # Query rows with the class of their vector: equal ones fold first, and common ones are joined apart.
    sizes = asking.groupBy("vec").agg(F.count(F.lit(1)).alias("m")).join(own.select("vec", "rep"), "vec")
    sizes = written(sizes, "asked")
    found = searched(sizes.join(file.select("rep", "dim"), "rep").select("rep", "dim", "vec"), file, k + 1)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    top = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "id", (F.col("rep") == F.col("query")).alias("own")))).alias("top"))  # k + 1 at most
    side = sizes.join(lists, sizes["rep"] == lists["query"]).select("vec", "m", "top")
    rows = by_key(asking, side, "vec", "m", asking.count())
    mine = F.array_position(F.transform("top", lambda t: t["own"] & (t["id"] == F.col("query_id"))), F.lit(True)).cast("int")
    others = F.when(mine > 0, F.concat(F.slice("top", F.lit(1), mine - 1), F.slice("top", mine + 1, F.lit(k)))).otherwise(F.slice("top", 1, k))
    out = rows.select("query_id", F.posexplode(others).alias("pos", "t"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.when(F.col("t.id") < _LONG, F.col("t.id")).alias("vec_id"), F.col("t.score").alias("score"))
