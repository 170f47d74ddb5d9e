"""HyperMinHash near-duplicate groups of documents by word shingles.

1. Every document's distinct shingle hashes are dealt to ``REGISTERS`` buckets; a register keeps its bucket's
   smallest hash as a leading-zero count and ``MANTISSA`` bits after it (16 bits in all). Empty registers borrow
   another bucket's value in a fixed probing order, so that short documents can be banded too. Documents with
   equal shingle sets (128-bit sum of the shingles' hashes, and size) become one class with a number of its own; its
   text is found again by the smallest ``doc_id`` of the class and 128 bits of hash of that row's text.
2. Bands of ``BAND_ROWS`` registers make keys. Two sets of similarity 0.75 share one of 51 bands with
   probability 1 - 1e-6. In a bucket of up to ``PAIRS_UP_TO`` classes all pairs are candidates; in a larger one each
   class is held against the bucket's smallest, which links most groups without listing their pairs.
3. Candidates whose collision-corrected estimate lies within four standard deviations of the threshold, or above
   it, are confirmed on full shingle sets, read again from whole texts. A pair of exactly 0.75 falls below that with
   probability 3e-5, a pair of 0.8 practically never.
4. Large buckets that still hold several components get an exact way: they are cut into blocks, and every pair of
   blocks is compared inside a task, first by registers alone, then by the full sets of the classes that are left.
   Only links that join components are returned. Nothing is capped.

Keys that may be hot (band buckets, leads, copies of a set, labels) are joined by ``by_key``, so that none is one task's.

Defined cases: documents without words or text have empty sets and link with nothing; with fewer than five words
the whole sequence is the only shingle; repeated rows with one ``doc_id`` and one text are one class and each keeps its
row; rows with one ``doc_id`` and different texts are documents of their own, each with its own links; a row with a null
``doc_id`` joins the class of equal sets, links like any other, and without any id in its group its component is null;
other columns are ignored by ``grouped``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_key, cut, free, marked, marks, trim, written
from ledgerloom.llm.components import components
from ledgerloom.llm.shingles import mix, seeded, shingles

WIDTH = 5
PERCENT = 75
REGISTERS = 256
MANTISSA = 10
BAND_ROWS = 5
PAIRS_UP_TO = 8
#: Rows of a block of a large bucket.
BLOCK = 1024
#: Low bits of a key, which hold its band.
BAND_MASK = 63
#: Approximate expected collisions of registers that hold different minima, from the published analysis.
_COLLIDES = 0.169919487159739093975315012348
#: Rows of a task's group of candidates with one first class, about.
GROUP = 256

#: Stands for a null doc_id where a class looks for its text.
_LAST = (1 << 63) - 1


def registers(sets: np.ndarray, at: np.ndarray, count: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """(documents x count) registers of 16 bits with empty ones filled, and the number that were not empty."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    hashed = seeded(sets, 7)
    cell = owner * count + (hashed % np.uint64(count)).astype(np.int64)
    rest = mix(hashed ^ np.uint64(0xA0761D6478BD642F))
    low = np.full(n * count, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, cell, rest)
    full = np.zeros(n * count, bool)
    full[cell] = True
    # Leading zeros of the minimum, at most 62, and the bits that follow the first one.
    _, exponent = np.frexp(low.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint64)
    mantissa = ((low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    packed = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16).reshape(n, count)
    full = full.reshape(n, count)
    filled = full.sum(1)
    doc, slot = np.nonzero(~full & (filled > 0)[:, None])
    step = 0
    while len(doc):
        donor = (seeded(slot.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(step), 11) % np.uint64(count)).astype(np.int64)
        hit = full[doc, donor]
        packed[doc[hit], slot[hit]] = packed[doc[hit], donor[hit]]
        doc, slot, step = doc[~hit], slot[~hit], step + 1
    return packed, filled


def similarity(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for expected accidental collisions."""
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    expected = _COLLIDES * 2.0 ** (np.log2(REGISTERS) - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, (a == b).sum(-1) - expected) / REGISTERS


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the estimate is above the threshold less four deviations; sizes alone rule out some."""
    p = percent / 100
    filled = np.minimum(REGISTERS * -np.expm1(-np.minimum(n, m) / REGISTERS), REGISTERS)
    margin = 4 * np.sqrt(p * (1 - p) / np.maximum(1, filled))
    return (similarity(a, b, n, m) >= p - margin) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


#: What tells a row's document from others: its id and two hashes of its text.
ROW = ["at", "h1", "h2"]


def text_hash(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("wide"), text).alias("h2")]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n_shingles, set_key, registers) of every row; the last two are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, max(1, whole.num_rows), 512):
                batch = whole.slice(lo, 512)
                sets, at = shingles(batch["text"], WIDTH)
                sizes = np.diff(at)
                rows, _ = registers(sets, at)
                sums = []
                for seed in (3, 5):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(seeded(sets, seed), dtype=np.uint64)])
                    sums.append(total[at[1:]] - total[at[:-1]])
                keys = np.stack([*sums, sizes.astype(np.uint64)], 1).astype("<u8")
                some = sizes > 0
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h1"], batch["h2"], pa.array(sizes.astype("int64")), pa.array([k.tobytes() if s else None for k, s in zip(keys, some, strict=True)], pa.binary()), pa.array([r.tobytes() if s else None for r, s in zip(rows, some, strict=True)], pa.binary())], ["doc_id", "h1", "h2", "n_shingles", "set_key", "registers"])
        trim()

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *text_hash(text)).mapInArrow(run, "doc_id long, h1 long, h2 long, n_shingles long, set_key binary, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """(key, rep): one row per band of each class."""
    count = REGISTERS // BAND_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            rows = rows[:, : count * BAND_ROWS].reshape(-1, count, BAND_ROWS).astype(np.uint64)
            key = np.broadcast_to(seeded(np.arange(count, dtype=np.uint64), 13), rows.shape[:2])
            for i in range(BAND_ROWS):
                key = seeded(key ^ rows[:, :, i], 17 + i)
            key = (key & ~np.uint64(BAND_MASK)) | np.arange(count, dtype=np.uint64)  # the band can be told from its key
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch["rep"].to_numpy(), count))], ["key", "rep"])

    return classes.select("rep", "registers").mapInArrow(run, "key long, rep long")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, near) of the written pairs (a, b) that may be links by their registers; near is the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            n, m = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            keep = np.flatnonzero(may_link(left, right, n, m, percent))
            yield pa.RecordBatch.from_arrays([batch["a"].take(keep), batch["b"].take(keep), pa.array(similarity(left, right, n, m)[keep])], ["a", "b", "near"])

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n").alias(f"n_{x}"))
    firsts = side("a").join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("many")), "a")
    with_a = by_key(pairs.select("a", "b"), firsts, "a", "many", pairs.count())
    return with_a.join(side("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(run, "a long, b long, near double")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The written pairs (a, b) whose full shingle sets are similar enough. Each b's text is moved once a pair, a's once a group of GROUP of its pairs."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("many"))
    salted = by_key(pairs.select("a", "b"), many, "a", "many", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / GROUP)))
    wanted = salted.select(F.col("b").alias("id"), "a", "salt", F.lit(1).alias("turn")).unionAll(salted.select(F.col("a").alias("id"), "a", "salt", F.lit(0).alias("turn")).distinct())
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    ready = wanted.join(texts_of(docs, classes, ids), "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "turn", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: np.ndarray = np.zeros(0, np.uint64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                sets, at = shingles(batch["text"], WIDTH)
                left, right = [], []
                for i, (turn, a, b) in enumerate(zip(batch["turn"].to_pylist(), batch["a"].to_pylist(), batch["id"].to_pylist(), strict=True)):
                    mine = sets[at[i] : at[i + 1]]
                    if not turn:
                        own = mine
                        continue
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(mine) - both):
                        left.append(a)
                        right.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        trim()

    return ready.select("text", "turn", "a", "id").mapInArrow(run, "a long, b long")


def leftovers(rows: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between different components inside large buckets (key, rep): block by block, with nothing left out.

    A pair that shares several buckets is met in the first of them alone. Registers are compared first, so that texts
    are moved only of classes that may have such a link. Those are confirmed on full sets inside the task, and only
    links that join parts of a block are returned, so fewer than its rows.
    """
    at = rows.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_keys = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi").select("key", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    cells = by_key(at, open_keys, "key", "m", rows.count()).withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "rep", "label")
    sketch = classes.select("rep", "registers", "n")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, ["key", "p", "q"]):
            left = near_rows(table, percent)
            if left.any():
                yield from table.select(["key", "p", "q", "mine", "rep", "label"]).filter(pa.array(left)).to_batches()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, ["key", "p", "q"]):
            left, right = block_links(table, percent)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    in_cells = lambda df: df.join(sketch, "rep").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "rep")
    near = in_cells(cells).select("key", "p", "q", "mine", "rep", "label", "registers", "n").mapInArrow(compared, "key long, p int, q int, mine int, rep long, label long")
    near = written(near, "near")
    texts = texts_of(docs, classes, near.select(F.col("rep").alias("id")).distinct()).withColumnRenamed("id", "rep")
    return in_cells(near.join(texts, "rep")).mapInArrow(linked, "a long, b long")


def pairs_of_cell(table: pa.Table, percent: int, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): later rows js of a cell that may link with row i by their registers, of another part, met in no earlier band."""
    regs = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    n, mine = table["n"].to_numpy(), table["mine"].to_numpy()
    band, count = int(table["key"][0].as_py()) & BAND_MASK, REGISTERS // BAND_ROWS
    across = table["p"][0] != table["q"][0]
    for i in range(len(n) - 1):
        ok = part[i + 1 :] != part[i]
        if across:
            ok &= mine[i + 1 :] != mine[i]
        j = i + 1 + np.flatnonzero(ok)
        if len(j):
            j = j[may_link(regs[i], regs[j], n[i], n[j], percent)]
        if len(j) and band:
            shared = (regs[j, : band * BAND_ROWS] == regs[i, : band * BAND_ROWS]).reshape(len(j), band, BAND_ROWS).all(2).any(1)
            j = j[~shared]
        if len(j):
            yield i, j


def near_rows(table: pa.Table, percent: int) -> np.ndarray:
    """Which rows of a cell may link with another label's."""
    left = np.zeros(table.num_rows, bool)
    for i, j in pairs_of_cell(table, percent, table["label"].to_numpy()):
        left[i] = True
        left[j] = True
    return left


def block_links(table: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links between different labels of a pair of blocks that join parts not joined before."""
    rep = table["rep"].to_numpy()
    sets, at = shingles(table["text"].combine_chunks(), WIDTH)
    _, part = np.unique(table["label"].to_numpy(), return_inverse=True)
    left, right = [], []
    for i, j in pairs_of_cell(table, percent, part):
        own, sizes = sets[at[i] : at[i + 1]], at[j + 1] - at[j]
        flat = np.concatenate([sets[at[x] : at[x + 1]] for x in j.tolist()])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
        for x in j[100 * both >= percent * (len(own) + sizes - both)].tolist():
            if part[x] != part[i]:
                part[part == part[x]] = part[i]
                left.append(int(rep[i]))
                right.append(int(rep[x]))
    return left, right


def texts_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the classes whose number is in ids, one row each: the text of the class's row of the smallest doc_id."""
    text = F.col("text").cast("string")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("at"), *text_hash(text), text.alias("text"))
    wanted = cut(classes.select(F.col("rep").alias("id"), "first.*").join(ids, "id", "left_semi"))
    # Texts of other rows are left out by a bitmap before the shuffle.
    texts = marked(texts, F.xxhash64(*ROW), marks(wanted.select(F.xxhash64(*ROW))), "wanted").filter("wanted")
    return texts.select(*ROW, "text").join(wanted, ROW).select("id", "text").dropDuplicates(["id"])


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each key, from batches sorted by it; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def linked_classes(classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(v, label): components of the classes that have links."""
    keyed = bands(classes)
    many = written(keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "many")
    shared = written(by_key(keyed, many, "key", "m", classes.count() * (REGISTERS // BAND_ROWS)), "buckets")
    small = shared.filter(F.col("m") <= PAIRS_UP_TO)
    stars = shared.filter(F.col("m") > PAIRS_UP_TO).filter("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    sets = small.groupBy("key").agg(F.array_sort(F.collect_list("rep")).alias("reps"))  # at most PAIRS_UP_TO
    sets = sets.select("reps", F.posexplode("reps").alias("i", "a")).select("a", F.explode(F.slice("reps", F.col("i") + 2, F.lit(PAIRS_UP_TO))).alias("b"))
    pairs = written(stars.unionAll(sets).distinct(), "pairs")
    candidates = cut(estimated(pairs, classes, percent))
    links = cut(confirmed(candidates, classes, docs, percent))
    labels = components(links)
    more = cut(leftovers(shared.filter(F.col("m") > PAIRS_UP_TO).select("key", "rep"), labels, classes, docs, percent))
    return labels if more.isEmpty() else components(links.unionAll(more))


def classified(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The written sketches of all rows, and the written classes: set_key, copies, least (smallest doc_id), first (its row) and label, one for each group."""
    sketched = written(sketches(docs), "sketches")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("at"), "h1", "h2")).alias("first")
    classes = sketched.filter("n_shingles > 0").groupBy("set_key", F.col("n_shingles").alias("n")).agg(first, F.min("doc_id").alias("least"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    labels = linked_classes(classes, docs, percent)
    own = classes.select("set_key", "copies", "rep", "least", "first").join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    return sketched, written(own.withColumn("label", F.coalesce("label", "rep")), "own")


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included)."""
    sketched, own = classified(docs, percent)
    names = own.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    names = by_key(own.select("label", "set_key", "copies"), names, "label", "m", own.count()).select("set_key", "copies", F.col("component_id").alias("named"))
    out = by_key(sketched.select("doc_id", "n_shingles", "set_key"), names, "set_key", "copies", sketched.count(), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("named")).alias("component_id"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents of which each group keeps one, a row of its smallest doc_id; all columns kept.

    Documents without words are kept. Rows of one doc_id and one text are one document, of which any row is kept.
    """
    sketched, own = classified(docs, percent)
    keys = sketched.groupBy(F.coalesce("doc_id", F.lit(_LAST)).alias("at"), "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.first("set_key").alias("set_key"))
    leads = own.groupBy("label").agg(F.min("first").alias("first")).select("first.*", F.lit(True).alias("lead"))
    keys = keys.join(leads, ROW, "left")
    kept = F.col("set_key").isNull() | F.coalesce("lead", F.lit(False))
    # Rows without an id and without words are documents of their own.
    many = (F.col("n") > 1) & ~(F.col("set_key").isNull() & (F.col("at") == _LAST))
    unsure = cut(keys.select(*ROW, kept.alias("kept"), many.alias("many")).filter("not kept or many"))
    names = free(docs, *ROW)
    open_, = free(docs, "open")
    rows = docs.select("*", F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias(names[0]), *[h.alias(n) for h, n in zip(text_hash(docs["text"].cast("string")), names[1:], strict=True)])
    # Most documents are kept, and a bitmap tells so: only the others, and a few more, are shuffled.
    rows = marked(rows, F.xxhash64(*names), marks(unsure.select(F.xxhash64(*ROW))), open_)
    unsure = unsure.withColumnsRenamed(dict(zip(ROW, names, strict=True)))
    maybe = rows.filter(open_)
    out = rows.filter(~F.col(open_)).select(*docs.columns).unionAll(maybe.join(unsure.select(*names), names, "left_anti").select(*docs.columns))
    if (several := unsure.filter("kept and many")).isEmpty():
        return out
    return out.unionAll(maybe.join(several.select(*names), names, "left_semi").dropDuplicates(names).select(*docs.columns))
