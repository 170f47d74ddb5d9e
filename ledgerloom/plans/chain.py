"""The canonical chain: fork choice, ancestor walks, canonicity, discovery and reorganisation, over a table of blocks.

Blocks have ``state_hash`` (unique), ``parent_hash``, ``height``, ``vrf`` (binary) and optionally ``hardfork`` (boolean).

A walk contracts the table first: heights are cut into segments of at most about ``SEGMENT`` blocks, and inside each the
first ancestor beyond it is found for all of its blocks at once. Between segments few blocks are left, whose pointers one
task follows if they are at most ``FEW``, and which are doubled in rounds otherwise; only segments that a walk enters are
walked inside. A table of n blocks takes one shuffle by segment and log2(n / SEGMENT) small rounds at most, whatever its
depth. A block that is its own ancestor is an error.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
from typing import NamedTuple

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a segment at most, and at least; between them so many that each core has a few.
SEGMENT, LEAST_SEGMENT = 50_000, 8192
#: Pointers between segments, and tips, that one task follows; more are doubled in rounds.
FEW, FEW_TIPS = 100_000, 100
#: Depth of the recent part of the canonical chain (fixed value of the ledger format).
RECENT = 10


def preference(df: DataFrame) -> Column:
    """The greater, the better: hard-fork blocks, then height, then VRF output, then state hash."""
    fork = F.coalesce(F.col("hardfork"), F.lit(False)) if "hardfork" in df.columns else F.lit(False)
    return F.struct(fork.alias("hardfork"), F.col("height"), F.col("vrf"), F.col("state_hash"))


def best_block(blocks: DataFrame) -> DataFrame:
    """One row, the best tip; one row of partial results from each task is all that moves."""
    return blocks.agg(F.max_by(F.struct(*blocks.columns), preference(blocks)).alias("best")).select("best.*")


def children(blocks: DataFrame) -> DataFrame:
    """(parent, child, nth): each block's children one height above it, the preferred one first."""
    parents = blocks.select(F.col("state_hash").alias("parent"), (F.col("height") + 1).alias("at"))
    own = blocks.select(F.col("parent_hash").alias("parent"), F.col("height").alias("at"), F.col("state_hash").alias("child"), preference(blocks).alias("rank")).join(parents, ["parent", "at"])
    return own.withColumn("nth", F.row_number().over(Window.partitionBy("parent").orderBy(F.col("rank").desc()))).drop("rank", "at")


class Contracted(NamedTuple):
    """nodes (seg, state_hash, parent_hash), and exits (state_hash, top, exit): the last ancestor in the segment and the first beyond it."""

    nodes: DataFrame
    exits: DataFrame


def contracted(blocks: DataFrame, segment: int | None = None) -> Contracted:
    """The table cut into segments; a range of heights that holds too many blocks is cut again, by hash."""
    n, low, high = blocks.agg(F.count(F.lit(1)), F.min("height"), F.max("height")).first()
    if segment is None:
        segment = min(SEGMENT, max(LEAST_SEGMENT, n // (2 * blocks.sparkSession.sparkContext.defaultParallelism)))
    width = max(1, math.ceil(((high or 0) - (low or 0) + 1) / max(1, math.ceil(n / segment))))
    bins = blocks.select(F.floor((F.col("height") - F.lit(low or 0)) / width).alias("bin"), "state_hash", "parent_hash")
    sizes = bins.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / (4 * segment)).alias("parts"))  # a row for each segment
    split = bins.join(sizes, "bin") if n > 4 * segment else bins.withColumn("parts", F.lit(1))
    seg = F.struct("bin", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("state_hash"), F.col("parts"))).otherwise(0).alias("part"))
    nodes = _cut(split.select(seg.alias("seg"), "state_hash", "parent_hash"))
    kind = blocks.schema["state_hash"].dataType.simpleString()
    exits = nodes.groupBy("seg").applyInArrow(_contract, f"state_hash {kind}, top {kind}, exit {kind}")
    return Contracted(nodes, _cut(exits))


def _contract(table: pa.Table) -> pa.Table:
    at = table["state_hash"].to_pylist()
    up = dict(zip(at, table["parent_hash"].to_pylist(), strict=True))
    ends: dict = {}
    for start in at:
        path, x = [], start
        while x in up and x not in ends:
            path.append(x)
            x = up[x]
            if len(path) > len(up):
                raise ValueError(f"block {start} is its own ancestor")
        end = ends[x] if x in ends else (path[-1], x)
        for p in path:
            ends[p] = end
    kind = table.schema.field("state_hash").type
    return pa.table({"state_hash": pa.array(at, kind), "top": pa.array([ends[x][0] for x in at], kind), "exit": pa.array([ends[x][1] for x in at], kind)})


def _doubled(jump: DataFrame, step) -> None:
    """Calls step(jump) for jumps (at, to) of 1, 2, 4 ... until none is left; more rounds than a path can have are an error."""
    rounds = math.ceil(math.log2(jump.count() + 1)) + 1
    for _ in range(rounds + 1):
        if jump.isEmpty():
            return
        step(jump)
        jump = _cut(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("beyond")), "to").select("at", F.col("beyond").alias("to")))
    raise ValueError("a block is its own ancestor")


def entries(ready: Contracted, tips: DataFrame) -> DataFrame:
    """(tip, state_hash): where each tip's walk enters each segment, the tip itself first."""
    starts = _cut(tips.filter("state_hash is not null").select(F.col("state_hash").alias("tip"), "state_hash"))
    exits = ready.exits.filter("exit is not null")
    between = exits.select(F.col("exit").alias("state_hash")).unionAll(starts.select("state_hash")).distinct()
    jump = _cut(exits.join(between, "state_hash", "left_semi").select(F.col("state_hash").alias("at"), F.col("exit").alias("to")))
    if jump.count() <= FEW and starts.count() <= FEW_TIPS:
        kind = jump.schema["at"].dataType.simpleString()
        return _cut(starts.withColumn("_a", F.lit(0)).groupBy("_a").cogroup(jump.withColumn("_b", F.lit(0)).groupBy("_b")).applyInArrow(_follow, f"tip {kind}, state_hash {kind}"))  # one small task
    reached = starts

    def step(jump: DataFrame) -> None:
        nonlocal reached
        more = reached.join(jump.withColumnRenamed("at", "state_hash"), "state_hash").select("tip", F.col("to").alias("state_hash"))
        reached = _cut(reached.unionAll(more).distinct())

    _doubled(jump, step)
    return reached


def _follow(starts: pa.Table, jump: pa.Table) -> pa.Table:
    up = dict(zip(jump["at"].to_pylist(), jump["to"].to_pylist(), strict=True))
    tips, out = [], []
    for tip, x in zip(starts["tip"].to_pylist(), starts["state_hash"].to_pylist(), strict=True):
        first = len(out)
        while x is not None:
            tips.append(tip)
            out.append(x)
            if len(out) - first > len(up) + 1:
                raise ValueError(f"block {x} is its own ancestor")
            x = up.get(x)
    kind = starts.schema.field("state_hash").type
    return pa.table({"tip": pa.array(tips, kind), "state_hash": pa.array(out, kind)})


def walked(ready: Contracted, reached: DataFrame) -> DataFrame:
    """(tip, state_hash) of the blocks that walks pass, from their entries to the ends of the segments."""
    kind = ready.nodes.schema["state_hash"].dataType.simpleString()
    starts = reached.join(ready.nodes.select(F.col("seg").alias("of"), "state_hash"), "state_hash").select("of", "tip", F.col("state_hash").alias("start"))
    nodes = ready.nodes.select(F.col("seg").alias("in"), "state_hash", "parent_hash").join(starts.select(F.col("of").alias("in")).distinct(), "in", "left_semi")
    return nodes.groupBy("in").cogroup(starts.groupBy("of")).applyInArrow(_walk, f"tip {kind}, state_hash {kind}")


def _walk(nodes: pa.Table, starts: pa.Table) -> pa.Table:
    up = dict(zip(nodes["state_hash"].to_pylist(), nodes["parent_hash"].to_pylist(), strict=True))
    tips, out = [], []
    for tip, x in zip(starts["tip"].to_pylist(), starts["start"].to_pylist(), strict=True):
        while x in up:
            tips.append(tip)
            out.append(x)
            x = up[x]
    kind = nodes.schema.field("state_hash").type
    return pa.table({"tip": pa.array(tips, kind), "state_hash": pa.array(out, kind)})


def ancestors(blocks: DataFrame, tips: DataFrame, ready: Contracted | None = None) -> DataFrame:
    """(tip, state_hash) of every ancestor of every tip, itself included."""
    ready = ready or contracted(blocks)
    return walked(ready, entries(ready, tips))


def differing(ready: Contracted, tips: DataFrame) -> DataFrame:
    """(tip, state_hash) of the ancestors, but for segments that all tips enter at the same block."""
    reached = entries(ready, tips)
    n = reached.select("tip").distinct().count()
    shared = reached.groupBy("state_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select("state_hash")
    return walked(ready, reached.join(shared, "state_hash", "left_anti") if n > 1 else reached)


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names; in a temporary one only on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not folder:
            own = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            folder = f"file://{own}"
        context.setCheckpointDir(folder)
    # Kept while it is counted and written, so that it is made once.
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint()
    finally:
        held.unpersist()


def canonicity(blocks: DataFrame, ready: Contracted | None = None) -> DataFrame:
    """Blocks with ``canonicity``: Canonical on the best chain, Orphaned at a height that it covers, null above it."""
    best = _cut(best_block(blocks))
    chain = ancestors(blocks, best, ready).select("state_hash", F.lit(True).alias("on_chain"))
    top = best.select(F.col("height").alias("top"))  # one row
    out = blocks.join(chain, "state_hash", "left").crossJoin(F.broadcast(top))
    return out.withColumn("canonicity", F.when(F.col("on_chain"), "Canonical").when(F.col("height") <= F.col("top"), "Orphaned")).drop("on_chain", "top")


def rivals(blocks: DataFrame, ready: Contracted | None = None) -> tuple[DataFrame, DataFrame]:
    """The best block off the best chain (a row of nulls where there is none), and the best block."""
    best = _cut(best_block(blocks))
    return _cut(best_block(blocks.join(ancestors(blocks, best, ready).select("state_hash"), "state_hash", "left_anti"))), best


def reorganisation(blocks: DataFrame, old: DataFrame, new: DataFrame, ready: Contracted | None = None) -> DataFrame:
    """(state_hash, height, change): blocks to unapply from the old tip down, and to apply up to the new tip.

    Segments below the common ancestor are not walked.
    """
    ready = ready or contracted(blocks)
    tips = _cut(old.select("state_hash", F.lit("unapply").alias("change")).unionAll(new.select("state_hash", F.lit("apply").alias("change"))).filter("state_hash is not null"))
    passed = differing(ready, tips.select("state_hash").distinct())
    once = passed.groupBy("state_hash").agg(F.count(F.lit(1)).alias("n"), F.min("tip").alias("tip")).filter("n = 1")
    only = tips.groupBy(F.col("state_hash").alias("tip")).agg(F.min("change").alias("change"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("tip", "change")
    return once.select("state_hash", "tip").join(F.broadcast(only), "tip").join(blocks.select("state_hash", "height"), "state_hash").select("state_hash", "height", "change")  # two rows


def discovery(blocks: DataFrame, roots: Column, recent: int = RECENT) -> DataFrame:
    """Blocks with ``status`` (Canonical, Recent or Orphaned) and ``on_chain``, as an initial load sorts them.

    The tree is what children one height above their parents reach from the blocks at the lowest height that meet
    ``roots``. Its tip is the last block of a breadth-first walk in the order of state hashes: not the fork choice, which
    looks at VRF outputs. The last ``recent`` blocks of the tip's chain and all others from the first of them upwards are
    recent; of the rest those on the chain are canonical, the others orphaned. Without a tip all blocks are recent.
    """
    parents = blocks.select(F.col("state_hash").alias("parent_hash"), (F.col("height") + 1).alias("height"), F.lit(True).alias("_has"))
    linked = blocks.join(parents, ["parent_hash", "height"], "left").withColumn("parent_hash", F.when(F.col("_has"), F.col("parent_hash"))).drop("_has")
    linked = _cut(linked.select("state_hash", "parent_hash", "height", roots.alias("_root")))
    ready = contracted(linked)
    ends = _tops(ready)
    lowest = F.broadcast(linked.agg(F.min("height").alias("_lowest")))  # one row
    starts = linked.crossJoin(lowest).filter((F.col("height") == F.col("_lowest")) & F.col("_root")).select(F.col("state_hash").alias("top"))
    tree = _cut(ends.join(starts, "top", "left_semi").join(linked.select("state_hash", "height"), "state_hash"))
    highest = tree.agg(F.max("height").alias("_highest"))  # one row
    tips = _cut(tree.crossJoin(F.broadcast(highest)).filter(F.col("height") == F.col("_highest")).select("state_hash", "height"))
    tip = _last_of_walk(ready, tips, linked) if tips.count() > 1 else tips
    chain = ancestors(linked, tip, ready).select("state_hash", F.lit(True).alias("on_chain"))
    least = tip.agg((F.max("height") - recent + 1).alias("_split"))  # one row, of null without a tip
    out = blocks.join(chain, "state_hash", "left").withColumn("on_chain", F.coalesce("on_chain", F.lit(False))).crossJoin(F.broadcast(least))
    status = F.when(F.col("_split").isNull() | (F.col("height") >= F.col("_split")), "Recent").when(F.col("on_chain"), "Canonical").otherwise("Orphaned")
    return out.withColumn("status", status).drop("_split")


def _last_of_walk(ready: Contracted, tips: DataFrame, linked: DataFrame) -> DataFrame:
    """The tip, of several at one height, that a breadth-first walk in the order of state hashes comes to last.

    Paths of equal length come in the order of such a walk if they are compared from the root on: at the lowest height at
    which they differ the tips with the greatest block stay, and so on until one is left. No path is put together.
    """
    path = _cut(differing(ready, tips).join(linked.select("state_hash", "height"), "state_hash"))
    while True:
        own = path.join(tips.select(F.col("state_hash").alias("tip")), "tip", "left_semi")
        split = own.groupBy("height").agg(F.min("state_hash").alias("least"), F.max("state_hash").alias("most")).filter("least < most")
        found = split.agg(F.min("height").alias("height"), F.min_by("most", "height").alias("most")).first()
        if found.height is None:
            return tips
        stays = path.filter((F.col("height") == found.height) & (F.col("state_hash") == F.lit(found.most))).select(F.col("tip").alias("state_hash"))
        tips = _cut(tips.join(stays, "state_hash", "left_semi"))


def _tops(ready: Contracted) -> DataFrame:
    """(state_hash, top): the last ancestor that the table holds, of every block."""
    known = ready.nodes.select(F.col("state_hash").alias("exit"))
    exits = ready.exits.join(known.withColumn("_in", F.lit(True)), "exit", "left").withColumn("exit", F.when(F.col("_in"), F.col("exit"))).drop("_in")
    entered = exits.filter("exit is not null").select(F.col("exit").alias("state_hash")).distinct()
    ends = _cut(exits.join(entered, "state_hash", "left_semi"))  # blocks that a walk enters a segment at
    many = ends.count()
    rounds = math.ceil(math.log2(many + 1)) + 1
    if many <= FEW:
        kind = ready.nodes.schema["state_hash"].dataType.simpleString()
        ends = _cut(ends.select("state_hash", "top", "exit", F.lit(0).alias("_a")).groupBy("_a").applyInArrow(_ends, f"state_hash {kind}, top {kind}, exit {kind}"))  # one small task
    for _ in range(rounds):
        if ends.filter("exit is not null").isEmpty():
            break
        far = ends.select(F.col("state_hash").alias("exit"), F.col("top").alias("_top"), F.col("exit").alias("_exit"))
        moved = F.col("_top").isNotNull()
        ends = _cut(ends.join(far, "exit", "left").select("state_hash", F.when(moved, F.col("_top")).otherwise(F.col("top")).alias("top"), F.when(moved, F.col("_exit")).alias("exit")))
    else:
        if not ends.filter("exit is not null").isEmpty():
            raise ValueError("a block is its own ancestor")
    far = ends.select(F.col("state_hash").alias("exit"), F.col("top").alias("_top"))
    return exits.join(far, "exit", "left").select("state_hash", F.coalesce("_top", "top").alias("top"))


def _ends(table: pa.Table) -> pa.Table:
    at, top, exit_ = (table[c].to_pylist() for c in ("state_hash", "top", "exit"))
    up, last = dict(zip(at, exit_, strict=True)), dict(zip(at, top, strict=True))
    ends: dict = {}
    for start in at:
        path, x = [], start
        while x not in ends and up[x] is not None:
            path.append(x)
            if len(path) > len(up):
                raise ValueError(f"block {start} is its own ancestor")
            x = up[x]
        end = ends.get(x, last[x])
        ends[x] = end
        for p in path:
            ends[p] = end
    kind = table.schema.field("state_hash").type
    return pa.table({"state_hash": pa.array(at, kind), "top": pa.array([ends[x] for x in at], kind), "exit": pa.array([None] * len(at), kind)})


def successors(blocks: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """new where it is strictly better than old, or else old: the best tip after more blocks."""
    return best_block(old.unionByName(new, allowMissingColumns=True))


def due(tip_height: Column, root_height: Column, threshold: int = 2) -> Column:
    """Whether the canonical root moves: the tip is at least so many blocks above it (fixed value of the ledger format)."""
    return tip_height - root_height >= threshold


def best_chain(blocks: DataFrame, last: int = 10) -> DataFrame:
    """(state_hash, height): the last blocks of the best chain, the tip included. Only blocks of these heights are walked."""
    tip = _cut(best_block(blocks))
    return _above(blocks, tip, (r.height if (r := tip.first()) and r.height is not None else 0) - last)


def _above(blocks: DataFrame, tip: DataFrame, height: int) -> DataFrame:
    near = blocks.filter(F.col("height") > height)
    return ancestors(near, tip).select("state_hash").join(near.select("state_hash", "height"), "state_hash")


def canonical_update(blocks: DataFrame, root_height: int, depth: int = RECENT, threshold: int = 2) -> DataFrame:
    """(state_hash, height, is_root): blocks that become canonical, those of the best chain above the old root and at least ``depth`` below the tip.

    None do unless the tip is ``threshold`` heights above the root. The highest of them is the new root. Blocks at or
    below the root's height are not walked, so an update costs what came since the last one.
    """
    tip = _cut(best_block(blocks))
    bounds = tip.select((F.col("height") - depth).alias("_most"), F.col("height").alias("_tip"))  # one row
    own = _above(blocks, tip, root_height).crossJoin(F.broadcast(bounds))
    own = own.filter(due(F.col("_tip"), F.lit(root_height), threshold) & (F.col("height") <= F.col("_most")))
    return own.select("state_hash", "height", (F.col("height") == F.col("_most")).alias("is_root"))
