"""The witness tree as state: blocks come in any order, and each batch costs its own blocks and the frontier.

The frontier holds the blocks above a fixed number of heights below the canonical root: those that reach the root, and those
that dangle until their parents come. Its tables are Parquet, one part a batch, under one folder:

- ``frontier``: the whole frontier after the batch; blocks that fall out of it leave the keys for dedupe with it.
- ``tip``: one row, the best tip and the canonical root.
- ``changes``: blocks that the batch unapplied and applied on the way from the old tip to the new one.
- ``flags``: canonicity, in buckets of heights; a batch writes the buckets that it touches anew, and the last one counts.
- one folder for each view: signed sums of what the batch applied and took back; every ``COMPACT`` batches their total.

A batch reads the state that the batch before it left and writes parts under its own number, so a batch that is run again
after a failure leaves the same. Parts that no later batch reads are removed by ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans import chain, counters

#: Heights below the root that the frontier keeps (fixed value of the ledger format).
KEEP = 290
#: Heights of a bucket of flags.
BUCKET = 1000
COMPACT = 32


class View(NamedTuple):
    """Sums that follow the best chain: rows(spark, hashes) gives the rows (state_hash, ...) of these blocks."""

    rows: Callable[[SparkSession, DataFrame], DataFrame]
    keys: list[str]
    measures: Mapping[str, Column]


class Tree:
    """The state in a folder that all machines share. ``root`` (a row: state_hash, height and the other columns) starts it."""

    def __init__(self, spark: SparkSession, folder: str, root: DataFrame, views: Mapping[str, View] | None = None, depth: int = chain.RECENT, keep: int = KEEP, threshold: int = 2):
        self.spark, self.folder, self.root, self.views = spark, folder, root, views or {}
        self.depth, self.keep, self.threshold = depth, keep, threshold
        self.columns = [c for c in root.columns]

    def path(self, name: str, number: int) -> str:
        return f"{self.folder}/{name}/batch={number}"

    def _read(self, name: str, number: int) -> DataFrame:
        return self.spark.read.parquet(self.path(name, number))

    def _write(self, df: DataFrame, name: str, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name, number))
        return self.spark.read.schema(df.schema).parquet(self.path(name, number))

    def numbers(self, name: str) -> list[int]:
        """Batches that have a part, in order."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = fs.Path(f"{self.folder}/{name}")
        system = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(at):
            return []
        parts = (s.getPath() for s in system.listStatus(at))
        return sorted(int(p.getName().partition("=")[2]) for p in parts if p.getName().startswith("batch=") and system.exists(fs.Path(p, "_SUCCESS")))

    def step(self, new: DataFrame, number: int) -> None:
        """Takes a batch of blocks; ``number`` is the batch's, one more than that of the batch before it."""
        before = [n for n in self.numbers("tip") if n < number]
        if before:
            old, state = self._read("frontier", before[-1]), self._read("tip", before[-1]).first()
        else:
            old = self.root.withColumn("attached", F.lit(True))
            top = self.root.first()
            state = {"tip_hash": None, "root_hash": top["state_hash"], "root_height": top["height"]}
        low = state["root_height"] - self.keep
        fresh = new.select(self.columns).filter(F.col("height") > low).dropDuplicates(["state_hash"]).join(old.select("state_hash"), "state_hash", "left_anti")
        open_ = chain._cut(old.filter(~F.col("attached")).select(self.columns).unionByName(fresh))
        held = old.filter("attached").select(self.columns)
        both = chain._cut(held.withColumn("attached", F.lit(True)).unionByName(self._attached(open_, held)))
        tree = both.filter("attached").select(self.columns)
        best = chain._cut(chain.best_block(tree).select(self.columns))
        if state["tip_hash"] is None:
            passed = chain.ancestors(tree, best).select("state_hash", F.lit("apply").alias("change"))
            changes = passed.join(tree.select("state_hash", "height"), "state_hash").select("state_hash", "height", "change")
        elif best.first()["state_hash"] == state["tip_hash"]:
            changes = tree.limit(0).select("state_hash", "height", F.lit("apply").alias("change"))
        else:
            changes = chain.reorganisation(tree, tree.filter(F.col("state_hash") == F.lit(state["tip_hash"])), best)
        changes = self._write(changes, "changes", number)
        self._flags(changes, both, old, number)
        for name, view in self.views.items():
            self._view(name, view, changes, number)
        root = self._root(tree, best, state)
        self._write(both.filter(F.col("height") > root["height"] - self.keep), "frontier", number)
        top = best.first()
        self._write(self.spark.createDataFrame([(top["state_hash"], top["height"], root["state_hash"], root["height"])], best.select(F.col("state_hash").alias("tip_hash"), F.col("height").alias("tip_height"), F.col("state_hash").alias("root_hash"), F.col("height").alias("root_height")).schema).coalesce(1), "tip", number)

    def _attached(self, open_: DataFrame, held: DataFrame) -> DataFrame:
        """Open blocks with ``attached``: whether the last of their ancestors among them has its parent in the tree."""
        if open_.isEmpty():
            return open_.withColumn("attached", F.lit(False))
        tops = chain._tops(chain.contracted(open_))
        known = open_.select(F.col("state_hash").alias("top"), F.col("parent_hash").alias("_of")).join(held.select(F.col("state_hash").alias("_of")), "_of", "left_semi")
        ends = tops.join(known.select("top", F.lit(True).alias("attached")), "top", "left").select("state_hash", F.coalesce("attached", F.lit(False)).alias("attached"))
        return open_.join(ends, "state_hash").select(*self.columns, "attached")

    def _root(self, tree: DataFrame, best: DataFrame, state) -> dict:
        """The canonical root: ``depth`` blocks below the tip once that is far enough above the old one."""
        moved = chain.canonical_update(tree, state["root_height"], self.depth, self.threshold).filter("is_root").first()
        return {"state_hash": moved["state_hash"], "height": moved["height"]} if moved else {"state_hash": state["root_hash"], "height": state["root_height"]}

    def _flags(self, changes: DataFrame, both: DataFrame, old: DataFrame, number: int) -> None:
        """Writes the buckets of flags that the batch touches: what changed, what is new, and what else they had."""
        set_ = changes.select("state_hash", "height", (F.col("change") == "apply").alias("canonical"))
        fresh = both.filter("attached").join(old.filter("attached").select("state_hash"), "state_hash", "left_anti").join(set_.select("state_hash"), "state_hash", "left_anti")
        now = set_.unionByName(fresh.select("state_hash", "height", F.lit(False).alias("canonical"))).withColumn("bucket", F.floor(F.col("height") / BUCKET))
        now = chain._cut(now)
        buckets = [r["bucket"] for r in now.select("bucket").distinct().collect()]  # one for each BUCKET heights that the batch touches
        had = self.flags(number - 1, buckets)
        if had is not None:
            had = had.withColumn("bucket", F.floor(F.col("height") / BUCKET)).join(now.select("state_hash"), "state_hash", "left_anti")
            now = now.unionByName(had.select(now.columns))
        now.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.folder}/flags")

    def _listed(self, folder: str) -> list[int]:
        """Numbers of the parts ``name=number`` of a folder, none where there is no folder."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
        return sorted(int(n.partition("=")[2]) for n in names if "=" in n)

    def flags(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """(state_hash, height, canonical) of all attached blocks after a batch (None: the last), or those of some buckets: of each its last part."""
        done = [n for n in self.numbers("tip") if number is None or n <= number]
        if not done:
            return None
        known = self._listed(f"{self.folder}/flags")
        paths = []
        for k in known if buckets is None else sorted(set(known) & set(buckets)):
            parts = [n for n in self._listed(f"{self.folder}/flags/bucket={k}") if n <= done[-1]]
            if parts:
                paths.append(f"{self.folder}/flags/bucket={k}/batch={parts[-1]}")
        return self.spark.read.parquet(*paths).select("state_hash", "height", "canonical") if paths else None

    def _view(self, name: str, view: View, changes: DataFrame, number: int) -> None:
        own = counters.signed(changes, view.rows(self.spark, changes.select("state_hash")), view.keys, dict(view.measures))
        if number % COMPACT == COMPACT - 1 and (had := self.view(name, number - 1)) is not None:
            own = self._total(had.unionByName(own), view)
        self._write(own, f"view-{name}", number)

    def _total(self, rows: DataFrame, view: View) -> DataFrame:
        out = rows.groupBy(*view.keys).agg(*[F.sum(n).alias(n) for n in view.measures])
        return out.filter(" OR ".join(f"{n} <> 0" for n in view.measures))

    def view(self, name: str, number: int | None = None) -> DataFrame | None:
        """(*keys, *measures) of a view after a batch (None: the last): the last total and the batches after it, added up."""
        parts = [n for n in self.numbers(f"view-{name}") if number is None or n <= number]
        totals = [n for n in parts if n % COMPACT == COMPACT - 1]
        parts = [n for n in parts if not totals or n >= totals[-1]]
        if not parts:
            return None
        return self._total(self.spark.read.parquet(*[self.path(f"view-{name}", n) for n in parts]), self.views[name])

    def tip(self) -> DataFrame | None:
        """One row: tip_hash, tip_height, root_hash, root_height."""
        parts = self.numbers("tip")
        return self._read("tip", parts[-1]) if parts else None

    def missing(self) -> DataFrame | None:
        """(hash, height) of parents that dangling blocks wait for: what to fetch next."""
        parts = self.numbers("frontier")
        if not parts:
            return None
        rows = self._read("frontier", parts[-1])
        wanted = rows.filter(~F.col("attached")).select(F.col("parent_hash").alias("hash"), (F.col("height") - 1).alias("height")).distinct()
        return wanted.join(rows.select(F.col("state_hash").alias("hash")), "hash", "left_anti")

    def vacuum(self) -> None:
        """Removes the parts that no later batch reads: frontiers and tips but the last two, sums below a total, and flags that were written anew."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        gone = [self.path(name, n) for name in ("frontier", "tip") for n in self.numbers(name)[:-2]]
        for name in self.views:
            parts = self.numbers(f"view-{name}")
            totals = [n for n in parts[:-2] if n % COMPACT == COMPACT - 1]
            gone += [self.path(f"view-{name}", n) for n in parts if totals and n < totals[-1]]
        for k in self._listed(f"{self.folder}/flags"):
            gone += [f"{self.folder}/flags/bucket={k}/batch={n}" for n in self._listed(f"{self.folder}/flags/bucket={k}")[:-2]]
        for p in gone:
            at = fs.Path(p)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def run(self, blocks: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts the tree on a stream of blocks, which may repeat and come in any order; it ends when all that is there is taken."""
        return blocks.writeStream.foreachBatch(lambda batch, number: self.step(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
