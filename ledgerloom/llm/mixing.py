"""Mixing of sources to target weights by entropy balancing.

Each source gets a token target (its share of the budget by weight, never more than ``MAX_COPIES`` times its
size, the excess reshared). Document rates are the closest ones to 1 in relative entropy, with base measure
``size + mean size of the source``, that meet the token constraints and stay at or below ``MAX_COPIES``. The
dual has one multiplier a source, and its solution is ``rate = min(MAX_COPIES, exp(multiplier * x))`` with
``x = size / (size + mean)``. Safeguarded Newton steps solve it: each is one distributed aggregation over the
(source, size) histogram, which is the pre-aggregated table of documents. Rates are then rounded to whole copies
by carrying the rounding error from longer to shorter documents inside hashed blocks of a source, so that any
source, however large, is spread over many tasks and its total is off by a few words a block. Rows that repeat a
document are rounded together, and their copies dealt to the single rows, so that some take one more than others.

Defined cases: a null text has size 0; a source of null is a source of its own, the last; of rows that repeat
a document (its id, source and size) the first ones take a copy more than the others where their copies don't divide,
and which are first is not fixed; a null ``doc_id`` is an id like any other; a source without words takes none; an empty
table mixes into an empty result; other columns are kept by ``mixed`` and ignored by ``rates``. Multipliers that are
not found within ``MAX_STEPS`` steps are an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, few, free, same, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_COPIES = 2
#: Distinct documents of a rounding block, about.
BLOCK_ROWS = 4096
TOLERANCE = 1e-7
MAX_STEPS = 60


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(hist: DataFrame, weights: Sequence[float], budget: float, most: int) -> DataFrame:
    """(source, total, docs, target): one row a source. The level c solves sum(min(most * total, c * weight)) = budget."""
    src = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("docs"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    src = src.withColumn("w", weight).withColumn("cap", (most * F.col("total")).cast("double"))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").asc_nulls_last())
    src = src.withColumn("capped", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    src = src.withColumn("open_w", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    src = src.withColumn("level", (F.sum("total").over(whole) * F.lit(float(budget)) - F.coalesce("capped", F.lit(0.0))) / F.col("open_w"))
    # The level rises while sources are capped and falls after: its maximum is the solution.
    fixed = F.max("level").over(whole)
    return src.select("source", "total", "docs", F.least("cap", fixed * F.col("w")).alias("target"))


def tilt(lam: Column, size: Column, mean: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(lam * size / (size + mean)))


def balanced(hist: DataFrame, goals: DataFrame, most: int = MAX_COPIES, tolerance: float = TOLERANCE) -> DataFrame:
    """goals with ``lam``, the multipliers that solve the dual; null where the rate is ``most`` throughout."""
    mean = F.col("total") / F.col("docs")
    inside = (F.col("total") > 0) & (F.col("target") < most * F.col("total") * (1 - 1e-9))
    state = goals.withColumns({"mean": mean, "lam": F.when(inside, F.lit(0.0)), "lo": -50.0 * (1 + mean), "hi": 1 + (1 + mean) * 2.0, "error": F.when(inside, F.lit(1.0)).otherwise(0.0)})
    state = cut(state)
    for _ in range(MAX_STEPS):
        if (state.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
        x = F.col("size") / (F.col("size") + F.col("mean"))
        rate = tilt(F.col("lam"), F.col("size"), F.col("mean"), most)
        at = hist.withColumnRenamed("source", "of").join(state.filter("lam is not null"), same("of", "source"))
        sums = at.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("f"), F.sum(F.when(rate < most, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"))
        state = state.join(sums.withColumnRenamed("source", "of"), same("of", "source"), "left")
        over = F.col("f") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - (F.log("f") - F.log("target")) * F.col("f") / F.when(F.col("slope") > 0, F.col("slope"))
        state = state.withColumns({"lo": lo, "hi": hi, "step": step})
        new = F.when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        error = F.when(F.col("lam").isNull(), 0.0).otherwise(F.abs(F.col("f") / F.col("target") - 1))
        state = state.withColumn("error", error)
        keep = F.col("error") <= tolerance
        state = cut(state.select("source", "total", "docs", "target", "mean", F.when(F.col("lam").isNull() | keep, F.col("lam")).otherwise(new).alias("lam"), "lo", "hi", "error"))
    else:
        if (state.agg(F.max("error")).first()[0] or 0.0) > tolerance:
            raise RuntimeError(f"the mix misses its targets after {MAX_STEPS} steps")
    return state.select("source", "total", "docs", "target", "mean", "lam")


def _carry(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of all rows of a block's documents: long ones first, each takes the copies that bring the running error nearest to 0."""
    pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last")
    error, copies = 0.0, []
    for size, n, rate, most in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), pdf["most"].tolist(), strict=True):
        want = error + size * n * rate
        copies.append(min(n * most, max(0, round(want / size))) if size else 0)
        error = want - size * copies[-1]
    return pdf.assign(copies=copies)[["doc_id", "source", "size", "n", "copies"]]


def rates(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MAX_COPIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate and copies (``size * copies`` words are taken)."""
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.spark_partition_id().alias("part"))
    base = written(base, "sizes")
    hist = cut(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = few(balanced(hist, cut(targets(hist, weights, budget, most)), most).withColumnRenamed("source", "of"))
    rate = F.when(F.col("lam").isNull(), F.when(F.col("target") > 0, float(most)).otherwise(0.0)).otherwise(tilt(F.col("lam"), F.col("size"), F.col("mean"), most))
    keys = base.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")).join(goals, same("source", "of"))
    keys = keys.withColumns({"rate": rate, "block": F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("docs") / block_rows).cast("long"))})
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = keys.select("doc_id", "source", "size", "n", "rate", F.lit(most).alias("most"), "block")
    copies = fields.groupBy("source", "block").applyInPandas(_carry, f"doc_id {kind}, source string, size long, n long, copies long")
    copies = written(copies.toDF("c_id", "c_source", "c_size", "n", "copies"), "copies")
    on = lambda: same("doc_id", "c_id") & same("source", "c_source") & (F.col("size") == F.col("c_size"))
    own = ["doc_id", "source", "size", F.col("copies").cast("int").alias("copies")]
    out = base.join(copies.filter("n = 1"), on()).select(own)
    if not (repeated := copies.filter("n > 1")).isEmpty():
        rows = numbered(base.join(few(repeated), on()).drop("c_id", "c_source", "c_size"), ["doc_id", "source", "size"], "part", "nth")
        out = out.unionAll(rows.withColumn("copies", dealt(F.col("copies"), F.col("n"), F.col("nth"))).select(own))
    out = out.join(goals, same("source", "of"))
    return out.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", rate.alias("rate"), "copies")


def numbered(rows: DataFrame, key: list[str], part: str, nth: str) -> DataFrame:
    """Written rows with ``nth``, from 0 among the rows of a key: numbered inside each part, on from those of the parts before."""
    *names, m = free(rows, *[f"b_{i}" for i in range(len(key) + 1)], "b_m")
    sizes = rows.groupBy(*key, part).agg(F.count(F.lit(1)).alias(m))
    before = F.coalesce(F.sum(m).over(Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(c).alias(n) for c, n in zip([*key, part], names, strict=True)], before.alias(m))
    inside = rows.withColumn(nth, F.row_number().over(Window.partitionBy(*key, part).orderBy(part)) - 1)
    on = reduce(and_, [same(c, n) for c, n in zip([*key, part], names, strict=True)])
    return inside.join(starts, on).withColumn(nth, F.col(nth) + F.col(m)).drop(*names, m)


def dealt(copies: Column, n: Column, nth: Column) -> Column:
    """Copies of the nth of n rows that share a number of copies."""
    return F.floor(copies / n) + F.when(nth < copies % n, 1).otherwise(0)


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MAX_COPIES) -> DataFrame:
    """The documents of the mix, all columns kept: each as many times as it has copies."""
    taken = rates(docs, weights, budget, most).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")).filter("copies > 0")
    taken = written(taken, "taken")
    ids = free(docs, "of_id", "of_source", "of_size", "of_n", "of_copies", "of_part", "of_nth", "of_copy")
    of_id, of_source, of_size, of_n, of_copies, of_part, of_nth, of_copy = map(F.col, ids)
    taken = taken.toDF(*ids[:5])
    on = same(docs["doc_id"], of_id) & same(docs["source"].cast("string"), of_source) & (words(docs["text"]) == of_size)
    copied = lambda df, n: df.withColumn(ids[7], F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*docs.columns)
    out = copied(docs.join(taken.filter(of_n == 1), on), of_copies)
    if (repeated := taken.filter(of_n > 1)).isEmpty():
        return out
    rows = written(docs.withColumn(ids[5], F.spark_partition_id()).join(few(repeated), on), "repeated")
    rows = numbered(rows, ids[:3], ids[5], ids[6]).withColumn(ids[4], dealt(of_copies, of_n, of_nth))
    return out.unionAll(copied(rows.filter(of_copies > 0), of_copies))
