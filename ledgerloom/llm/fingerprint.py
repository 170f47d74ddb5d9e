"""Canonical exact document digests, with DataFrame functions alone.

A text is folded (Unicode compatibility composition, full case folding, white space runs to one space,
trimmed) and digested by two chained 64-bit xxhash values with different seeds: 128 bits. Documents are
grouped by that digest; inside a digest's bucket the canonical bytes themselves are compared, and texts that
differ there get a numbered suffix, so that equal fingerprints mean equal canonical bytes.

Digests are counted first, so that texts are only shuffled where a digest occurs more than once, and copies fold
before that. The next document by id is found inside blocks of the order of ids: a block starts at a row of a sample of
the order, whose bounds are broadcast as one row, and the row that a block starts at is also sent to the block before
it. Equal rows of an id that fills a block are folded before, and unfolded after. So one shuffle moves every text once, and
no window holds more than a block, but for different texts of one id and hash.

Defined cases: a null text is the empty text; repeated rows share a fingerprint and each keeps its row; rows
with a null ``doc_id`` are kept and come last; rows of one ``doc_id`` follow each other in the order of a hash of their
texts; other columns are ignored, whatever their names; an empty table gives an empty result; a table of one row is its
own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, marked, marks, same

#: Rows of a block of the id order, about: a window holds one block, never the table.
BLOCK_ROWS = 1000
#: Blocks at most, about, since their bounds go to all executors (some 24 bytes each); blocks are larger beyond.
MAX_BLOCKS = 100_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding can decompose), white space runs to a space, trimmed."""
    compose = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    filled = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(filled) == F.char_length(filled)
    folded = F.when(ascii_only, F.lower(filled)).otherwise(compose(fold(compose(filled))))
    return F.trim(F.regexp_replace(folded, r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """32 lower-case hex digits: two xxhash64 values of the text, the second seeded by a constant."""
    halves = (F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon))
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in halves]))


def collisions(docs: DataFrame, digest_of=digest) -> DataFrame:
    """(digest, canon, ordinal) of the digests that more than one canonical text has, ordinals from 0.

    Digests that occur more than once mark a bitmap of a fixed size, which is broadcast; texts of other digests, but for a
    few that share a bit, are never shuffled. Copies fold before the shuffle, so that a group of any size is one row of
    each task.
    """
    # Folded once: what follows refers to the folded column, which is not inlined.
    texts = docs.select(canonical(F.col("text")).alias("canon")).select(digest_of(F.col("canon")).alias("digest"), "canon")
    often = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.xxhash64("digest"))
    texts = marked(texts, F.xxhash64("digest"), marks(often), "often").filter("often").select("digest", "canon").distinct()
    shared = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    ordinal = F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1
    return texts.join(shared, "digest").withColumn("ordinal", ordinal)


def numbered(df: DataFrame, canon: str, digest: str, clash: DataFrame) -> DataFrame:
    """df with the digest of a canonical text lengthened by the text's ordinal where its bucket has several, from 1 on."""
    others = clash.filter("ordinal > 0").select(F.col("digest").alias(digest), F.col("canon").alias(canon), F.concat(F.lit("-"), F.col("ordinal").cast("string")).alias("_suffix"))
    joined = df.join(others, [digest, canon], "left")
    return joined.withColumn(digest, F.concat(digest, F.coalesce("_suffix", F.lit("")))).select(df.columns)


def fingerprints(docs: DataFrame, digest_of=digest, clash: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, fingerprint): the digest, with the ordinal of the text where a digest has several; clash is collisions(docs)."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), canonical(F.col("text")).alias("_canon"))
    out = out.select("doc_id", "text", "_canon", digest_of(F.col("_canon")).alias("fingerprint"))
    clash = cut(collisions(docs, digest_of)) if clash is None else clash
    return (out if clash.isEmpty() else numbered(out, "_canon", "fingerprint", clash)).drop("_canon")


def place(doc_id: Column, text: Column) -> Column:
    """The greater, the later: descending ids, null last, then a hash of the text."""
    return F.struct(doc_id.isNull().alias("last"), F.coalesce(F.bitwise_not(doc_id.cast("long")), F.lit(0).cast("long")).alias("down"), F.xxhash64(text).alias("tie"))


def bounds(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: the places at which blocks start, in order, as groups (fine) and each group's first (coarse); every ``each`` make a group.

    The first place of all is one of them, the others are a sample by hash of about a row in block_rows.
    """
    every = max(block_rows, docs.count() // MAX_BLOCKS)
    at = docs.select(place(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("at"))
    sample = at.filter(F.pmod(F.xxhash64("at", F.lit(41)), F.lit(every)) == 0).unionAll(at.agg(F.min("at").alias("at")).filter("at is not null"))
    found = sample.agg(F.sort_array(F.collect_set("at")).alias("b")).withColumn("each", F.greatest(F.ceil(F.sqrt(F.size("b"))), F.lit(1)).cast("int"))
    starts = F.when(F.size("b") > 0, F.sequence(F.lit(0), F.size("b") - 1, F.col("each"))).otherwise(F.array().cast("array<int>"))
    return found.select("each", F.size("b").alias("blocks"), F.transform(starts, lambda i: F.get("b", i)).alias("coarse"), F.transform(starts, lambda i: F.slice("b", i + 1, F.col("each"))).alias("fine"))


def folded(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs (doc_id, text, fingerprint) with ``copies``: rows of an id that more than a block's rows have are one row if their texts are equal."""
    often = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows).select(F.col("doc_id").alias("often")))
    one = F.lit(1).cast("long").alias("copies")
    if often.isEmpty():
        return docs.select("*", one)
    on = same("doc_id", "often")
    hot = docs.join(often, on, "left_semi").groupBy(docs.columns).agg(F.count(F.lit(1)).alias("copies"))
    return docs.join(often, on, "left_anti").select("*", one).unionByName(hot)


def with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs (doc_id, text, fingerprint) with next_text and next_fingerprint, of the next row in descending doc_id (after the last: the first)."""
    own = folded(docs, block_rows)
    placed = own.withColumn("at", place(F.col("doc_id"), F.col("text"))).crossJoin(F.broadcast(cut(bounds(docs.select("doc_id", "text"), block_rows))))  # one row
    upto = lambda places: F.size(F.filter(places, lambda b: b <= F.col("at")))
    placed = placed.withColumn("group", upto(F.col("coarse")) - 1)
    placed = placed.withColumn("inside", upto(F.get("fine", F.col("group")))).withColumn("block", F.col("group") * F.col("each") + F.col("inside"))
    start = F.get(F.get("fine", F.col("group")), F.col("inside") - 1)
    before = F.when(F.col("block") > 1, F.col("block") - 1).otherwise(F.col("blocks"))
    here = F.struct(F.col("block"), F.lit(False).alias("follows"))
    to = F.when(F.col("at") == start, F.array(here, F.struct(before.alias("block"), F.lit(True).alias("follows")))).otherwise(F.array(here))
    both = placed.select("doc_id", "text", "fingerprint", "copies", "at", F.explode(to).alias("to")).select("doc_id", "text", "fingerprint", "copies", "at", "to.*")
    w = Window.partitionBy("block").orderBy("follows", "at")
    both = both.withColumns({"next_text": F.lead("text").over(w), "next_fingerprint": F.lead("fingerprint").over(w)}).filter(~F.col("follows"))
    # Of equal rows that were folded all but the last are followed by one like themselves.
    last = F.array(F.struct("next_text", "next_fingerprint"))
    like = F.array_repeat(F.struct(F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")), (F.col("copies") - 1).cast("int"))
    return both.select("doc_id", "text", "fingerprint", F.explode(F.when(F.col("copies") > 1, F.concat(last, like)).otherwise(last)).alias("n")).select("doc_id", "text", "fingerprint", "n.*")


def edited_fingerprints(docs: DataFrame, digest_of=digest, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are (1.0 if equal, else 0.0)."""
    clash = cut(collisions(docs, digest_of))
    df = with_next(fingerprints(docs, digest_of, clash), block_rows).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    keep = F.col("n_chars").cast("int") - half
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), keep), F.substring(F.col("next_text"), F.lit(1), half)))
    df = df.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_fingerprint", digest_of(F.col("edited_canon")))
    # Texts are compared byte by byte where the digests agree.
    like = F.when(F.substring("fingerprint", 1, F.length("edited_fingerprint")) == F.col("edited_fingerprint"), F.when(canonical(F.col("text")) == F.col("edited_canon"), 1.0).otherwise(0.0)).otherwise(0.0)
    df = df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_canon", "edited_fingerprint",
        like.alias("near_edited"), F.when(F.col("fingerprint") == F.col("next_fingerprint"), 1.0).otherwise(0.0).alias("near_next"),
    )
    # An edited text that is one of a bucket's texts has that one's number.
    return (df if clash.isEmpty() else numbered(df, "edited_canon", "edited_fingerprint", clash)).drop("edited_canon")
