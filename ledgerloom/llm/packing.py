"""Concatenate-and-cut packing of token streams into sequences of a fixed length.

Pass one tokenises every document once and writes its ids with the document's offset inside its partition.
Partition totals (a row each) give every partition's global offset by a prefix sum. Pass two cuts the global
stream at multiples of the sequence length: a document that crosses a boundary leaves one record on each side.
Texts are never shuffled, and only the last sequence of the whole stream needs padding.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed once each; a null
``doc_id`` is carried; a text of any length is cut into as many pieces as it fills; other columns are ignored,
whatever their names; an empty table packs into nothing.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import trim, written

SEQUENCE = 1024
END_ID = 0
#: Words kept by a worker with their ids; beyond that the store is emptied, so memory stays bounded (about 400 bytes a word).
#: Longer words, and odd ones, are encoded each time. Either way gives the same ids.
KEPT_WORDS = 40_000
KEPT_LENGTH = 40
#: Texts that are cut into words at once.
SLICE = 256

#: A single space between two other characters: no token of the vocabulary's pattern reaches across it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s\s")


def vocabulary_path() -> str:
    """The public byte-level vocabulary of 50,257 ids; ``.tiktoken`` beside it holds the same ids as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; ids of words met before are looked up.

    Added tokens of the vocabulary file (such as one that ends texts) are ids of their own wherever they stand in a
    text, the leftmost first and the longest of those; what lies between them is encoded apart.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.find_added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(ranks.values()) + 1, "int64")
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]
        self.words: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that follow a space, by one call for all: the tokens' byte lengths tell where each ends."""
        ids = np.array(self.encode(" " + " ".join(words)), "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = (4 * (1 + np.searchsorted(np.cumsum(self.sizes[ids]), ends))).tolist()
        flat = ids.tobytes()
        return {w: flat[a:b] for w, a, b in zip(words, [0, *cuts], cuts)}  # noqa: B905

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        some = {i: text for i, text in enumerate(texts) if self.find_added.search(text)} if self.added else {}
        out = self.plain(["" if i in some else text for i, text in enumerate(texts)])
        for i, text in some.items():
            parts, at = [], 0
            for m in self.find_added.finditer(text):
                parts += [self.ids(text[at : m.start()]), self.added[m[0]]]
                at = m.end()
            out[i] = b"".join([*parts, self.ids(text[at:])])
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without added tokens."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        cut = [_CUT.split(text) if _RUN.search(text) else text.split(" ") for text in texts]
        known = self.words
        new = set(chain.from_iterable(cut)) - known.keys()
        odd = {w: self.ids(" " + w) for w in new if len(w) > KEPT_LENGTH or not w or w[0].isspace() or w[-1].isspace()}
        new -= odd.keys()
        if new:
            known.update(self.learn(list(new)))
        known.update(odd)
        look = known.__getitem__
        out = [self.ids(pieces[0]) + b"".join(map(look, pieces[1:])) for pieces in cut]
        for w in odd:
            del known[w]
        return out


@lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(part, before, doc_id, n, ids): each document's ids and the count of its partition's ids before it."""
    path = path or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = tokenizer(path).batch, TaskContext.get().partitionId(), 0
        for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            ids = [x + end for x in encode([text or "" for text in batch["text"].to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], "int64")
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            # Two bytes an id are enough on disk where the vocabulary allows; narrow() keeps wider ids as they are.
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(start), batch["doc_id"].cast(pa.int64()), pa.array(n), pa.array([narrow(x) for x in ids], pa.binary())], ["part", "before", "doc_id", "n", "ids"])
        trim()

    # doc_id is a long here, since the schema of the result is fixed.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, before long, doc_id long, n long, ids binary")


def narrow(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.size == 0 or wide.max() < 65536 else b"\x04" + ids


def widen(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1).astype("<u4")


def packed(docs: DataFrame, length: int = SEQUENCE, path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    tokens = written(tokenized(docs, path, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select(F.col("part").alias("of"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(base), F.col("part") == F.col("of"))  # a row for each partition of pass one
    placed = placed.select("doc_id", "ids", (F.col("base") + F.col("before")).alias("at"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, ids, at in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), batch["at"].to_pylist(), strict=True):
                wide = widen(ids)
                n, start = len(wide), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    take = min(n - start, length - offset)
                    piece = wide[start : start + take]
                    for column, x in zip(rows, (doc, start, take, zlib.crc32(piece), n, sequence, offset, piece.astype("int64"))):  # noqa: B905
                        column.append(x)
                    start += take
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64()) if name == "ids" else pa.int64()) for name, x in zip(names, rows, strict=True)], names)
        trim()

    return placed.mapInArrow(cut, schema)
