"""Web archives: written from pages with revisit records, read back, and indexed by merging sorted capture runs.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes the one with the smallest ``page_id`` is a response
and the others are revisits of it. Records are written by Spark's text writer, whose line separator is the two line
ends that close a record, so that archives go to whatever file system the shared folder is on. Records are written by
size, a class of sizes with so many records a file that no file exceeds about ``FILE_BYTES``, but for one of a single
longer record; an archive is read back by its records' lengths.

The index is an external merge. Each archive gives one capture run, sorted by URL key and timestamp inside the task
that reads it, and runs are written. Runs are then dealt to key ranges, and each range merges its slices of the runs
with a loser tree; ranges are in order, so their files together are the global capture history. A range is cut by URL
key, timestamp and page, so a URL of any number of captures spreads over ranges.

Defined cases: null html is the empty payload; a null ``page_id`` never revisits or is revisited before others of its
payload that have one; rows that repeat the smallest id are all responses; a null url has the empty key; line ends in
urls are escaped; other columns are ignored; an empty table gives an empty archive and an empty index. Capture times
are in UTC whatever the session's zone, and repeat after CAPTURE_SPAN seconds, so that any page_id gives a year of four digits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh_path, same, written

LEAST_BYTES = 100
#: Bytes of an archive at most, unless a single record is longer; and of the payload and URL of the records of each class of sizes.
FILE_BYTES = 1 << 26
SIZES = (1 << 14, 1 << 18, 1 << 22)
#: What a record's header takes at most beside its URL, about.
HEAD_BYTES = 1 << 10
#: Captures of a key range, about.
RANGE_ROWS = 200_000
#: The first page's capture time (2020-01-01) and the seconds between pages, since pages have none of their own.
FIRST_CAPTURE, CAPTURE_STEP = 1_577_836_800, 1
CAPTURE_SPAN = 86_400 * 36_524

_FIELDS = "run string, position long, url_key string, captured_at string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long, length long"
_KEY = ("url_key", "captured_at", "page_id")


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "%0A").alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    groups = rows.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy(F.col("payload_digest").alias("of")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Written first, so that its size is known: payloads are only shuffled where repeated ones are too many to broadcast.
    groups = written(groups.filter("n > 1 and first is not null").select("of", "first"), "repeated")
    out = rows.join(groups, F.col("payload_digest") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~same("page_id", "first")
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _id(page_id: Column) -> Column:
    digest = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def capture_time(page_id: Column) -> Column:
    """The capture time of a page as text in UTC, by whole numbers alone, so that no zone of the session takes part."""
    at = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(CAPTURE_SPAN // CAPTURE_STEP)) * CAPTURE_STEP
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(at / 86_400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), two(F.floor(at % 86_400 / 3_600)), F.lit(":"), two(F.floor(at % 3_600 / 60)), F.lit(":"), two(at % 60), F.lit("Z"))


def records(rows: DataFrame) -> DataFrame:
    """One column of whole records, without the two line ends that close each."""
    end = "\r\n"
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(end + end))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    when = capture_time(F.col("page_id"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(end))
    head = F.concat(
        F.lit(f"WARC/1.1{end}"), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", _id(F.col("page_id"))), field("WARC-Date", when), field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("page_id").isNotNull(), field("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", _id(F.col("refers_to"))), field("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        field("Content-Type", F.lit("application/http;msgtype=response")), field("Content-Length", F.octet_length(block).cast("string")), F.lit(end),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of all records under a path, one folder for each class of sizes that occurs."""
    rows = decided(pages)
    size = F.octet_length("url") + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    kind = sum((F.when(size > most, 1).otherwise(0) for most in SIZES), F.lit(0))
    # Of the pages alone, whether or not they revisit: it only tells which folders may be needed.
    longest = pages.agg(F.max(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).cast("long") + F.coalesce(3 * F.octet_length(F.col("url").cast("string")), F.lit(0)))).first()[0] or 0
    for i, least in enumerate((0, *SIZES)):
        if i and longest <= least:
            break
        most = max(1, FILE_BYTES // (SIZES[i] + HEAD_BYTES)) if i < len(SIZES) else 1
        records(rows.filter(kind == i)).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).option("compression", "none").text(f"{path}/size={i}")


def url_key(url: str) -> str:
    """Host parts from the last to the first, then path and query, all in lower case."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


_HEAD = re.compile(rb"\r\n\r\n")


def parse(content: memoryview) -> Iterator[tuple[dict[str, str], int, int, memoryview]]:
    """Fields, offset, length and block of each record of an archive."""
    at, whole = 0, len(content)
    while at < whole:
        m = _HEAD.search(content, at)
        if m is None:
            raise ValueError(f"no end of the header at {at}")
        lines = bytes(content[at : m.start()]).decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        end = m.end() + int(fields["Content-Length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of the record at {at}")
        yield fields, at, end + 4 - at, content[m.end() : end]
        at = end + 4


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures read back from all archives under a path; each archive's are one run, sorted (position from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for f, offset, length, block in parse(memoryview(content.as_buffer())):
                    if f["WARC-Type"] == "response":
                        payload = block[_HEAD.search(block).end() :]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if f["WARC-Payload-Digest"] != f"sha256:{digest}":
                            raise ValueError(f"wrong digest in {name} at {offset}")
                    else:
                        size, digest = int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:")
                    page = int(f["X-Page-ID"]) if "X-Page-ID" in f else None
                    rows.append((url_key(f["WARC-Target-URI"]), f["WARC-Date"], page, f["WARC-Type"], size, digest, int(f["X-Refers-To-Page"]) if "X-Refers-To-Page" in f else None, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2], r[7]))
                columns = [[name.as_py()] * len(rows), list(range(len(rows))), *(zip(*rows, strict=True) if rows else [[]] * 9)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if n in ("run", "url_key", "captured_at", "record_type", "payload_digest") else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.read.schema(schema).format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, _FIELDS)


class LoserTree:
    """Merges sorted sequences: each step replays one path of log2(runs) matches."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, len(runs))
        self.loser = [-1] * self.size
        for i in range(len(runs)):
            self._replay(i, building=True)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; a run without rows comes last, ties by number."""
        x, y = self.at[a] < len(self.runs[a]), self.at[b] < len(self.runs[b])
        if not (x and y):
            return x or (not y and a < b)
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _replay(self, run: int, building: bool = False) -> None:
        node = (run + self.size) // 2
        while node > 0:
            other = self.loser[node]
            if other < 0 and building:
                self.loser[node] = run
                return
            if other >= 0 and self._before(other, run):
                self.loser[node], run = run, other
            node //= 2
        self.loser[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, index in it) of all rows in order."""
        while self.runs and self.at[w := self.loser[0]] < len(self.runs[w]):
            yield w, self.at[w]
            self.at[w] += 1
            self._replay(w)


def merged(runs: DataFrame) -> DataFrame:
    """All captures in global order: one partition a key range, in the order of ranges."""
    rows = runs.count()
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
    dealt = runs.repartitionByRange(ranges, *_KEY).sortWithinPartitions("run", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one range, RANGE_ROWS or so
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = list(zip(whole["url_key"].to_pylist(), whole["captured_at"].to_pylist(), [-1 if x is None else x for x in whole["page_id"].to_pylist()], strict=True))
        names = whole["run"].to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        order = [cuts[r] + i for r, i in LoserTree([keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])]
        yield from whole.take(order).to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, _FIELDS)


def index(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back and merges their captures."""
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    write_archives(pages, path)
    return merged(written(capture_runs(spark, path), "runs"))
