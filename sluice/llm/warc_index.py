"""WARC archives of pages, with a capture index built by external merge.

Each writing task fills archives of bounded size in the shared folder and returns
its captures as a run sorted by URL key and timestamp. Runs are cut by key range,
and within a range a loser tree merges them k ways, so that the index as a whole
is in order: the history of a URL is one stretch of it. Records are read back from
the archives by the index's offsets.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import few_rows, file_system, fresh_path, load, slices, written

#: Bytes of compressed records after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
#: Rows of the index in one range of keys.
RANGE_ROWS = 200_000
#: Bytes of an archive that a task reads at least.
READ_BYTES = 8 << 20
#: Slots of the bitmap of repeated digests. Where they fill up, more pages are shuffled than have copies.
SLOTS = 1 << 23
RECORD = "urn:sluice:page:"
EPOCH = 1_704_067_200

CAPTURE = "urlkey string, ts long, page_id long, record_type string, file string, offset long, length long, run long, seq long"


class LoserTree:
    """Merges sorted runs. Inner nodes hold the loser of a match, so the next item costs one path of matches to the root."""

    def __init__(self, runs: Iterable[Iterable], key: Callable) -> None:
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a goes before run b: ended runs go last, equal keys by run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) >> 1
        while node:
            other = self.losers[node]
            if other < 0:
                # first of the two to come here while the tree is built
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node >>= 1
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.keys[w := self.losers[0]] is not None:
            yield self.heads[w]
            head = next(self.runs[w], None)
            self.heads[w], self.keys[w] = head, None if head is None else self.key(head)
            self._play(w)


def url_key(url: str | None) -> str:
    """Host labels from the right, in lower case, then the path and query as they are: captures of a host lie together. A null URL has the empty key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip()
    host = re.sub(r"^www\d*\.", "", host)
    labels = ",".join(reversed(host.split(".")))
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _date(ts: int) -> str:
    import datetime

    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page: int | None, url: str | None, ts: int, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit has the response's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{'' if page is None else page}>", f"WARC-Date: {_date(ts)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"\s", "%20", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record; names in lower case."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    warc = fields(head.decode().split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http_head.decode().split("\r\n")[1:]), payload


def _id(reference: str) -> int | None:
    found = reference.strip("<>").removeprefix(RECORD)
    return int(found) if found else None


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with __first, the smallest page_id with the same payload, where several have it; null else.

    Groups are found by digest and id alone. A bitmap of their digests, of at most
    SLOTS / 64 rows, then parts the pages: those whose digest is not in it stay where
    they are read, and only the others are shuffled with their payload to their group.
    """
    sized = pages.withColumn("__sha", F.sha1(F.col("html").cast("binary")))
    sound = sized.where(f"octet_length(html) >= {int(min_bytes)} and page_id is not null")
    groups = sound.groupBy("__sha").agg(F.min("page_id").alias("__first"), F.max("page_id").alias("__last")).where("__last > __first").select("__sha", "__first")
    groups = written(groups, "copies")
    slot = F.pmod(F.xxhash64("__sha"), F.lit(SLOTS))
    word, bit = F.floor(slot / 64).cast("int"), (slot % 64).cast("int")
    marks = groups.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__marks"))
    marked = sized.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(marks), "__word", "left")
    likely = F.coalesce(F.call_function("bit_get", F.col("__marks"), F.col("__bit")) == 1, F.lit(False))
    alone = marked.where(~likely).select(*pages.columns, F.lit(None).cast("long").alias("__first"))
    # a merge join at every size: payloads are never broadcast, and groups grow with the pages
    grouped = marked.where(likely).hint("merge").join(groups, "__sha", "left").select(*pages.columns, "__first")
    return alone.unionByName(grouped)


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html, ts) as records under folder; returns their captures, a sorted run for each task.

    Of pages with equal payloads of at least min_bytes, the one with the smallest
    page_id is a response and the others revisit it; a smaller payload is always
    a response, and so is a page without id. A null html is an empty payload.
    """
    joined = with_first(pages, min_bytes).select("page_id", "url", "html", "ts", F.expr("case when page_id > __first then __first end").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        # a repeated attempt writes files of its own; only those of the attempt that ends well are in the index
        task, number, out, name, offset, captures = TaskContext.get(), 0, None, "", 0, []
        for batch in slices(batches, "html", 8 << 20):
            for row in batch.to_pylist():
                if out is None:
                    name, offset = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                member = record(row["page_id"], row["url"], row["ts"], row["html"].encode(), row["refers_to"])
                out.write(member)
                captures.append((url_key(row["url"]), row["ts"], row["page_id"], "response" if row["refers_to"] is None else "revisit", name, offset, len(member)))
                offset += len(member)
                if offset >= archive_bytes:
                    out.close()
                    out, number = None, number + 1
        if out is not None:
            out.close()
        captures.sort(key=_order)
        for a in range(0, len(captures), 10_000):
            part = captures[a : a + 10_000]
            columns = [*zip(*part, strict=True), [task.partitionId()] * len(part), range(a, a + len(part))]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CAPTURE.split(", ")])

    return joined.mapInArrow(run, CAPTURE)


def _order(row: tuple) -> tuple:
    """URL key, timestamp, then page id with null first."""
    return row[0], row[1], -1 if row[2] is None else 0, row[2] or 0


def merge_runs(captures: DataFrame, rows: int, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures with range_no and place, by which they are in order of URL key, timestamp and page id.

    Files of a table are read in any order, so the order is in these two columns: all
    of a range goes before the next range, and in it rows go by place. Ranges of the
    whole order, not of keys alone, hold range_rows or so each, which is what a task
    has in hand, however many captures one URL has. Spark sorts a range's rows by run
    and place in the run, and a loser tree merges the runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(row[7], []).append(row)
        own, at, held = TaskContext.get().partitionId(), 0, []

        def out() -> pa.RecordBatch:
            whole = _batch(held, schema)
            places = [pa.array(np.full(len(held), own)), pa.array(np.arange(at - len(held), at))]
            return pa.RecordBatch.from_arrays([*whole.columns, *places], names=[*schema.names, "range_no", "place"])

        for row in LoserTree(runs.values(), _order):
            held.append(row)
            at += 1
            if len(held) == 10_000:
                yield out()
                held = []
        if held:
            yield out()

    names = [c.split()[0] for c in CAPTURE.split(", ")]
    dealt = captures.select(*names).repartitionByRange(max(1, -(-rows // range_rows)), "urlkey", "ts", "page_id").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(run, f"{CAPTURE}, range_no long, place long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that index names, read from the archives; those of one stretch of an archive in one pass over it.

    Length and digest of a response are taken from its payload, those of a
    revisit from the record, which has no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        opened, source = "", None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != opened:
                    if source is not None:
                        source.close()
                    opened, source = name, files.open_input_file(f"{base}/{name}")
                source.seek(offset)
                warc, http, payload = parse(source.read(length))
                own = warc["warc-type"] == "response"
                rows.append((_id(warc["warc-record-id"]), len(payload) if own else int(http["content-length"]), digest(payload) if own else warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"], _id(warc["warc-refers-to"]) if not own else None, warc.get("warc-target-uri")))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in READ.split(", ")])
        if source is not None:
            source.close()

    # dealt by bytes of the archives: adaptive plans see the index only, and leave an explicit number alone
    total = index.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / READ_BYTES)
    return index.select("file", "offset", "length").repartition(max(1, -(-total // READ_BYTES)), "file", stretch).sortWithinPartitions("file", "offset").mapInArrow(run, READ)


def archive_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", ts: Column | None = None, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records read back, capture index) of pages, whose archives are written to the shared folder now. The index is in order by range_no and place.

    ts is the capture time in seconds; by default a page's id counts seconds from
    2024-01-01. Repeated rows are records each; columns beside the three are left out.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    plain = few_rows(pages).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.coalesce((F.lit(EPOCH) + F.col(page_id) if ts is None else ts).cast("long"), F.lit(EPOCH)).alias("ts"))
    runs = written(write_archives(plain, folder, min_bytes=min_bytes), "capture-runs")
    index = written(merge_runs(runs, runs.count()), "capture-index")
    return read_archives(index, folder), index


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = archive_pages(load(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}
ORACLE_SQL = {
    "op7_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id,
         list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS chunks
  FROM p
)
SELECT page_id,
       CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(chunks, lambda c:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((c >> 15) & 31 AS INTEGER) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((c >> 10) & 31 AS INTEGER) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((c >> 5) & 31 AS INTEGER) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(c & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM r
"""
}
