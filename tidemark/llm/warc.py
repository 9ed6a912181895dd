"""WARC archives of pages, and their capture histories by an external index merge.

:func:`write` appends one gzip member per page to archive files in the shared folder: a response with the payload, or
a revisit that refers to the response with an equal payload. File names are unique to a task attempt and only those in
the written manifest count, so a lost or repeated task leaves no record twice (what such an attempt left stays in the
folder unread). :func:`read` parses the archives, :func:`runs` sorts the captures of a group of archives by URL key, time
and id (Spark's sort, which spills) and writes each group as a run file of small blocks with an index row per block.
:func:`merge` cuts the index into key intervals; the task of an interval opens every run at the block where the interval
begins and merges the streams with a loser tree, one block per run in memory. The histories come in one global order.

Cases: null html is an empty payload; a null url is the empty URL; pages without an id are responses only where no
page with an id has their payload; rows that repeat the smallest id and its payload are all responses; an empty table
gives no archive and an empty result; other columns are ignored. Line breaks in URLs are percent-encoded.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Pages carry no capture time: theirs is this plus as many seconds as their id.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_KNOWN, _NO_ID = 0x7469646570616765, 0x7469646570616766
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    """A UUID that holds the id."""
    high = _NO_ID if page_id is None else _KNOWN
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | (page_id or 0) & (1 << 64) - 1)}>"


def page_of(rid: str) -> int | None:
    n = uuid.UUID(rid.strip("<>").rpartition(":")[2]).int
    low = n & (1 << 64) - 1
    return None if n >> 64 == _NO_ID else low - (1 << 64 if low >> 63 else 0)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_time(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str) -> str:
    """Host labels from the top down, then path and query: pages of a site sort together."""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.lower()
    at = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + at + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {capture_time(page_id)}", f"WARC-Target-URI: {safe}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The capture that one record holds; the payload's digest and size are taken from the payload where it is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (base32_sha1(payload) != stated or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest or length")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url_key": url_key(fields["WARC-Target-URI"]),
            "captured_at": fields["WARC-Date"], "payload_bytes": size if revisit else len(payload),
            "payload_digest": stated if revisit else base32_sha1(payload), "record_type": fields["WARC-Type"],
            "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None}


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives under folder; returns the manifest (path, records), itself written."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"),
                     F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    p = p.withColumn("sha", F.sha1("html")).withColumn("key", C.row_key(F.col("page_id"), F.col("sha")))
    narrow = p.select("page_id", "sha", "key")
    first = narrow.groupBy("sha").agg(F.min("page_id").alias("first"))
    # Only revisits are marked; responses find no mark.
    marks = (narrow.join(first, "sha").where("first IS NOT NULL AND NOT page_id <=> first")
             .select("key", "first").distinct())
    rows = p.join(marks, "key", "left").select("page_id", "url", "html", "sha", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        fs.create_dir(top)
        out, name, size, n, done = None, "", 0, 0, []
        for b in batches:
            for page, url, html, sha, ref in zip(*(b.column(c) for c in range(5))):
                page, ref = page.as_py(), ref.as_py()
                if out is None:
                    name, size, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = z.compress(record(page, url.as_py(), html.as_py(), digest, ref, ref is not None)) + z.flush()
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((name, n))
        if out is not None:
            out.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())],
                                             ["path", "records"])

    return C.materialize(rows.mapInArrow(run, "path string, records long"), "manifest")


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member of a stream, one in memory at a time."""
    z, parts, start, at, data = zlib.decompressobj(31), [], 0, 0, stream.read(1 << 20)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            at += len(data) - len(z.unused_data)
            yield start, b"".join(parts)
            data, start, parts = z.unused_data, at, []
            z = zlib.decompressobj(31)
            data = data or stream.read(1 << 20)
        else:
            at += len(data)
            data = stream.read(1 << 20)


_CAPTURE = ("page_id long, url_key string, captured_at string, payload_bytes long, payload_digest string, "
            "record_type string, refers_to long, run string, offset long")
_COLUMNS = [x.split()[0] for x in _CAPTURE.split(", ")]


_ORDER = ["url_key", "captured_at", "page_id"]


def _order(r: tuple) -> tuple:
    """Of a capture as a tuple of _COLUMNS; as Spark sorts by _ORDER, nulls first."""
    return r[1].encode(), r[2], r[0] is not None, r[0] or 0


def _batch(rows: list[tuple], types: list, columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)


def _batches(rows: Iterable[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield _batch(part, _TYPES, _COLUMNS)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Captures of every archive of the manifest. Archives are dealt to as many tasks as there are archives, above 512 to one
    for each 16 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for b in batches:
            for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = 0

                def captures():
                    nonlocal seen
                    with fs.open_input_stream(path, compression=None) as stream:
                        for at, raw in members(stream):
                            seen += 1
                            yield tuple((parse(raw) | {"run": path, "offset": at})[c] for c in _COLUMNS)

                yield from _batches(captures())
                if seen != n:
                    raise ValueError(f"{path} has {seen} records, the manifest {n}")

    n = manifest.count()
    return manifest.repartition(max(1, min(n, 512), n // 16), "path").mapInArrow(run, _CAPTURE)


#: Captures in a block of a run file: what a merge holds of each run.
BLOCK_ROWS = 256
_INDEX = "run_file string, block int, url_key string, captured_at string, page_id long, captures int"
_SCHEMA = pa.schema(list(zip(_COLUMNS, _TYPES)))


def runs(captures: DataFrame, folder: str) -> DataFrame:
    """Write every partition of captures as one sorted run file; returns its index, itself written: the first key of each
    block. Files are unique to a task attempt and only those of the index count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        fs.create_dir(top)
        name, index = f"{top}/{uuid.uuid4().hex}.arrow", []
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        first = next(rows, None)
        if first is None:
            return
        with fs.open_output_stream(name, compression=None) as out, pa.ipc.new_file(out, _SCHEMA) as file:
            for block in _batches(itertools.chain([first], rows), BLOCK_ROWS):
                file.write_batch(block)
                index.append((name, len(index), *(block.column(c)[0].as_py() for c in _ORDER), block.num_rows))
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        yield _batch(index, kinds, [x.split()[0] for x in _INDEX.split(", ")])

    return C.materialize(captures.sortWithinPartitions(*_ORDER).mapInArrow(run, _INDEX), "index")


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so that a new head plays log2(k) matches."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.heads = [next(r, None) for r in runs]
        k = self.k = len(runs)
        self.losers = [-1] * k
        for leaf in range(k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        x, y = self.key(self.heads[a]), self.key(self.heads[b])
        return x < y or x == y and a < b

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


#: Captures of an interval, about.
INTERVAL_ROWS = 200_000


def merge(index: DataFrame, folder: str) -> DataFrame:
    """All captures of the indexed runs in the order of URL key, time and id: partitions are key intervals, in order. Only
    the intervals' first keys, one for each task, reach the driver."""
    spark = index.sparkSession
    n = index.agg(F.coalesce(F.sum("captures"), F.lit(0))).first()[0]
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // INTERVAL_ROWS)
    firsts = (index.select(*_ORDER).repartitionByRange(pieces, *_ORDER).groupBy(F.spark_partition_id().alias("p"))
              .agg(F.min(F.struct(*_ORDER)).alias("x")).select("x.*").collect())
    cuts = sorted(_order((r.page_id, r.url_key, r.captured_at)) for r in firsts)
    # A block may reach to the first key of the next one of its run.
    after = Window.partitionBy("run_file").orderBy("block")
    spans = index.select("run_file", "block", *_ORDER, *[F.lead(c).over(after).alias(f"next_{c}") for c in _ORDER],
                         F.lead("block").over(after).alias("next"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, block, url, at, page, url2, at2, page2, more in zip(*(c.to_pylist() for c in b.columns)):
                low = max(0, bisect.bisect_right(cuts, _order((page, url, at))) - 1)
                high = len(cuts) - 1 if more is None else max(0, bisect.bisect_right(cuts, _order((page2, url2, at2))) - 1)
                rows += [(i, path, block) for i in range(low, high + 1)]
            if rows:
                yield _batch(rows, [pa.int64(), pa.string(), pa.int32()], ["interval", "run_file", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for t in C.sorted_groups(batches, 1):
            i = t.column("interval")[0].as_py()
            low, high = cuts[i] if i else None, cuts[i + 1] if i + 1 < len(cuts) else None

            def stream(path: str, blocks: list[int]) -> Iterator[tuple]:
                with fs.open_input_file(path) as file:
                    reader = pa.ipc.open_file(file)
                    for block in blocks:
                        for r in zip(*(c.to_pylist() for c in reader.get_batch(block).columns)):
                            key = _order(r)
                            if high is not None and key >= high:
                                return
                            if low is None or key >= low:
                                yield r

            of: dict[str, list[int]] = {}
            for path, block in zip(t.column("run_file").to_pylist(), t.column("block").to_pylist()):
                of.setdefault(path, []).append(block)
            yield from _batches(LoserTree([stream(p, x) for p, x in of.items()], _order))

    found = spans.mapInArrow(locate, "interval long, run_file string, block int")
    return (found.repartitionByRange(max(1, len(cuts)), "interval").sortWithinPartitions("interval", "run_file", "block")
            .mapInArrow(run, _CAPTURE))


def histories(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of the pages under folder, read back and merged into capture histories."""
    return merge(runs(read(write(pages, folder), folder), f"{folder}/runs"), f"{folder}/runs")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return histories(pages, C.new_path(spark, "warc")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS sha, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(sha, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31) + 1)::BIGINT, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', ''), '.')), ',')
         || ')' || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END
         || regexp_extract(url, '^[^#?]*(\?[^#]+)', 1) AS url_key,
       strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM d
"""

QUERIES = {"op2_warc": op2_warc}
SQL = {"op2_warc": OP2_SQL}
