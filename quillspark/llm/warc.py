"""WARC archives with a merged capture index.

Tasks write gzipped WARC records and, for each archive, a locally sorted run of
index entries.  The runs are then merged: the key space is cut into ranges, and
within each range a loser tree merges the runs' cursors, which read one small
piece of a run at a time, by URL key, timestamp and page.  The merged index is
the capture history in global order; records are read back through it, each at
its offset.

Records with equal payloads of at least ``REVISIT_BYTES`` bytes: the smallest
page_id is the response, the others revisit it and carry no payload.

Defined results: null html is an empty payload; a null url has the empty key;
rows without a page_id have no record; rows that share a page_id have a record
each; an empty table has no archives; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_table, map_batches, open_input, open_output, shared_folder, table

REVISIT_BYTES = 100
#: Index entries in a piece of a run, the unit that a merge reads.
PIECE = 512
#: Bytes of archive after which a new one is begun.
ARCHIVE_BYTES = 1 << 30
#: Entries, about, in a range of the merge.
RANGE_ENTRIES = 4_000
#: Runs that a merge takes at once; more are merged into longer runs first.
MERGED_RUNS = 64
_START = datetime(2024, 1, 1, tzinfo=timezone.utc)
_ENTRY = pa.schema([("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def url_key(url: str | None) -> str:
    """Sort-friendly key: host reversed, then path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower().removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


def capture_time(page_id: int) -> str:
    """The table has no clock: captures follow each other second by second in order of page_id."""
    return (_START + timedelta(seconds=page_id % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{page_id}:{digest}')}>"


def warc_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    kind = "response" if refers_to is None else "revisit"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id(page_id, digest)}\r\nWARC-Date: {capture_time(page_id)}\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha256:{digest}\r\nX-Page-Id: {page_id}\r\nX-Payload-Length: {len(payload)}\r\n"
    if refers_to is not None:
        head += f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {record_id(refers_to, digest)}\r\nX-Refers-To-Page: {refers_to}\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class LoserTree:
    """Merges k sorted iterators; each step replays one path of log2(k) games."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.k = max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [-1] * self.k
        self.winner = 0
        for i in range(self.k):
            self._seat(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _seat(self, i: int) -> None:
        """Enters source i: it stops at the first empty node, or replays games up to the root."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.sources[i], None)
            node = (i + self.k) // 2
            while node > 0:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


_KEY = "struct<urlkey:string,timestamp:string,page_id:bigint>"
_PIECES = f"path string, run string, start long, size long, n long, first {_KEY}, last {_KEY}"
_PIECE_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.struct([("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64())])] * 2]


def write_run(run: str, name: str, entries: Iterator[tuple]) -> pa.RecordBatch:
    """A sorted run in pieces; one row of _PIECES for each."""
    pieces, start, part = [], 0, []

    def named(entry: tuple) -> dict:
        return {"urlkey": entry[0], "timestamp": entry[1], "page_id": entry[2]}

    with open_output(run) as index:
        while part := list(islice(entries, PIECE)):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, _ENTRY) as out:
                out.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY))
            index.write(sink.getvalue())
            pieces.append((name, run, start, sink.tell(), len(part), named(part[0]), named(part[-1])))
            start += sink.tell()
    columns = list(zip(*pieces, strict=True)) or [()] * len(_PIECE_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], ["path", "run", "start", "size", "n", "first", "last"])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives and sorted index runs in ``folder``; returns the kept list of the runs' pieces."""
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # narrow rows meet on the digest, whole pages only on their own id: equal or empty pages are no hot key for texts
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")).where("first_page < last_page").drop("last_page")
    revisits = large.join(firsts, "digest").where("page_id <> first_page").groupBy("page_id", "digest").agg(F.min("first_page").alias("refers_to"))
    typed = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, offset, entries = "", None, 0, []

        def close() -> pa.RecordBatch:
            stream.close()
            entries.sort()
            return write_run(f"{name}.cdx", name, iter(entries))

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if stream is None:
                    # a name of its own for each attempt; the list names those of attempts that ended well
                    name, offset, entries = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, []
                    stream = open_output(name)
                member = warc_record(page_id, url, html.encode(), digest, refers_to)
                stream.write(member)
                entries.append((url_key(url), capture_time(page_id), page_id, name, offset, len(member)))
                offset += len(member)
                if offset >= ARCHIVE_BYTES:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    return keep_table(map_batches(typed, written, _PIECES))


def _cursor(pieces: list[tuple[str, int, int]], low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """A run's entries with low <= (key, timestamp, page_id) < high, one piece in memory at a time."""
    for run, start, size in pieces:
        with open_input(run) as stream:
            stream.seek(start)
            part = pa.ipc.open_stream(stream.read(size)).read_all()
        for entry in zip(*[c.to_pylist() for c in part.columns], strict=True):
            if (low is None or entry[:3] >= low) and (high is None or entry[:3] < high):
                yield entry


def fewer_runs(pieces: DataFrame, folder: str, most: int = MERGED_RUNS) -> DataFrame:
    """The pieces of at most about ``most`` runs: groups of runs are merged into longer ones, in as many passes as it takes."""
    runs = pieces.select("run").distinct().count()
    while runs > most:
        groups = -(-2 * runs // most)  # half of ``most`` in each, about

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, mine = None, {}

            def flow() -> pa.RecordBatch:
                run = f"{folder}/{uuid.uuid4().hex}.cdx"
                return write_run(run, run, iter(LoserTree([_cursor(p) for _, p in sorted(mine.items())])))

            for batch in batches:
                for group, run, start, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if now is not None and group != now:
                        yield flow()
                        mine = {}
                    now = group
                    mine.setdefault(run, []).append((run, start, size))
            if now is not None:
                yield flow()

        dealt = pieces.select(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group"), "run", "start", "size").repartition(groups, "group").sortWithinPartitions("group", "run", "start")
        pieces = keep_table(map_batches(dealt, merged, _PIECES))
        fewer = pieces.select("run").distinct().count()
        if fewer >= runs:
            break
        runs = fewer
    return pieces


def merged_index(pieces: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """part, place and the entries of all runs: in global order of (part, place).

    Ranges are cut by url key, timestamp and page_id, so that one url with very many captures is many ranges; each is
    wide enough that a range reads few pieces in vain from each run.
    """
    whole = pieces.agg(F.sum("n").alias("n"), F.countDistinct("run").alias("runs")).first()
    ranges = max(1, min(10_000, -(-(whole["n"] or 0) // max(range_entries, 4 * PIECE * whole["runs"]))))
    # cuts between ranges: they balance tasks and change no result, so a bounded sample of pieces serves
    keys = sorted(tuple(r[0]) for r in pieces.select("first").orderBy(F.xxhash64("run", "start")).limit(20_000).collect())
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [(part, r["run"], r["start"], r["size"]) for r in rows for part in range(bisect.bisect_right(cuts, tuple(r["first"].values())), bisect.bisect_right(cuts, tuple(r["last"].values())) + 1)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([o[0] for o in out], pa.int64()), "run": pa.array([o[1] for o in out], pa.string()), "start": pa.array([o[2] for o in out], pa.int64()), "size": pa.array([o[3] for o in out], pa.int64())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, {}

        def flow() -> Iterator[pa.RecordBatch]:
            low, high = (cuts[now - 1] if now else None), (cuts[now] if now < len(cuts) else None)
            rows = []
            for place, entry in enumerate(LoserTree([_cursor(p, low, high) for _, p in sorted(runs.items())])):
                rows.append((now, place, *entry))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["part", "place", *_ENTRY.names])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["part", "place", *_ENTRY.names])

        for batch in batches:
            for part, run, start, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is not None and part != now:
                    yield from flow()
                    runs = {}
                now = part
                runs.setdefault(run, []).append((run, start, size))
        if now is not None:
            yield from flow()

    spread = map_batches(pieces.select("run", "start", "size", "first", "last"), dealt, "part long, run string, start long, size long")
    sorted_pieces = spread.repartition(max(1, len(cuts) + 1), "part").sortWithinPartitions("part", "run", "start")
    return map_batches(sorted_pieces, merge, "part long, place long, urlkey string, timestamp string, page_id long, path string, offset long, length long")


def read_archives(index: DataFrame) -> DataFrame:
    """part, place, urlkey, timestamp and what each record itself says: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "part long, place long, urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found, path_open, stream = [None] * len(rows), None, None
            for i in sorted(range(len(rows)), key=lambda i: (rows[i]["path"], rows[i]["offset"])):
                if rows[i]["path"] != path_open:
                    stream, path_open = open_input(rows[i]["path"]), rows[i]["path"]
                stream.seek(rows[i]["offset"])
                headers, payload = parse_record(stream.read(rows[i]["length"]))
                kind, digest, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                if kind == "response":
                    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                refers_to = headers.get("X-Refers-To-Page")
                found[i] = (rows[i]["part"], rows[i]["place"], rows[i]["urlkey"], rows[i]["timestamp"], int(headers["X-Page-Id"]), size, digest, kind, int(refers_to) if refers_to else None)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(types)], ["part", "place", "urlkey", "timestamp", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return map_batches(index, read, schema)


def capture_history(pages: DataFrame) -> DataFrame:
    """Writes archives of all of ``pages`` and reads them back through the merged index."""
    folder = shared_folder(pages.sparkSession)
    return read_archives(merged_index(fewer_runs(write_archives(pages, folder), folder)))


def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_history(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "part", "place")


