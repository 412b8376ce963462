"""WARC archives with a globally ordered capture index made by an external merge.

Tasks write archives into the shared folder, a compressed member per record, and give their index as runs: entries
sorted by URL key, timestamp and page. Runs are dealt to key ranges, and each range is merged from its runs by
a loser tree, so the ranges one after the other are the capture history of every URL. Ranges are cut on the whole
sort key, so a URL that many captures share goes over several of them. Reading goes through the merged index:
each record is fetched at its offset and its payload hashed again.

Of captures with one payload the one of smallest page id is written as a response, the others as revisits that refer to
it. Digests that many pages share are looked up in a broadcast of bounded size, the others by a join.

A task that is repeated writes archives of its own; only those that the finished task names are in the index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.url_filter import host_of, lower_ascii
from wardloom.llm.work import saved, take
from wardloom.session import work_path

ROLL = 32 << 20  # bytes after which a new archive is begun
RUN_ROWS = 20_000  # entries of a sorted run
RANGE_ROWS = 50_000  # entries of a merged range, about
LEVEL = 3  # of compression
ENTRY = "url_key string, stamp string, page_id long, record_type string, file string, offset long, length long"


# --- records -----------------------------------------------------------------------------------------------


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, stamp, payload: bytes, digest: str, refers_to=None, refers_url=None, revisit=False) -> bytes:
    """One WARC record, not compressed. A revisit has the payload's length and digest in its headers, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {stamp}", f"WARC-Target-URI: {_header(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parsed(data: bytes) -> dict:
    """Headers of a record and, of a response, the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    answer = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"headers": headers, "size": int(answer["Content-Length"]), "payload": payload}


class Archives:
    """Archives of one task, rolled at a size."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
        self.fs.create_dir(self.root, recursive=True)
        self.out: BinaryIO | None = None
        self.name, self.at = "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        """Archive, offset and length of the record."""
        if self.out is None or self.at >= ROLL:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        begin = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, begin, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


# --- which record is the response --------------------------------------------------------------------------


def decided(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with ``first``: the smallest page id among those of the same payload, null where the payload is a response by itself."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumn("html", body).withColumn("sha", F.sha1(body))
    sizes = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    groups = saved(sizes.where("n > 1 AND first IS NOT NULL"), "payload-groups")
    share = groups.agg(F.sum("n")).head()[0] or 0
    # each hot digest has a hundredth of these rows or more: there are a hundred at most
    hot = groups.where(F.col("n") * 100 >= share).select(F.col("sha").alias("hot_sha"), F.col("first").alias("hot_first"))
    cold = groups.where(F.col("n") * 100 < share).select("sha", "first")
    rows = rows.join(F.broadcast(hot), rows["sha"] == hot["hot_sha"], "left").drop("hot_sha")
    # rows of hot digests need no match and are dealt by page
    key = F.when(F.col("hot_first").isNull(), F.col("sha")).otherwise(F.concat(F.lit("hot"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    cold = cold.withColumnRenamed("sha", "key").hint("shuffle_hash")
    rows = rows.withColumn("key", key).join(cold, "key", "left")
    return rows.select("page_id", "url", "html", "stamp", F.coalesce("hot_first", "first").alias("first"))


def url_key(url: Column) -> Column:
    """Host labels in reverse, then the rest: ``com,example)/path?query``."""
    host = host_of(url)
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)://[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), lower_ascii(rest))
    return F.when(host == "", F.coalesce(url, F.lit(""))).otherwise(key)


# --- writing -----------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes all pages (page_id, url, html, captured) and gives the runs of their index: ``run, place`` and an entry."""
    wanted = take(pages, page_id="long", url="string", html="string", captured="timestamp")
    stamp = F.date_format(F.coalesce("captured", F.lit("1970-01-01 00:00:00").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = decided(wanted.withColumn("stamp", stamp), least_bytes).withColumn("url_key", url_key(F.col("url")))
    names = ["run", "place", *[c.split()[0] for c in ENTRY.split(", ")]]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        archives, entries = Archives(folder), []

        def flush():
            entries.sort(key=sort_key)
            name = uuid.uuid4().hex
            columns = zip(*[(name, k, *e) for k, e in enumerate(entries)])
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "stamp", "url_key", "first")]
            for page_id, url, when, key, first, html in zip(*columns, batch.column("html")):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                revisit = first is not None and page_id != first
                data = packed(record(page_id, url, when, payload, digest32(payload), first, None, revisit))
                entries.append((key, when, page_id, "revisit" if revisit else "response", *archives.add(data)))
                if len(entries) >= RUN_ROWS:
                    yield flush()
                    entries = []
        archives.close()
        if entries:
            yield flush()

    return saved(rows.mapInArrow(run, f"run string, place int, {ENTRY}"), "runs")


# --- merging -----------------------------------------------------------------------------------------------


def sort_key(entry: tuple) -> tuple:
    key, stamp, page_id, _, file, offset, _ = entry
    return key.encode(), stamp, page_id is not None, page_id or 0, file, offset


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a new entry plays only its own path up."""

    def __init__(self, runs: list[list], key=sort_key) -> None:
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * len(runs)
        self.heads = [self._head(r) for r in range(len(runs))]
        self.losers = [-1] * self.k
        self.winner = -1
        for r in range(len(runs)):
            self._play(r)

    def _head(self, r: int):
        at = self.at[r]
        return self.key(self.runs[r][at]) if at < len(self.runs[r]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _play(self, r: int) -> None:
        node = (r + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its match
                self.losers[node] = r
                return
            if self._beats(other, r):
                self.losers[node], r = r, other
            node //= 2
        self.winner = r

    def __iter__(self):
        while self.runs and self.heads[self.winner] is not None:
            r = self.winner
            yield self.runs[r][self.at[r]]
            self.at[r] += 1
            self.heads[r] = self._head(r)
            self._play(r)


def merged(runs: DataFrame) -> DataFrame:
    """The entries in global order: by ``range_no`` and ``place`` in it."""
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, F.encode("url_key", "utf-8"), "stamp", "page_id", "file", "offset")
    fields = [c.split()[0] for c in ENTRY.split(", ")]
    schema = f"range_no int, place int, {ENTRY}"

    def run(batches):
        by_run: dict[str, list] = {}
        number = 0
        for batch in batches:
            number = batch.column("range_no")[0].as_py() if batch.num_rows else number
            columns = [batch.column(c).to_pylist() for c in ("run", "place", *fields)]
            for name, place, *entry in zip(*columns):
                by_run.setdefault(name, []).append((place, tuple(entry)))
        # rows of a run come in the order of the shuffle's blocks; their places put them right
        segments = [[e for _, e in sorted(rows, key=lambda r: r[0])] for _, rows in sorted(by_run.items())]
        done = list(LoserTree(segments))
        if done:
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            numbers = pa.array([number] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32())
            yield pa.record_batch([*numbers, *columns], ["range_no", "place", *fields])

    numbered = dealt.withColumn("range_no", F.spark_partition_id())
    return saved(numbered.mapInArrow(run, schema), "captures")


# --- reading -----------------------------------------------------------------------------------------------


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, stamp, payload_bytes, payload_digest, record_type, refers_to`` of every record in the index, from the archives.

    A response's payload is measured and hashed anew; a payload that is not the one its header names is an error.
    """
    schema = "page_id long, url string, stamp string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")]):
                if file != name:
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                source.seek(offset)
                found = parsed(zlib.decompress(source.read(length), 31))
                headers = found["headers"]
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and (digest32(found["payload"]), len(found["payload"])) != (digest, found["size"]):
                    raise ValueError(f"{file} is damaged at {offset}")
                page, first = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                rows.append(
                    (page and int(page), headers["WARC-Target-URI"], headers["WARC-Date"], found["size"], digest, headers["WARC-Type"], first and int(first))
                )
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    ordered = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)


def archived(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Archives all rows of ``pages`` (page_id, url, html, captured; others are ignored) and reads them back.

    Gives the capture index in global order (``range_no, place`` and an entry) and the records as read. ``captured`` may be
    absent or null: the epoch then. Archives lie in ``folder``, else below the shared folder.

    Null html is an empty payload, a null url an empty address. Payloads of fewer than ``least_bytes`` are always responses. Rows that
    repeat the smallest page id of a payload are responses each. A null page id refers to the smallest id of its
    payload, and is a response if there is none. An empty table gives empty results.
    """
    folder = folder or work_path(pages.sparkSession, "archives")
    index = merged(write_archives(pages, folder, least_bytes))
    return index, read_records(index, folder)


def epoch_plus(seconds: Column) -> Column:
    """A capture time for tables that have none: so many seconds after the start of 2024."""
    start = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())
    return F.timestamp_seconds(F.coalesce(seconds, F.lit(0)) + start)
