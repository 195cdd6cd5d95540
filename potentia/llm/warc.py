"""Deterministic sharded WARC archives: write, commit, read back.

Records are range-sorted by page. The shard bounds are page ids whose hash falls in a class, merged
until a shard holds its share of bytes, so the same table gives the same shards however it is
partitioned, and each shard gives the same files. A task sorts its shard and streams it: one
gzip member a record, headers and digests made anew from the payload, a new file whenever the
compressed size of the current one passes ``roll_bytes``.

Commit: a task writes files under temporary names that carry its attempt's token and returns
their manifest rows; Spark's own commit of the staged manifest keeps one attempt of each task. Only
files in the manifest are renamed (again by tasks; renaming twice is harmless), then the final manifest
is written, and what other attempts left goes. Readers open only files that the manifest
lists, so an unfinished or failed write is never seen, and they check sizes and digests.

Of records with equal payloads (SHA-256) of at least ``least`` bytes, those with the largest page id
are responses and the others revisit them: their records have no payload. The mark that a record
is a revisit travels to its shard as a small row that sorts in front of it, so payloads are
shuffled once and a group of equal payloads never meets in one task.

Defined results: a null html is an empty payload; rows repeated as a whole and other rows of one page id
are records of their own; equal payloads without any page id are all responses, with some page ids
the rows without refer to the largest; a null url is written as the record's own urn, control and
non-ASCII characters of urls as percent escapes; payloads of any length are written
whole, one in memory at a time; an empty table gives archives without records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potentia.llm.textio import stage
from potentia.session import checkpoint_dir

_TEMPORARY = "_temporary"
_MANIFEST = "shard int, seq int, temporary string, name string, records long, bytes long, sha256 string"
_RECORD = ("file string, offset long, record_type string, record_id string, target_uri string, page_id long, refers_to long, "
           "payload_bytes long, payload_digest string")
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archives:
    folder: str
    manifest: DataFrame  # shard, seq, name, records, bytes, sha256


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a folder as Spark names it."""
    url = urlparse(uri)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, date: str, block: bytes, content: str, extra: list[tuple[str, str]]) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *extra,
              ("WARC-Block-Digest", _digest(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, nth: int, url: str | None, payload: bytes, target: int | None, date: str) -> bytes:
    """The response record of a page, or its revisit of the page ``target``."""
    sha1 = hashlib.sha1(payload).hexdigest()
    name = f"urn:page:{'' if page_id is None else page_id}:{sha1}:{nth}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    extra = [("WARC-Target-URI", quote(url, safe=_PRINTABLE) if url else name), ("WARC-Payload-Digest", _digest(payload))]
    if target is None:
        return record("response", name, date, http + payload, "application/http; msgtype=response", extra)
    extra += [("WARC-Refers-To", f"<urn:page:{target}:{sha1}:0>"), ("WARC-Profile", _PROFILE)]
    return record("revisit", name, date, http, "application/http; msgtype=response", extra)


class _Roll:
    """Files of one shard under temporary names."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, date: str):
        self.fs, self.path = opened(folder)
        self.token, self.shard, self.roll, self.date = uuid.uuid4().hex, shard, roll_bytes, date
        self.seq, self.file, self.done = 0, None, []

    def add(self, member: bytes) -> None:
        if self.file is None:
            self.name = f"pages-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{_TEMPORARY}/{self.token}-{self.name}"
            self.file = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            self._write(record("warcinfo", f"urn:file:{self.name}", self.date, b"format: WARC file version 1.1\r\n",
                               "application/warc-fields", [("WARC-Filename", self.name)]))
        self._write(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.shard, self.seq, self.temporary, self.name, self.records, self.size, self.sha.hexdigest()))
            self.file, self.seq = None, self.seq + 1


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _manifest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, ["shard", "seq", "temporary", "name", "records", "bytes", "sha256"],
                 [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()])


def shard_bounds(keys: DataFrame, shard_bytes: int, max_shards: int) -> tuple[np.ndarray, int]:
    """(first place of each shard but the first, bytes a shard should hold) from ``keys(place, bytes)``.

    Candidates are places whose hash falls in one class of many, about eight a shard; neighbouring
    intervals are merged until they hold a shard's bytes. At most 8 x ``max_shards`` numbers and sums
    reach the driver, and they depend on the table alone."""
    whole = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    shards = min(max_shards, max(1, -(-whole["b"] // shard_bytes)))
    share = max(shard_bytes, -(-whole["b"] // shards))
    if shards == 1:
        return np.zeros(0, np.int64), share
    some = F.pmod(F.xxhash64(F.lit("shard"), "place"), F.lit(max(1, whole["n"] // (8 * shards)))) == 0
    cuts = np.sort(np.array([r[0] for r in keys.where(some).select("place").distinct().collect()], np.int64))

    def sums(batches):
        total = np.zeros(len(cuts) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(cuts, b.column("place").to_numpy(), "right")
            np.add.at(total, at, b.column("bytes").to_numpy())
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["at", "bytes"])

    held = np.zeros(len(cuts) + 1, np.int64)
    for r in keys.select("place", "bytes").mapInArrow(sums, "at long, bytes long").groupBy("at").agg(F.sum("bytes").alias("b")).collect():
        held[r["at"]] = r["b"]
    bounds, now = [], 0
    for k, b in enumerate(held.tolist()):
        if k and now and now + b > share:
            bounds.append(cuts[k - 1])
            now = 0
        now += b
    return np.array(bounds, np.int64), share


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 1000, shard_bytes: int = 32 << 20,
                   max_shards: int = 1 << 16, roll_bytes: int | None = None, date: str = "2020-01-01T00:00:00Z") -> Archives:
    """Write ``pages(page_id, url, html)`` as WARC files under ``folder`` (default: a new one in the
    checkpoint folder). ``roll_bytes`` defaults to an eighth of a shard's bytes."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"),
                     F.unhex(F.sha2(payload.cast("binary"), 256)).alias("same"))
    # pages without an id are spread over the order by their payload's hash
    p = p.withColumn("place", F.coalesce("page_id", F.xxhash64("same")))
    keys = stage(p.select("place", "page_id", "same", F.octet_length("html").cast("long").alias("bytes")), "warc-keys")
    bounds, share = shard_bounds(keys, shard_bytes, max_shards)
    roll = roll_bytes or share // 8

    long_ones = keys.where(F.col("bytes") >= least)
    target = long_ones.groupBy("same").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND target IS NOT NULL")
    marks = (long_ones.join(target, "same").where("page_id IS NULL OR page_id < target")
             .select("place", "page_id", "same", "target").distinct())

    @F.pandas_udf("int")
    def shard_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), "right").astype(np.int32))

    rows = p.withColumn("target", F.lit(None).cast("long")).withColumn("mark", F.lit(1)).unionByName(
        marks.withColumn("url", F.lit(None).cast("string")).withColumn("html", F.lit(None).cast("string")).withColumn("mark", F.lit(0)))
    order = ["place", F.col("page_id").asc_nulls_first(), "same", "mark", F.col("url").asc_nulls_first()]
    rows = (rows.withColumn("shard", shard_of("place")).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(*order)
            .select("shard", "page_id", "url", "html", "same", "target", "mark"))

    def write(batches):
        files, now, aim, nth = None, None, None, 0
        for batch in batches:
            html = batch.column("html").cast(pa.large_binary())
            cols = [batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "same", "target", "mark")]
            for i, (shard, page, url, same, to, mark) in enumerate(zip(*cols)):
                if (page, same) != now:
                    now, aim, nth = (page, same), None, 0
                if not mark:
                    aim = to
                    continue
                if files is None:
                    files = _Roll(folder, shard, roll, date)
                files.add(page_record(page, nth, url, html[i].as_py(), aim, date))
                nth += 1
            if files is not None and files.done:
                yield _manifest_rows(files.done)
                files.done = []
        if files is not None:
            files.close()
            if files.done:
                yield _manifest_rows(files.done)

    system, path = opened(folder)
    system.create_dir(f"{path}/{_TEMPORARY}", recursive=True)
    written = stage(rows.mapInArrow(write, _MANIFEST), "warc-manifest")

    def commit(batches):
        system, path = opened(folder)
        for batch in batches:
            for old, new, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "name", "bytes"))):
                if system.get_file_info(f"{path}/{old}").type == fs.FileType.File:
                    system.move(f"{path}/{old}", f"{path}/{new}")
                elif system.get_file_info(f"{path}/{new}").size != size:
                    raise OSError(f"{new}: neither its temporary file nor the whole file is there")
            yield batch

    written.mapInArrow(commit, _MANIFEST).drop("temporary").write.parquet(f"{folder}/_manifest")
    system.delete_dir(f"{path}/{_TEMPORARY}")
    return Archives(folder, spark.read.parquet(f"{folder}/_manifest"))


def members(stream, chunk: int = 1 << 20):
    """(offset, whole decompressed member) of each gzip member of a stream, one in memory at a time."""
    offset, at, rest = 0, 0, b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            data = rest or stream.read(chunk)
            rest = b""
            if not data:
                if out:
                    raise ValueError(f"the member at {offset} ends early")
                return
            at += len(data)
            out.append(z.decompress(data))
        rest = z.unused_data
        at -= len(rest)
        yield offset, b"".join(out)
        offset = at


def parse(member: bytes) -> tuple[dict[str, str], memoryview]:
    """(fields, block) of a WARC record; a wrong length or digest is an error."""
    end = member.index(b"\r\n\r\n")
    lines = member[:end].decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = memoryview(member)[end + 4:end + 4 + size]
    if lines[0] != "WARC/1.1" or len(block) != size or member[end + 4 + size:] != b"\r\n\r\n" or _digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


def _page(name: str) -> int | None:
    number = name.strip("<>").split(":")[2]
    return int(number) if number else None


def _read(path_of, listed, with_payload: bool):
    names = [f.split()[0] for f in _RECORD.split(", ")] + (["payload"] if with_payload else [])
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    types += [pa.binary()] if with_payload else []
    system, path = path_of
    for name, size, want in listed:
        info = system.get_file_info(f"{path}/{name}")
        if info.size != size:
            raise OSError(f"{name}: {info.size} bytes, the manifest lists {size}")
        out, held, count = [], 0, 0
        with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
            for offset, member in members(stream):
                f, block = parse(member)
                kind = f["WARC-Type"]
                if kind == "warcinfo":
                    continue
                head = bytes(block[:4096]).index(b"\r\n\r\n") + 4
                body = None
                if kind == "response":
                    body = bytes(block[head:])
                    length, digest = len(body), hashlib.sha1(body).hexdigest()
                else:  # the payload is elsewhere; its length and digest were kept
                    http = dict(x.split(": ", 1) for x in bytes(block[:head - 4]).decode().split("\r\n")[1:])
                    length = int(http["Content-Length"])
                    digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                to = f.get("WARC-Refers-To")
                row = (name, offset, kind, f["WARC-Record-ID"].strip("<>"), f["WARC-Target-URI"], _page(f["WARC-Record-ID"]),
                       _page(to) if to else None, length, digest)
                out.append((*row, body) if with_payload else row)
                count += 1
                held += len(body or b"") if with_payload else 256
                if held > 8 << 20:
                    yield _rows(out, names, types)
                    out, held = [], 0
        if count != want:
            raise OSError(f"{name}: {count} records, the manifest lists {want}")
        if out:
            yield _rows(out, names, types)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a page record of the files in the folder's manifest: file, offset, record_type, record_id,
    target_uri, page_id, refers_to (a page id), payload_bytes and payload_digest of the full payload,
    and on request the payload (null for revisits)."""
    manifest = spark.read.parquet(f"{folder}/_manifest").select("shard", "seq", "name", "bytes", "records")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        place = opened(folder)
        for batch in batches:
            listed = list(zip(*(batch.column(c).to_pylist() for c in ("name", "bytes", "records"))))
            yield from _read(place, listed, with_payload)

    schema = _RECORD + (", payload binary" if with_payload else "")
    return manifest.repartition(tasks, "shard", "seq").mapInArrow(read, schema)
