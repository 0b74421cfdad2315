"""Writing pages as WARC archives, and reading them back.

A narrow pass notes each payload's digest and size. From it come the originals (of equal payloads, the one
with the largest page id) and the shard bounds: ids at equal steps in a sample that hashes choose, so the same
pages always give the same shards. Pages travel once, to their shard, together with the notes about them, and
are sorted there by id. Each task writes its shard as a sequence of files of gzip members, one per record, and
starts a new file before the current one exceeds ``roll_bytes``. Headers and digests are computed anew from
the payload; record ids and dates follow from the page, so that a repeated task writes the same bytes.

A file is written under a temporary name of the task's own and renamed when complete; the manifest, a parquet
table with a row per file, is written last and by Spark's committer. Only files that it lists count, so a lost
executor or a second attempt leaves nothing that a reader would see.

Null html is an empty payload. Payloads smaller than ``min_bytes`` are never revisits. Of rows that repeat an id and a
payload, the first is the response and the others revisit it. Rows with a null id are written in the first
shard; they can be revisits but not originals, unless no page with an id has their payload. A null url is
written as an empty target.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordercast.llm.common import new_path, prepare, stage

#: Fixed value of the WARC format for revisits of equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, records long, bytes long, sha1 string, first_page long, last_page long"


def digest(data: bytes) -> str:
    """Base32 SHA-1, as in WARC headers."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{copy}')}>"


def _one_line(text) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text) if isinstance(text, str) else ""


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A record as one gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", mtime=0)


def page_record(page_id, url, payload: bytes, full: int, payload_digest: str, refers_to, copy: int, date: str) -> bytes:
    """The record of a page: a response, or a revisit of the page ``refers_to`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    block = http + payload
    revisit = refers_to is not None
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, copy),
        "WARC-Date": date,
        "WARC-Target-URI": _one_line(url),
        "X-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": str(refers_to)}
    return record(headers, block)


class _Roll:
    """The files of one shard."""

    def __init__(self, root: str, shard: int, roll_bytes: int, date: str):
        self._files, self._root = fs.FileSystem.from_uri(root)
        self._shard, self._limit, self._date = shard, roll_bytes, date
        self._number = 0
        self._out = None
        attempt = TaskContext.get().taskAttemptId()
        self._temporary = f"{self._root}/_temporary/{shard:06d}-{attempt}"

    def _open(self) -> None:
        self._name = f"pages-{self._shard:06d}-{self._number:05d}.warc.gz"
        self._number += 1
        self._files.create_dir(f"{self._root}/_temporary", recursive=True)
        self._out = self._files.open_output_stream(self._temporary, compression=None)
        self._size, self._records, self._pages, self._sum = 0, 0, [], hashlib.sha1()
        about = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(self._name), "WARC-Date": self._date}
        about |= {"WARC-Filename": self._name, "Content-Type": "application/warc-fields"}
        self._put(record(about, b"format: WARC File Format 1.1\r\n"))

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self._sum.update(data)
        self._size += len(data)

    def add(self, page_id, data: bytes) -> Iterator[tuple]:
        """Write a record; gives the manifest row of a file that is complete."""
        if self._out is not None and self._records and self._size + len(data) > self._limit:
            yield self.close()
        if self._out is None:
            self._open()
        self._put(data)
        self._records += 1
        if page_id is not None:
            self._pages.append(page_id) if len(self._pages) < 2 else self._pages.__setitem__(1, page_id)

    def close(self) -> tuple | None:
        if self._out is None:
            return None
        self._out.close()
        self._out = None
        final = f"{self._root}/{self._name}"
        if self._files.get_file_info(final).type != fs.FileType.NotFound:
            self._files.delete_file(final)  # of an earlier attempt, the same bytes
        self._files.move(self._temporary, final)
        first, last = (self._pages[0], self._pages[-1]) if self._pages else (None, None)
        return self._name, self._shard, self._records, self._size, self._sum.hexdigest(), first, last


def _notes(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha1, n_bytes, original): what a narrow pass finds out about each page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    found = stage(pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n_bytes")), "digests")
    originals = found.where(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("original"))
    return found.join(originals, "sha1", "left").select("page_id", "sha1", "n_bytes", "original")


def _bounds(notes: DataFrame, shard_bytes: int, per_shard: int = 200) -> list[int]:
    """Ids at which shards begin: equal steps in a sample, chosen by hash, of a fixed number per shard."""
    total = notes.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    ids = notes.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id")
    sample = sorted(r[0] for r in ids.limit(per_shard * shards).collect()) if shards > 1 else []
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []


def write(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    shard_bytes: int = 64 << 20,
    roll_bytes: int = 32 << 20,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``path``, a folder all executors reach; gives the manifest."""
    spark = pages.sparkSession
    prepare(spark)
    notes = stage(_notes(pages, min_bytes), "notes")
    bounds = _bounds(notes, shard_bytes)
    id_type = dict(pages.dtypes)["page_id"]
    none = lambda kind: F.lit(None).cast(kind)
    # Notes and pages of one id meet in its shard, the notes first. So pages are shuffled once.
    told = notes.select("page_id", F.lit(0).alias("kind"), F.col("sha1").alias("url"), none("string").alias("html"), "original")
    wide = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", none(id_type).alias("original"))

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: 0 if pd.isna(i) else bisect_right(bounds, i)).astype("int32")

    rows = told.unionAll(wide).withColumn("shard", shard_of("page_id") if bounds else F.lit(0))
    dealt = rows.repartitionById(len(bounds) + 1, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "url", "html")

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, shard, current, originals, copies = None, None, object(), {}, {}
        for batch in batches:
            done = []
            for s, page_id, kind, url, html, original in zip(*(batch[c].tolist() for c in names)):
                page_id = None if page_id is None else int(page_id)
                if s != shard:
                    if roll is not None:
                        done.append(roll.close())
                    roll, shard = _Roll(path, int(s), roll_bytes, date), s
                if page_id != current:
                    current, originals, copies = page_id, {}, {}
                if not kind:
                    originals[url] = None if original is None else int(original)
                    continue
                payload = html.encode("utf-8", "replace") if isinstance(html, str) else b""
                sha1 = hashlib.sha1(payload)
                refers_to = None
                if len(payload) >= min_bytes:
                    refers_to = originals[sha1.hexdigest()]
                    if refers_to == page_id and not copies.get(sha1.hexdigest()):
                        refers_to = None
                n = sum(copies.values())
                copies[sha1.hexdigest()] = copies.get(sha1.hexdigest(), 0) + 1
                named = base64.b32encode(sha1.digest()).decode()
                kept = payload if refers_to is None else b""
                done += roll.add(page_id, page_record(page_id, url, kept, len(payload), named, refers_to, n, date))
            yield pd.DataFrame([d for d in done if d], columns=columns)
        if roll is not None and (last := roll.close()):
            yield pd.DataFrame([last], columns=columns)

    names = ["shard", "page_id", "kind", "url", "html", "original"]
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    # Ids go as text: integers with nulls among them would arrive as rounded floats.
    exact = {c: F.col(c).cast("string") for c in ("page_id", "original")}
    ordered.withColumns(exact).select(names).mapInPandas(written, MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a file, read in bounded steps."""
    data, offset = b"", 0
    unzip, out, start = zlib.decompressobj(31), io.BytesIO(), 0
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                return
        size = len(data)
        out.write(unzip.decompress(data))
        data = unzip.unused_data
        offset += size - len(data)
        if unzip.eof:
            yield start, out.getvalue()
            unzip, out, start = zlib.decompressobj(31), io.BytesIO(), offset


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The page records of the files that the manifest lists. Block digests, and payload digests of
    responses, are compared with what is there; a difference fails the job."""
    prepare(spark)

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch["file"]:
                rows = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, content in _members(stream):
                        headers, block = parse(content)
                        if headers["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        full = int(http.decode().rpartition("Content-Length: ")[2])
                        stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = headers["WARC-Type"] == "response"
                        if f"sha1:{digest(block)}" != headers["WARC-Block-Digest"] or response and digest(payload) != stated:
                            raise ValueError(f"{name} at {offset}: the content doesn't have the stated digest")
                        page, refers_to = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                        rows.append(
                            (int(page) if page else None, headers["WARC-Target-URI"], full, stated, headers["WARC-Type"])
                            + (int(refers_to) if refers_to else None, name, offset)
                        )
                        if len(rows) >= 10_000:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    names = [c.split()[0] for c in READ.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.assign(**{c: pd.array([r[names.index(c)] for r in rows], dtype="Int64") for c in ("page_id", "refers_to")})

    # A task for each file: the manifest, a row per file, is numbered, and numbers are partitions.
    listed = manifest(spark, path).select("file")
    numbered = listed.withColumn("number", (F.row_number().over(Window.orderBy("file")) - 1).cast("int"))
    dealt = numbered.repartitionById(max(listed.count(), 1), F.col("number"))
    return dealt.select("file").mapInPandas(records, READ)


def round_trip(pages: DataFrame, min_bytes: int = 0, **sizes) -> DataFrame:
    """Write ``pages`` to a new folder of the session, and read the records back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes, **sizes)
    return read(pages.sparkSession, path)
