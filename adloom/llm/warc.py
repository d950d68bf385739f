"""Web archives: written with an index first, read back by coalesced byte ranges.

``write_archive`` writes one gzip member per record into rolling files below a folder, and returns the index: file, offset,
length, URL and digest of each record. The index holds the rows of successful tasks only, so files that a lost executor or
a repeated attempt leaves behind are never read. ``read_records`` takes any selection of the index, sorts it by file and
offset, joins neighbouring records into ranges and reads each range once.

Records with equal payloads of at least ``min_bytes`` are written once as response, by the smallest page id; the others are
revisits without payload. Payload digests are SHA-256.

Defined results: a null html counts as empty; a null URL is written as an empty target; null page ids never are the response
of a group that has others, and a group of null ids has responses only; repeated rows of a response's page id are
responses too. Smaller payloads are always responses. An empty table gives an empty index. Texts of any length are
written one at a time. Other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import need
from adloom.session import shared_dir, staged

MIN_BYTES = 100
FILE_BYTES = 1 << 30
MAX_GAP = 1 << 16
MAX_RANGE = 1 << 23
DATE = "2024-01-01T00:00:00Z"
INDEX = ("file string, offset long, length long, url string, digest string, page_id long, payload_bytes long, "
         "record_type string, refers_to long")
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
          "payload binary")


def with_record_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, digest, payload_bytes, record_type, refers_to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = need(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"))
    large = F.col("payload_bytes") >= min_bytes
    first = (rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select(F.col("digest").alias("key"), "first"))
    # Small payloads have no partner; their own id keeps them from meeting in one task.
    keyed = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    found = keyed.join(first, "key", "left")
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return (found.withColumn("refers_to", refers)
            .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
            .select("page_id", "url", "html", "digest", "payload_bytes", "record_type", "refers_to"))


def _record_id(page_id, salt: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{salt}')}>"


def _record(row, salt: str) -> bytes:
    """One record as a gzip member."""
    url = "".join((row.url or "").split())
    page = None if pd.isna(row.page_id) else int(row.page_id)
    body = row.html.encode() if row.record_type == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: {_record_id(page, salt)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{row.digest}", f"X-Payload-Length: {row.payload_bytes}",
        f"X-Page-Id: {'' if page is None else page}", f"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    if row.record_type == "revisit":
        head.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(5, f"WARC-Refers-To: {_record_id(int(row.refers_to), '')}")
        head.insert(6, f"X-Refers-To-Page: {int(row.refers_to)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


def _writer(folder: str, file_bytes: int):
    def write(batches):
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        out, path, at, part = None, None, 0, 0
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{part:04d}.warc.gz"
                    out, at, part = store.open_output_stream(os.path.join(base, path), compression=None), 0, part + 1
                data = _record(row, "")
                out.write(data)
                rows.append((path, at, len(data), row.url, row.digest, row.page_id, row.payload_bytes, row.record_type, row.refers_to))
                at += len(data)
            out and out.flush()
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()
    return write


def write_archive(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archive files below ``folder`` and return the stored index."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    index = with_record_types(pages, min_bytes).mapInPandas(_writer(folder, file_bytes), INDEX)
    return staged(index, folder, "index")


def _parse(data: bytes):
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no archive record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body


def _reader(folder: str, max_gap: int, max_range: int):
    def ranges(batches):
        """Lists of neighbouring (file, offset, length), each of at most one range."""
        run, end = [], 0
        for batch in batches:
            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"]):
                if run and (file != run[0][0] or offset > end + max_gap or offset + length - run[0][1] > max_range):
                    yield run
                    run = []
                run.append((file, int(offset), int(length)))
                end = int(offset) + int(length)
        if run:
            yield run

    def read(batches):
        store, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for run in ranges(batches):
            if run[0][0] != name:
                if source is not None:
                    source.close()
                name, source = run[0][0], store.open_input_file(os.path.join(base, run[0][0]))
            start = run[0][1]
            data = source.read_at(run[-1][1] + run[-1][2] - start, start)
            rows = []
            for _, offset, length in run:
                fields, body = _parse(zlib.decompress(data[offset - start: offset - start + length], 31))
                number = lambda key: int(fields[key]) if fields.get(key) else None  # noqa: B023, E731
                rows.append((number("X-Page-Id"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Refers-To-Page"),
                             fields["WARC-Payload-Digest"].removeprefix("sha256:"), number("X-Payload-Length"), body))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()
    return read


def read_records(index: DataFrame, folder: str, max_gap: int = MAX_GAP, max_range: int = MAX_RANGE, task_bytes: int = 1 << 26) -> DataFrame:
    """The records that ``index`` selects: headers and payload (of revisits: empty payload, digest and length of the full one)."""
    places = need(index, "file", "offset", "length")
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    spread = (places.withColumn("block", F.floor(F.col("offset") / (4 * max_range)))
              .repartition(tasks, "file", "block").sortWithinPartitions("file", "offset"))
    return spread.select("file", "offset", "length").mapInPandas(_reader(folder, max_gap, max_range), RECORD)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write all pages, read every record back; one row per page from what was read."""
    folder = shared_dir(pages.sparkSession, "warc")
    records = read_records(write_archive(pages, folder), folder)
    full = F.col("record_type") == "response"
    digest = F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    size = F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    intact = ~full | ((F.sha2("payload", 256) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes")))
    checked = F.when(intact, digest).otherwise(F.raise_error(F.concat(F.lit("broken record of page "), F.col("page_id").cast("string"))))
    return records.select("page_id", size.alias("payload_bytes"), checked.cast("string").alias("payload_digest"), "record_type", "refers_to")
