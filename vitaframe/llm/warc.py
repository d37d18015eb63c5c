"""WARC archives whose records are compressed one by one with a shared dictionary.

Each file begins with a skippable frame that holds a Zstandard dictionary built
from the records of that file; then every record is a frame of its own, so that
any record can be read without the others. Of records with equal payloads of at
least ``min_revisit`` bytes the one with the smallest page id is a response, the
others are revisits that name it and carry no payload.

Null payloads are empty. Rows that repeat a page (same id and payload) are alike:
all of them are responses if it is the smallest id. Null ids come after all others
and are left out of the record's header. Extra columns play no part. An empty table
gives no archive and no rows. Files hold about ``file_bytes`` of payload, and a
payload that is longer is a file of its own.

The rows of a partition are sorted before they are written, so a task that runs
again writes the same files, under a temporary name first.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.common import fresh_path, read_table, stage

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
FILE_BYTES = 16 << 20
MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, url_col: str, min_revisit: int) -> DataFrame:
    """id, url, payload, digest and refers_to (null for responses)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    slim = stage(rows.filter(F.octet_length("payload") >= min_revisit).select("id", "digest"), "warc-digests")
    first = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = slim.join(first.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"))
    revisits = (
        revisits.filter(~F.col("id").eqNullSafe(F.col("first")))
        .select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("first").alias("refers_to"))
        .distinct()
    )
    on = rows["id"].eqNullSafe(revisits["r_id"]) & (rows["digest"] == revisits["r_digest"])
    return rows.join(revisits, on, "left").drop("r_id", "r_digest")


def _header(fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields)]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n"


def _record(page, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; the payload of a revisit is left out, its length is not."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"{page}:{digest}" if page is not None else uuid.uuid5(uuid.NAMESPACE_URL, digest)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>"), ("WARC-Profile", REVISIT_PROFILE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    fields += [
        ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def _info() -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", DATE),
        ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body))),
    ]
    return _header(fields) + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from evenly spaced records; where they are too few to train one, their bytes."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[k : k + 4096] for r in records[::step] for k in range(0, min(len(r), 1 << 16), 4096)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> bytes:
    records = [_info(), *records]
    dictionary = build_dictionary(records)
    raw = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)) + raw, *map(compressor.compress, records)])


def archive_records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed by itself."""
    at, dictionary = 0, None
    magic, size = struct.unpack_from("<II", content) if len(content) >= 8 else (0, 0)
    if magic == SKIPPABLE:
        dictionary, at = zstandard.ZstdCompressionDict(content[8 : 8 + size]), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(content)
    while at < len(content):
        frame = reader.decompressobj()
        parts, step = [], 1 << 16
        while not frame.eof:
            if at >= len(content):
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(view[at : at + step]))
            at += step
        at = min(at, len(content)) if not frame.unused_data else min(at, len(content)) - len(frame.unused_data)
        yield b"".join(parts)


def read_record(record: bytes) -> dict | None:
    """What a record says; None for records without a page."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    refers = None
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload does not match its digest")
    else:
        refers, payload = fields["WARC-Refers-To"][len("<urn:page:") :].split(":")[0], None
    return {
        "page_id": fields.get("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload": payload,
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers,
    }


def _file_system(folder: str):
    return fs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (fs.LocalFileSystem(), folder)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html",
    url_col: str = "url", min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes the archives; returns each file's name and number of records."""
    rows = mark_revisits(pages, id_col, payload_col, url_col, min_revisit)
    rows = rows.sortWithinPartitions("id", "digest", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, root = _file_system(folder)
        target.create_dir(root, recursive=True)
        part, made = TaskContext.get().partitionId(), []

        def flush(records: list[bytes]) -> None:
            name = f"{root}/{part:06d}-{len(made):05d}.warc.zst"
            spare = f"{root}/_{uuid.uuid4().hex}"
            with target.open_output_stream(spare) as out:
                out.write(archive_bytes(records))
            target.move(spare, name)
            made.append((name, len(records)))

        records, size = [], 0
        for batch in batches:
            for page, url, payload, digest, refers in batch.itertuples(index=False):
                page = None if pd.isna(page) else page
                refers = None if pd.isna(refers) else refers
                records.append(_record(page, url, payload, digest, refers))
                size += len(records[-1])
                if size >= file_bytes:
                    flush(records)
                    records, size = [], 0
        if records:
            flush(records)
        yield pd.DataFrame(made, columns=["file", "n_records"])

    as_text = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return stage(as_text.mapInPandas(run, "file string, n_records long"), "warc-files")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    columns = ["page_id", "url", *(["payload"] if with_payload else []), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = {"payload": "binary", "payload_bytes": "long"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for record in archive_records(content):
                    row = read_record(record)
                    if row is None:
                        continue
                    rows.append([row[c] for c in columns])
                    size += len(row["payload"] or b"") if with_payload else 0
                    if size > FILE_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns)

    return files.select("content").mapInPandas(run, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, reads the archives back."""
    pages = read_table(spark, sf_dir, "pages")
    folder = fresh_path(spark, "warc")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, folder, with_payload=False).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
