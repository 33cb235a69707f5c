"""WARC archives compressed with a dictionary: zstd frames, one for each record, after a skippable frame with the dictionary.

Every task writes its pages as archives of at most `archive_bytes` of payload. The dictionary of an archive is built from
its own first records (`sample_bytes` of them), for an archive of any size; it is written in front, in a skippable frame
of magic number 0x184D2A5D, so that each archive can be read alone. Of records with equal payloads of at least `min_bytes`, the one with the largest
id is the response and the others are revisits without the payload; they name the response's id and digest.

Archives go to a folder that all machines share, through Arrow's file systems, under names of their own; only those that
a finished task reports count, so a lost or repeated task leaves nothing that is read.

Defined cases: a null payload is an empty one; rows that share the largest id are responses all; a null id is never the
largest unless all are null (then all are responses); an empty table gives no archive; the digest is that of the payload.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Fixed values of the archive format: the magic number of the dictionary's frame, and of zstd frames.
DICTIONARY_FRAME = (0x184D2A5D).to_bytes(4, "little")
ZSTD_FRAME = (0xFD2FB528).to_bytes(4, "little")
ARCHIVES = "_archive string, _records long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def roles(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """The pages with `_payload`, `_digest`, `_type` and `_refers_to`. Copies are found by digest: one row for each digest and task is shuffled."""
    pages = pages.drop("_payload", "_digest", "_type", "_refers_to")
    payload = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_page"), F.col(id_col).alias("_id"), payload.alias("_payload"), F.sha1(payload).alias("_digest"))
    large = F.octet_length("_payload") >= min_bytes
    copies = rows.filter(large).groupBy(F.col("_digest").alias("_d")).agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    out = rows.join(copies, F.col("_digest") == F.col("_d"), "left")
    revisit = F.col("_last").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_last"))
    return out.select("_page.*", "_payload", "_digest", F.when(revisit, "revisit").otherwise("response").alias("_type"), F.when(revisit, F.col("_last")).alias("_refers_to"))


def head(kind: bytes, fields: list[tuple[str, object]], length: int) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % length]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def one_line(x):
    """Header values stand on one line."""
    return None if x is None else "".join(c if c >= " " else "%%%02X" % ord(c) for c in x)


def dictionary(records: list[bytes], sample_bytes: int, dict_bytes: int) -> bytes:
    """A dictionary made from the archive's own records: trained where there are samples enough, else their own bytes.

    A dictionary of `dict_bytes`, or of a quarter of a smaller sample. The trainer needs several samples much larger than
    the dictionary; where it finds too little in common, the heads of the records, which Zstandard takes as they are, do."""
    sample, size = [], 0
    for r in records:
        if size >= sample_bytes:
            break
        sample.append(r[: 128 << 10])  # training reads no further into a sample
        size += len(sample[-1])
    most = min(dict_bytes, max(size // 4, 256))
    try:
        return zstandard.train_dictionary(most, sample).as_bytes()
    except zstandard.ZstdError:
        share = max(most // max(len(sample), 1), 64)
        return b"".join(x[:share] for x in sample)[:most]


def archive(records: list[bytes], sample_bytes: int, dict_bytes: int, level: int) -> bytes:
    raw = dictionary(records, sample_bytes, dict_bytes)
    made = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    return DICTIONARY_FRAME + len(raw).to_bytes(4, "little") + raw + b"".join(map(made.compress, records))


def write(pages: DataFrame, folder: str, min_bytes: int = 1000, archive_bytes: int = 16 << 20, sample_bytes: int = 2 << 20, dict_bytes: int = 32 << 10, level: int = 3, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write the archives; returns what was written: (_archive, _records), already carried out and kept in a table."""
    rows = roles(pages, min_bytes, id_col, text_col).select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), "_payload", "_digest", "_type", "_refers_to")

    def record(i, url, payload, digest, kind, to):
        fields = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Target-URI", one_line(url)), ("X-Page-ID", i), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
        if kind == "revisit":
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", to)]
            payload = b""
        return head(kind.encode(), fields, len(payload)) + payload + b"\r\n\r\n"

    def written(it):
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        held, size = [], 0

        def put():
            name = f"{path}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(name, compression=None) as out:
                out.write(archive(held, sample_bytes, dict_bytes, level))
            return pa.record_batch({"_archive": [name], "_records": pa.array([len(held)], pa.int64())})

        for b in it:
            for row in zip(*(b.column(c) for c in ("_id", "_url", "_payload", "_digest", "_type", "_refers_to"))):
                held.append(record(*(x.as_py() for x in row)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield put()
                    held.clear()
                    size = 0
        if held:
            yield put()

    return stored(rows.mapInArrow(written, ARCHIVES), "archives")


def frames(fs, name: str):
    """The records of an archive, decompressed one by one."""
    with fs.open_input_stream(name, compression=None) as f:
        raw = f.read()
    if raw[:4] != DICTIONARY_FRAME:
        raise ValueError(f"{name} has no dictionary frame")
    n = int.from_bytes(raw[4:8], "little")
    own = zstandard.ZstdCompressionDict(raw[8 : 8 + n])
    rest = memoryview(raw)[8 + n :]
    while len(rest):
        if bytes(rest[:4]) != ZSTD_FRAME:
            raise ValueError(f"{name} has a broken frame")
        d = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
        out = d.decompress(rest)
        if not d.eof:
            raise ValueError(f"{name} ends within a record")
        rest = rest[len(rest) - len(d.unused_data) :]
        yield out


def parsed(raw: bytes) -> tuple:
    top, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    number = lambda k: int(fields[k]) if k in fields else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != number("X-Payload-Length")):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return number("X-Page-ID"), fields.get("WARC-Target-URI"), kind, number("X-Payload-Length"), digest, number("X-Refers-To-Page-ID"), body if kind == "response" else None


def read(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """All records of the archives, one task for a few archives each; payloads are checked against their digests."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def batch(rows):
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    def records(it):
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for b in it:
            for name in b.column("_archive").to_pylist():
                held, size = [], 0
                for raw in frames(fs, name):
                    held.append(parsed(raw))
                    size += len(raw)
                    if size >= 4 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number is not coalesced, small as the list of names is
    return archives.repartition(tasks, "_archive").mapInArrow(records, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, **more) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read(spark, write(pages, folder, **more), folder)
