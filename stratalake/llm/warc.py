"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some WARC records, and a footer: a skippable
frame with the compressed and decompressed size of every frame (the seekable format's seek table).  The index
maps a record to (bundle, frame, offset and length in the frame), so one record is read by decompressing one
frame.  Records whose payload another record holds are written as revisits of it.

Tasks write bundles straight to the shared folder (any file system that pyarrow knows by its URI) under a name
of their own; only the names that successful tasks report enter the index, so a lost executor's leftovers are
never read.

Groups of equal payloads are settled on rows of ids, digests and lengths.  Payloads travel only if their group has other
rows and this one is its response, or if there are more such groups than ``broadcast_groups``; then pages meet the groups
in a shuffle in which a digest has ``_SALTS`` keys.

Records are WARC/1.1: a response's block is an HTTP message whose body is the payload, a revisit's block is empty and its
``WARC-Refers-To`` is the record id of the response.  Record ids hold page_id and row_key, the key of the index.  A null or empty url is
written as ``about:blank``; all other characters than those of URIs are percent-encoded.

Defined cases: null html is an empty payload; repeated rows and equal payloads
form one group whose largest page_id is the response (of rows that repeat that page_id, one); null page_id is
smaller than all others, so a group of null page_ids only has a response of null page_id and revisits whose refers_to is null; an
empty table gives no bundle and an empty index; payloads may be of any length that a string may have; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm._shared import shared_dir, small_batches, stored

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Fixed values of the seekable format: skippable frame magic, footer magic.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_SALTS = 32
INDEX = "page_id long, row_key long, bundle string, frame int, offset int, length int"
RECORD = "page_id long, row_key long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row_key: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row_key}>"


def page_and_key(uri: str) -> tuple[int | None, int]:
    """What ``record_id`` was made of."""
    page, _, key = uri.removeprefix("<urn:page:").removesuffix(">").partition(":")
    return int(page) if page else None, int(key)


def record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record; header fields that do not fit the standard are prefixed X-."""
    if row["revisit"]:
        block, kind = b"", [("WARC-Refers-To", record_id(row["refers_page"], row["refers_key"])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    else:
        payload = (row["html"] or "").encode()
        block, kind = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload, []
    fields = [
        ("WARC-Type", "revisit" if row["revisit"] else "response"),
        ("WARC-Record-ID", record_id(row["page_id"], row["row_key"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", urllib.parse.quote(row["url"] or "about:blank", safe="%:/?#[]@!$&'()*+,;=-._~")),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(row['digest']).decode()}"),
        ("X-Payload-Length", str(row["payload_bytes"])),
        *kind,
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; that of a revisit is empty here."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


class Bundle:
    """Writer of one bundle: records gather into frames, frames and their sizes into the file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        import zstandard

        self.path, self.out = path, fs.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.sizes: list[tuple[int, int]] = []
        self.buffer, self.written = bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        if self.buffer and len(self.buffer) + len(data) > FRAME_BYTES:
            self.flush()
        place = (len(self.sizes), len(self.buffer), len(data))
        self.buffer += data
        return place

    def flush(self) -> None:
        frame = self.zstd.compress(bytes(self.buffer))
        self.out.write(frame)
        self.sizes.append((len(frame), len(self.buffer)))
        self.written += len(frame)
        self.buffer = bytearray()

    def close(self) -> None:
        if self.buffer:
            self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the footer of an open bundle."""
    end = f.size()
    f.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE:
        raise ValueError("not a seekable bundle")
    f.seek(end - 9 - 8 * n)
    flat = struct.unpack(f"<{2 * n}I", f.read(8 * n))
    frames, at = [], 0
    for size, full in zip(flat[::2], flat[1::2], strict=True):
        frames.append((at, size, full))
        at += size
    return frames


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(uri: str, date: str):
    names = ("page_id", "row_key", "bundle", "frame", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(uri)
        bundle = None
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                if bundle is None:
                    fs.create_dir(folder, recursive=True)
                    bundle = Bundle(fs, f"{folder}/{uuid.uuid4().hex}.warc.zst")
                place = bundle.add(record(row, date))
                found.append((row["page_id"], row["row_key"], bundle.path.rpartition("/")[2], *place))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            columns = [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names)
        if bundle is not None:
            bundle.close()

    return run


def _is_best(best: Column) -> Column:
    return F.col("page_id").eqNullSafe(best["page_id"]) & (F.xxhash64("url") == best["url_key"])


def with_roles(pages: DataFrame, revisit_from: int = 0, broadcast_groups: int = 200_000) -> DataFrame:
    """The records of ``pages`` (page_id, url, html): with digest, payload_bytes, row_key, revisit, refers_page and refers_key.

    Revisits come without html.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    slim = stored(rows.drop("html").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS))), "payloads")
    # nulls come first in structs' order; of rows alike the least salt has the response
    best = F.max(F.struct("page_id", F.xxhash64("url").alias("url_key"), (-F.col("salt")).alias("salt")))
    groups = stored(slim.where(F.col("payload_bytes") >= revisit_from).groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "groups")
    if groups.count() <= broadcast_groups:
        met, joined = rows.join(F.broadcast(groups), "digest", "left"), slim.join(F.broadcast(groups), "digest")
    else:
        groups = groups.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        deal = F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int")
        met, joined = rows.withColumn("deal", deal).join(groups, ["digest", "deal"], "left"), slim.withColumn("deal", deal).join(groups, ["digest", "deal"])
    joined = joined.withColumn("twin", F.row_number().over(Window.partitionBy("digest", "page_id", "url", "salt").orderBy("payload_bytes")))
    first = _is_best(F.col("best")) & (-F.col("salt") == F.col("best")["salt"]) & (F.col("twin") == 1)
    revisits = joined.where(~first).select(
        "page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "payload_bytes", F.xxhash64("url", "digest", "salt", "twin").alias("row_key"),
        F.lit(True).alias("revisit"), F.col("best")["page_id"].alias("refers_page"), F.xxhash64("digest").alias("refers_key"),
    )
    own = ["page_id", "url", "html", "digest", "payload_bytes"]
    single = met.where("best IS NULL").select(*own, F.when(F.col("payload_bytes") < revisit_from, F.xxhash64("digest", F.monotonically_increasing_id())).otherwise(F.xxhash64("digest")).alias("row_key"))
    shared = met.where(F.col("best").isNotNull() & _is_best(F.col("best"))).select(*own).dropDuplicates(["digest"]).select(*own, F.xxhash64("digest").alias("row_key"))
    return single.unionByName(shared).withColumns({"revisit": F.lit(False), "refers_page": F.lit(None).cast("long"), "refers_key": F.lit(None).cast("long")}).unionByName(revisits)


def write_bundles(pages: DataFrame, uri: str, revisit_from: int = 0, broadcast_groups: int = 200_000, date: datetime | None = None) -> DataFrame:
    """Write ``pages`` as bundles under ``uri``/bundles and their index as Parquet under ``uri``/index; the index.

    ``date``: of all records; the time of the call if unset.
    """
    small_batches(pages.sparkSession)
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    with_roles(pages, revisit_from, broadcast_groups).mapInArrow(_write(f"{uri}/bundles", stamp), INDEX).write.parquet(f"{uri}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{uri}/index")


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, folder = _filesystem(uri)
        zstd = zstandard.ZstdDecompressor()
        name, f, frames, at, frame = None, None, [], -1, b""
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    name, at = row["bundle"], -1
                    f = fs.open_input_file(f"{folder}/{name}")
                    frames = seek_table(f)
                if row["frame"] != at:
                    at = row["frame"]
                    start, size, full = frames[at]
                    f.seek(start)
                    frame = zstd.decompress(f.read(size), max_output_size=full)
                fields, payload = parse(frame[row["offset"] : row["offset"] + row["length"]])
                page, key = page_and_key(fields["WARC-Record-ID"])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind, refers = fields["WARC-Type"], None
                if kind == "revisit":
                    refers, _ = page_and_key(fields["WARC-Refers-To"])
                elif payload_digest(payload) != digest:
                    raise ValueError(f"record {page} in {name} is damaged")
                out.append((page, key, int(fields["X-Payload-Length"]) if kind == "revisit" else len(payload), digest, kind, refers))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "row_key", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_records(index: DataFrame, uri: str) -> DataFrame:
    """The records that ``index`` names, each task reading its bundles frame by frame."""
    places = index.repartition("bundle", F.floor(F.col("frame") / 64)).sortWithinPartitions("bundle", "frame", "offset")
    return places.mapInArrow(_read(f"{uri}/bundles"), RECORD)


def op5_query(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back."""
    uri = shared_dir(pages.sparkSession, "warc")
    return read_records(write_bundles(pages, uri), uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
