"""WARC archives in Zstandard form: one frame per record behind a skippable frame that holds the dictionary.

The reader loads the dictionary, decodes frame by frame, and checks each record's version line, named fields,
lengths and digests.  It holds one record at a time.  The writer rolls archives over by size, writes each under
a name of its own attempt and renames it when complete, so that a retried task leaves no half-written archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import near_ids, scratch_path, stash

#: Fixed by the format: the magic number of the skippable frame with the dictionary, and that of a frame.
DICTIONARY_MAGIC, FRAME_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL, SAMPLES, DICTIONARY, READ = 16_000_000, 64, 16_384, 1 << 20
RECORD = "id string, type string, uri string, refers_to string, payload_digest string, payload_bytes long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A field's value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(name: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or with ``refers_to`` a revisit, whose block keeps the HTTP header only."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    )
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
    ]
    if uri is not None:
        fields.append(("WARC-Target-URI", _field(uri)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(block))
    ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(
        f"{k}: {v}\r\n" for k, v in fields
    ).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record in ``data``; ValueError names what is wrong with it."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line or no end of the named fields")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a named field: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdecimal() or len(rest) != int(
        fields["content-length"]
    ) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"Content-Length {fields['content-length']}, but {len(rest) - 4} bytes")
    block = rest[:-4]
    digest = lambda name: fields.get(name, "").rpartition(":")[2] or None
    if (d := digest("warc-block-digest")) and d != base32_sha1(block):
        raise ValueError("the block does not have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    whole, kind = len(payload), fields["warc-type"]
    if "msgtype=response" in fields.get("content-type", ""):
        said = [
            line.partition(":")[2].strip()
            for line in http.decode("latin-1").split("\r\n")
            if line.lower().startswith("content-length:")
        ]
        if kind == "revisit":
            whole = int(said[0]) if said and said[0].isdecimal() else None
        elif said and said[0].isdecimal() and int(said[0]) != len(payload):
            raise ValueError(f"the HTTP header says {said[0]} bytes, the payload has {len(payload)}")
    else:
        payload, whole = block, len(block)
    if (d := digest("warc-payload-digest")) and kind != "revisit" and d != base32_sha1(payload):
        raise ValueError("the payload does not have its digest")
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    return {
        "id": bare("warc-record-id"),
        "type": kind,
        "uri": fields.get("warc-target-uri"),
        "refers_to": bare("warc-refers-to"),
        "payload_digest": digest("warc-payload-digest"),
        "payload_bytes": whole,
        "payload": payload,
    }


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from a bounded number of records; their first bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(
            b"".join(s[:2048] for s in samples)[:DICTIONARY] or b"WARC/1.1\r\n",
            dict_type=zstandard.DICT_TYPE_RAWCONTENT,
        )


def write_archive(out: BinaryIO, records: list[bytes]) -> None:
    kept = train(records[:SAMPLES])
    frame = zstandard.ZstdCompressor(level=3).compress(kept.as_bytes())
    out.write(DICTIONARY_MAGIC + len(frame).to_bytes(4, "little") + frame)
    one = zstandard.ZstdCompressor(level=3, dict_data=kept, write_content_size=True)
    for record in records:
        out.write(one.compress(record))


def read_archive(source: BinaryIO) -> Iterator[bytes]:
    """The frames of an archive, one record each; memory is that of one record."""
    head = source.read(8)
    dctx = zstandard.ZstdDecompressor()
    data = b""
    if head[:4] == DICTIONARY_MAGIC:
        size = int.from_bytes(head[4:], "little")
        body = source.read(size)
        if len(body) != size:
            raise ValueError("the dictionary's frame is cut off")
        if body[:4] == FRAME_MAGIC:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
    else:
        data = head
    while data or (data := source.read(READ)):
        frame, parts = dctx.decompressobj(), []
        while not frame.eof:
            if not data and not (data := source.read(READ)):
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and the folder's path within it; Hadoop's names of stores are known too."""
    scheme, colon, rest = folder.partition(":")
    if not colon or len(scheme) < 2:
        raise ValueError(
            f"{folder} needs a scheme (like file: or s3a:), as machines without one look at their own disks"
        )
    try:
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)
    except (ValueError, NotImplementedError, OSError) as e:
        raise ValueError(f"archives cannot be kept in {folder}: {e}") from None


def _records(path: str, source: BinaryIO) -> Iterator[tuple[int, dict]]:
    """Size of the data and the record, one by one; an error names the archive and the record's number."""
    frames, n = read_archive(source), 0
    while True:
        try:
            data = next(frames, None)
            if data is None:
                return
            record = parse_record(data)
        except (ValueError, zstandard.ZstdError) as e:
            raise ValueError(f"{path}, record {n}: {e}") from None
        yield len(data), record
        n += 1


def write_warc(rows: DataFrame, folder: str, *, date: str = "2000-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Write rows (id, uri, payload, refers_to) as archives below ``folder``, a URI that all machines reach.

    Returns the archives: path, records, bytes (a stored table: archives are written once).  A null payload is
    empty; a null uri leaves its field out; without rows there are no archives.  A store that pyarrow cannot reach
    is refused at once.
    """
    _store(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{base}/{uuid.uuid4().hex}"
            with store.open_output_stream(f"{name}.part") as out:
                write_archive(out, held)
            store.move(f"{name}.part", f"{name}.warc.zst")
            return pa.record_batch([[f"{name}.warc.zst"], [len(held)], [size]], ["path", "records", "bytes"])

        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, uri, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(make_record(name, uri, (payload or "").encode("utf-8", "replace"), refers_to, date))
                size += len(held[-1])
                if size >= roll:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    made = rows.select(
        "id", "uri", F.col("payload").cast("string"), "refers_to"
    ).mapInArrow(run, "path string, records long, bytes long")
    return stash(made, "archives")


def read_warc(spark: SparkSession, archives: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of the archives in column ``path`` (within the store of ``folder``); a malformed one stops the read.

    Columns: id, type, uri, refers_to, payload_digest, payload_bytes and, if asked for, payload (binary; empty
    for a revisit, whose payload_bytes is that of the full payload).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * payloads
        kinds = [pa.string()] * 5 + [pa.int64()] + [pa.binary()] * payloads
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for length, record in _records(path, source):
                        held.append(record)
                        size += length if payloads else 300
                        if size > 4_000_000:
                            yield pa.record_batch(
                                [pa.array([r[c] for r in held], k) for c, k in zip(names, kinds, strict=True)], names
                            )
                            held, size = [], 0
                if held:
                    yield pa.record_batch(
                        [pa.array([r[c] for r in held], k) for c, k in zip(names, kinds, strict=True)], names
                    )

    n = max(1, min(archives.count(), spark.sparkContext.defaultParallelism * 16))
    return archives.select("path").repartition(n).mapInArrow(run, RECORD + ", payload binary" * payloads)


def with_responses(
    pages: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """id, uri, payload and refers_to (record names) for every row; the largest id of equal payloads is the response.

    Payloads of fewer than ``min_bytes`` bytes are all responses.  Null payloads are empty; very long ones stay whole.
    Rows with a null id are responses if all of their payload's ids are null; rows that share the largest id are all
    responses; other columns are dropped.  Only digests are shuffled to find equal payloads; payloads stay where they
    are unless more than ``BROADCAST_IDS`` of them repeat.
    """
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    rows = pages.select(
        F.col(id_col).alias("_id"),
        F.col(url_col).alias("uri"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumn("_key", F.sha2("payload", 256))
    groups = rows.select("_id", "_key").groupBy("_key").agg(F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_n"))
    groups = near_ids(stash(groups.filter("_n > 1 and _best is not null").drop("_n"), "repeated-payloads"))
    again = F.col("_best").isNotNull() & ~F.col("_best").eqNullSafe(F.col("_id")) & (
        F.octet_length("payload") >= min_bytes
    )
    joined = rows.join(groups, "_key", "left")
    return joined.select(name("_id").alias("id"), "uri", "payload", F.when(again, name("_best")).alias("refers_to"))


def page_id(name: str | Column) -> Column:
    return F.expr(f"try_cast(substring_index({name}, ':', -1) as bigint)")


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read the records back, without payloads."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    return read_warc(spark, write_warc(with_responses(pages, **names), folder), folder, payloads=False)
