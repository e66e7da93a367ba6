"""WARC archives, records compressed one by one with a Zstandard dictionary.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, followed by one frame for each
record, each of which can be decompressed alone once the dictionary is known. The dictionary is trained on a sample of
the records to be archived, ``SAMPLE_ROWS`` rows (smallest hash of the id first) of which ``SAMPLE_CHARS`` are read each and
``SAMPLE_BYTES`` are used.

Of records with equal payloads (of ``least`` bytes or more) the one with the largest id is written as a response, the others
as revisits that refer to it and have no body. Ids and digests are shuffled to decide this, groups are reduced on the map
side. Rows that a bitmap of the revisits (bounded, one-sided) does not know are written straight from the scan; only the others,
revisits and a few more, are joined with the decision, by id and digest. Each task writes archives of about
``ARCHIVE_BYTES`` to the folder, under a name of its own, and moves them into place when they are complete: of several attempts of a
task one set of names is stored, and only those are read.

Defined cases: null payloads are empty; a null or odd url is left out of the record (no WARC-Target-URI); null ids are
written without a number and read back as null, and are responses; rows that repeat an id are records of their own, each
with its own payload (all of those with the group's largest id are responses); an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, in_filter, join_groups, new_folder, stored

MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 400
SAMPLE_BYTES = 8 << 20
SAMPLE_CHARS = 128 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
#: Tasks that read archives at most; each reads its archives one after the other.
READERS = 20_000

_DATE = "1970-01-01T00:00:00Z"
_READ = 1 << 20


def open_folder(uri: str):
    """A pyarrow file system and a path in it."""
    from pyarrow import fs

    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block but the length and digest of its payload."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{id}|{url}')}>", f"WARC-Date: {_DATE}"]
    if id is not None:
        lines.append(f"X-Page-ID: {id}")
    if url and not any(c in url for c in "\r\n"):
        lines.append(f"WARC-Target-URI: {url}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    block = payload
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}", f"X-Payload-Length: {len(payload)}"]
        block = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or the samples' own bytes where they are too few or too small to train one; empty without samples."""
    used, total = [], 0
    for s in samples:
        if total + len(s) > SAMPLE_BYTES:
            continue
        used.append(s)
        total += len(s)
    if len(used) >= 8 and total > 2 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, used).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(used)[-DICTIONARY_BYTES:]


class Writer:
    """Writes records to a binary stream."""

    def __init__(self, out, dictionary: bytes):
        self.out, self.size = out, 0
        self._frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        self._put(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self._frames.compress(data))


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; frames are decompressed as they come."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    dictionary = stream.read(size)
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    with frames.stream_reader(stream, read_size=_READ, read_across_frames=True) as data:
        held = b""

        def fill(n: int) -> None:
            nonlocal held
            parts, have = [held], len(held)
            while have < n and (more := data.read(max(n - have, 1 << 16))):
                parts.append(more)
                have += len(more)
            held = b"".join(parts)

        while True:
            fill(1)
            if not held:
                return
            while (end := held.find(b"\r\n\r\n")) < 0:
                before = len(held)
                fill(before + (1 << 16))
                if len(held) == before:
                    raise ValueError("a record's head is cut off")
            head = held[:end].decode().split("\r\n")
            if head[0] != "WARC/1.1":
                raise ValueError("not a record")
            fields = dict(x.split(": ", 1) for x in head[1:])
            stop = end + 4 + int(fields["Content-Length"])
            fill(stop + 4)
            if len(held) < stop + 4:
                raise ValueError("a record's block is cut off")
            yield fields, held[end + 4 : stop]
            held = held[stop + 4 :]


def revisits(pages: DataFrame, id: str, payload: Column, least: int) -> DataFrame:
    """(id, digest, refers_to) of the records that are revisits, stored: ids and digests alone are shuffled."""
    keys = stored(pages.where(F.col(id).isNotNull() & (F.octet_length(payload) >= least)).select(F.col(id).cast("long").alias("id"), F.sha1(payload).alias("digest")), "digests")
    groups = keys.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("low"), F.count(F.lit(1)).alias("size"))
    groups = stored(groups.where("low < refers_to").select("digest", "refers_to", "size"), "groups")
    return stored(join_groups(keys, groups, "digest", "size").where("id < refers_to").select("id", "digest", "refers_to").distinct(), "revisits")


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, dictionary: bytes | None = None) -> DataFrame:
    """Archive every row; returns the paths of the archives (column ``path``, stored)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    spark = pages.sparkSession
    if dictionary is None:
        # the ids are chosen first, so few texts are sorted
        ids = pages.where(F.octet_length(payload) > 0).select(F.col(id).alias("sample_id")).orderBy(F.xxhash64(id), id).limit(SAMPLE_ROWS)
        some = pages.join(F.broadcast(ids.distinct()), F.col(id) == F.col("sample_id"), "left_semi").select(F.col(id).alias("id"), F.substring(payload, 1, SAMPLE_CHARS).alias("p"))
        got = some.orderBy(F.xxhash64("id"), "id", "p").limit(SAMPLE_ROWS).collect()
        dictionary = train_dictionary([r["p"].encode() for r in got])
    shared = spark.sparkContext.broadcast(dictionary)
    found = revisits(pages, id, payload, least)
    bits = spark.sparkContext.broadcast(bit_filter(found.select(F.xxhash64("id", "digest").alias("key")), "key", found.count()))

    @F.pandas_udf("boolean")
    def known(keys: pd.Series) -> pd.Series:
        return pd.Series(in_filter(bits.value, keys.to_numpy().view(np.uint64)))

    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("again", known(F.xxhash64("id", "digest")))
    straight = rows.where("NOT again").select("id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    rows = straight.union(rows.where("again").join(found, ["id", "digest"], "left").select("id", "url", "payload", "refers_to"))

    def run(batches):
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        out = writer = None
        name = ""

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for b in batches:
            for row in zip(*(b.column(i) for i in range(4))):
                i, u, p, ref = (x.as_py() for x in row)
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{base}/{name}.part", compression=None)
                    writer = Writer(out, shared.value)
                writer.add(record(i, u, p.encode(), ref))
                if writer.size >= ARCHIVE_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    names = rows.mapInArrow(run, "name string").select(F.concat(F.lit(f"{folder}/"), "name").alias("path"))
    return stored(names, "archives")


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, payload string"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives at ``path``. ``intact``: a response's block has the stated digest. Without ``payloads`` that column is null."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, inner = open_folder(path)
                rows, size = [], 0
                with fs.open_input_stream(inner, compression=None) as stream:
                    for f, block in read_records(stream):
                        own = f["WARC-Type"] == "response"
                        said = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                        rows.append((number("X-Page-ID"), f.get("WARC-Target-URI"), f["WARC-Type"], number("X-Refers-To-Page-ID"), len(block) if own else number("X-Payload-Length"), digest(block) if own else said, digest(block) == said if own else True, block.decode() if own and payloads else None))
                        size += len(block)
                        if len(rows) >= 1000 or size > (8 << 20):
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    # archives are of about one size: each task reads some, whole and one after the other
    return archives.select("path").repartition(max(1, min(archives.count(), READERS))).mapInArrow(run, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
    names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact", "payload")
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], list(names))


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder."""
    return new_folder(spark, "warc")
