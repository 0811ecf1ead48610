"""WARC archives, compressed record by record with a Zstandard dictionary of their own.

An archive is a .warc.zst file: a skippable frame of magic 0x184D2A5D that holds the dictionary, then one frame for
each record. archived() turns rows into archives as a table (archive, part, content binary), a part being at most
ARCHIVE_BYTES of records with its own dictionary, so every part is a whole .warc.zst file by itself; that table is
written with Spark to any store. read_archives() reads such contents back. Of records with equal payloads of at
least `least` bytes, that with the smallest id is a response, the others are revisits that refer to it.

The dictionary is trained on all records of the part; where they are too few or too short to train on, it is their
own first DICTIONARY_BYTES.

Results in special cases: a null html counts as empty and makes an empty payload; a null url becomes "urn:null:" and a null id the
record id "null"; payloads of null ids alone are all responses, beside a row with an id they are its revisits; rows equal in id and
payload are the same record, so all of them are responses where that id is the smallest, else all are revisits; an empty table gives an empty one; other columns are ignored, whatever their names. A record that isn't whole
raises ValueError when read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches, text_or_empty, written

#: A skippable frame with this magic holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Uncompressed bytes of records in a part.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """One response or revisit record; a revisit keeps the HTTP header, whose Content-Length is that of the whole payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A .warc.zst file of these records."""
    dictionary = _dictionary(records)
    content = dictionary.as_bytes()
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary if content else None, write_checksum=True).compress
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content + b"".join(compress(r) for r in records)


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on all these records; where they are too few or too short for that, the records themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=512, d=8)
    except zstandard.ZstdError:
        content = b"".join(records)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def records_of(file: bytes) -> Iterator[bytes]:
    """The records of a .warc.zst file, one frame each."""
    dictionary, at = None, 0
    if len(file) >= 8 and struct.unpack_from("<I", file)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", file, 4)[0]
        content = file[8 : 8 + size]
        if len(content) < size:
            raise ValueError("the dictionary is cut short")
        at = 8 + size
        if content[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content) if content else None
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(file)
    while at < len(file):
        one = decompressor.decompressobj()
        out = one.decompress(view[at:])
        if not one.eof:
            raise ValueError(f"the record at {at} is cut short")
        yield out
        at = len(file) - len(one.unused_data)


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record, names in lower case."""

    def headers(part: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode("utf-8").split("\r\n")[1:])}

    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc = headers(head)
    n = int(warc["content-length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{warc.get('warc-record-id')}: the block is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


def deduplicated(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id string, url, data binary, digest, refers_to string): what each record is to be, in even partitions."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("urn:null:")).alias("url"), text_or_empty(html_col).cast("binary").alias("data"))
    small = rows.select("id", F.unhex(F.sha1("data")).alias("key"), (F.length("data") >= least).alias("long"))
    first = small.where("long").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only groups of copies come this far; a row that isn't its group's first refers to it. A large group's rows are split by Spark's skew join
    copies = small.where("long").join(first, "key").select("id", "key", "first").distinct()
    keyed = rows.withColumn("key", F.unhex(F.sha1("data"))).join(copies.select(F.col("id").alias("i"), F.col("key").alias("k"), "first"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    return keyed.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "url", "data", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to"))


def archived(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(part string, n_records long, content binary): rows of deduplicated() as .warc.zst files of about archive_bytes of records."""
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            content = archive(waiting)
            name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(waiting)], pa.int64()), pa.array([content], pa.binary())], names=["part", "n_records", "content"])

        for batch in batches:
            for i, url, data, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(record(i, url, data, digest(data), refers_to))
                size += len(waiting[-1])
                if size >= archive_bytes:
                    yield out()
                    waiting, size = [], 0
        if waiting:
            yield out()

    return records.select("id", "url", "data", "refers_to").mapInArrow(run, "part string, n_records long, content binary")


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """(id string, url, record_type, payload_bytes long, payload_digest, refers_to string, payload binary: null for a revisit).

    Digests of responses are computed from the payload read and must be those that the record states.
    """
    small_batches(archives.sparkSession)
    kinds = {"id": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}

    def one(data: bytes) -> tuple:
        warc, http, payload = parsed(data)
        stated = warc["warc-payload-digest"].removeprefix("sha1:")
        kind = warc["warc-type"]
        n = int(http["content-length"])
        if kind == "response" and (len(payload) != n or digest(payload) != stated):
            raise ValueError(f"{warc['warc-record-id']}: the payload isn't what its record states")
        bare = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
        return bare(warc["warc-record-id"]), warc["warc-target-uri"], kind, n, stated, bare(warc.get("warc-refers-to")), payload if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [one(r) for r in records_of(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return archives.select(content_col).mapInArrow(run, "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def stored(pages: DataFrame, least: int = 0) -> DataFrame:
    """The archives of pages, written in the shared folder and opened again."""
    return written(archived(deduplicated(pages, least)))
