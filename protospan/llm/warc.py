"""WARC archives compressed with Zstandard: one frame a record, with a dictionary in the leading skippable frame.

Writing: rows are dealt into archives of about ARCHIVE bytes of payload. A task writes an archive row by row: it
trains a dictionary on the first SAMPLE bytes of payload, puts it in a skippable frame and then yields a frame for
each record. Spark's text writer and committer put the frames in a file, wherever the folder lies; what it writes
after each row is an empty skippable frame, which readers skip. So no task holds a whole archive, and an attempt
that is lost leaves nothing behind.

Reading: ``binaryFile`` brings archives, which are small, to the tasks. The dictionary is loaded from the leading
skippable frame, then one frame at a time is decoded and its record checked: version line, mandatory fields, the
block's length against Content-Length, the two line ends after it, the HTTP message's own Content-Length, and both
digests. A fault raises ValueError with the archive's name and the frame's place.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is a response; the others
revisit it. Equality is that of SHA-256. A payload that makes up a thousandth of the rows or more joins by broadcast (there
are at most a thousand of them), the others in a shuffle, so that a hot payload does not meet in one task.

Defined results: a null html is an empty payload. A row with a null page_id cannot be referred to; if a payload has
no other rows, all of them are responses. Rows that repeat page_id and html have one record each, all of one type. A
null url has no target field and comes back as null; control characters, spaces and non-ASCII ones of a url are
percent-encoded, as a header line cannot hold them. Payloads of any length are whole. An empty table makes no
archive with records, and reads as no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.llm.store import python_ready, remove_later, shared_folder

ARCHIVE = 16 << 20
#: Bytes of payload that a dictionary is trained on, at most, and its size.
SAMPLE, DICTIONARY = 1 << 20, 1 << 15
LEVEL = 3

# Fixed values of the formats: little-endian magic numbers of Zstandard and of a WARC file's dictionary frame.
FRAME, TRAINED, OWN_DICTIONARY = b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec", b"\x5d\x2a\x4d\x18"
SKIPPED, EMPTY = b"\x2a\x4d\x18", b"P\x2a\x4d\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "archive string, record_id string, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string"


def new_folder(spark: SparkSession) -> str:
    """A folder for archives beside the other intermediate tables; it goes when the driver's Python ends."""
    return remove_later(f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """_key, _id and refers_to of the rows (of ``_key``, ``_id``, page_id and ``_n``) that repeat a payload."""
    groups = pages.filter(F.col("_n") >= least).groupBy("_key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1 and refers_to is not null")
    total = pages.count()
    hot = groups.filter(F.col("_rows") * 1000 >= total).select("_key", "refers_to")
    cold = groups.filter(F.col("_rows") * 1000 < total).select("_key", "refers_to")
    # Each hot payload has a thousandth of the rows: there are at most a thousand.
    rest = pages.join(F.broadcast(hot), "_key", "left").withColumnRenamed("refers_to", "_hot")
    there = rest.filter("_hot is not null").select("_key", "_id", "page_id", F.col("_hot").alias("refers_to"))
    there = there.union(rest.filter("_hot is null").join(cold, "_key").select("_key", "_id", "page_id", "refers_to"))
    return there.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("_key", "_id", "refers_to").distinct()


def _record(page_id, url: str | None, payload: bytes, refers_to, sha1: bytes) -> bytes:
    def name(i) -> str:
        return uuid.uuid5(uuid.NAMESPACE_OID, f"{i}:{sha1.hex()}").urn

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = "sha1:" + base64.b32encode(sha1).decode()
    lines = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    lines += [f"WARC-Payload-Digest: {digest}", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Type: application/http; msgtype=response"]
    # Fields of our own: the table's ids, which record ids are derived from.
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{name(refers_to)}>", f"Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    def rows():
        for b in batches:
            for at in range(b.num_rows):
                yield tuple(b.column(k)[at].as_py() for k in range(b.num_columns))

    def framed():
        held, size, source = [], 0, rows()
        for row in source:
            held.append(row)
            size += len(row[2])
            if size >= SAMPLE:
                break
        if not held:
            return
        own = None
        samples = [r[2] for r in held if 8 <= len(r[2]) <= SAMPLE // 8]
        try:
            own = zstandard.train_dictionary(DICTIONARY, samples) if len(samples) >= 16 else None
        except zstandard.ZstdError:  # too few samples, or too much alike
            own = None
        raw = own.as_bytes() if own else b""
        yield OWN_DICTIONARY + len(raw).to_bytes(4, "little") + raw
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True)
        while held:
            for r in held:
                yield packer.compress(_record(*r))
            held = [r] if (r := next(source, None)) is not None else []

    out, size = [], 0
    for f in framed():
        out.append(f)
        size += len(f)
        if size >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])


def write_archives(pages: DataFrame, folder: str, least: int = 1000, archive: int = ARCHIVE) -> str:
    """Write ``pages`` (page_id, url, html) as archives; returns the folder."""
    spark = pages.sparkSession
    python_ready(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"_key": F.unhex(F.sha2("payload", 256)), "_id": F.coalesce(F.col("page_id").cast("string"), F.lit("")), "_n": F.octet_length("payload")})
    again = revisits(rows.select("_key", "_id", "page_id", "_n"), least)
    n = max(1, -(-(rows.agg(F.sum("_n")).first()[0] or 0) // archive))
    keys = ["_id", "_key"]
    whole = rows.repartition(n, *keys).join(again.repartition(n, *keys), keys, "left")
    frames = whole.select("page_id", "url", "payload", "refers_to", F.unhex(F.sha1("payload")).alias("sha1")).mapInArrow(_frames, "frame binary")
    # Bytes pass through a string column as they are.
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY.decode("latin1")).option("compression", "none").text(folder)
    return folder


def frames_of(archive: memoryview) -> Iterator[tuple[int, bytes]]:
    """Place and contents of every Zstandard frame, by the dictionary of the leading skippable frame."""
    import zstandard

    at, unpacker = 0, None
    while at < len(archive):
        magic = bytes(archive[at : at + 4])
        if len(magic) == 4 and magic[1:] == SKIPPED and 0x50 <= magic[0] <= 0x5F:
            if at + 8 > len(archive) or (end := at + 8 + int.from_bytes(archive[at + 4 : at + 8], "little")) > len(archive):
                raise ValueError(f"at {at}: a skippable frame is cut off")
            if magic == OWN_DICTIONARY:
                raw = bytes(archive[at + 8 : end])
                if raw[:4] == FRAME:  # a dictionary may be compressed itself
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                if raw and raw[:4] != TRAINED:
                    raise ValueError(f"at {at}: not a dictionary")
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
            at = end
        elif magic == FRAME:
            unpacker = unpacker or zstandard.ZstdDecompressor()
            parts, one, begun = [], unpacker.decompressobj(), at
            try:
                while not one.eof and at < len(archive):
                    given = archive[at : at + (1 << 16)]
                    parts.append(one.decompress(given))
                    at += len(given)
            except zstandard.ZstdError as e:
                raise ValueError(f"at {begun}: {e}") from e
            if not one.eof:
                raise ValueError(f"at {begun}: a frame is cut off")
            at -= len(one.unused_data)
            yield begun, b"".join(parts)
        else:
            raise ValueError(f"at {at}: not a Zstandard frame")


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header line: {line[:60]!r}")
        if name.lower() in out:
            raise ValueError(f"{name} is given twice")
        out[name.lower()] = value.strip()
    return out


def _length(fields: dict[str, str]) -> int:
    if not fields.get("content-length", "").isdecimal():
        raise ValueError("no Content-Length")
    return int(fields["content-length"])


def _sha1(fields: dict[str, str], name: str) -> bytes:
    kind, _, value = fields.get(name, "").partition(":")
    if kind != "sha1":
        raise ValueError(f"{name} is not a SHA-1")
    return base64.b32decode(value)


def parsed(record: bytes) -> dict:
    """A checked record: its ids, type, url and payload (empty for a revisit), and the full payload's length and digest."""
    head, end, rest = record.partition(b"\r\n\r\n")
    if not end or head.split(b"\r\n", 1)[0] != VERSION:
        raise ValueError("no WARC header")
    f = _fields(head)
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date") if not f.get(n)]
    if missing:
        raise ValueError(f"{missing[0]} is missing")
    size, kind = _length(f), f["warc-type"]
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block of {size} bytes and two line ends are due, {len(rest)} bytes are there")
    block = rest[:size]
    if hashlib.sha1(block).digest() != _sha1(f, "warc-block-digest"):
        raise ValueError("the block does not have its digest")
    if kind not in ("response", "revisit"):
        return {"record_type": kind}
    http, end, payload = block.partition(b"\r\n\r\n")
    if not end or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    length, digest = _length(_fields(http)), _sha1(f, "warc-payload-digest")
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"a payload of {length} bytes is due, or its digest is another")
    if kind == "revisit" and (payload or f.get("warc-profile") != IDENTICAL or not f.get("warc-refers-to") or not f.get("refers-to-page-id")):
        raise ValueError("a revisit has a profile, what it refers to, and no payload")
    number = {n: int(f[k]) if k in f else None for n, k in (("page_id", "page-id"), ("refers_to", "refers-to-page-id"))}
    return number | {"record_type": kind, "record_id": f["warc-record-id"], "url": f.get("warc-target-uri"), "payload": payload, "payload_bytes": length, "payload_digest": digest.hex()}


def _read(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
    types = [pa.int64() if " long" in x else pa.string() for x in RECORDS.split(", ")] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in zip(names, types, strict=True)], names=names)
            out.clear()
            return made

        for b in batches:
            for k in range(b.num_rows):
                path, size = b.column(0)[k].as_py(), 0
                try:
                    for at, record in frames_of(memoryview(b.column(1)[k].as_buffer())):
                        try:
                            r = parsed(record)
                        except ValueError as e:
                            raise ValueError(f"at {at}: {e}") from e
                        if r["record_type"] not in ("response", "revisit"):
                            continue
                        out.append(r | {"archive": path})
                        size += len(record) if with_payload else 256
                        if size >= 1 << 22:
                            yield given()
                            size = 0
                except ValueError as e:
                    raise ValueError(f"{path} {e}") from e
                yield given()

    return run


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row for each response and revisit: archive, ids, type, url, length and digest of the full payload, and the payload if asked for."""
    python_ready(spark)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_read(payload), RECORDS + ", payload binary" * payload)
