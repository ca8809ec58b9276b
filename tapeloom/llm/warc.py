"""Zstandard WARC archives: a writer of one frame per record, and a reader that checks headers and lengths.

An archive file is: one skippable frame that holds the file's dictionary, then a Zstandard frame for each record. Between
frames lie empty skippable frames, which decoders pass over: Spark's own text writer puts them there as its line separator,
so that archives are committed task by task on any file system that Spark writes to, and a lost executor leaves no half
file behind. A file has at most `records_a_file` records (1,000). A reader task holds one file and its records one by one, so
files of pages of some megabytes each want a smaller number; Spark reads no file of 2 GB or more.

Records: of pages with equal payloads of at least `least` bytes, that with the smallest page_id is a response, others are
revisits that refer to it and carry no payload. Smaller payloads are all responses. Null html is an empty payload. Pages
that repeat the smallest page_id with the same payload are responses too. A null page_id never is the one referred to while
another page has the payload; if none has an id, all are responses. Null urls give records without a target; control
characters in urls are percent-encoded. Very long payloads are records like others. Pages that repeat in all have records of one
name each. Payloads that very many pages share go through `hot_join`: their pages stay where they are. An empty table gives no
archive and an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, chunked, hot_join, new_path, written

#: Magic numbers of frames, of a dictionary and of the skippable frames for dictionaries and separators.
FRAME, DICTIONARY, SKIP_DICTIONARY, SKIP_EMPTY = 0xFD2FB528, 0xEC30A437, 0x184D2A5D, 0x184D2A50
SEPARATOR = struct.pack("<II", SKIP_EMPTY, 0)
LEAST_BYTES, RECORDS_A_FILE, LEVEL = 100, 1_000, 3
#: A file's dictionary is trained on at most so many of its first payloads, each up to so many bytes.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8_192, 16_384
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"


class DamagedArchive(ValueError):
    """A frame, header or length of an archive isn't as it should be."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (refers_to given) whose block has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, from its block headers."""
    if len(data) < at + 5:
        raise DamagedArchive("a frame header is cut off")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if len(data) < at + 3:
            raise DamagedArchive("a block header is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise DamagedArchive("a block of a reserved kind")
        at += 3 + (1 if kind == 1 else size)
        if head & 1:
            break
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise DamagedArchive("a frame is cut off")
    return at


def frames(data: bytes) -> Iterator[tuple[str, bytes]]:
    """("dictionary", content) for a leading dictionary, then ("record", frame) for each record."""
    view, at, first = memoryview(data), 0, True
    while at < len(view):
        if len(view) < at + 8:
            raise DamagedArchive("trailing bytes")
        magic, size = struct.unpack_from("<II", view, at)
        if magic == FRAME:
            end = frame_end(view, at)
            yield "record", bytes(view[at:end])
            at = end
        elif magic & 0xFFFFFFF0 == SKIP_EMPTY:
            if at + 8 + size > len(view):
                raise DamagedArchive("a skippable frame is cut off")
            if magic == SKIP_DICTIONARY:
                if not first:
                    raise DamagedArchive("the dictionary isn't the first frame")
                yield "dictionary", bytes(view[at + 8 : at + 8 + size])
            at += 8 + size
        else:
            raise DamagedArchive(f"no frame begins with {magic:08x}")
        first = False


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one decoded record; its lengths must agree."""
    head, end, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not end or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise DamagedArchive("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise DamagedArchive(f"a header line without a name: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise DamagedArchive(f"{name} is missing")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise DamagedArchive("Content-Length and the block differ")
    return headers, rest[:-4]


def page_of(name: str) -> int | None:
    """The page id in a record's name."""
    inner = name.removeprefix("<" + RECORD_ID).removesuffix(">")
    if not name.startswith("<" + RECORD_ID):
        raise DamagedArchive(f"a foreign record id: {name[:80]}")
    return int(inner) if inner else None


def read_archive(data: bytes) -> Iterator[tuple]:
    """(page_id, url, payload or None, payload_bytes, payload_digest, record_type, refers_to) of every record of a file."""
    import zstandard

    decoder = zstandard.ZstdDecompressor()
    for kind, content in frames(data):
        if kind == "dictionary":
            if content[:4] == struct.pack("<I", FRAME):
                content = decoder.decompress(content)
            if content[:4] != struct.pack("<I", DICTIONARY):
                raise DamagedArchive("the first frame holds no dictionary")
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            continue
        try:
            headers, block = parse(decoder.decompress(content))
        except zstandard.ZstdError as error:
            raise DamagedArchive(str(error)) from error
        http, end, payload = block.partition(b"\r\n\r\n")
        lengths = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        if not end or not http.startswith(b"HTTP/") or len(lengths) != 1 or not lengths[0].isdigit():
            raise DamagedArchive("the block is no HTTP response with a length")
        size, digest = int(lengths[0]), headers.get("warc-payload-digest", "").removeprefix("sha256:")
        kind, refers_to = headers["warc-type"], None
        if kind == "response":
            if size != len(payload) or digest != hashlib.sha256(payload).hexdigest():
                raise DamagedArchive("the payload isn't as long as its header says, or has another digest")
        elif kind == "revisit":
            if payload or headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers:
                raise DamagedArchive("a revisit with a payload or without its reference")
            refers_to, payload = page_of(headers["warc-refers-to"]), None
        else:
            raise DamagedArchive(f"a record of type {kind[:40]}")
        yield page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), payload, size, digest, kind, refers_to


def trained(samples: list[bytes]) -> bytes | None:
    """A dictionary of the first records of a file; None where there are too few for one."""
    import zstandard

    if len(samples) < 16 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return None


def archive(records: Iterator[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """The frames of one file; the first holds the dictionary, compressed, or nothing where none could be trained."""
    import zstandard

    head = list(itertools.islice(records, SAMPLES))
    dictionary = trained([r[:SAMPLE_BYTES] for r in head])
    if dictionary:
        inner = zstandard.ZstdCompressor(level=level).compress(dictionary)
        yield struct.pack("<II", SKIP_DICTIONARY, len(inner)) + inner
        coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    else:
        yield SEPARATOR
        coder = zstandard.ZstdCompressor(level=level, write_checksum=True)
    for one in itertools.chain(head, records):
        yield coder.compress(one)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, records_a_file: int = RECORDS_A_FILE) -> None:
    """Writes the pages (page_id, url, html) as archives below `path`."""
    bounded_batches(pages.sparkSession)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    digests = written(rows.select("page_id", "digest", F.octet_length("payload").alias("size")), "digests")
    first = digests.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    typed = hot_join(rows, first, "digest", "left", keys=digests).select("page_id", "url", "payload", "digest", F.expr("if(page_id <=> first, null, first)").alias("refers_to"))
    frame = pa.schema([("frame", pa.binary())])

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record(i, url, body, digest, to) for i, url, body, digest, to in arrow_rows(batches))

        def files() -> Iterator[tuple]:
            for one in records:  # the writer begins a new file after records_a_file + 1 frames
                for data in archive(itertools.chain([one], itertools.islice(records, records_a_file - 1))):
                    yield (data,)

        yield from chunked(files(), frame, 500)

    # A cast from binary to string keeps the bytes; the text writer writes them as they are.
    typed.mapInArrow(framed, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR.decode("latin-1")).option("maxRecordsPerFile", records_a_file + 1).text(path)


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below `path`; a damaged file fails the query. Without payloads they are read, checked and dropped."""
    bounded_batches(spark)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row if payloads else (*row[:2], None, *row[3:]) for (data,) in arrow_rows(batches) for row in read_archive(data))
        yield from chunked(rows, _RECORDS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decoded, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def checked_revisits(records: DataFrame) -> DataFrame:
    """The records; a revisit whose response is missing or has another digest or length fails the query."""
    targets = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("payload_digest"), F.col("payload_bytes").alias("payload_bytes")).distinct().withColumn("there", F.lit(True))
    revisits = records.where("record_type = 'revisit'").join(targets, ["refers_to", "payload_digest", "payload_bytes"], "left")
    sound = revisits.withColumn("record_type", F.when(F.col("there"), F.col("record_type")).otherwise(F.raise_error(F.lit("a revisit refers to no such response")).cast("string")))
    return records.where("record_type = 'response'").unionByName(sound.select(*records.columns))


def page_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives to the shared folder, reads them back, checks them, and gives a row a page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    if not pages.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return checked_revisits(written(read_archives(spark, path, payloads=False).select(*columns), "records"))
