"""WARC archives compressed record by record with Zstandard: writer and validating reader.

An archive opens with a skippable frame that holds the dictionary; every further frame is one record.
The writer's tasks build archives of bounded size, and Spark's text sink writes each as a file of its
own: its commit protocol covers lost executors, and any store that Spark writes to will do. What the
sink puts behind a row is an empty skippable frame, which readers of the format pass over.

The reader walks the frames by their block headers, so a frame that is cut off, runs past the file or
holds more or less than one record is found before it is used.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_ops.functions.session import broadcast_if_small, new_folder, stage
from telemetry_ops.llm.text import column, slices, small_batches

#: Bytes of an archive beyond which its task opens the next one; a larger record is an archive of its own.
ARCHIVE_BYTES = 32 << 20
#: The dictionary is trained on this many records at most, on that many code points of each.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 1024, 8192, 64 << 10
LEVEL = 3
#: Bytes that one record may decompress to.
LARGEST_RECORD = 1 << 30
#: Estimated bytes of a row that says which page answers for a payload.
ANSWER_BYTES = 160

# Fixed values of the formats.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

RECORDS = (
    "archive string, begin long, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, error string"
)
_SCHEMA = pa.schema(
    [("archive", pa.string()), ("begin", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]
    + [("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]
)


class Damaged(ValueError):
    """An archive, a frame or a record that does not hold what it says."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(identity: str | None) -> int | None:
    """The page of a record id that ``record_id`` made."""
    m = re.fullmatch(r"<urn:page:(-?\d*):[A-Z2-7]*>", identity or "")
    return int(m[1]) if m and m[1] else None


def http_block(payload: bytes, revisit: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + (b"" if revisit else payload)


def make_record(page_id: int | None, url: str | None, payload: bytes, answer: int | None, revisit: bool, date: str) -> bytes:
    """One record; a revisit keeps the headers of the answer and leaves its payload to the record it refers to."""
    digest, block = base32_sha1(payload), http_block(payload, revisit)
    named = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if revisit:
        named += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(answer, digest))]
    named += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", b"\r\n".join(lines)).split(b"\r\n") if lines else []:  # a line may be folded
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(_NAME, name):
            raise Damaged(f"not a header line: {line[:60]!r}")
        found.setdefault(name.decode().lower(), value.strip().decode("utf-8", "replace"))
    return found


def _length(text: str | None, what: str) -> int:
    if text is None or not re.fullmatch(r"[0-9]+", text):
        raise Damaged(f"{what} has no length: {text!r}")
    return int(text)


def _digest_holds(named: str | None, content: bytes, what: str) -> None:
    if named is not None and named.lower().startswith("sha1:") and named[5:].upper() != base32_sha1(content):
        raise Damaged(f"{what} digest differs")


def read_record(raw: bytes) -> dict:
    """The parts of one decompressed record, after its headers, lengths and digests were found to hold."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("no end of headers")
    version, *lines = raw[:end].split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise Damaged(f"not a WARC version: {version[:20]!r}")
    fields = _fields(lines)
    for name in REQUIRED:
        if name not in fields:
            raise Damaged(f"no {name}")
    size = _length(fields["content-length"], "record")
    block, rest = raw[end + 4 : end + 4 + size], raw[end + 4 + size :]
    if len(block) < size or rest != b"\r\n\r\n":
        raise Damaged(f"length {size} does not fit the record")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest")
    _digest_holds(fields.get("warc-block-digest"), block, "block")
    payload, n = block, size
    if fields.get("content-type", "").startswith("application/http") and kind in ("response", "revisit"):
        close = block.find(b"\r\n\r\n")
        if close < 0:
            raise Damaged("no end of HTTP headers")
        status, *http = block[:close].split(b"\r\n")
        if not status.startswith(b"HTTP/"):
            raise Damaged(f"not an HTTP answer: {status[:20]!r}")
        told, payload = _fields(http).get("content-length"), block[close + 4 :]
        n = len(payload) if told is None else _length(told, "HTTP answer")
        if kind == "response" and n != len(payload):
            raise Damaged(f"HTTP length {n} does not fit the payload")
    if kind == "revisit":
        if "warc-profile" not in fields or (fields["warc-profile"] == PROFILE and not digest):
            raise Damaged("revisit without a profile or a payload digest")
        payload = None
    else:
        _digest_holds(digest, payload, "payload")
    return {
        "record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "payload_digest": digest.partition(":")[2] if digest else None,
        "payload_bytes": n, "payload": payload,
    }


# ---------------------------------------------------------------- frames


def skippable(content: bytes, magic: int = DICTIONARY_FRAME) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def frame_end(data: memoryview, begin: int) -> int:
    """Where the Zstandard frame at ``begin`` ends, by its header and block headers."""
    try:
        head = zstandard.frame_header_size(bytes(data[begin : begin + 18]))
        checksum = zstandard.get_frame_parameters(bytes(data[begin : begin + 18])).has_checksum
    except zstandard.ZstdError as error:
        raise Damaged(f"not a frame header: {error}") from error
    at, last = begin + head, False
    while not last:
        if at + 3 > len(data):
            raise Damaged("frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        if kind == 3:
            raise Damaged("frame has a reserved kind of block")
        at += 3 + (1 if kind == 1 else size)
    at += 4 if checksum else 0
    if at > len(data):
        raise Damaged("frame is cut off")
    return at


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """``(begin, end, magic)`` of all frames; ``magic`` is 0 for those with content."""
    at = 0
    while at < len(data):
        if bytes(data[at : at + 4]) == FRAME:
            end = frame_end(data, at)
            yield at, end, 0
        else:
            if at + 8 > len(data):
                raise Damaged(f"trailing bytes at {at}")
            magic, size = struct.unpack_from("<II", data, at)
            if magic not in SKIPPABLE_FRAMES:
                raise Damaged(f"not a frame at {at}")
            end = at + 8 + size
            if end > len(data):
                raise Damaged(f"skippable frame at {at} is cut off")
            yield at, end, magic
        at = end


def load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary of a leading skippable frame, which may itself be compressed."""
    if content[:4] == FRAME:
        content = _content(zstandard.ZstdDecompressor(), content)
    return zstandard.ZstdCompressionDict(content)


def _content(engine: zstandard.ZstdDecompressor, frame: bytes) -> bytes:
    try:
        size = zstandard.frame_content_size(frame)
        if size > LARGEST_RECORD:
            raise Damaged(f"record of {size} bytes is beyond {LARGEST_RECORD}")
        found = b"" if size == 0 else engine.decompress(frame, max_output_size=LARGEST_RECORD if size < 0 else 0)
    except zstandard.ZstdError as error:
        raise Damaged(f"frame does not decompress: {error}") from error
    if 0 <= size != len(found):
        raise Damaged(f"frame says {size} bytes and has {len(found)}")
    return found


def read_frames(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """``(begin, record bytes)`` of an archive, whose dictionary may only lead it."""
    engine, used = zstandard.ZstdDecompressor(), 0
    for begin, end, magic in frames(data):
        if magic == DICTIONARY_FRAME and begin == 0:
            dictionary = load_dictionary(bytes(data[8:end]))
            engine, used = zstandard.ZstdDecompressor(dict_data=dictionary), dictionary.dict_id()
        elif magic == 0:
            frame = bytes(data[begin:end])
            wanted = zstandard.get_frame_parameters(frame).dict_id
            if wanted not in (0, used):
                raise Damaged(f"frame at {begin} wants dictionary {wanted}, the archive has {used or 'none'}")
            yield begin, _content(engine, frame)


# ---------------------------------------------------------------- Spark


def _answers(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``(same, answer)``: payloads that more than one page bears, with the largest page id among these."""
    keyed = pages.where(F.octet_length("payload") >= least_bytes)
    counts = keyed.groupBy("same").agg(F.max("page_id").alias("answer"), F.count("*").alias("n"))
    return stage(counts.where("n > 1").select("same", "answer"), "answers")


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of records, or nothing where the sample is too small for one.

    The sample is that of the ``SAMPLE`` smallest row hashes, and so does not depend on how rows lie in files. Rows are
    counted first, and only hashes below a bound that lets about twice the sample through are sent on: otherwise
    every task would send as many rows as the whole sample has.
    """
    rows = pages.select("page_id", "url", F.col("html").substr(1, SAMPLE_CHARS).alias("html"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("page_id", "url", "html"), 2))
    share = min(1.0, (2.0 * SAMPLE + 100) / max(1, pages.count()))
    some = rows.where(F.col("h") <= int(share * float(1 << 62))).orderBy("h", "page_id").limit(SAMPLE).collect()
    texts = [make_record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "replace"), None, False, "") for r in some]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) > 7 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Writes ``page_id, url, html`` as archives into the folder ``path``, one record per row.

    Of the rows with one payload of ``least_bytes`` or more, those with the largest ``page_id`` are responses
    (several only if that id repeats) and all others revisit them; a null id is less than any other, so null
    ids alone are all responses. A null ``html`` is an empty payload, a null ``url`` is ``about:blank``. Other
    columns are ignored, and an empty table writes no archive. A payload is encoded where it is read and never
    shuffled, unless there are so many repeated payloads that their table cannot be broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    answers = _answers(rows, least_bytes)
    joined = rows.join(broadcast_if_small(answers, answers.count(), ANSWER_BYTES), "same", "left")
    revisit = F.octet_length("payload") >= least_bytes
    revisit = revisit & F.col("answer").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("answer"))
    dictionary = train_dictionary(pages.select("page_id", "url", "html"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        engine = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_checksum=True)
        head = skippable(zstandard.ZstdCompressor(level=19).compress(dictionary)) if dictionary else b""
        parts, size = [head], len(head)
        for batch in batches:
            for piece in slices(batch, "payload"):
                names = ("page_id", "url", "payload", "answer", "revisit")
                for page_id, url, body, answer, again in zip(*(column(piece, c) for c in names)):
                    frame = engine.compress(make_record(page_id, url, body, answer, again, date))
                    if len(parts) > 1 and size + len(frame) > archive_bytes:
                        yield pa.record_batch([pa.array([b"".join(parts)], pa.binary())], ["archive"])
                        parts, size = [head], len(head)
                    parts.append(frame)
                    size += len(frame)
        if len(parts) > 1:
            yield pa.record_batch([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    chosen = small_batches(joined).select("page_id", "url", "payload", "answer", revisit.alias("revisit"))
    packed = chosen.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
    packed.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True, strict: bool = True, glob: str = "*") -> DataFrame:
    """All records of the archives under ``path`` that match ``glob``, as ``RECORDS``.

    An archive is read by one task and must be below 2 GB; its records leave in slices. With ``strict`` the
    first damage fails the job and names archive and place. Without it, a damaged record is a row with its
    ``error`` and without content, and damage to the frames ends that archive with such a row. Without ``payloads``
    they are validated but not returned. An empty folder gives no rows.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                data = memoryview(batch.column(1)[k].as_buffer())
                rows, size, begin = [], 0, -1

                def failed(error, name=name):
                    if strict:
                        raise Damaged(f"{name} at {begin}: {error}") from error
                    return {"archive": name, "begin": begin, "error": str(error)}

                found = read_frames(data)
                while True:
                    try:
                        begin, raw = next(found)
                    except StopIteration:
                        break
                    except Damaged as error:
                        rows.append(failed(error))
                        break
                    try:
                        row = read_record(raw) | {"archive": name, "begin": begin}
                        if not payloads:
                            row["payload"] = None
                        size += len(raw) if payloads else 0
                    except Damaged as error:
                        row = failed(error)
                    rows.append(row)
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return small_batches(files).mapInArrow(unpack, RECORDS)


def page_records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and reports what is read back from them."""
    path = new_folder(spark, "archives")
    write_archives(pages, path)
    found = read_archives(spark, path, payloads=False)

    def page(c):
        return F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1).try_cast("long")

    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
