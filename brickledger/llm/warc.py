"""WARC archives: a writer for gzip and plain archives, and a reader that salvages damaged ones.

Archives are written by Spark's own text writer, so they reach any file
system, appear only when their task has committed, and survive lost executors.
A text row holds whole records as raw bytes, and the line separator is chosen
so that the file stays a valid archive: two line ends between plain records,
an empty gzip member between compressed ones.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import utf8, whole_texts

VERSION = b"WARC/1.1"
CHUNK_BYTES = 1 << 20  # records are joined to text rows of about this size
CHUNKS_PER_FILE = 32  # so an archive holds some 32 MB, and one longer record at most
GZIP_START = b"\x1f\x8b\x08"
WINDOW = 1 << 16
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)
PLAIN_END = b"\r\n\r\n"
ID_PREFIX = "urn:page:"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
GAP = "gap"

RECORDS = ("archive string, offset long, length long, record_type string, page_id long, refers_to long, uri string, "
           "payload_bytes long, payload_digest string, payload binary, problem string")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def sha1_base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


# ------------------------------------------------------------------- writing

def with_revisits(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Records to write: of equal payloads the smallest id is the response, and all rows with a larger id revisit it.

    Only groups with two rows or more take part in the join, and a group is
    counted on the map side first, so a payload that very many rows share
    costs one row per task.  Rows with a null id are responses.
    """
    rows = whole_texts(pages).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("uri"),
        F.coalesce(utf8(payload_col), F.lit(b"")).alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    shared = rows.filter(F.length("payload") >= least_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(shared, "sha1", "left").withColumn(
        "refers_to", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))).drop("first_id")


def record(page_id: int | None, uri: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One record.  A revisit has no payload of its own; its digest and full length stay in the headers."""
    block = HTTP_HEAD if refers_to is not None else HTTP_HEAD + payload
    head = [
        VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(sha1)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        head.insert(4, "WARC-Target-URI: " + " ".join(uri.split()))
    if refers_to is not None:
        head.insert(4, f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>")
        head.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, path: str, compressed: bool = True, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z",
          id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row below ``path``.

    Payloads are whole UTF-8 texts; a null text is an empty payload.  Payloads
    of fewer than ``least_bytes`` bytes are always responses.  An empty table
    gives a folder without archives.
    """
    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(b"" if compressed else PLAIN_END).join(held)], pa.binary())], ["chunk"])
        for batch in source:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "uri", "payload", "sha1", "refers_to"))):
                made = record(*row, date)
                held.append(member(made + PLAIN_END) if compressed else made)
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()

    rows = with_revisits(pages, least_bytes, id_col, url_col, payload_col)
    chunks = rows.select("page_id", "uri", "payload", "sha1", "refers_to").mapInArrow(pack, "chunk binary")
    separator = (EMPTY_MEMBER if compressed else PLAIN_END).decode("latin-1")
    (chunks.select(F.col("chunk").cast("string").alias("value")).write.option("lineSep", separator)
     .option("encoding", "ISO-8859-1").option("maxRecordsPerFile", CHUNKS_PER_FILE).text(path))


# ------------------------------------------------------------------- reading

@dataclass
class Found:
    """A record that passed every check, or (``problem`` set) the bytes of one that did not."""

    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes
    problem: str | None = None


class Damaged(Exception):
    pass


def parse_record(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``start``."""
    if not data.startswith(b"WARC/1.", start):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", start)
    if head_end < 0:
        raise Damaged("no end of headers")
    headers = {}
    for line in data[start:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    end = head_end + 4 + int(length)
    if end > len(data) or data[end:end + 4] != PLAIN_END:
        raise Damaged("block does not end where its length says")
    block = data[head_end + 4:end]
    named = headers.get("warc-block-digest", "")
    if named.startswith("sha1:") and digest(block) != named[5:].upper():
        raise Damaged("block digest differs")
    return headers, block, end + 4


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        head, split, payload = block.partition(b"\r\n\r\n")
        if not split:
            raise Damaged("no end of the HTTP headers")
    named = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and named.startswith("sha1:") and digest(payload) != named[5:].upper():
        raise Damaged("payload digest differs")
    return payload


def inflate(view: memoryview, start: int) -> tuple[bytes, int, str | None]:
    """Content of the gzip member at ``start``, its end, and what is wrong with it; content before a damage is whole.

    It is fed window by window, so that a member costs its own length and not
    the archive's; a window that fails is fed again in smaller steps.
    """
    opened, parts, at, step = zlib.decompressobj(31), [], start, WINDOW
    while not opened.eof and at < len(view):
        before = opened.copy()
        try:
            parts.append(opened.decompress(view[at:at + step]))
            at += step
        except zlib.error as error:
            if step == 1:
                return b"".join(parts), at, f"member: {error}"
            opened, step = before, step // 256
    return b"".join(parts), min(at, len(view)) - len(opened.unused_data), None if opened.eof else "member is cut off"


def records_of(content: bytes, sound: bool) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """The records in the content of a member that pass their checks, and the first failure.

    A damaged member has no check of its own content, so its records need a block digest.
    """
    passed, problem, at = [], None, 0
    while at < len(content):
        try:
            headers, block, end = parse_record(content, at)
            if not sound and not headers.get("warc-block-digest", "").startswith("sha1:"):
                raise Damaged("record without a digest in a damaged member")
            passed.append((headers, payload_of(headers, block)))
            at = end
        except Damaged as error:
            problem = problem or str(error)
            later = content.find(b"WARC/1.", at + 1)
            at = later if later >= 0 else len(content)
    return passed, problem


def next_gzip(view: memoryview, start: int) -> tuple[list[Found], int, str | None]:
    """Records of the gzip member at ``start`` (none of an empty one), where to go on, and what was wrong with the member.

    The first record has the length of the member, the others none; if
    something was wrong, none has, since the member's bytes are a gap.
    """
    content, end, damage = inflate(view, start)
    passed, problem = records_of(content, damage is None)
    problem = damage or problem
    if problem and not passed:
        raise Damaged(problem)
    made = [Found(start, 0, headers, payload) for headers, payload in passed]
    if made and not problem:
        made[0].length = end - start
    return made, end if damage is None else start + 1, problem


def next_plain(data: bytes, start: int) -> tuple[list[Found], int, str | None]:
    headers, block, end = parse_record(data, start)
    return [Found(start, end - start, headers, payload_of(headers, block))], end, None


def candidates(data: bytes, start: int) -> Iterator[tuple[int, bool]]:
    """Places from ``start`` on where a member or a version line may begin, and whether it is a member."""
    zipped, plain = data.find(GZIP_START, start), data.find(b"WARC/1.", start)
    while zipped >= 0 or plain >= 0:
        if plain < 0 or 0 <= zipped < plain:
            yield zipped, True
            zipped = data.find(GZIP_START, zipped + 1)
        else:
            yield plain, False
            plain = data.find(b"WARC/1.", plain + 1)


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive that pass their checks, and the gaps between them, in order.

    After a check has failed, the search goes on one byte behind the place
    that failed, to the next member or version line with a record that passes.
    The bytes passed over are one gap, with the first failure as its problem.
    A member may hold any number of records.  Of a damaged one those before the
    damage are read, of a sound one those around a bad record; its bytes are
    a gap all the same.
    """
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            found, end, problem = next_gzip(view, at) if data.startswith(GZIP_START, at) else next_plain(data, at)
        except Damaged as error:
            place = next_valid(view, data, at + 1)
            yield Found(at, place - at, {}, b"", str(error))
            at = place
            continue
        yield from found
        if problem:
            # the end of a damaged member is not known; its stored blocks may show records again that have been read
            place = end if end > at + 1 else next_valid(view, data, end, {f.headers.get("warc-record-id") for f in found})
            yield Found(at, place - at, {}, b"", problem)
            end = place
        at = end


def next_valid(view: memoryview, data: bytes, start: int, known: set | frozenset = frozenset()) -> int:
    """The first place from ``start`` on with a record, not of ``known`` ids, that passes its checks, or an empty member; else the file's end."""
    for place, is_member in candidates(data, start):
        try:
            found, _, _ = next_gzip(view, place) if is_member else next_plain(data, place)
        except Damaged:
            continue
        if not found or any(f.headers.get("warc-record-id") not in known for f in found):
            return place
    return len(data)


def number(text: str | None) -> int | None:
    """The id inside ``<urn:page:7>``; null for ids of other writers."""
    bare = (text or "").strip("<>").removeprefix(ID_PREFIX)
    return int(bare) if bare.removeprefix("-").isdigit() and bare.isascii() else None


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record below ``path``, and a row of type ``gap`` for each run of bytes that was given up.

    Gzip members and plain records may be mixed, and a member may hold several
    records, the first of which has its length.  ``problem`` is null but for
    gaps, which name the archive, offset and length that are quarantined.
    ``payload_bytes`` of a revisit is the length of the full payload.
    Archives are read whole, one per task at a time.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for found in salvage(data.as_py()):
                    h = found.headers
                    length = h.get("x-payload-length", "")
                    bare = h.get("warc-payload-digest", "").removeprefix("sha1:") or (None if found.problem else digest(found.payload))
                    rows.append({
                        "archive": name, "offset": found.offset, "length": found.length,
                        "record_type": GAP if found.problem else h.get("warc-type"), "page_id": number(h.get("warc-record-id")),
                        "refers_to": number(h.get("warc-refers-to")), "uri": h.get("warc-target-uri"),
                        "payload_bytes": None if found.problem else int(length) if length.isdigit() and h.get("warc-type") == "revisit" else len(found.payload),
                        "payload_digest": bare, "payload": None if found.problem or not with_payload else found.payload, "problem": found.problem,
                    })
                    size += len(found.payload)
                    if size > CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


SCHEMA = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
    ("refers_to", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary()), ("problem", pa.string()),
])


def gaps(records: DataFrame) -> DataFrame:
    """The quarantine log: archive, offset, length and problem of every gap."""
    return records.filter(is_gap()).select("archive", "offset", "length", "problem")


def is_gap() -> Column:
    return F.col("record_type") == GAP
