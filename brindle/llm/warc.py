"""WARC archives: writing, reading, and resolving revisits.

Records are laid out and compressed in Arrow batches, a gzip member each, so that readers can
seek; Spark's text writer commits the bytes, so archives are written like any table and may
lie in any store that Spark writes. Revisit resolution shuffles headers (no payloads) by the
digests of the real payloads, joins the later responses of a digest to the first one, and
writes archives in which those are ``revisit`` records with fresh headers; every other record
passes through as it is.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import map_frames, materialize, ship

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of members that are written as one row; a batch of records that the reader hands over holds about so many bytes of payload.
_CHUNK_BYTES, _BATCH_BYTES = 1 << 20, 4 << 20
#: An empty gzip member: ends what a member of 16 MB or more ends with a byte that isn't 0.
_EMPTY = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)

RECORD_SCHEMA = "archive string, at long, row_id string, record_id string, record_type string, uri string, date string, payload_digest string, payload_bytes long, refers_to string, refers_to_row string, digest_ok boolean, payload binary"
_FIELDS = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]


def base32_sha1(data: bytes) -> str:
    """SHA-1 in upper-case base32, bare."""
    return b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*parts: object) -> str:
    """A record id from the parts: the same for a task that runs again."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(0).join('' if p is None else 'x' + str(p) for p in parts))}>"


def _one_line(value: object) -> str:
    """A value that can't end its line."""
    return "".join("%20" if x <= " " or x == "\x7f" else x for x in str(value))


def record(kind: str, block: bytes, *fields: tuple[str, object]) -> bytes:
    """A whole record; fields that are None are left out."""
    head = [f"{k}: {_one_line(v)}" for k, v in (("WARC-Type", kind), *fields) if v is not None]
    return "\r\n".join(["WARC/1.1", *head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is 0."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY


def _write(rows: DataFrame, lay_out: Callable[[tuple], bytes], path: str, max_bytes: int) -> None:
    """A member per row, in archives of about ``max_bytes`` of members (more only where single ones are over 1 MB)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                held.append(member(lay_out(row)))
                size += len(held[-1])
                if size >= _CHUNK_BYTES:
                    yield pd.DataFrame({"value": [b"".join(held)[:-1]]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [b"".join(held)[:-1]]})

    # The writer ends each row with the separator, which is the last byte of the last member.
    chunks = map_frames(rows, run, "value binary").select(F.col("value").cast("string"))
    chunks.write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, max_bytes // _CHUNK_BYTES)).text(path)


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", max_bytes: int = 64 << 20) -> None:
    """A ``response`` record per row, payload in UTF-8 (null: empty), the id in a field of its own.

    Equal rows make records of their own. Null urls make records without a target; control
    characters and spaces in a url are escaped. Columns beside those named are not looked at.
    A payload is held whole by its task.
    """
    ship(pages.sparkSession)

    def lay_out(row: tuple) -> bytes:
        row_id, uri, body, number = row
        body = body or b""
        digest = base32_sha1(body)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        return record("response", http + body, ("WARC-Record-ID", _urn(row_id, uri, digest, number)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Row-ID", row_id))

    rows = pages.select(F.col(id_column).cast("string"), F.col(url), F.col(payload).cast("binary"), F.monotonically_increasing_id())
    _write(rows.toDF("row_id", "uri", "body", "number"), lay_out, path, max_bytes)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs if k.strip()}


def _unchunked(body: bytes) -> bytes | None:
    """The body that HTTP sent in chunks; None if it isn't so laid out."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, a piece at a time; other data as they are."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof and at < len(view):
            piece = view[at : at + step]
            yield z.decompress(piece)
            at += len(piece) - len(z.unused_data)
        if not z.eof:
            raise ValueError("an archive is cut short")


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes, bytes]]:
    """The records of an archive that comes in pieces: place, fields, head and block, one held at a time."""
    pieces, held, at = iter(pieces), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (start := held.find(b"WARC/")) < 0:
            drop = max(0, len(held) - 4)
            at += drop
            del held[:drop]
            if not more():
                if bytes(held).strip():
                    raise ValueError("what follows the last record isn't one")
                return
        at += start
        del held[:start]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's head is cut short")
        head = bytes(held[: end + 4])
        fields = _fields(head[:-4])
        size = int(fields["content-length"])
        while len(held) < len(head) + size:
            if not more():
                raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield at, fields, head, bytes(held[len(head) : len(head) + size])
        at += len(head) + size
        del held[: len(head) + size]


def _row(archive: str, at: int, h: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A record as a row of RECORD_SCHEMA; digests are those of the real payloads, for revisits the declared ones."""
    kind, payload, length = h.get("warc-type"), block, len(block)
    said = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    digest, ok = said, True
    if kind in ("response", "revisit"):
        cut = block.find(b"\r\n\r\n")
        http = _fields(block[:cut]) if cut >= 0 and block[:5] == b"HTTP/" else {}
        raw = block[cut + 4 :] if http else block
        payload = _unchunked(raw) if http.get("transfer-encoding", "").lower() == "chunked" else None
        payload = raw if payload is None else payload
        length = len(payload)
        if kind == "revisit":
            length = next((int(v) for v in (h.get("warc-payload-length"), http.get("content-length")) if v and v.isdigit()), None)
        else:
            digest = base32_sha1(payload)
            ok = said in (None, digest, base32_sha1(raw))
    return archive, at, h.get("warc-row-id"), h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), digest, length, h.get("warc-refers-to"), h.get("warc-refers-to-row-id"), ok, payload if with_payload else None


def _records(spark: SparkSession, path: str, with_payload: bool, whole: bool) -> DataFrame:
    ship(spark)
    names = [*_FIELDS, "whole"] if whole else _FIELDS

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                rows, held = [], 0
                for at, fields, head, block in parse_records(_inflated(content)):
                    row = _row(archive, at, fields, block, with_payload)
                    rows.append((*row, head + block + b"\r\n\r\n") if whole else row)
                    held += (len(block) if with_payload or whole else 0) + 500
                    if held > _BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return map_frames(files, parse, RECORD_SCHEMA + (", whole binary" if whole else ""))


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives in a folder, gzipped or not, as RECORD_SCHEMA.

    A task holds one compressed archive and one record at a time; archives are as large as
    write_warc() makes them, foreign ones up to Spark's limit for a binary file. A record
    that is cut short raises. ``payload_digest`` is that of the real payload (chunks of HTTP
    taken apart), for revisits what they declare; ``digest_ok`` is false where a payload
    isn't what its header says.
    """
    return _records(spark, path, with_payload, False)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0, id_type: str = "long") -> DataFrame:
    """Of responses with equal payloads, all but the first, as archive, at, record_id, first (a struct).

    First is the smallest row id (compared as ``id_type``; null last), then the record id,
    then the place. Payloads of fewer than ``min_bytes`` bytes are left alone, and so are records
    that aren't responses. Firsts are found with partial sums per task, and the join reads
    headers only, so a digest that most records share costs no more than others; adaptive
    execution splits it.
    """
    own = F.col("row_id").try_cast(id_type)
    rank = F.struct(own.isNull().alias("n"), own.alias("v"), F.col("record_id").alias("r"), F.col("archive").alias("a"), F.col("at").alias("o")).alias("rank")
    h = headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes)).select("archive", "at", "row_id", "record_id", "uri", "date", "payload_digest", "payload_bytes", rank)
    firsts = h.groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).agg(F.min(F.struct("rank", "row_id", "record_id", "uri", "date")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts.drop("n"), "firsts")
    found = h.join(firsts, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")))
    return found.where((F.col("archive") != F.col("first.rank.a")) | (F.col("at") != F.col("first.rank.o"))).select("archive", "at", "record_id", F.struct("first.row_id", "first.record_id", "first.uri", "first.date").alias("first"))


def dedup_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0, id_type: str = "long", max_bytes: int = 64 << 20) -> None:
    """Write the archives of ``source`` anew, with revisits in place of payloads that came before.

    A new revisit keeps its capture's date, target and HTTP headers, and gets a record id and
    references of its own. Revisits that were there already stay; those that name a response which
    is now a revisit name its first one instead. All other records are copied.
    """
    headers = materialize(_records(spark, source, False, False).drop("payload"), "headers")
    gone = materialize(resolve_revisits(headers, min_bytes, id_type), "revisits")
    # Record ids should be unique; where they aren't, the first of them decides.
    moved = gone.groupBy(F.col("record_id").alias("old_id")).agg(F.min("first").alias("first"))
    named = headers.where("record_type = 'revisit'").join(moved, F.col("refers_to") == F.col("old_id")).select("archive", "at", "first")
    changes = gone.select("archive", "at", "first").unionByName(named)
    changes = changes.select(F.col("archive").alias("archive2"), F.col("at").alias("at2"), F.col("first.row_id").alias("first_row"), F.col("first.record_id").alias("first_id"), F.col("first.uri").alias("first_uri"), F.col("first.date").alias("first_date"), F.lit(True).alias("changed"))
    records = _records(spark, source, False, True)
    # Places are unique: this join has no heavy key.
    rows = records.join(materialize(changes, "changes"), (F.col("archive") == F.col("archive2")) & (F.col("at") == F.col("at2")), "left")
    columns = ["row_id", "record_id", "uri", "date", "payload_digest", "payload_bytes", "archive", "at", "changed", "first_row", "first_id", "first_uri", "first_date", "whole"]

    def lay_out(row: tuple) -> bytes:
        row_id, record_id, uri, date, digest, size, archive, at, changed, first_row, first_id, first_uri, first_date, whole = (None if x is None or x != x else x for x in row)
        if not changed:
            return whole
        _, fields, head, block = next(parse_records([whole]))
        cut = block.find(b"\r\n\r\n")
        http = block[: cut + 4] if cut >= 0 and block[:5] == b"HTTP/" else b""
        return record(
            "revisit",
            http,
            ("WARC-Record-ID", _urn("revisit", record_id, archive.rsplit("/", 1)[-1], int(at))),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", first_id),
            ("WARC-Refers-To-Target-URI", first_uri),
            ("WARC-Refers-To-Date", first_date),
            ("WARC-Refers-To-Row-ID", first_row),
            ("WARC-Payload-Digest", None if digest is None else f"sha1:{digest}"),
            ("WARC-Payload-Length", None if size is None else int(size)),
            ("WARC-Row-ID", row_id),
        )

    _write(rows.select(*columns), lay_out, target, max_bytes)
