"""Legacy ARC archives converted to WARC, written as files and read back.

ARC records have one header line whose fields depend on the version named in
the archive's first record: version 1 has url, ip, date, type and length;
version 2 puts result code, checksum, location, offset and file name between
type and length. The declared length bounds the record, whatever it contains.
Conversion synthesises what WARC needs: a record id derived from the record, an
ISO timestamp, the record type, and SHA-1 digests of block and payload. The
version block becomes a warcinfo record that the archive's records name; what
holds an HTTP message is a response, whose head may end its lines with CRLF or
LF; anything else (dns:, ftp:) is a resource of the media type that ARC states.

Records with equal payloads of at least 1000 bytes are stored once: that with
the largest id is the response, the others are revisits that refer to it. Which
they are is decided on rows without payloads; revisits are written from those
rows, and payloads meet only the record ids of revisits, which spread evenly.

Each record is a gzip member of its own, so that it can be sought. Members are
gathered to volumes of some megabytes, and a file holds a few of these, so its
size is bounded by bytes, unless single records are larger. Files are written by
Spark's text writer with an empty member between volumes, so they go through its
commit protocol to any file system; in reading, one member is unpacked at a time.
The page id travels in the HTTP head as X-Page-Id, and in revisits as
WARC-Refers-To-Page; both are this module's own.

Rows: a null html is an empty payload; a null url becomes urn:page:<id>; blanks
and controls in urls are percent-encoded; a null id is written as -, and such
records are ordered first; rows that repeat the largest id of their payload are
all responses; any bytes may occur in a payload; an empty table gives no records;
a null archive has none. Extra columns are ignored. A damaged archive gives the
records before the damage and one of kind "damaged" whose url says what is wrong;
`strict` raises ArchiveError instead, as damaged WARC files always do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.kernels import slices
from quadrille.plans.lineage import cut, scratch_path

#: Payloads below this many bytes are never revisits.
LEAST = 1000
END = b"\r\n\r\n"
PIECE = 1 << 13
#: An empty gzip member, which stands between records.
NOTHING = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
# The fields of an ARC header line by version.
FIELDS = {
    1: "url ip date type length".split(),
    2: "url ip date type code checksum location offset filename length".split(),
}


class ArchiveError(ValueError):
    """An archive that breaks its format."""


@dataclass(frozen=True)
class Arc:
    """One record: header fields by name, and the bytes of its declared length."""

    header: dict[str, str]
    body: bytes


def arc_block(records: list[tuple[str, str, bytes]], version: int) -> bytes:
    """An archive of (url, 14-digit date, http response) records, behind its version block."""
    info = f"{version} 0 quadrille\n{' '.join(FIELDS[version])}\n".encode()

    def record(url: str, date: str, kind: str, body: bytes) -> bytes:
        value = dict(url=url, ip="0.0.0.0", date=date, type=kind, length=str(len(body)), code="200", checksum="-", location="-", offset="0", filename="-")
        return " ".join(value[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"

    return record("filedesc://block.arc", "19960101000000", "text/plain", info) + b"".join(record(url, date, "text/html", body) for url, date, body in records)


def read_arc(data: bytes) -> Iterator[Arc]:
    """The records of an archive, its version block first."""
    at, version = 0, None
    while at < len(data):
        eol = data.find(b"\n", at)
        if eol < 0:
            raise ArchiveError(f"no header line at byte {at}")
        if eol == at:  # blank lines may stand between records
            at += 1
            continue
        values = data[at:eol].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        fields = FIELDS.get(version) or (FIELDS[1] if len(values) == len(FIELDS[1]) else FIELDS[2])
        if len(values) != len(fields) or not values[-1].isdecimal():
            raise ArchiveError(f"bad header line at byte {at}")
        header, start = dict(zip(fields, values, strict=True)), eol + 1
        body = data[start : start + int(header["length"])]
        if len(body) < int(header["length"]):
            raise ArchiveError(f"record at byte {at} is cut off")
        if version is None:
            if not header["url"].startswith("filedesc://") or body[:1] not in b"12" or not body[:1]:
                raise ArchiveError("no version block")
            version = int(body[:1])
        yield Arc(header, body)
        at = start + len(body)


def http_parts(message: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields in lower case, the head with its empty line, and the payload."""
    end = re.search(rb"\r?\n\r?\n", message) if message.startswith(b"HTTP/") else None
    if end is None:
        return {}, b"", message
    lines = re.split(r"\r?\n", message[: end.start()].decode("latin-1"))[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, message[: end.end()], message[end.end() :]


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, source: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {source} {payload_digest}')}>"


def iso_date(date: str) -> str:
    """A 14-digit (or 12-digit) ARC date as WARC writes it."""
    d = (date + "00")[:14]
    if not re.fullmatch(r"\d{14}", d):
        raise ArchiveError(f"bad date {date!r}")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields in lower case and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        gap = data.find(END, at)
        if gap < 0 or not data.startswith(b"WARC/1.", at):
            raise ArchiveError(f"no record at byte {at}")
        lines = data[at:gap].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = gap + 4
        end = start + int(header["content-length"])
        if data[end : end + 4] != END:
            raise ArchiveError(f"record at byte {at} does not end where it says")
        yield header, data[start:end]
        at = end + 4


def members(data) -> Iterator[bytes]:
    """The members of a gzip file that aren't empty, one after the other; read in pieces so that what follows a member is not copied for each."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ArchiveError("a member is cut off")
            out.append(member.decompress(view[at : at + PIECE]))
            at += PIECE
        at = min(at, len(view)) - len(member.unused_data)
        if any(out):
            yield b"".join(out)


def gunzip(data) -> bytes:
    return b"".join(members(data))


def to_arc(pages: DataFrame, date: str = "20080101000000", size: int = 1 << 20) -> DataFrame:
    """Pages as archive blocks of about `size` bytes, of both versions by turns: one column, arc."""

    def run(batches):
        version = 1
        for batch in slices(batches, "html", size):
            records = []
            for source, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'-' if source is None else source}\r\nContent-Length: {len(body)}".encode()
                records.append((re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url if url else f"urn:page:{source}"), date, head + END + body))
            yield pa.RecordBatch.from_arrays([pa.array([arc_block(records, version)], pa.binary())], ["arc"])
            version = 3 - version

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "arc binary")


_CONVERTED = "kind string, source long, url string, ip string, type string, date string, record_id string, info_id string, digest string, length long, head binary, block binary"
WARCINFO, RESPONSE, RESOURCE, REVISIT, DAMAGED = "warcinfo", "response", "resource", "revisit", "damaged"


def converted(data: bytes, strict: bool = False) -> Iterator[tuple]:
    """What WARC needs of each record of an archive, in the order of _CONVERTED."""
    info_id = None
    try:
        for r in read_arc(data):
            url, date = r.header["url"], iso_date(r.header["date"])
            if info_id is None:
                block = f"software: quadrille\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/\r\nisPartOf: {url.removeprefix('filedesc://')}\r\n".encode()
                info_id = record_id(url, date, "", hashlib.sha1(data).hexdigest())
                yield WARCINFO, None, url, None, "application/warc-fields", date, info_id, None, hashlib.sha1(block).hexdigest(), len(block), b"", block
                continue
            fields, head, payload = http_parts(r.body)
            source, digest = fields.get("x-page-id", "-"), hashlib.sha1(payload).hexdigest()
            kind, media = (RESPONSE, "application/http; msgtype=response") if head else (RESOURCE, r.header["type"])
            yield kind, int(source) if source.isdecimal() else None, url, r.header["ip"], media, date, record_id(url, r.header["date"], source, digest), info_id, digest, len(payload), head, r.body
    except ArchiveError as e:
        if strict:
            raise
        yield DAMAGED, None, str(e), None, None, None, None, info_id, None, 0, b"", b""


def convert(arcs: DataFrame, strict: bool = False) -> DataFrame:
    """Records of archives (column arc) with what WARC needs; head and block are the bytes to be stored."""
    names = [x.split()[0] for x in _CONVERTED.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _CONVERTED.split(", ")]

    def run(batches):
        for batch in batches:
            for arc in batch.column("arc"):
                rows = list(converted(arc.as_buffer().to_pybytes(), strict)) if arc.is_valid else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return arcs.select("arc").mapInArrow(run, _CONVERTED)


def revisits(records: DataFrame) -> DataFrame:
    """The records that revisit another: without payloads, with refers_to, refers_id and refers_url of the response."""
    narrow = cut(records.where(f"kind = '{RESPONSE}' and length >= {LEAST}").drop("block"), "payloads")
    place = F.struct(F.coalesce(F.col("source"), F.lit(-(1 << 63))).alias("at"), "source", "record_id", "url")
    firsts = cut(narrow.groupBy("digest").agg(F.max(place).alias("r"), F.count("*").alias("n")).where("n > 1").select("digest", "r"), "firsts")
    again = narrow.join(firsts, "digest").where(~F.col("source").eqNullSafe(F.col("r.source")))
    return cut(again.select(*narrow.columns, *(F.col(f"r.{a}").alias(b) for a, b in (("source", "refers_to"), ("record_id", "refers_id"), ("url", "refers_url")))), "revisits")


def mark(records: DataFrame) -> DataFrame:
    """Records with the kind they are stored as; the block of a revisit is its head."""
    again = revisits(records)
    whole = records.where(f"kind <> '{DAMAGED}'").join(again.select("record_id").distinct(), "record_id", "left_anti").select(*records.columns)
    none = [F.lit(None).cast(again.schema[c].dataType).alias(c) for c in ("refers_to", "refers_id", "refers_url")]
    return whole.select("*", *none).union(again.select(F.lit(REVISIT).alias("kind"), *(c for c in records.columns if c not in ("kind", "block")), F.col("head").alias("block"), "refers_to", "refers_id", "refers_url"))


def warc_records(marked: DataFrame, size: int = 4 << 20) -> DataFrame:
    """One column, volume: WARC records as gzip members, some `size` bytes of them together, or one larger record."""
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

    def one(row: dict) -> bytes:
        payload_digest = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
        fields = {
            "WARC-Type": row["kind"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"], "WARC-Target-URI": None if row["kind"] == WARCINFO else row["url"], "WARC-Warcinfo-ID": row["info_id"],
            "WARC-IP-Address": None if row["ip"] in (None, "", "-", "0.0.0.0") else row["ip"], "WARC-Block-Digest": _sha1(row["block"]), "WARC-Payload-Digest": None if row["kind"] == WARCINFO else payload_digest,
            "WARC-Profile": profile if row["kind"] == REVISIT else None, "WARC-Refers-To": row["refers_id"], "WARC-Refers-To-Target-URI": row["refers_url"],
            "WARC-Refers-To-Page": None if row["kind"] != REVISIT else "-" if row["refers_to"] is None else str(row["refers_to"]), "Content-Type": row["type"], "Content-Length": str(len(row["block"])),
        }
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
        member = zlib.compressobj(1, zlib.DEFLATED, 31)
        return member.compress("\r\n".join(lines).encode("utf-8", "surrogateescape") + END + row["block"] + END) + member.flush()

    def volume(parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["volume"])

    def run(batches):
        parts, held = [], 0
        for batch in slices(batches, "block", 1 << 20):
            for row in batch.to_pylist():
                member = one(row)
                if parts and held + len(member) > size:
                    yield volume(parts)
                    parts, held = [], 0
                parts.append(member)
                held += len(member)
        if parts:
            yield volume(parts)

    return marked.mapInArrow(run, "volume binary")


def write(volumes: DataFrame, path: str, most: int = 8) -> None:
    """Archive files of at most `most` volumes each."""
    text = volumes.select(F.col("volume").cast("string").alias("value"))
    text.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("compression", "none").option("maxRecordsPerFile", most).text(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Records of archive files: source, payload_bytes, payload_digest (hex), record_type, refers_to, url, date, record_id."""
    names = "source payload_bytes payload_digest record_type refers_to url date record_id".split()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def number(x):
        return None if x in (None, "", "-") else int(x)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for header, block in (record for member in members(content.as_buffer()) for record in read_warc(member)):
                    if header["warc-type"] == WARCINFO:
                        continue
                    fields, _, payload = http_parts(block)
                    kind, digest = header["warc-type"], header["warc-payload-digest"].removeprefix("sha1:")
                    if _sha1(block) != header["warc-block-digest"] or kind != REVISIT and _sha1(payload) != header["warc-payload-digest"]:
                        raise ArchiveError(f"bad digest in {header['warc-record-id']}")
                    size = len(payload) if kind != REVISIT else int(fields["content-length"])
                    rows.append((number(fields.get("x-page-id")), size, base64.b32decode(digest).hex(), kind, number(header.get("warc-refers-to-page")), header["warc-target-uri"], header["warc-date"], header["warc-record-id"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "source long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, record_id string")


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages through ARC into WARC files at path (a scratch path by default), and what the files hold."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write(warc_records(mark(convert(to_arc(pages)))), path)
    return load(pages.sparkSession, path)
