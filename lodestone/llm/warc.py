"""Web archives: pages as legacy ARC archives, their conversion to WARC, and WARC records as rows.

write_arc puts each page into an ARC archive (version 1 or 2): a version block that names the fields of the header lines, and
for each page a header line with the declared length, then the HTTP response whose body is the html in UTF-8. convert reads
such archives (also plain ones, and header lines of URLs with spaces) by the fields that their own version block names and
by the declared lengths alone, and synthesises what WARC has and ARC lacks: record ids (name-based UUIDs of the archive's
declared name and the record's number, so that a task that runs again gives the same), ISO timestamps from 8 to 17 digits,
types (warcinfo for the version block, response, revisit, resource for what is not HTTP) and SHA-1 digests of block and payload. Of
records with equal payloads of at least `least` bytes that with the largest page id is the response, the others are revisits of it
without the payload. read_warc gives a row for each record but warcinfo, and checks lengths and digests.

Archives are gzip files with one member a record, closed at about MOST compressed bytes, so a task holds one archive at a time and
no page is split. Spark's own text writer commits them, so that lost tasks can run again: a row is a whole archive but
its last byte. That byte is the highest of the last member's length, 0, since longer records are cut into members of under
16 MB, and is written as the line separator. Archives are read as whole files. Payloads never shuffle; digests do (a row of numbers a page), after
that one row an archive is joined with the list of its revisits. Frequent digests are joined apart (join_counted).

Null html is an empty payload, and empty payloads are equal. Null or empty urls stand as "-" in ARC and as the record's own id in
WARC, and are read as null; other bytes of urls than visible ASCII are percent-encoded. A null page id is left out of the HTTP header, read
as null, and counts as the smallest; of equal page ids (repeated rows) the greatest url, archive and number is the response. Empty tables give one
archive without pages or none, and no rows. Columns other than page_id, url and html are not read. Broken archives raise ValueError.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, shared_dir, stash, unstash

#: Compressed bytes after which an archive is closed; bytes of a gzip member; gzip level.
MOST, MEMBER, LEVEL = 4 << 20, (1 << 24) - 1, 4
# Fixed values of the formats.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def members(data: bytes) -> bytes:
    """data as gzip members of under 16 MB, each of which therefore ends with a zero byte."""
    out = []
    for k in range(0, max(1, len(data)), MEMBER):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += [z.compress(data[k : k + MEMBER]), z.flush()]
    return b"".join(out)


def opened(raw: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)


def exactly(f: io.BufferedIOBase, n: int, name: str) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"{name}: a record of {n} bytes ends after {len(data)}")
    return data


# ARC
def arc_line(version: int, url: bytes, ip: str, date: str, kind: str, length: int, status: str = "-", offset: int = 0, name: str = "-") -> bytes:
    more = f" {status} - - {offset} {name}" if version == 2 else ""
    return url + f" {ip} {date} {kind}{more} {length}\n".encode()


def arc_head(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 lodestone\n".encode() + FIELDS[version] + b"\n"
    return arc_line(version, f"filedesc://{name}".encode(), "0.0.0.0", date, "text/plain", len(block), "200", 0, name) + block


def quoted(url: str | None) -> bytes:
    return b"".join(bytes([b]) if 0x20 < b < 0x7F else b"%%%02X" % b for b in (url or "-").encode("utf-8", "surrogatepass"))


def http(page_id: int | None, payload: bytes) -> bytes:
    known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{known}Content-Length: {len(payload)}{END.decode()}".encode() + payload


def read_arc(raw: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields of the header line and content of each record, the version block first, by the fields that this block names."""
    f = opened(raw)
    cells = f.readline().decode().split()
    if len(cells) < 5 or not cells[0].startswith("filedesc://") or not cells[-1].isdigit():
        raise ValueError(f"{name}: not an ARC archive")
    block = exactly(f, int(cells[-1]), name)
    lines = block.decode().splitlines()
    if len(lines) < 2 or lines[0].split(" ")[0] not in ("1", "2") or not lines[1].endswith("Archive-length"):
        raise ValueError(f"{name}: a version block that is not known")
    names = lines[1].split()
    yield {"URL": cells[0], "Archive-date": cells[2], "version": lines[0].split(" ")[0]}, block
    while line := f.readline():
        if not line.strip(b"\r\n"):
            continue
        cells = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        spare = len(cells) - len(names)  # spaces of the URL
        if spare < 0 or not cells[-1].isdigit():
            raise ValueError(f"{name}: a header line without its fields")
        yield dict(zip(names, ["%20".join(cells[: spare + 1]), *cells[spare + 1 :]], strict=True)), exactly(f, int(cells[-1]), name)


# WARC
def warc_date(digits: str, name: str) -> str:
    if not digits.isdigit() or not 8 <= len(digits) <= 17:
        raise ValueError(f"{name}: a date that is not known")
    d = digits[:14].ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(archive: str, k: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{k}')}>"


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    named = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{named}Content-Length: {len(block)}{END.decode()}".encode() + block + END


def http_parts(content: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP head with its empty line, payload, header fields by lower-case name."""
    at = content.find(END)
    head = content[: at + 4] if at >= 0 else content
    fields = dict(x.partition(":")[::2] for x in head.decode("latin-1").split("\r\n")[1:] if ":" in x)
    return head, content[len(head) :], {k.strip().lower(): v.strip() for k, v in fields.items()}


def records(raw: bytes, name: str) -> Iterator[tuple[str, str, int, dict[str, str], bytes]]:
    """(record id, archive's declared name, number, header fields, content) of each record of an ARC archive."""
    archive = ""
    for k, (fields, content) in enumerate(read_arc(raw, name)):
        archive = archive or fields["URL"].removeprefix("filedesc://")
        yield record_id(archive, k), archive, k, fields, content


def to_warc(raw: bytes, name: str, revisits: dict[int, dict]) -> bytes:
    """An ARC archive as a WARC archive; revisits: what the records with these numbers revisit (record, url, date, page_id)."""
    out = []
    for rid, archive, k, fields, content in records(raw, name):
        date = warc_date(fields["Archive-date"], name)
        ip = fields.get("IP-address")
        base = {"WARC-Type": "response", "WARC-Record-ID": rid, "WARC-Date": date, "WARC-Target-URI": rid[1:-1] if fields["URL"] == "-" else fields["URL"], "WARC-IP-Address": ip if ip not in ("0.0.0.0", "-") else None}
        if k == 0:
            block = f"software: lodestone\r\nformat: WARC File Format 1.1\r\ndescription: {archive}, ARC version {fields['version']}\r\n".encode()
            out.append(members(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": rid, "WARC-Date": date, "Content-Type": "application/warc-fields"}, block)))
            continue
        if not content.startswith(b"HTTP/"):
            base |= {"WARC-Type": "resource", "WARC-Payload-Digest": f"sha1:{digest(content)}", "Content-Type": fields["Content-type"]}
            out.append(members(warc_record(base, content)))
            continue
        head, payload, _ = http_parts(content)
        base["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
        if (of := revisits.get(k)) is not None:
            content = head
            page = None if of["page_id"] is None else str(of["page_id"])
            base |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": of["record"], "WARC-Refers-To-Target-URI": of["record"][1:-1] if of["url"] == "-" else of["url"], "WARC-Refers-To-Date": warc_date(of["date"], name), "Refers-To-Page-Id": page}
        base |= {"WARC-Block-Digest": f"sha1:{digest(content)}", "Content-Type": "application/http; msgtype=response"}
        out.append(members(warc_record(base, content)))
    return b"".join(out)


def read_records(raw: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower-case names) and block of each WARC record."""
    f = opened(raw)
    while line := f.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{name}: not a WARC record")
        fields: dict[str, str] = {}
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = exactly(f, int(fields["content-length"]), name)
        if exactly(f, 4, name) != END:
            raise ValueError(f"{name}: a record that does not end where it says")
        yield fields, block


def row_of(fields: dict[str, str], block: bytes, name: str) -> dict:
    """A response, revisit or resource as a row; digests are computed anew where the payload is there."""
    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    head, payload, more = (b"", block, {}) if kind == "resource" else http_parts(block)
    n = int(more["content-length"]) if kind == "revisit" else len(payload)
    if kind != "revisit" and digest(payload) != said:
        raise ValueError(f"{name}: a payload that is not that of its digest")
    page, of, url = more.get("x-page-id"), fields.get("refers-to-page-id"), fields["warc-target-uri"]
    return {
        "page_id": None if page is None else int(page), "url": None if f"<{url}>" == fields["warc-record-id"] else url, "date": fields["warc-date"], "payload_bytes": n,
        "payload_digest": said, "record_type": kind, "refers_to": None if of is None else int(of), "record_id": fields["warc-record-id"], "refers_to_record": fields.get("warc-refers-to"),
    }


# On Spark
def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _save(rows: DataFrame, path: str) -> None:
    """Writes each row of value, a whole archive but its last byte, as a file of its own."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _mapped(of: Callable[..., Iterator[dict]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a file's columns by a function of them; a batch for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if found := list(of(*(c[k].as_py() for c in batch.columns))):
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    return run


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), date: str = "20240101000000", most: int = MOST) -> str:
    """pages: page_id, url, html. ARC archives in path, of these versions in turn, all pages captured at date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        name, parts, size, version = "", [], 0, 1
        for batch in batches:
            for page, url, html in zip(*batch.columns, strict=True):
                if not parts:
                    version, name = versions[(part + number) % len(versions)], f"pages-{part:06}-{number:06}.arc.gz"
                    parts = [members(arc_head(version, name, date))]
                    size = len(parts[0])
                content = http(page.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"))
                parts.append(members(b"\n" + arc_line(version, quoted(url.as_py()), "0.0.0.0", date, "text/html", len(content), "200", size, name) + content))
                size += len(parts[-1])
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["value"])
                    parts, number = [], number + 1
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["value"])

    _save(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value binary"), path)
    return path


def convert(spark: SparkSession, arc: str, path: str, least: int = 0) -> str:
    """The ARC archives of a folder as WARC archives in path, one for each; equal payloads of at least so many bytes are revisited."""
    head = pa.schema([("path", pa.string()), ("k", pa.int32()), ("archive", pa.string()), ("record", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("n", pa.int64())])

    def heads(at: str, content: bytes) -> Iterator[dict]:
        for rid, archive, k, fields, body in records(content, at):
            if body.startswith(b"HTTP/") and k:
                _, payload, more = http_parts(body)
                page = more.get("x-page-id")
                yield {"path": at, "k": k, "archive": archive, "record": rid, "page_id": None if page is None else int(page), "url": fields["URL"], "date": fields["Archive-date"], "digest": digest(payload), "n": len(payload)}

    known = stash(archives(spark, arc).mapInArrow(_mapped(heads, head), "path string, k int, archive string, record string, page_id long, url string, date string, digest string, n long").where(F.col("n") >= least), "arc_heads")
    keep = F.max(F.struct("page_id", "url", "archive", "k", "record", "date")).alias("keep")
    groups = stash(known.groupBy("digest").agg(F.count("*").alias("c"), keep).where("c > 1"), "arc_groups")
    again = join_counted(known.select("digest", "path", "k", "record"), groups, ["digest"]).where("record <> keep.record")
    listed = again.groupBy("path").agg(F.collect_list(F.struct("k", "keep.record", "keep.url", "keep.date", "keep.page_id")).alias("revisits"))  # at most an archive's records
    listed = stash(listed, "arc_revisits")

    def warcs(at: str, content: bytes, revisits: list[dict] | None) -> Iterator[dict]:
        yield {"value": to_warc(content, at, {r["k"]: r for r in revisits or []})[:-1]}

    _save(archives(spark, arc).join(listed, "path", "left").mapInArrow(_mapped(warcs, pa.schema([("value", pa.binary())])), "value binary"), path)
    unstash(known, groups, listed)
    return path


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses, revisits and resources of the WARC archives of a folder."""
    row = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string())])

    def rows(at: str, content: bytes) -> Iterator[dict]:
        return (row_of(fields, block, at) for fields, block in read_records(content, at) if fields["warc-type"] != "warcinfo")

    return archives(spark, path).mapInArrow(_mapped(rows, row), "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string")


def through_warc(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages written as ARC archives, converted to WARC archives in the shared folder, and read back."""
    spark, at = pages.sparkSession, f"{shared_dir(pages.sparkSession)}/web-{uuid.uuid4().hex}"
    arc = write_arc(pages, f"{at}/arc")
    return read_warc(spark, convert(spark, arc, f"{at}/warc", least))
