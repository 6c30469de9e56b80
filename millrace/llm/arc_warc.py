"""Legacy ARC archives into WARC.

An ARC file begins with a version block that says how its record lines look:
version 1 lines have URL, IP, date, type and length; version 2 adds result
code, checksum, location, offset and file name before the length. ``read_arc``
follows the declared lengths; ``to_warc`` synthesises what WARC needs and ARC
lacks: record ids (a name-based UUID of URL, date, payload digest and HTTP
head), dates in ISO form, record types and SHA-1 digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pick, ship, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINES = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_EPOCH = datetime(1996, 1, 1, tzinfo=UTC)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes


def _word(text: str) -> str:
    """A URL without blanks, so that a record line splits at its spaces."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text) or "urn:none"


def arc_bytes(records: list[ArcRecord], name: str, version: int) -> bytes:
    info = f"{version} 0 none\n".encode() + _LINES[version] + b"\n"
    out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain".encode()]
    out.append(b" 200 - - 0 " + name.encode() if version == 2 else b"")
    out.append(f" {len(info)}\n".encode() + info + b"\n")
    at = sum(map(len, out))
    for r in records:
        line = f"{_word(r.url)} {r.ip} {r.date} {r.mime}"
        if version == 2:
            line += f" 200 - - {at} {name}"
        part = f"{line} {len(r.body)}\n".encode("utf-8", "surrogatepass") + r.body + b"\n"
        out.append(part)
        at += len(part)
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block, by the fields that its version has.

    Raises ValueError on an unknown version, a short line or a length beyond the end.
    """
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a record line has no end")
        if end == at:
            at += 1
            continue
        line = data[at:end].decode("utf-8", "surrogatepass")
        length = line.rpartition(" ")[2]
        if not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"no fitting length in record line {line[:80]!r}")
        body = data[end + 1 : end + 1 + int(length)]
        at = end + 1 + int(length)
        if fields is None:
            version = body.split(b" ", 1)[0]
            if version not in (b"1", b"2"):
                raise ValueError(f"unknown archive version {version[:20]!r}")
            fields = {b"1": 5, b"2": 10}[version]
            continue
        part = line.rsplit(" ", fields - 1)
        if len(part) != fields:
            raise ValueError(f"record line has {len(part)} of {fields} fields")
        yield ArcRecord(part[0], part[1], part[2], part[3], body)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, payload_digest: str, head: bytes = b"") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {payload_digest} {digest(head)}')}>"


def warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def to_warc(r: ArcRecord, first: tuple[str, str, bytes] | None = None) -> bytes:
    """One ARC record as WARC: a response, or a revisit of the record (url, ARC date, HTTP head) ``first``."""
    http = r.body.startswith(b"HTTP/")
    head, sep, payload = r.body.partition(b"\r\n\r\n") if http else (b"", b"", r.body)
    own = digest(payload)
    kind = ("revisit" if first else "response") if http else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(r.url, r.date, own, head)), ("WARC-Date", warc_date(r.date)), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", f"sha1:{own}")]
    block = head + sep if first else r.body
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first[0], first[1], own, first[2])), ("WARC-Refers-To-Target-URI", first[0]), ("WARC-Refers-To-Date", warc_date(first[1]))]
    fields += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response" if http else r.mime)]
    return warc_record(fields, block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record; raises ValueError on damage."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at {at}")
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut")
        yield fields, block
        at = end + 8 + n


# --- over pages -------------------------------------------------------------


def arc_date(page_id: int | None) -> str:
    """Pages carry no date; theirs is as many seconds after a fixed one as their id says."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 250_000_000_000)).strftime("%Y%m%d%H%M%S")


def page_head(page_id: int | None, n: int) -> bytes:
    """The HTTP head, without the empty line, of a page with a payload of ``n`` bytes. It makes the page's record id its own."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\nX-Page-Id: {'' if page_id is None else page_id}".encode()


def page_record(page_id: int | None, url: str | None, html: str | None) -> ArcRecord:
    payload = (html or "").encode("utf-8", "surrogatepass")
    return ArcRecord(_word(url or ""), "0.0.0.0", arc_date(page_id), "text/html", page_head(page_id, len(payload)) + b"\r\n\r\n" + payload)


def _archives(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[ArcRecord, tuple[str, str, bytes] | None]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            name, version = f"pages-{part:05d}-{seq:05d}", 1 + (part + seq) % 2
            legacy = arc_bytes([r for r, _ in held], f"{name}.arc", version)
            info = f"software: millrace\r\nisPartOf: {name}\r\nformat: WARC File Format 1.1\r\n".encode()
            out = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "19960101000000", digest(info))), ("WARC-Date", warc_date("19960101000000")), ("Content-Type", "application/warc-fields")], info)]
            out += [to_warc(r, first) for r, (_, first) in zip(read_arc(legacy), held, strict=True)]
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc"]), pa.array([version], pa.int32()), pa.array([b"".join(out)], pa.binary())], ["name", "arc_version", "data"])

        for b in batches:
            for page, url, html, lead, lead_url in zip(*[b.column(i) for i in range(5)]):
                p, first = page.as_py(), lead.as_py()
                r = page_record(p, url.as_py(), html.as_py())
                n = len(r.body) - r.body.index(b"\r\n\r\n") - 4
                held.append((r, None if first is None or first == p else (_word(lead_url.as_py() or ""), arc_date(first), page_head(first, n))))
                size += len(r.body)
                if size >= segment_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def write_archives(pages: DataFrame, space: Workspace, least_bytes: int = 0, segment_bytes: int = 4_000_000, name: str = "warc") -> DataFrame:
    """Pages as ARC records converted to WARC archives (name, arc_version, data).

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the
    largest page_id is the response and the others revisit it without a payload;
    rows that repeat that page_id are responses each. A null html is an empty
    payload, a null url ``urn:none``; a null page_id never is the response if
    the group has another. Digests are grouped, never texts.
    """
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n"))
    lead = light.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("lead"), F.count("*").alias("rows"))
    lead = lead.where("rows > 1 AND lead.page_id IS NOT NULL").select("sha", F.col("lead.page_id").alias("lead"), F.col("lead.url").alias("lead_url"))
    joined = rows.join(lead, "sha", "left").select("page_id", "url", "html", "lead", "lead_url")
    return space.put(joined.mapInArrow(_archives(segment_bytes), "name string, arc_version int, data binary"), name)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0):
            rows = []
            for fields, block in read_warc(data.as_py()):
                if fields["warc-type"] == "warcinfo":
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                http = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("latin-1").split("\r\n")[1:])}
                own = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (digest(payload) != own or len(payload) != int(http["content-length"])):
                    raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                rows.append((int(http["x-page-id"]) if http["x-page-id"] else None, int(http["content-length"]), own, fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to")))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of WARC archives; a revisit's page is found through the id it refers to.

    Responses refer to nothing and take no part in the join. A revisit whose
    response is in none of the archives has a null ``refers_to``.
    """
    spark = archives.sparkSession
    ship(spark)
    rows = archives.select("data").mapInArrow(_records, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string")
    space = Workspace(spark, "records")
    rows = space.put(rows, "rows")
    own = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    revisits = rows.where("record_type = 'revisit'")
    # One row for each record that is revisited, however often.
    asked = revisits.groupBy("refers").agg(F.count("*").alias("times"))
    aims = rows.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers"), "page_id")
    aims = space.put(aims.join(asked, "refers").groupBy("refers").agg(F.max("page_id").alias("refers_to")), "aims")
    found = pick(revisits, aims, ["refers"], "left").select(*own, "refers_to")
    return rows.where("record_type <> 'revisit'").select(*own, F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def op8_arc_warc(spark, sf_dir):
    return read_archives(write_archives(table(spark, sf_dir, "pages"), Workspace(spark, "warc")))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS top FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(sha, 5 * i + 1, 5))::BIGINT) AS five FROM d)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(five, lambda x: substr('{_BASE32}', ((x >> 15) & 31) + 1, 1) || substr('{_BASE32}', ((x >> 10) & 31) + 1, 1) || substr('{_BASE32}', ((x >> 5) & 31) + 1, 1) || substr('{_BASE32}', (x & 31) + 1, 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM v
"""
