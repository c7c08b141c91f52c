"""Legacy archive converter: ARC files of either version become WARC files with equivalent records.

An ARC file opens with a version block, whose first content line names the version and whose second lists the fields of
the header line before every record; the last field is the declared length of what follows. The converter reads both
versions by these declared lengths. Header lines are read from both ends, since a URL or a content type may hold spaces.
A record keeps its own block byte for byte. It becomes a response where its block opens with a status line,
and a resource otherwise (DNS answers, FTP files, texts without a head), with a synthesised identifier,
timestamp and digests; a version block becomes a warcinfo record. Of responses with equal payloads one stays; the others
become revisits that refer to it and hold their own HTTP head without the payload.

Archives are written in files of about SEGMENT bytes, one gzip member to a record, so that a record can be read alone at
its offset, and are read record by record through Spark's binary reader, so any store that Spark can reach will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_root, utf8

SEGMENT = 8 << 20
#: Bytes of payloads that leave a task together.
FRAME = 4 << 20
#: A payload of at least so many bytes is revisited when it repeats.
REVISIT_FROM = 0
DATE = "20000101000000"
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Spark names its files by a random identifier, which record identifiers leave out.
_PART = re.compile(r"(part-\d+)-[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(-c\d+)")
_NO_MEMBER = gzip.compress(b"", 1, mtime=0)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- files of gzip members


def member(record: bytes) -> bytes:
    """A gzip member that ends with a zero byte: the sizes of most records do, an empty member after the others does."""
    data = gzip.compress(record, 1, mtime=0)
    return data if data[-1] == 0 else data + _NO_MEMBER


def _segments(records: Iterator[Callable[[int, int], bytes]], opening: Callable[[int], bytes], segment: int = SEGMENT) -> Iterator[pd.DataFrame]:
    """One row for each file: opening(number) and records(offset, number) up to about ``segment`` bytes, without the last zero byte."""
    parts, size, number = [], 0, 0
    for record in records:
        if not parts:
            first = opening(number)
            parts, size = [member(first)], len(first)
        data = record(size, number)
        parts.append(member(data))
        size += len(data)
        if size >= segment:
            yield pd.DataFrame({"value": [b"".join(parts)[:-1]]})
            parts, number = [], number + 1
    if parts:
        yield pd.DataFrame({"value": [b"".join(parts)[:-1]]})


def _write(rows: DataFrame, path: str) -> None:
    """One file for each row, by Spark's text writer, which writes bytes as they are and ends a row with the zero byte left out."""
    rows.select(F.col("value").cast("string")).write.options(maxRecordsPerFile=1, lineSep="\x00").text(path)


def _open(content: bytes) -> io.BufferedIOBase:
    """Bytes of an archive, compressed or not; only what is being read is unpacked."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def archive_name(file: str, folder: str) -> str:
    """What record identifiers call a file: its path in the folder that was read."""
    plain = [re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", x) for x in (file, folder.rstrip("/") + "/")]
    return _PART.sub(r"\1\2", plain[0].removeprefix(plain[1]))


# --- legacy archives


def _header_line(version: str, url: str, ip: str, date: str, mime: str, body: bytes, at: int, name: str) -> str:
    middle = [] if version == "1" else ["200", hashlib.md5(body).hexdigest(), "-", str(at), name]
    return " ".join([url, ip, date, mime, *middle, str(len(body))]) + "\n"


def _http(payload: bytes, page_id) -> bytes:
    own = "" if pd.isna(page_id) else f"X-Page-Id: {int(page_id)}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def write_arc(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Store (page_id, url, html) rows as ARC files, version 1 and 2 in turn. Null html: empty; null url: unknown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def opening(number: int) -> bytes:
            version = "12"[number % 2]
            body = f"{version} 0 archive\n{FIELDS[version]}\n".encode()
            return _header_line(version, f"filedesc://{number}.arc", "0.0.0.0", DATE, "text/plain", body, 0, f"{number}.arc").encode() + body + b"\n"

        def one(page_id, url, html):
            body = _http(utf8(html), page_id)
            url = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "http://unknown.invalid/"
            return lambda at, number: _header_line("12"[number % 2], url, "0.0.0.0", DATE, "text/html", body, at, f"{number}.arc").encode() + body + b"\n"

        yield from _segments((one(*r) for pdf in batches for r in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True)), opening, segment)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    _write(rows.mapInPandas(run, "value binary"), path)


def header_fields(line: str, names: list[str]) -> dict[str, str]:
    """The fields of an ARC header line.

    Fields after the content type are read from the right. Of what is left, the last date after an address divides the
    URL before them from the content type behind; both may hold spaces, and the content type may be missing.
    """
    words = line.split(" ")
    lower = [n.lower() for n in names]
    behind = names[lower.index("content-type") + 1 :] if "content-type" in lower else names[3:]
    if len(words) < 3 + len(behind):
        raise ValueError(f"header line of {len(words)} fields: {line[:200]!r}")
    tail = words[len(words) - len(behind) :]
    front = words[: len(words) - len(behind)]
    dates = [i for i in range(2, len(front)) if re.fullmatch(r"\d{4,17}", front[i]) and re.fullmatch(r"(?=.*[.:])[0-9A-Fa-f.:]+|-", front[i - 1])]
    if not dates or not tail[-1].isdigit():
        raise ValueError(f"header line without date or length: {line[:200]!r}")
    at = dates[-1]
    known = {"URL": " ".join(front[: at - 1]), "IP-address": front[at - 1], "Archive-date": front[at], "Content-type": " ".join(front[at + 1 :])}
    return dict(zip(behind, tail, strict=True)) | known


def parse_arc(source: bytes | io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, content) of each record, the version block first, by the declared lengths.

    Offsets count unpacked bytes. A header line that can't be read, a record that is cut short and an unknown version
    raise ValueError.
    """
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    at, names = 0, None
    while line := stream.readline():
        begin, at = at, at + len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            continue
        length = text.rsplit(" ", 1)[-1]
        body = stream.read(int(length)) if length.isdigit() else b""
        at += len(body)
        if not length.isdigit() or len(body) < int(length):
            raise ValueError(f"record at {begin} is cut short")
        if names is None:
            head = body.decode("utf-8", "replace").split("\n")
            version = head[0].split(" ")[0]
            if version not in FIELDS:
                raise ValueError(f"unknown archive version {version}")
            names = (head[1].strip() if len(head) > 1 and head[1].strip() else FIELDS[version]).split(" ")
            yield begin, header_fields(text, FIELDS["1"].split(" ") if len(text.split(" ")) == 5 else names), body
        else:
            yield begin, header_fields(text, names), body


def _split_http(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(fields with lower-case names, head with its blank line, payload) of an HTTP message."""
    end = re.search(rb"\r?\n\r?\n", body)
    cut = end.end() if end else len(body)
    lines = re.split(r"\r?\n", body[:cut].decode("latin-1"))[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}, body[:cut], body[cut:]


def is_response(url: str, body: bytes) -> bool:
    """Whether a block is an HTTP response: it opens with a status line and its scheme has no other protocol."""
    return bool(re.match(rb"HTTP/\d(\.\d)? \d{3}", body)) and not re.match(r"(dns|ftp|gopher|nntp|whois|filedesc):", url.lower())


def _number(headers: dict[str, str], key: str) -> int | None:
    return int(headers[key]) if headers.get(key, "").isdigit() else None


def _framed(rows: Iterator[tuple], columns: str, sizes: int) -> Iterator[pd.DataFrame]:
    """Frames of rows that leave before column number ``sizes`` sums to more than FRAME bytes by more than one row."""
    out, size = [], 0
    frame = lambda: pd.DataFrame(out, columns=columns.split()).astype({"page_id": "Int64"})
    for row in rows:
        out.append(row)
        size += len(row[sizes] or b"") + 200
        if size >= FRAME:
            yield frame()
            out, size = [], 0
    yield frame()


ARC_COLUMNS = "page_id url ip date mime kind block archive at digest n_bytes"


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per record: page_id (an HTTP field X-Page-Id, else null), url, ip, date, mime, kind (warcinfo, response or
    resource), block (as archived; null unless asked for), archive, at, digest and n_bytes (of the payload: an HTTP
    message's body, else the block)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for pdf in batches:
                for file, content in zip(pdf["path"], pdf["content"], strict=True):
                    name = archive_name(file, path)
                    try:
                        for i, (at, h, body) in enumerate(parse_arc(_open(content))):
                            kind, headers, payload = "resource" if i else "warcinfo", {}, body
                            if is_response(h["URL"], body):
                                kind, (headers, _, payload) = "response", _split_http(body)
                            yield (
                                _number(headers, "x-page-id"), h["URL"], h["IP-address"], h["Archive-date"], h["Content-type"], kind,
                                body if blocks else None, name, at, payload_digest(payload), len(payload),
                            )
                    except ValueError as e:
                        raise ValueError(f"{file}: {e}") from e

        yield from _framed(records(), ARC_COLUMNS, 6)

    schema = "page_id long, url string, ip string, date string, mime string, kind string, block binary, archive string, at long, digest string, n_bytes long"
    return _files(spark, path).mapInPandas(run, schema)


# --- web archives


def record_id(archive: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{archive}:{at}')}>"


def _iso(date: str) -> str:
    d = date[:14] + DATE[len(date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(head: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert_record(r) -> bytes:
    """The WARC record of a row of read_arc with first_archive, first_at, first_url and first_date (null: none of equal payload)."""
    refers = isinstance(r.first_archive, str) and (r.first_archive, int(r.first_at)) != (r.archive, r.at)
    block = _split_http(r.block)[1] if refers else r.block
    head = {
        "WARC-Type": "revisit" if refers else r.kind,
        "WARC-Record-ID": record_id(r.archive, r.at),
        "WARC-Date": _iso(r.date),
    }
    if r.kind == "warcinfo":
        block = b"software: archive converter\r\nformat: WARC File Format 1.1\r\nisPartOf: %s\r\ndescription: converted from ARC version %s\r\n"
        block %= (r.url.encode(), r.block.split(b" ")[0])
        head |= {"WARC-Filename": r.archive, "WARC-Block-Digest": f"sha1:{payload_digest(block)}", "Content-Type": "application/warc-fields"}
        return warc_record(head, block)
    head |= {
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": f"sha1:{r.digest}",
        "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
        "Content-Type": "application/http; msgtype=response" if r.kind == "response" else r.mime or "application/octet-stream",
    }
    if r.ip in ("-", "0.0.0.0"):
        del head["WARC-IP-Address"]
    if refers:
        head |= {
            "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(r.first_archive, int(r.first_at)),
            "WARC-Refers-To-Target-URI": r.first_url, "WARC-Refers-To-Date": _iso(r.first_date),
        }
    return warc_record(head, block)


def arc_to_warc(spark: SparkSession, arc: str, warc: str, revisit_from: int = REVISIT_FROM) -> None:
    """Convert the ARC files of a folder into WARC files in another.

    Of responses with equal payloads of at least revisit_from bytes the one with the least page_id (null last), then the
    earliest in date and place, stays. Records shuffle only where the repeated digests are too many to broadcast.
    """
    index = materialize(read_arc(spark, arc, blocks=False).where("kind = 'response'").drop("block", "ip", "mime", "kind"), "arc-index")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "date", "archive", "at", "url")).alias("first")
    repeats = index.where(F.col("n_bytes") >= revisit_from).groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1")
    repeats = materialize(repeats.select(F.col("digest").alias("d"), "first.archive", "first.at", "first.url", "first.date"), "arc-repeats")
    repeats = repeats.select("d", *[F.col(c).alias(f"first_{c}") for c in ("archive", "at", "url", "date")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def opening(number: int) -> bytes:
            body = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
            name = uuid.uuid5(uuid.NAMESPACE_OID, f"info:{number}:{len(body)}")
            return warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": _iso(DATE), "Content-Type": "application/warc-fields"}, body)

        rows = (r for pdf in batches for r in pdf.itertuples(index=False))
        yield from _segments((lambda at, number, r=r: convert_record(r) for r in rows), opening)

    records = read_arc(spark, arc)
    joined = records.join(repeats, (records.digest == repeats.d) & (records.kind == "response"), "left")
    _write(joined.drop("d").mapInPandas(run, "value binary"), warc)


def parse_warc(source: bytes | io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with lower-case names, block) of each record, by the declared lengths."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = stream.read(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise ValueError(f"{head.get('warc-record-id')} is cut short")
        yield head, block


WARC_COLUMNS = "page_id record_id record_type refers_id payload_bytes payload_digest url date content_type"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses, resources and revisits: page_id, record_id, record_type, refers_id, payload_bytes (null for revisits, whose
    payload lies elsewhere), payload_digest, url, date, content_type.

    Digests of blocks, and of payloads that are there, are verified; a mismatch raises an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for pdf in batches:
                for content in pdf["content"]:
                    for head, block in parse_warc(_open(content)):
                        kind = head["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        http, payload = {}, block
                        if kind != "resource":
                            http, _, payload = _split_http(block)
                        digest = head["warc-payload-digest"].partition(":")[2]
                        if (kind != "revisit" and payload_digest(payload) != digest) or head["warc-block-digest"] != f"sha1:{payload_digest(block)}":
                            raise ValueError(f"digest mismatch in {head['warc-record-id']}")
                        yield (
                            _number(http, "x-page-id"), head["warc-record-id"], kind, head.get("warc-refers-to"), None if kind == "revisit" else len(payload),
                            digest, head["warc-target-uri"], head["warc-date"], head.get("content-type"),
                        )

        for frame in _framed(records(), WARC_COLUMNS, 6):
            yield frame.astype({"payload_bytes": "Int64"})

    schema = "page_id long, record_id string, record_type string, refers_id string, payload_bytes long, payload_digest string, url string, date string, content_type string"
    return _files(spark, path).mapInPandas(run, schema)


def convert_pages(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Round trip of (page_id, url, html) rows: written as ARC, converted to WARC, read back, references resolved.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id). Null html counts as
    empty, rows that repeat get a record each, and an empty table gives no rows. Extra columns are ignored. Ids are cast
    to long; one that is no number fails the job. URLs of other protocols (ftp:) make resources, which no record revisits.
    """
    spark = pages.sparkSession
    root = f"{scratch_root(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{root}/arc")
    arc_to_warc(spark, f"{root}/arc", f"{root}/warc", revisit_from)
    back = materialize(read_warc(spark, f"{root}/warc").drop("url", "date", "content_type"), "warc-index")
    referred = materialize(back.where("refers_id IS NOT NULL").select("refers_id").distinct(), "warc-referred")
    target = back.join(referred, back.record_id == referred.refers_id, "left_semi").select(
        F.col("record_id").alias("r"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n")
    )
    target = materialize(target, "warc-targets")
    return back.join(target, back.refers_id == target.r, "left").select(
        "page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111',
    '1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(hex, i, 1))]), '') AS b FROM p),
d AS (
  SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
      + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER w THEN NULL ELSE min(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY hex)
"""
