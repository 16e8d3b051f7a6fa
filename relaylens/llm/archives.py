"""Legacy ARC archives, their conversion to WARC, and reading WARC back.

An ARC file opens with a version block that names the fields of the record headers (five in
version 1, ten in version 2); every record is one header line and as many bytes as its last field
declares. The converter reads both versions and synthesises for each record a WARC identifier,
timestamp, type and digests. Records whose payloads are equal and of at least ``LEAST`` bytes are
written once: the first by its number (a header field that the caller names) stays a response, the
others become revisits that refer to it.

Archives are written by Spark's text writer, record by record with the format's own separator,
and read as whole binary files, so any store that Spark reaches will do. Files are cut after
a number of records that makes them ``FILE_BYTES`` on average, since a task holds one at a time;
only a single larger record makes a larger one. Payloads are not shuffled, unless there are over
``SENT`` revisits, when archives meet the lists of their revisits in a shuffled join.

Null payloads are empty; a null url becomes ``UNKNOWN``; blanks in urls are escaped; a record
without number comes last among equals and reads back with a null number. Dates of 12 digits lack
seconds; a date that cannot be read becomes ``CLOCK``. A line that is no header is
skipped; a record cut off by the end of its file is dropped. Empty tables give empty archives.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from relaylens.llm.common import written
from relaylens.session import scratch_path

LEAST = 100  # bytes of a payload from which on equal ones are written once
FILE_BYTES = 16 << 20
SENT = 200_000  # revisits that are sent to all tasks: at most some 30 MB
UNKNOWN = "http://unknown.invalid/"
CLOCK = "20240101000000"
NUMBER = "X-Record-Number"
#: The header fields of both versions and the profile of revisits.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
             "Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_META = ("path string, offset long, record_id string, url string, date string, "
            "payload_bytes long, payload_digest string, number long")
WARC_META = ("record_id string, type string, url string, date string, payload_bytes long, "
             "payload_digest string, number long, refers_to_number long, refers_to string")


def escaped(url: str | None) -> str:
    """A url without blanks and line ends, which would break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else UNKNOWN


def http_block(payload: bytes, number: int | None) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
             f"Content-Length: {len(payload)}"]
    if number is not None:
        lines.append(f"{NUMBER}: {number}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 relaylens\n{FIELDS[version]}\n".encode()
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {CLOCK} text/plain{more} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, url: str, block: bytes, offset: int) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {CLOCK} text/html{more} {len(block)}\n".encode() + block


def per_file(sizes: DataFrame) -> int:
    """Records a file, from (n records, sum of bytes)."""
    row = sizes.first()
    mean = (row["bytes"] or 0) / max(row["n"], 1) + 300
    return max(1, int(FILE_BYTES / mean))


def _text(frame: DataFrame, path: str, separator: str, records: int) -> None:
    frame.select(F.col("value").cast("string")).write.option("lineSep", separator).option(
        "maxRecordsPerFile", records).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """Archives of (page_id, url, html): even partitions in version 1, odd ones in version 2."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    records = per_file(rows.agg(F.count(F.lit(1)).alias("n"),
                                F.sum(F.octet_length("payload")).alias("bytes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, seen, offset = 1 + part % 2, 0, 0
        for batch in batches:
            out = []
            for number, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"pages-{part}-{seen // max(records - 1, 1)}.arc"
                if seen % max(records - 1, 1) == 0:  # a new file starts with its version
                    out.append(version_block(version, name))
                    offset = len(out[-1]) + 1
                out.append(arc_record(version, name, escaped(url),
                                      http_block(payload, number), offset))
                offset += len(out[-1]) + 1
                seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _text(rows.mapInArrow(run, "value binary"), path, "\n",
          max(records, 2) if records > 1 else 2)


def unpacked(content: bytes) -> bytes:
    """The bytes of a file, out of any number of gzip members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def iso_date(date: str, other: str = CLOCK) -> str:
    """``YYYY-MM-DDThh:mm:ssZ`` of 14 digits, or 12 without seconds."""
    if re.fullmatch(r"\d{12}", date):
        date += "00"
    if not re.fullmatch(r"\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([01]\d|2[0-3])[0-5]\d[0-5]\d",
                        date):
        date = other
    return (f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z")


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record after the version block."""
    names, pos = FIELDS[1].split(), 0
    while pos < len(data):
        end = data.find(b"\n", pos)
        if end < 0:
            return
        line, start = data[pos:end].decode("utf-8", "replace"), pos
        pos = end + 1
        if line.startswith("filedesc://"):
            size = line.rsplit(" ", 1)[-1]
            if size.isdigit():
                lines = data[pos:pos + int(size)].decode("utf-8", "replace").split("\n")
                if len(lines) > 1 and lines[1].startswith("URL "):
                    names = lines[1].split()
                yield start, {"URL": line.split(" ")[0], "Archive-date": line.split(" ")[2]
                              if line.count(" ") > 2 else CLOCK}, data[pos:pos + int(size)]
                pos += int(size)
            continue
        parts = line.rsplit(" ", len(names) - 1)  # an unescaped url may hold blanks
        if len(parts) != len(names) or not parts[-1].isdigit():
            continue
        size = int(parts[-1])
        if pos + size > len(data):
            return
        yield start, dict(zip(names, parts)), data[pos:pos + size]
        pos += size


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head, payload and header fields of an HTTP response; other blocks are all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    cut = block.find(b"\r\n\r\n")
    if cut < 0:
        return block, b"", {}
    head = block[:cut + 4]
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:]
                  if ": " in x)
    return head, block[cut + 4:], fields


def as_number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None


def record_name(path: str, url: str, offset: int, block_digest: str) -> str:
    """The same record of a file gets the same identifier whenever it is converted."""
    place = f"{path.rsplit('/', 1)[-1]} {offset} {url} {block_digest}"
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}"


def described(path: str, offset: int, fields: dict[str, str], block: bytes) -> dict:
    """What the converter needs to know of an ARC record."""
    head, payload, http = http_parts(block)
    url, date = fields["URL"], iso_date(fields.get("Archive-date", ""))
    digest = hashlib.sha256(block).hexdigest()
    kind = ("warcinfo" if url.startswith("filedesc:") else "response" if head else "resource")
    return {"offset": offset, "url": url, "date": date, "kind": kind, "head": head,
            "payload": payload, "block_digest": digest, "mime": fields.get("Content-type", "-"),
            "ip": fields.get("IP-address", "-"), "number": as_number(http.get(NUMBER)),
            "payload_digest": hashlib.sha256(payload).hexdigest(),
            "record_id": record_name(path, url, offset, digest)}


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        path).select("path", "content")


def arc_meta(archives: DataFrame) -> DataFrame:
    """Places, names and payload digests of the response records of all archives."""
    kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()),
                       ("url", pa.string()), ("date", pa.string()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("number", pa.int64())])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for record in arc_records(unpacked(content.as_py())):
                    r = described(path, *record)
                    if r["kind"] == "response":
                        rows.append({"path": path, "payload_bytes": len(r["payload"])}
                                    | {k: r[k] for k in ("offset", "record_id", "url", "date",
                                                         "payload_digest", "number")})
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return archives.mapInArrow(run, ARC_META)


def revisits(meta: DataFrame, least: int = LEAST) -> DataFrame:
    """(path, offset, to): records with an earlier one of equal payload, and that one."""
    place = F.struct(F.coalesce("number", F.lit((1 << 63) - 1)).alias("order"), "record_id",
                     "url", "date", "number")
    large = meta.filter(F.col("payload_bytes") >= least)
    firsts = large.groupBy("payload_digest").agg(
        F.min(place).alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return large.join(firsts, "payload_digest").filter(
        F.col("record_id") != F.col("to.record_id")).select("path", "offset", "to")


def warc_head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def warc_record(r: dict, to: dict | None) -> bytes:
    """The WARC record of a described ARC record, without the separator that follows it."""
    kind, block = r["kind"], r["head"] + r["payload"]
    if to is not None:
        kind, block = "revisit", r["head"]
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{r['record_id']}>"),
              ("WARC-Date", r["date"])]
    if kind != "warcinfo":
        fields += [("WARC-Target-URI", r["url"]),
                   ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}")]
        if r["ip"] not in ("-", "0.0.0.0"):
            fields.append(("WARC-IP-Address", r["ip"]))
    if to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{to['record_id']}>"),
                   ("WARC-Refers-To-Target-URI", to["url"]),
                   ("WARC-Refers-To-Date", to["date"])]
        if to["number"] is not None:
            fields.append((f"{NUMBER}-Referred", str(to["number"])))
    mime = {"warcinfo": "text/plain", "resource": r["mime"]}.get(
        kind, "application/http; msgtype=response")
    fields += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return warc_head(fields) + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST) -> None:
    """Writes the records of all ARC files below a path as WARC files."""
    archives = files(spark, arc_path)
    meta = written(arc_meta(archives), "arc-meta")
    again = written(revisits(meta, least), "revisits")
    lists = again.groupBy("path").agg(F.collect_list(F.struct("offset", "to")).alias("again"))
    if again.count() <= SENT:
        lists = F.broadcast(lists)
    both = archives.join(lists, "path", "left").select("path", "content", "again")
    records = per_file(meta.agg(F.count(F.lit(1)).alias("n"),
                                F.sum("payload_bytes").alias("bytes")))

    def run(batches):
        for batch in batches:
            for path, content, known in zip(*batch.columns):
                to = {x["offset"]: x["to"] for x in known.as_py() or []}
                out = []
                for record in arc_records(unpacked(content.as_py())):
                    r = described(path.as_py(), *record)
                    out.append(warc_record(r, to.get(r["offset"])))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out = []
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _text(both.mapInArrow(run, "value binary"), warc_path, "\r\n\r\n", records + 1)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths."""
    pos = 0
    while True:
        while data[pos:pos + 2] == b"\r\n":
            pos += 2
        cut = data.find(b"\r\n\r\n", pos)
        if not data.startswith(b"WARC/", pos) or cut < 0:
            return
        fields = dict(x.split(": ", 1) for x in
                      data[pos:cut].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        size = int(fields.get("Content-Length", "0"))
        yield fields, data[cut + 4:cut + 4 + size]
        pos = cut + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records below a path. Digests of responses are those of the
    payloads that were read; a payload that differs from its declared digest is an error."""
    kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()),
                       ("date", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("number", pa.int64()),
                       ("refers_to_number", pa.int64()), ("refers_to", pa.string())])

    def row(fields: dict[str, str], block: bytes) -> dict:
        kind, (_, payload, http) = fields["WARC-Type"], http_parts(block)
        declared = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        size, digest = len(payload), declared
        if kind == "revisit":
            size = int(http.get("Content-Length", "0"))
        elif (digest := hashlib.sha256(payload).hexdigest()) != declared:
            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
        return {"record_id": fields["WARC-Record-ID"].strip("<>"), "type": kind,
                "url": fields.get("WARC-Target-URI"), "date": fields.get("WARC-Date"),
                "payload_bytes": size, "payload_digest": digest,
                "number": as_number(http.get(NUMBER)),
                "refers_to_number": as_number(fields.get(f"{NUMBER}-Referred")),
                "refers_to": fields.get("WARC-Refers-To", "").strip("<>") or None}

    def run(batches):
        for batch in batches:
            for content in batch.column(1):
                yield pa.RecordBatch.from_pylist(
                    [row(*r) for r in warc_records(unpacked(content.as_py()))
                     if r[0].get("WARC-Type") in ("response", "revisit")], kinds)

    return files(spark, path).mapInArrow(run, WARC_META)


def through_archives(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back, a row for each."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "llm-arc"), scratch_path(spark, "llm-warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
