"""Legacy ARC archives converted to WARC, and both formats read and written by Spark.

An ARC file opens with a version block whose last line names the fields of its records' header lines: version 1 has five, version 2 ten.
The converter parses each header line by its version, takes the declared length of bytes, and makes from it the WARC fields that ARC lacks:
a record id (a name-based UUID, so reruns agree), an ISO time, the record type, block and payload digests.

Equal payloads of at least `LEAST` bytes are stored once: the record with the largest page id is the response and the others revisit it.
Digests are counted by a shuffle of (digest, page id) alone, and only the digests that occur more than once are joined back, under SALTS keys
each, so a payload that a third of all pages share is spread; payloads are shuffled only if that table is too large to broadcast.

Files are written by Spark's text writer, one row a record and one file a task, compressed by gzip at its fastest level; what ends a record in
the format is the writer's line separator. They are read as binary files and unpacked record by record, so a task holds one packed file and
one record at a time. Both work wherever Spark's file systems do.

Defined results: null html is the empty payload; a null url is "about:blank", white space in urls is escaped; a null page_id stays null and counts as the
smallest; rows that repeat both page_id and payload share one type; extra columns are ignored; empty input gives empty output.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Page-Id"

LEAST = 1000
#: Characters of records handed on together; keys that a payload with copies is joined by.
HANDED, SALTS = 4_000_000, 32
#: When pages were taken, if nothing says so.
TAKEN = "20240101000000"

PARSED = "page_id long, uri string, ip string, taken string, mime string, http string, payload string, n long, digest string, record_id string"


def _escaped(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "about:blank"


def _handed(records: Iterable[str]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for x in records:
        held.append(x)
        size += len(x)
        if size >= HANDED:
            yield pd.DataFrame({"value": held})
            held, size = [], 0
    if held:
        yield pd.DataFrame({"value": held})


def _write(records: DataFrame, path: str, ending: str) -> str:
    """One record per row of the column `value`; the writer ends each with `ending`."""
    with common.shuffles_removed(records.sparkSession):
        records.write.option("lineSep", ending).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _opened(content: bytes) -> BinaryIO:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def arc_opening(version: int) -> str:
    block = f"{version} 0 basketry\n{' '.join(ARC_FIELDS[version])}\n\n"
    values = {"URL": "filedesc://pages.arc", "IP-address": "0.0.0.0", "Archive-date": TAKEN, "Content-type": "text/plain", "Result-code": "200", "Archive-length": str(len(block))}
    return " ".join(values.get(x, "-") for x in ARC_FIELDS[version]) + "\n" + block


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None) -> str:
    body = html or ""
    named = "" if page_id is None else f"{ID_HEADER}: {page_id}\r\n"
    content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(body.encode())}\r\n\r\n{body}"
    values = {"URL": _escaped(url), "IP-address": "0.0.0.0", "Archive-date": TAKEN, "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(content.encode()))}
    return " ".join(values.get(x, "-") for x in ARC_FIELDS[version]) + "\n" + content


def write_arc(pages: DataFrame, path: str) -> str:
    """The pages as ARC files; versions 1 and 2 take turns by batch, each with a version block of its own."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[str]:
        version = 1
        for batch in batches:
            yield arc_opening(version)
            for i, u, h in zip(batch["page_id"], batch["url"], batch["html"]):
                yield arc_record(version, None if pd.isna(i) else int(i), u, h)
            version = 3 - version

    rows = pages.select(F.col("page_id").cast("string"), "url", "html")
    return _write(rows.mapInPandas(lambda batches: _handed(records(batches)), "value string"), path, "\n")


def arc_records(data: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record that is no version block; fields are named as the last version block's last line names them."""
    fields = ARC_FIELDS[1]
    while raw := data.readline():
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not line:
            continue
        content = data.read(int(line.rpartition(" ")[2]))
        if line.startswith("filedesc://"):
            version = int(content.split(b" ", 1)[0])
            fields = ARC_FIELDS.get(version) or content.split(b"\n")[1].decode().split()
            continue
        rest = line.rsplit(" ", len(fields) - 1)  # from the right: urls of old archives may hold spaces
        yield dict(zip(fields, rest)), content


def _http(content: bytes) -> tuple[str, bytes, dict[str, str]]:
    """(head with its blank line, payload, header fields by lower-case name) of an HTTP response; other content is all payload."""
    if not content.startswith(b"HTTP/"):
        return "", content, {}
    ends = [(content.find(x), len(x)) for x in (b"\r\n\r\n", b"\n\n")]
    found = min(((i, n) for i, n in ends if i >= 0), default=(len(content), 0))
    head = content[: found[0] + found[1]].decode("latin-1")
    named = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.splitlines()[1:]) if v)
    return head, content[found[0] + found[1] :], named


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the ARC files at path, with what its WARC record will need. Payloads are text (UTF-8); without them the column is null."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for fields, body in arc_records(_opened(content)):
                    head, payload, named = _http(body)
                    digest = hashlib.sha1(payload).hexdigest()
                    page = named.get(ID_HEADER.lower())
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['URL']} {fields['Archive-date']} {page} {digest}")
                    rows.append((int(page) if page else None, fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], head, payload.decode("utf-8", "replace") if payloads else None, len(payload), digest, str(name)))
                    size += len(payload)
                    if payloads and size >= HANDED:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)

    return _read(spark, path).mapInPandas(parsed, PARSED)


def _frame(rows: list[tuple], columns: str = PARSED) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in columns.split(", ")])
    return out.astype({c: "Int64" for c in ("page_id", "refers_page") if c in out})


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _iso(taken: str) -> str:
    t = (taken + "0" * 14)[:14]
    return f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"


def warc_record(row) -> str:
    """One WARC record of a parsed ARC row; with refers_id it is a revisit, whose block is the HTTP head alone."""
    revisit = isinstance(row.refers_id, str)
    block = row.http if revisit else row.http + row.payload
    raw = block.encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{row.record_id}>",
        f"WARC-Date: {_iso(row.taken)}",
        f"WARC-Target-URI: {row.uri}",
        f"WARC-IP-Address: {row.ip}",
        f"WARC-Payload-Digest: {_base32(row.digest)}",
        f"WARC-Block-Digest: {_base32(hashlib.sha1(raw).hexdigest())}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:uuid:{row.refers_id}>", f"WARC-Refers-To-Target-URI: {row.refers_uri}", f"WARC-Refers-To-Date: {_iso(row.refers_taken)}"]
    head += [f"Content-Type: {'application/http;msgtype=response' if row.http else row.mime}", f"Content-Length: {len(raw)}"]
    return "\r\n".join(head) + "\r\n\r\n" + block


def warc_opening() -> str:
    block = "software: basketry\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, block)
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {_iso(TAKEN)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n{block}"


def originals(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, n, refers_id, refers_uri, refers_taken, refers_page) of payloads of at least `least` bytes that occur more than once."""
    best = F.max(F.struct(F.col("page_id").alias("refers_page"), F.col("record_id").alias("refers_id"), F.col("uri").alias("refers_uri"), F.col("taken").alias("refers_taken")))
    groups = records.where(F.col("n") >= least).groupBy("digest", "n").agg(F.count(F.lit(1)).alias("copies"), best.alias("best"))
    return groups.where("copies > 1").select("digest", "n", "best.*")


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _under_salts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST) -> str:
    """ARC files to WARC files."""
    first = common.cut(originals(read_arc(spark, arc_path, payloads=False), least))
    rows = _salted(read_arc(spark, arc_path), "record_id").join(_under_salts(first), ["digest", "n", "salt"], "left")
    own = F.col("refers_page").eqNullSafe(F.col("page_id"))
    rows = rows.withColumns({c: F.when(~own, F.col(c)) for c in ("refers_id", "refers_uri", "refers_taken")})
    rows = rows.withColumn("payload", F.when(F.col("refers_id").isNull(), F.col("payload"))).drop("refers_page", "page_id", "salt")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[str]:
        yield warc_opening()
        for batch in batches:
            yield from map(warc_record, batch.itertuples())

    return _write(rows.mapInPandas(lambda batches: _handed(records(batches)), "value string"), warc_path, "\r\n\r\n")


def warc_records(data: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record."""
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            continue
        lines = iter(lambda: data.readline().decode("utf-8", "replace").strip(), "")
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
        yield fields, data.read(int(fields["content-length"]))


READ = "page_id long, record_id string, record_type string, uri string, taken string, payload string, n long, digest string, refers_id string"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per response or revisit of the WARC files at path; n is the length of the full payload, also of revisits."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for fields, block in warc_records(_opened(content)):
                    if (kind := fields["warc-type"]) not in ("response", "revisit"):
                        continue
                    _, payload, named = _http(block)
                    if kind == "response":
                        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        n, digest = int(named["content-length"]), base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    page = named.get(ID_HEADER.lower())
                    name = lambda k: fields[k][len("<urn:uuid:") : -1] if k in fields else None
                    rows.append((int(page) if page else None, name("warc-record-id"), kind, fields["warc-target-uri"], fields["warc-date"], payload.decode("utf-8", "replace") if payloads and kind == "response" else None, n, digest, name("warc-refers-to")))
                    size += len(payload)
                    if payloads and size >= HANDED:
                        yield _frame(rows, READ)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, READ)

    return _read(spark, path).mapInPandas(parsed, READ)


def archive(pages: DataFrame, least: int = LEAST) -> str:
    """The pages as WARC files by way of ARC; returns the folder."""
    spark = pages.sparkSession
    folder = f"{common.shared_folder(spark)}/{uuid.uuid4().hex}"
    return convert(spark, write_arc(pages, f"{folder}/arc"), f"{folder}/warc", least)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as its archive has it."""
    rows = common.cut(read_warc(pages.sparkSession, archive(pages, least), payloads=False).drop("uri", "taken", "payload"))
    said = [F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type"]
    revisits = _salted(rows.where("record_type = 'revisit'").withColumnRenamed("refers_id", "named"), "record_id")
    wanted = revisits.select("named").distinct()
    named = rows.where("record_type = 'response'").join(wanted, F.col("record_id") == F.col("named"), "left_semi")
    named = _under_salts(named.groupBy(F.col("record_id").alias("named")).agg(F.max("page_id").alias("refers_to")))
    revisits = revisits.join(named, ["named", "salt"], "left").select("page_id", *said, "refers_to")
    return rows.where("record_type = 'response'").select("page_id", *said, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
