"""WARC archives: pages written as records, equal payloads as revisits, and a reader that salvages what a broken archive still holds.

Writing: each page is a response record with an HTTP head; of pages with equal payloads of at least `least` bytes that of the
largest id is the response and the others revisit it. Spark's text sink writes the archives, as any store takes them: a
record ends with two line ends, which are the sink's separator; a compressed record is a gzip member of under 2**24 bytes
(longer ones are several members), whose last byte, the high byte of its size, is zero and so is the separator.

Reading: a record must have a version line, well-formed named fields with type, id, date and length, all of its block, the
two line ends, and the digests that it names; a member must pass gzip's own checks. Where one fails, the reader looks for the
next gzip member or version line that starts a record which passes, goes on there, and logs the bytes between as a gap with
the reason. Whatever an archive holds, its records and gaps cover all of its bytes, but for a member that others continue.

An archive is one row of Spark's binaryFile source, which raises an error above 2 GB (spark.sql.sources.binaryFile.maxLength
lowers that); write_archives starts a new file after `rows` records. A task holds one archive and the member it reads.

Defined cases: null html is an empty payload, a null url is given as the record's id; a null page id is least, and rows of one
id and payload are all responses, or all revisits; an empty table makes archives without records; texts of any length are
whole; only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pegtrail.llm.batches import map_slices, picked, shared_dir, small_batches

#: Fixed values of the format.
VERSION, END, MAGIC = b"WARC/1.1\r\n", b"\r\n\r\n", b"\x1f\x8b\x08"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_FIELD = re.compile(r"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*)")
#: Uncompressed bytes of a member of a longer record; bytes that are given to the decompressor at a time.
MEMBER, FEED = 8 << 20, 1 << 16
#: Bytes of a record's head at most: a version line without an end of its fields is none.
HEAD = 1 << 20


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or with `refers_to` a revisit, with its last two line ends."""
    target = quote(url or record_id, safe="!#$%&'()*+,/:;=?@[]~-._")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if refers_to else payload)
    fields = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": target, "WARC-Payload-Digest": _sha1(payload), "WARC-Block-Digest": _sha1(block), "Content-Type": "application/http; msgtype=response"}
    if refers_to:
        fields |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": SAME_PAYLOAD}
    fields["Content-Length"] = str(len(block))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + END


def members(data: bytes) -> bytes:
    """The data as gzip members, each of at most MEMBER bytes before compression."""
    out = []
    for at in range(0, len(data), MEMBER):
        one = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [one.compress(data[at : at + MEMBER]), one.flush()]
    return b"".join(out)


def record_types(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, record_type and refers_to (a page id) of each page."""
    shared_dir(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("same", F.unhex(F.sha2("payload", 256)))
    copies = named.where(F.octet_length("payload") >= least).groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1").select("same", "last").checkpoint()
    marked = picked(named, copies, ["same"], "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return marked.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"))


def _urn(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def write_archives(typed: DataFrame, folder: str, compress: bool = True, rows: int = 20_000) -> None:
    """Archives of record_types() rows in `folder`, which any store of Spark's may hold, each of at most `rows` records."""

    def made():
        def build(part: pa.RecordBatch) -> dict:
            out = []
            for page_id, url, payload, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                data = record(_urn(page_id), url, payload, None if refers_to is None else _urn(refers_to))
                out.append(members(data)[:-1] if compress else data[: -len(END)])
            return {"data": pa.array(out, pa.binary())}

        return build

    data = map_slices(typed, ["page_id", "url", "payload", "refers_to"], "payload", "data binary", made)
    data.select(F.col("data").cast("string")).write.option("lineSep", "\0" if compress else END.decode()).option("maxRecordsPerFile", rows).text(folder)


class Bad(Exception):
    """Why no record that passes starts at a place."""


def _head(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The named fields (lower-case names) of the record at a version line, and where its block starts."""
    if not _VERSION.match(data, at):
        raise Bad("no version line")
    end = data.find(END, at, at + HEAD)
    if end < 0:
        raise Bad("head without an end")
    fields: dict[str, str] = {}
    name = ""
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and name:  # a folded line
            fields[name] += " " + line.strip()
        elif m := _FIELD.fullmatch(line):
            name = m[1].lower()
            fields[name] = m[2].strip()
        else:
            raise Bad("malformed field")
    if missing := [x for x in NEEDED if x not in fields]:
        raise Bad(f"no {missing[0]}")
    if not re.fullmatch(r"[0-9]{1,18}", fields["content-length"]):
        raise Bad("malformed content-length")
    return fields, end + len(END)


def _fits(digest: str | None, data: bytes) -> bool:
    """Whether data has the digest, if it is a SHA-1 in base 32 or hex; others aren't checked."""
    if digest is None or not digest.lower().startswith("sha1:"):
        return True
    value = digest[5:]
    own = hashlib.sha1(data)
    return value.upper() == base64.b32encode(own.digest()).decode() or value.lower() == own.hexdigest()


def _checked(fields: dict[str, str], block: bytes) -> dict:
    """The record's row, its digests verified."""
    if not _fits(fields.get("warc-block-digest"), block):
        raise Bad("block digest")
    kind, payload = fields["warc-type"].lower(), block
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, cut, payload = block.partition(END)
        if not cut:
            raise Bad("HTTP head without an end")
    digest = fields.get("warc-payload-digest")
    if kind != "revisit" and not _fits(digest, payload):
        raise Bad("payload digest")
    named = digest[5:] if digest and digest.lower().startswith("sha1:") else None
    if named and len(named) == 32:
        try:
            named = base64.b32decode(named.upper()).hex()
        except ValueError:
            raise Bad("malformed digest") from None
    whole = None if kind == "revisit" else len(payload)
    bare = lambda x: None if x is None else x.strip("<>")
    return {
        "record_type": kind, "record_id": bare(fields["warc-record-id"]), "target_uri": fields.get("warc-target-uri"), "refers_to": bare(fields.get("warc-refers-to")), "payload_bytes": whole,
        "payload_digest": named.lower() if kind == "revisit" and named else None if kind == "revisit" else hashlib.sha1(payload).hexdigest(), "payload": None if kind == "revisit" else payload,
    }


def _plain(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a version line, and where it ends."""
    fields, start = _head(data, at)
    end = start + int(fields["content-length"])
    if end + len(END) > len(data):
        raise Bad("cut short")
    if data[end : end + len(END)] != END:
        raise Bad("block without two line ends")
    return _checked(fields, data[start:end]), end + len(END)


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member holds, and where it ends."""
    if data[at : at + 3] != MAGIC:
        raise Bad("no member")
    one, out, to = zlib.decompressobj(31), [], at
    view = memoryview(data)
    try:
        while not one.eof:
            if to >= len(data):
                raise Bad("cut short")
            out.append(one.decompress(view[to : to + FEED]))
            to += FEED
    except zlib.error:
        raise Bad("gzip check") from None
    return b"".join(out), min(to, len(data)) - len(one.unused_data)


def _compressed(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of the member, and of those that continue it, and where they end."""
    text, to = _member(data, at)
    found, seen = [], 0
    while True:
        try:
            while seen < len(text):
                row, seen = _plain(text, seen)
                found.append(row)
            return found, to
        except Bad as bad:
            if not (str(bad) == "cut short" or str(bad) == "head without an end" and len(text) - seen < HEAD):
                raise
            # the record may go on in the next member, if that isn't the start of another
            fields, start = _head(text, seen)
            parts, held, need = [text[seen:]], len(text) - seen, start - seen + int(fields["content-length"]) + len(END)
            while held < need:
                more, to = _member(data, to)
                if _VERSION.match(more):
                    raise Bad("cut short") from None
                parts.append(more)
                held += len(more)
            text, seen = b"".join(parts), 0


def _records_at(data: bytes, at: int) -> tuple[list[dict], int]:
    if data[at : at + 3] == MAGIC:
        return _compressed(data, at)
    row, to = _plain(data, at)
    return [row], to


def scan(data: bytes) -> Iterator[dict]:
    """Rows of an archive's bytes in order: records, and gaps with a reason."""
    at = 0
    while at < len(data):
        try:
            found, to = _records_at(data, at)
        except Bad as bad:
            to, found = at, None
            while found is None:
                start = _START.search(data, to + 1)
                to = start.start() if start else len(data)
                if not start:
                    break
                try:
                    found, after = _records_at(data, to)
                except Bad:
                    pass
            yield {"kind": "gap", "offset": at, "length": to - at, "reason": str(bad)}
            if found is None:
                return
            at, to = to, after
        for row in found:
            yield {"kind": "record", "offset": at, "length": to - at} | row
        at = to


FIELDS = "archive string, kind string, offset long, length long, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
#: Rows and payload bytes of an output batch.
ROWS, BYTES = 1000, 4 << 20


def salvage(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """FIELDS: the records and gaps of all archives of a folder; payload_bytes is null for revisits, payload too without `payloads`."""
    small_batches(spark)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[f.split()[1]]) for n, f in zip(names, FIELDS.split(", "), strict=True)])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                archive, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for row in scan(data):
                    size += row.get("payload_bytes") or 0 if payloads else 0
                    held.append({"archive": archive} | (row if payloads else row | {"payload": None}))
                    if len(held) >= ROWS or size >= BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(run, FIELDS)


def resolved(read: DataFrame) -> DataFrame:
    """The records of narrow salvage() rows; a revisit has the payload_bytes of the response that it names, if that has its digest."""
    shared_dir(read.sparkSession)
    rows = read.where("kind = 'record'").select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest").checkpoint()
    again = rows.where("record_type = 'revisit'").drop("payload_bytes")
    named = again.select(F.col("refers_to").alias("record_id"), "payload_digest").distinct()
    there = rows.where("record_type <> 'revisit'").join(named, ["record_id", "payload_digest"], "left_semi").groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes")).checkpoint()
    return rows.where("record_type <> 'revisit'").unionByName(picked(again, there, ["refers_to", "payload_digest"], "left").select(*rows.columns))


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, from archives written in the shared folder and read again."""
    spark = pages.sparkSession
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(record_types(pages, least), folder)
    number = lambda c: F.try_to_number(F.regexp_extract(c, r"^urn:page:(-?[0-9]+)$", 1), F.lit("S9999999999999999999")).cast("long")
    found = resolved(salvage(spark, folder, payloads=False))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: round_trip() of the table pages.
ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
m as (select *, max(case when octet_length(payload) >= 1000 then page_id end) over (partition by payload) as last from p)
select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest, case when last is null or page_id is not distinct from last then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from last then last end as refers_to from m
"""
