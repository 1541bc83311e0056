"""WARC archives: writing, and normalising archives that are one gzip stream as a whole.

``write_archives`` writes one archive per partition in the form crawlers often leave behind: a
single gzip stream around all records. ``normalise`` inflates such a stream once from
start to end, writes every record as a gzip member of its own and a sidecar index
of the members' offsets. ``read_records`` then opens members at their offsets, so that a
record is reached without inflating what stands before it.

Of records with equal payloads of at least ``least_bytes`` the one with the smallest id is a
response, the others are revisits without payload that refer to it.

Defined results: a null html is an empty payload; a null page_id is written as such, counts as
the largest id and is read back as null; rows that repeat are records of their own, and if
the smallest id itself repeats, all its records are responses, since none can refer to
itself; an empty table gives no archives; other columns are not written.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrilake.llm.files import open_input, open_output
from sentrilake.session import cut, shared_path

LEAST_BYTES = 100
_LEVEL = 6
_CHUNK = 1 << 18
_DATE = "2024-01-01T00:00:00Z"
_ENTRY = struct.Struct("<qq")
_GZIP = 31  # window bits of zlib for a gzip wrapper


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) to page_id, url, html, digest, first_id, revisit.

    Only digests and ids are shuffled for the search of equal payloads. Its rows are pre-aggregated
    per (digest, page_id), and digests that stand alone go no further."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    small = F.octet_length("html") < least_bytes
    per_id = rows.where(~small).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    per_digest = per_id.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.sum("n").alias("n"))
    copied = cut(per_digest.where("n > 1").select("digest", "first_id"))
    joined = rows.join(copied.withColumnRenamed("digest", "copied_digest"),
                       F.when(~small, F.col("digest")) == F.col("copied_digest"), "left")
    revisit = F.col("copied_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("revisit", revisit).drop("copied_digest")


def _head(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record(page_id, url, html: bytes, digest: str, revisit: bool, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    number = "none" if page_id is None else page_id
    return _head(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:page:{number}>"),
            ("WARC-Date", _DATE),
            ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%")),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("X-Payload-Length", len(html)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
            ("WARC-Refers-To", f"<urn:page:{'none' if refers_to is None else refers_to}>" if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        http if revisit else http + html,
    )


def write_archives(records: DataFrame) -> DataFrame:
    """Write planned records; each partition becomes one archive, a single gzip stream. Returns the
    paths and the numbers of records."""
    folder = shared_path(records.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, n = None, 0
        for batch in batches:
            if file is None:
                file, path = open_output(folder, "crawl.warc.gz")
                packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
                file.write(packer.compress(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"),
                                                  ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")],
                                                 b"software: sentrilake\r\n")))
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    file.write(packer.compress(_record(row["page_id"], row["url"], row["html"], row["digest"],
                                                       row["revisit"], row["first_id"])))
            n += batch.num_rows
        if file is not None:
            file.write(packer.flush())
            file.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    wanted = records.select("page_id", "url", "html", "digest", "revisit", "first_id")
    return cut(wanted.mapInArrow(write, "path string, n_records long"))


class RecordStream:
    """Whole records of a gzip file, one after the other. Works for one stream around everything
    as for one member per record; memory is bound by the largest record."""

    def __init__(self, file):
        self.file, self.inflate, self.data, self.rest = file, zlib.decompressobj(_GZIP), bytearray(), b""
        self.inside = False  # a gzip stream has begun and not ended

    def _more(self) -> bool:
        raw = self.rest or self.file.read(_CHUNK)
        if not raw and not self.inside:
            return False
        self.inside = True
        self.data += self.inflate.decompress(raw, 4 * _CHUNK) if raw else self.inflate.flush()
        if not raw and not self.inflate.eof:
            raise ValueError("the gzip stream is cut off")
        self.rest = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.rest, self.inflate, self.inside = self.inflate.unused_data, zlib.decompressobj(_GZIP), False
        return True

    def __iter__(self) -> Iterator[bytes]:
        while True:
            while (end := self.data.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.data:
                        raise ValueError("the archive ends inside a record")
                    return
            size = end + 4 + content_length(bytes(self.data[:end])) + 4
            while len(self.data) < size:
                if not self._more():
                    raise ValueError("the archive ends inside a record")
            record = bytes(self.data[:size])
            if not record.startswith(b"WARC/") or not record.endswith(b"\r\n\r\n"):
                raise ValueError("no WARC record where one should begin")
            del self.data[:size]
            yield record


def content_length(head: bytes) -> int:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    raise ValueError("a record without Content-Length")


def gzip_member(record: bytes) -> bytes:
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
    return packer.compress(record) + packer.flush()


def index_entry(offset: int, length: int) -> bytes:
    return _ENTRY.pack(offset, length)


def index_entries(data: bytes) -> list[tuple[int, int]]:
    return list(_ENTRY.iter_unpack(data))


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite archives (path): one gzip member per record and a sidecar index of (offset, length).
    One archive is one task's stream; returns path, index_path, n_records."""
    folder = shared_path(archives.sparkSession, "warc-members")
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                out, member_path = open_output(folder, "members.warc.gz")
                index, index_path = open_output(folder, "members.idx")
                at, n = 0, 0
                with open_input(path) as file:
                    for record in RecordStream(file):
                        member = gzip_member(record)
                        out.write(member)
                        index.write(index_entry(at, len(member)))
                        at, n = at + len(member), n + 1
                out.close()
                index.close()
                yield pa.RecordBatch.from_pydict({"path": [member_path], "index_path": [index_path], "n_records": [n]})

    dealt = archives.select("path").repartition(tasks)
    return cut(dealt.mapInArrow(rewrite, "path string, index_path string, n_records long"))


def read_member(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    inflate = zlib.decompressobj(_GZIP)
    record = inflate.decompress(file.read(length))
    if not inflate.eof:
        raise ValueError("a member that is cut off")
    return record


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload; the HTTP head is taken off."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = block[: int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return fields, block


def read_records(members: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every page record of normalised archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to and, if wanted, payload. Length and digest of a response are those
    of the bytes that were read, and must be those of its header."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if with_payload:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], f"{schema}, payload binary"
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def number(urn: str | None) -> int | None:
        return None if urn is None or urn == "<urn:page:none>" else int(urn[len("<urn:page:") : -1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index_path in zip(batch["path"].to_pylist(), batch["index_path"].to_pylist()):
                with open_input(index_path) as file:
                    entries = index_entries(file.read())
                with open_input(path) as file:
                    for start in range(0, len(entries), 64):
                        rows = []
                        for offset, length in entries[start : start + 64]:
                            fields, payload = parse_record(read_member(file, offset, length))
                            kind = fields["warc-type"]
                            if kind not in ("response", "revisit"):
                                continue
                            size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"][7:]
                            if kind == "response" and (size, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
                                raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                            row = (number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to")))
                            rows.append((*row, payload) if with_payload else row)
                        if rows:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names
                            )

    return members.select("path", "index_path").repartition(tasks).mapInArrow(read, schema)


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages to archives of one stream each, and on to normalised archives with their index."""
    return normalise(write_archives(plan_records(pages, least_bytes)))
