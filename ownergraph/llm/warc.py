"""WARC archives: a writer and a sequential reader.

Every page becomes one record, each record one gzip member. Of the pages with the
same payload the one with the largest page_id is stored as ``response``, the
others as ``revisit`` records that refer to it (identical-payload-digest profile:
the HTTP head with the full payload's length, no payload). Smaller payloads than
``least_bytes`` are always responses.

The reader goes through a file from front to back with an incremental zlib
decompressor, member by member, takes the header up to the blank line, exactly
Content-Length bytes of block and the closing blank lines, and verifies block and
payload digests; anything else raises. A record larger than the read size is put
together from several reads; memory is bounded by the largest record.

Null html is an empty payload. Repeated page_ids: one of the rows with the largest
page_id is the response, the others are revisits that refer to that page_id. A
null page_id is the smallest; a null url is written as an empty target. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.llm.token_files import SharedFolder, qualified
from ownergraph.session import scratch_path

VERSION = b"WARC/1.1"
# Fixed value: the profile of revisits whose payload equals an earlier one.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WHEN = "2000-01-01T00:00:00Z"  # pages carry no capture time
READ_BYTES = 1 << 20
OUT_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _urn(page_id: int | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def _page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", WHEN),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + digest32(payload)),
        ("WARC-Block-Digest", "sha1:" + digest32(block)),
        *([("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", SAME_PAYLOAD)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + text + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a byte stream, one after the other."""
    unpack, out, fresh = zlib.decompressobj(31), [], True
    for data in blocks:
        while data:
            out.append(unpack.decompress(data))
            fresh = False
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(out)
                unpack, out, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise ValueError("the archive ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, blank, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record header")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: its length is not {size}")
    if fields.get("warc-block-digest") != "sha1:" + digest32(block):
        raise ValueError(f"record {fields.get('warc-record-id')}: block digest differs")
    return fields, block


def page(fields: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page_id, full payload length, payload digest, type, refers_to, payload
    (None for revisits) of a verified record."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    own = _page_of(fields["warc-record-id"])
    if kind == "revisit":
        return own, size, digest, kind, _page_of(fields["warc-refers-to"]), None
    if len(payload) != size or digest32(payload) != digest:
        raise ValueError(f"record {fields['warc-record-id']}: payload digest differs")
    return own, size, digest, kind, None, payload


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, refers_to, revisit)``: which row of each payload is
    the response. Only digests, ids and counts are grouped (pre-aggregated); the
    pages meet them in a join on the digest, which a hot payload lets AQE split.
    ``monotonically_increasing_id`` tells equal rows apart: the input must be a
    table that gives the same rows in the same order when read again."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("__row"),
    ).withColumn("__digest", F.unhex(F.sha1("html")))
    best = (
        own.where(F.octet_length("html") >= least_bytes)
        .groupBy("__digest")
        .agg(F.max(F.struct(F.col("page_id"), F.col("__row"))).alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select("__digest", F.col("best.page_id").alias("__page"), F.col("best.__row").alias("__best"))
    )
    revisit = F.col("__best").isNotNull() & (F.col("__best") != F.col("__row"))
    return own.join(best, "__digest", "left").select(
        "page_id", "url", "html", F.when(revisit, F.col("__page")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write one archive per task into the shared ``folder``; returns
    ``(name, records, bytes)`` per archive."""
    folder = qualified(pages.sparkSession, folder)

    def write(batches):
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        n = 0

        def blocks():
            nonlocal n
            for batch in batches:
                for row in batch.to_pylist():
                    n += 1
                    yield record(row["page_id"], row["url"], row["html"].encode("utf-8", "replace"), row["refers_to"], row["revisit"])

        size = SharedFolder(folder).write(name, blocks())
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [n], "bytes": [size]})

    return marked(pages, least_bytes).mapInArrow(write, "name string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives named in ``archives(name, records)``."""
    folder = qualified(archives.sparkSession, folder)

    def read(batches):
        store = SharedFolder(folder)
        for batch in batches:
            for name, records in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist()):
                raw = store.array(name, np.dtype("u1"))
                rows, n = [], 0
                for member in members(raw[i : i + READ_BYTES].tobytes() for i in range(0, len(raw), READ_BYTES)):
                    rows.append(page(*parse(member))[:5])
                    n += 1
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                if n != records:
                    raise ValueError(f"{name}: {n} records read, {records} written")
                if rows:
                    yield _rows(rows)

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.repartition(n).mapInArrow(read, OUT_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in OUT_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives, then read them back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    done = write_archives(pages, folder, least_bytes).collect()  # a row per archive
    archives = pages.sparkSession.createDataFrame(done, "name string, records long, bytes long")
    return read_archives(archives, folder)
