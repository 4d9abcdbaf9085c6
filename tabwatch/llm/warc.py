"""WARC archives through a chunked record table.

Writing. A payload becomes rows (record, chunk number, bytes): no row but the source's
own is larger than a chunk, and every chunk carries the digest of its record's payload
up to its end, taken on by one running hash, so the last chunk knows the payload's
length and digest. Records whose payloads are equal (length, SHA-1 and a second hash)
and of at least ``min_bytes`` keep one payload: the record of the largest page_id is the
response, the others are revisits of it. A chunk is written as one WARC record: the
first as the response, the next ones as its continuations (WARC segments), so no
reader needs more memory than a chunk, and a long record may lie in many tasks.

Chunks are also cut inside every version name that a payload holds. A version line after
an empty line is therefore always a record's start, and archives of any size can be read by
Spark's line reader with that line as the separator, split anywhere.

Reading. Headers and blocks are cut apart by the lengths in the headers; segments of a
record are sorted by number and hashed one after the other, with the hash as the only
state, and compared with the digest the headers claim.

Spark's text sink writes and commits the archives, so a lost executor leaves no partial
file behind. Groups of equal payloads are met by partial maxima and by salted keys, so a
payload that a third of all records share is spread over many tasks.

Defined results: a null html is an empty payload; of repeated rows (same page_id and
payload) one is the response and the others revisit it; a null page_id is smaller than
any number and stays null, also as ``refers_to``; spaces and control characters of a url
are written percent-encoded, a null url has no header; extra columns are not archived;
an empty table gives empty archives and no rows; an archive whose block is shorter than
its header says, or whose payload has another digest, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwatch.llm.common import field, join_narrow, map_batches
from tabwatch.session import materialize, new_folder, scratch

#: Most payload bytes of a chunk, and about how many an output batch holds.
CHUNK_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
#: Payloads shorter than this are always written whole.
MIN_BYTES = 0
#: Parts of a group of equal payloads.
SALTS = 64
# Fixed values of the format.
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
VERSION_NAME = re.compile(re.escape(VERSION.strip()).encode())
UNSAFE = re.compile(r"[\x00-\x20\x7F]")
#: Date of all records of an archive, where the caller gives none.
DATE = "2024-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_ends(payload, size: int) -> list[int]:
    """Where chunks end: every ``size`` bytes and two bytes into each version name (its line may
    be ended by the line ends after the record)."""
    ends, at = [], 0
    for stop in [*(m.start() + 2 for m in VERSION_NAME.finditer(payload)), len(payload)]:
        ends += [*range(at + size, stop, size), stop]
        at = stop
    return ends


def chunks(pages: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: one row a chunk, with the digests of the payload so far
    and, on the record's last chunk, ``last``. A record is named by the row's own number,
    so the result is to be stored before it is read more than once."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    fields = [field(n, k) for n, k in (("record", "bigint"), ("page_id", "bigint"), ("url", "string"), ("chunk", "bigint"), ("end", "bigint"), ("last", "boolean"), ("sha1", "string"), ("second", "bigint"), ("data", "binary"))]

    def work():
        def on_batch(batch: pa.RecordBatch):
            names = ("record", "page_id", "url")
            out, held = [], 0
            for record, page, url, cell in zip(*(batch.column(n).to_pylist() for n in names), batch.column("payload"), strict=True):
                view, running, second, at = memoryview(cell.as_buffer()), hashlib.sha1(), xxhash.xxh3_64(), 0
                ends = chunk_ends(view, size)
                uri = url and UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
                for k, end in enumerate(ends):
                    part = view[at:end]
                    running.update(part)
                    second.update(part)
                    out.append((record, page, uri if k == 0 else None, k, end, k + 1 == len(ends), base32(running.digest()), second.intdigest() - (1 << 63), bytes(part)))
                    held, at = held + len(part) + 200, end
                    if held > BATCH_BYTES:
                        yield list(zip(*out, strict=True))
                        out, held = [], 0
            if out:
                yield list(zip(*out, strict=True))

        return on_batch

    return map_batches(rows, fields, work)


def verdicts(table: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(record, n_bytes, digest, refers_record, refers_to) of every record; the last two are
    of the response that a revisit refers to, null for responses."""
    heads = table.where("last").select("record", "page_id", F.col("end").alias("n_bytes"), F.col("sha1").alias("digest"), "second", F.pmod(F.xxhash64("record"), F.lit(SALTS)).alias("salt"))
    key = ["n_bytes", "digest", "second"]
    best = F.max(F.struct("page_id", "record"))  # nulls are smallest
    parts = heads.where(F.col("n_bytes") >= min_bytes).groupBy(*key, "salt").agg(best.alias("top"))
    whole = parts.groupBy(*key).agg(F.max("top").alias("top"))
    met = parts.drop("top").join(whole, key)  # at most SALTS rows of a key meet, and no more rows than records
    given = heads.join(met, [*key, "salt"], "left")
    again = F.col("top.record") != F.col("record")  # null where a payload is too short to be met
    return given.select("record", "n_bytes", "digest", F.when(again, F.col("top.record")).alias("refers_record"), F.when(again, F.col("top.page_id")).alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    """One header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _urn(record: Column, page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), record.cast("string"), F.lit(">"))


def records(table: DataFrame, min_bytes: int = MIN_BYTES, date: str = DATE) -> DataFrame:
    """WARC records as one string column ``value`` (bytes, not decoded), without the two
    line ends after each."""
    told = materialize(verdicts(table, min_bytes))
    rows = join_narrow(table, told, "record").where("refers_record is null or chunk = 0")
    is_revisit, is_first = F.col("refers_record").isNotNull(), F.col("chunk") == 0
    several = ~(is_first & F.col("last")) & ~is_revisit
    block = F.when(is_revisit, F.lit(b"")).when(is_first, F.concat(F.lit(HTTP.encode()), F.col("data"))).otherwise(F.col("data"))
    origin = _urn(F.col("record"), F.col("page_id"))
    head = F.concat(
        F.lit(VERSION),
        _header("WARC-Type", F.when(is_revisit, "revisit").when(is_first, "response").otherwise("continuation")),
        _header("WARC-Record-ID", F.when(is_first, origin).otherwise(F.concat(F.substring_index(origin, ">", 1), F.lit(":"), F.col("chunk").cast("string"), F.lit(">")))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.when(is_first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _header("X-Payload-Length", F.when(is_first, F.col("n_bytes"))),
        _header("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(is_revisit, _urn(F.col("refers_record"), F.col("refers_to")))),
        _header("WARC-Segment-Number", F.when(several, F.col("chunk") + 1)),
        _header("WARC-Segment-Origin-ID", F.when(~is_first, origin)),
        _header("WARC-Segment-Total-Length", F.when(several & F.col("last"), F.col("n_bytes") + len(HTTP))),
        _header("Content-Type", F.when(is_first & ~is_revisit, F.lit("application/http;msgtype=response"))),
        _header("Content-Length", F.length(block)),
        F.lit("\r\n"))
    return rows.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))


def write(pages: DataFrame, path: str, size: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Archives of all pages into a new folder."""
    records(materialize(chunks(pages, size), compression="zstd"), min_bytes, date).write.option("lineSep", END).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives, one row a WARC record: type, id, origin (the id of the record
    that it is a segment of), segment number, total block length on a last segment, claimed
    digest and length, id of the record that a revisit refers to, and payload bytes."""
    rows = spark.read.option("lineSep", END + VERSION).text(path)
    cut = rows.select(F.col("value").cast("binary").alias("raw"), F.substring_index("value", END, 1).alias("head"))  # the head ends at the first empty line
    told = cut.withColumn("told", F.str_to_map(F.col("head"), F.lit("\r\n"), F.lit(": ")))
    of = lambda name: F.col("told")[name]
    length = of("Content-Length").cast("int")
    block = F.substring(F.col("raw"), F.octet_length("head") + len(END) + 1, length)
    short = F.raise_error(F.concat(F.lit("block shorter than its header says: "), of("WARC-Record-ID"))).cast("binary")
    blocks = told.withColumn("block", F.when(F.octet_length(block) == length, block).otherwise(short))
    body = F.when(of("WARC-Type") == "response", F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)).otherwise(0)
    return blocks.select(
        of("WARC-Type").alias("type"), of("WARC-Record-ID").alias("id"), F.coalesce(of("WARC-Segment-Origin-ID"), of("WARC-Record-ID")).alias("origin"),
        of("WARC-Segment-Number").cast("long").alias("segment"), (of("WARC-Segment-Total-Length").cast("long") - len(HTTP)).alias("total"), of("WARC-Target-URI").alias("url"),
        F.substring_index(of("WARC-Payload-Digest"), ":", -1).alias("claimed_digest"), of("X-Payload-Length").cast("long").alias("claimed_bytes"),
        of("WARC-Refers-To").alias("refers"), F.substring(F.col("block"), body + 1, length).alias("payload"))


def payloads(segments: DataFrame) -> DataFrame:
    """One row a record: id, url, type, length and digest of its payload, and the record that
    it refers to. A payload in one piece is hashed where it was read; only segments are moved,
    sorted by number and hashed in turn. Digests, lengths and segment numbers must hold."""
    alone = F.col("segment").isNull()
    moved = segments.select(
        "origin", "type", "url", "segment", "total", "claimed_digest", "claimed_bytes", "refers",
        F.when(alone & (F.col("type") == "response"), F.sha1("payload")).alias("hex"), F.octet_length("payload").cast("long").alias("n"), F.when(~alone, F.col("payload")).alias("payload"))
    dealt = moved.repartition("origin").sortWithinPartitions("origin", "segment")
    fields = [field(n, k) for n, k in (("id", "string"), ("url", "string"), ("type", "string"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("refers", "string"))]

    def work():
        state: dict = {}  # of the record whose segments are being read

        def finish(out, row, n, digest):
            if (n, digest) != (row["claimed_bytes"], row["claimed_digest"]):
                raise ValueError(f"payload of {row['origin']} has {n} bytes and digest {digest}, its header says {row['claimed_bytes']} and {row['claimed_digest']}")
            out.append((row["origin"], row["url"], row["type"], n, digest, row["refers"]))

        def on_batch(batch: pa.RecordBatch):
            out = []
            names = batch.schema.names[:-1]
            for *cells, payload in zip(*(batch.column(c).to_pylist() for c in names), batch.column("payload"), strict=True):
                row = dict(zip(names, cells, strict=True))
                if row["segment"] is None:
                    if row["type"] == "revisit":
                        finish(out, row, row["claimed_bytes"], row["claimed_digest"])
                    else:
                        finish(out, row, row["n"], base32(bytes.fromhex(row["hex"])))
                    continue
                if row["segment"] == 1:
                    state.update(first=row, next=1, n=0, hash=hashlib.sha1())
                if not state or state["first"]["origin"] != row["origin"] or state["next"] != row["segment"]:
                    raise ValueError(f"segment {row['segment']} of {row['origin']} does not follow the one before")
                state["hash"].update(memoryview(payload.as_buffer()))
                state["n"], state["next"] = state["n"] + row["n"], row["segment"] + 1
                if row["total"] is not None:
                    if row["total"] != state["n"]:
                        raise ValueError(f"{row['origin']} has {state['n']} bytes in its segments, the last one says {row['total']}")
                    finish(out, state["first"], state["n"], base32(state["hash"].digest()))
                    state.clear()
            if out:
                yield list(zip(*out, strict=True))

        return on_batch

    return map_batches(dealt, fields, work)


def round_trip(pages: DataFrame, size: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Archives of all pages in a new shared folder, read back: one row a page."""
    path = new_folder(pages.sparkSession, "warc")
    with scratch(pages.sparkSession):  # the chunk table is not needed once the archives are written
        write(pages, path, size, min_bytes)
    return payloads(read(pages.sparkSession, path))


def digests(found: DataFrame) -> DataFrame:
    """Numbers and digests by page."""
    page = lambda urn: F.nullif(F.split(urn, ":")[2], F.lit("")).cast("long")
    return found.select(page(F.col("id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page(F.col("refers")).alias("refers_to"))
