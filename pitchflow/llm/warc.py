"""A deterministic sharded WARC writer and its reader.

Records are put in order of page_id by a range sort of their sizes alone; the running sum of the compressed sizes says
which file a record goes to, so files roll by compressed size and their bounds depend on the rows, not on partitions or
retries. Copies of one record are cut like others and made anew in each file, so a page that repeats without end rolls on
too. Each record is a gzip member. Files are written by Spark's own committer in a folder of temporary name, which is
renamed as a whole; they become visible when the manifest, written last, tells of them.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_function, shared_folder, stored

ROLL_BYTES = 16 << 20
#: A record counts by its compressed bytes, or by its payload's over this if that is more, which bounds a file's content.
RATIO = 8
#: Files are dealt to at most this many shards, one task each; the shards' bounds are all that the driver holds.
SHARDS = 65536
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member; it stands between records, where the text sink asks for a separator.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
CRLF = b"\r\n"
CHUNK = 1 << 14


def record_id(page_id, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}\n{url}\n{digest}'.encode('utf-8', 'surrogatepass')).digest()[:16])}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record as a gzip member; a revisit (no payload) of page ``refers_to`` if that is given."""
    clean = "".join(c for c in url or "" if c >= " ")
    kind = "response" if refers_to is None else "revisit"
    body = b"" if refers_to is not None else payload
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, clean, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Page-Number: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-Number: {refers_to}"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF + CRLF + block + CRLF + CRLF
    return gzip.compress(data, 6, mtime=0)


def _payload(html: str | None) -> bytes:
    return (html or "").encode("utf-8", "surrogatepass")


@column_function("digest string, bytes long, member_bytes long")
def _measure(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for page, url, html in parts:
        rows = []
        for p, u, h in zip(page, url, html, strict=True):
            payload = _payload(h)
            digest = hashlib.sha1(payload).hexdigest()
            rows.append((digest, len(payload), len(record(_int(p), u, payload, digest)) + len(EMPTY_MEMBER)))
        yield pd.DataFrame(rows, columns=["digest", "bytes", "member_bytes"])


@column_function("long")
def _revisit_bytes(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for page, url, digest, head in parts:
        rows = zip(page, url, digest, head, strict=True)
        yield pd.Series([len(record(_int(p), u, b"", d, int(r))) + len(EMPTY_MEMBER) for p, u, d, r in rows], dtype="int64")


def _int(x) -> int | None:
    return None if x is None or x != x else int(x)


ORDER = ["page_id", "digest", "url"]


def plan(pages: DataFrame, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, digest, bytes, member_bytes, n (equal rows), refers_to, size, start: a row for each distinct record.

    page_id goes as text here and in the writer, so that large ids and nulls stay exact.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    sized = rows.select("page_id", "url", _measure(F.col("page_id").cast("string"), "url", "html").alias("m"))
    distinct = stored(
        sized.groupBy("page_id", "url", "m").agg(F.count("*").alias("n")).select("page_id", "url", "m.*", "n"), "sizes"
    )
    heads = stored(  # a table of its own, so that Spark can split the join at a page found everywhere
        distinct.where(F.col("bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("head"), F.sum("n").alias("copies"))
        .where("copies > 1 and head is not null")
        .select(F.col("digest").alias("of"), "head"),
        "heads",
    )
    typed = distinct.join(heads, distinct.digest == heads.of, "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    )
    texts = [F.col(c).cast("string") for c in ("page_id", "url", "digest", "refers_to")]
    revisits = typed.where("refers_to is not null").withColumn("member_bytes", _revisit_bytes(*texts))
    final = typed.where("refers_to is null").unionByName(revisits).drop("of", "head")
    weight = F.when(F.col("refers_to").isNull(), F.ceil(F.col("bytes") / RATIO)).otherwise(0)
    sizes = final.withColumn("size", F.greatest("member_bytes", weight))
    ranged = stored(sizes.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "ranged")
    size = F.col("size") * F.col("n")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("part").agg(F.sum(size).alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("base") + F.sum(size).over(inside) - size
    return stored(ranged.join(base, "part").withColumn("start", start).drop("part", "base"), "placed")


def cells(placed: DataFrame, roll_bytes: int) -> DataFrame:
    """The rows of ``plan`` once for each file they go to, with file and copies: of n copies those that start in it."""
    file = lambda k: F.floor((F.col("start") + F.col("size") * k) / roll_bytes)
    spread = placed.withColumn("file", F.explode(F.sequence(file(F.lit(0)), file(F.col("n") - 1))))
    first = lambda f: F.greatest(F.lit(0), F.least("n", F.ceil((f * roll_bytes - F.col("start")) / F.col("size"))))
    return stored(spread.withColumn("copies", first(F.col("file") + 1) - first(F.col("file"))).where("copies > 0"), "cells")


def _key(page_id, digest: str, url: str | None) -> tuple:
    """What rows of ORDER sort by, nulls first."""
    return (page_id is not None, page_id or 0, digest, url is not None, (url or "").encode("utf-8", "surrogatepass"))


def _bounds(found: DataFrame, per: int) -> tuple[list[tuple], list[tuple], list[int]]:
    """The least and the greatest key of each shard of ``per`` files, and its number; a long record leaves gaps."""
    shard = F.floor(F.col("file") / per)
    ends = found.groupBy(shard.alias("shard")).agg(F.min(F.struct(*ORDER)).alias("a"), F.max(F.struct(*ORDER)).alias("z"))
    rows = ends.orderBy("shard").collect()
    return [_key(*r.a) for r in rows], [_key(*r.z) for r in rows], [r.shard for r in rows]


MEMBER = pa.schema([("file", pa.int64()), ("seq", pa.int64()), ("member", pa.binary())])


def _members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from rows in order, where the files that a page goes to stand before its content."""
    waiting: list[dict] = []
    rows: list[dict] = []
    seq = size = 0
    for batch in batches:
        for x in batch.to_pylist():
            if x["html"] is None:
                if waiting and any(waiting[0][k] != x[k] for k in ORDER):
                    raise ValueError("a plan without its page")
                waiting.append(x)
                continue
            if not waiting or any(waiting[0][k] != x[k] for k in ORDER):
                raise ValueError("a page without a plan")
            out = record(x["page_id"], x["url"], _payload(x["html"]), x["digest"], waiting[0]["refers_to"])
            for cell in waiting:
                for _ in range(cell["copies"]):
                    rows.append({"file": cell["file"], "seq": seq, "member": out})
                    seq += 1
                    size += len(out)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, MEMBER)
                        rows, size = [], 0
            waiting = []
    if waiting:
        raise ValueError("a plan without its page")
    yield pa.RecordBatch.from_pylist(rows, MEMBER)


def write_archives(pages: DataFrame, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> str:
    """Write ``pages`` (page_id, url, html) as record-wise compressed WARC files; the folder, which holds ``archives`` (a
    folder for each file, by its number) and ``manifest`` (file, path, n_records, first_page, last_page, as JSON).

    Of equal payloads of at least ``revisit_bytes`` bytes the largest page_id is a response and the others are revisits of
    it; rows that share that page_id are all responses. A null html is an empty payload, a null url an empty one. Rows
    without page_id are never referred to; they are revisits if some row with an id has their payload. Equal rows give
    equal records. A page of any length is one record. An empty table gives no file and an empty manifest. Extra columns
    are ignored.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    placed = plan(pages, roll_bytes, revisit_bytes)
    found = cells(placed, roll_bytes)
    last = found.agg(F.max("file")).first()[0]
    per = -(-((last or 0) + 1) // SHARDS)
    content = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    several = stored(placed.where("n > 1").select(*[F.col(c).alias(f"of_{c}") for c in ORDER]), "several")
    if several.limit(1).count():  # one copy of the content is enough
        same = (F.col("digest") == F.col("of_digest")) & F.col("page_id").eqNullSafe(F.col("of_page_id")) & F.col("url").eqNullSafe(F.col("of_url"))
        content = content.join(several, same, "left_anti").unionByName(content.join(several, same, "left_semi").dropDuplicates(ORDER))
    bounds = spark.sparkContext.broadcast(_bounds(found, per))

    @F.pandas_udf("array<long>")
    def shards(page: pd.Series, digest: pd.Series, url: pd.Series) -> pd.Series:
        least, most, number = bounds.value
        keys = [_key(None if p is None else int(p), d, u) for p, d, u in zip(page, digest, url, strict=True)]
        return pd.Series([number[bisect_left(most, k) : bisect_right(least, k)] for k in keys])

    none = F.lit(None).cast("long")
    content = content.withColumn("shard", F.explode(shards(F.col("page_id").cast("string"), "digest", "url")))
    rows = found.select(*ORDER, "refers_to", "file", "copies", F.lit(None).cast("string").alias("html"), F.floor(F.col("file") / per).alias("shard"))
    rows = rows.unionByName(content.withColumns({"refers_to": none, "file": none, "copies": none}))
    (
        rows.repartition("shard")
        .sortWithinPartitions("shard", *ORDER, F.col("html").isNotNull(), "file")
        .mapInArrow(_members_of, "file long, seq long, member binary")
        .sortWithinPartitions("file", "seq")
        .select("file", F.col("member").cast("string").alias("value"))
        .write.partitionBy("file")
        .options(lineSep=EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1")
        .text(f"{folder}/_archives")
    )
    _publish(spark, folder, found)
    return folder


def _publish(spark: SparkSession, folder: str, found: DataFrame) -> None:
    """Rename the folder of the files, then write the manifest under a temporary name and rename it: two metadata calls,
    however many files there are."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def show(name: str) -> None:
        if not fs.rename(Path(f"{folder}/_{name}"), Path(f"{folder}/{name}")):  # false, no exception, where it fails
            raise OSError(f"{folder}/_{name} could not be renamed to {name}")

    show("archives")
    manifest = found.groupBy("file").agg(
        F.sum("copies").alias("n_records"),
        F.min("page_id").alias("first_page"),
        F.max("page_id").alias("last_page"),
    )
    manifest.withColumn("path", F.format_string(f"{folder}/archives/file=%d", "file")).write.json(f"{folder}/_manifest")
    show("manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The contents of an archive's gzip members, in order, empty ones included."""
    at, view = 0, memoryview(data)
    while at < len(data):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("cut archive")
            chunk = view[at : at + CHUNK]
            out.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record; ValueError if a length or digest is wrong."""
    head, block = data.split(CRLF + CRLF, 1)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if lines[0] != "WARC/1.1" or len(block) != int(headers["Content-Length"]) + 4:
        raise ValueError("damaged record")
    block = block[:-4]
    if headers["WARC-Block-Digest"] != f"sha1:{b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError("damaged block")
    return headers, block.split(CRLF + CRLF, 1)[1]


KEYS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("stated_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows: list[dict] = []
            size = 0
            for out in members(content.as_py()):
                if not out:
                    continue
                h, payload = parse(out)
                number, refers = h["WARC-Page-Number"], h.get("WARC-Refers-To-Page-Number")
                rows.append(
                    {
                        "page_id": int(number) if number else None,
                        "url": h["WARC-Target-URI"],
                        "record_type": h["WARC-Type"],
                        "refers_to": int(refers) if refers else None,
                        "stated_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"),
                        "payload": payload if refers is None else None,
                    }
                )
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, KEYS)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, KEYS)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, stated_digest (base 32), payload (null for revisits) of every record. A folder
    without a manifest was never committed and raises an error."""
    kind = "file long, path string, n_records long, first_page long, last_page long"
    out = "page_id long, url string, record_type string, refers_to long, stated_digest string, payload binary"
    if not spark.read.schema(kind).json(f"{folder}/manifest").limit(1).count():
        return spark.createDataFrame([], out)
    files = spark.read.format("binaryFile").load(f"{folder}/archives")
    return files.select("content").mapInArrow(_parse_files, out)


def digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url: of the full payload, which for a revisit is
    that of the response that it refers to. Of several responses of one page it is the one with the stated digest."""
    seen = stored(
        records.select(
            "page_id",
            F.length("payload").cast("long").alias("payload_bytes"),
            F.lower(F.sha1("payload")).alias("payload_digest"),
            "record_type",
            "refers_to",
            "url",
            "stated_digest",
        ),
        "read",
    )
    of = stored(  # a table of its own, so that Spark can split the join at a page found everywhere
        seen.where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("to"), F.col("stated_digest").alias("stated"))
        .agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("p"))
        .select("to", "stated", F.col("p.payload_bytes").alias("b"), F.col("p.payload_digest").alias("d")),
        "responses",
    )
    mine = (F.col("refers_to") == F.col("to")) & (F.col("stated_digest") == F.col("stated"))
    revisits = seen.where("record_type = 'revisit'").join(of, mine, "left")
    return seen.where("record_type = 'response'").drop("stated_digest").unionByName(
        revisits.select(
            "page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to", "url"
        )
    )
