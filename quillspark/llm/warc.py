"""WARC archives: writing with continuation records and chunked framing, reading with reassembly."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches, local_path, new_folder, text_slices, written

RECORD = "record_id string, type string, uri string, origin string, segment long, total_length long, refers_to string, digest string, block binary, archive string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload without its chunked framing (extensions and trailers are skipped)."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def urn(page_id: int | None, again: int = 0, segment: int = 1) -> str:
    """again: how many rows with that page_id come before."""
    return f"<urn:page:{'none' if page_id is None else page_id}{f':again:{again}' * bool(again)}{f':segment:{segment}' * (segment > 1)}>"


def page_records(page_id: int | None, again: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of a page: a revisit, a response, or a response that continuation records follow."""
    common = {"WARC-Date": datetime(1970, 1, 1, tzinfo=timezone.utc).isoformat(), "WARC-Target-URI": "".join((url or "").split())}
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": urn(page_id, again), **common, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": urn(refers_to), "WARC-Payload-Digest": f"sha1:{digest}"}, head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    for number, part in enumerate(parts, 1):
        headers = {"WARC-Type": "response" if number == 1 else "continuation", "WARC-Record-ID": urn(page_id, again, number), **common, "WARC-Payload-Digest": f"sha1:{digest}"}
        if len(parts) > 1:
            headers["WARC-Segment-Number"] = str(number)
        if number > 1:
            headers["WARC-Segment-Origin-ID"] = urn(page_id, again)
            if number == len(parts):
                headers["WARC-Segment-Total-Length"] = str(len(block))
        yield record(headers, part)


def first_copies(pages: DataFrame, least: int) -> DataFrame:
    """For payloads of at least `least` bytes that several pages have: key, and the largest page_id, which is the response."""
    keyed = pages.where(F.octet_length("html") >= least).groupBy("key").agg(F.max("page_id").alias("origin"), F.count("*").alias("n"))
    return keyed.where("n > 1").select(F.col("key").alias("copied"), "origin")


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 0, segment_bytes: int = 16_384, chunk_bytes: int = 4_096) -> DataFrame:
    """Writes a page (page_id, url, html; others are ignored) as records of archives; returns archive, records.

    Pages with equal payloads of at least least_revisit bytes become revisits of the one with the
    largest page_id. Null html is an empty payload, null url an empty target. Rows with one page_id, or with none,
    get record ids of their own and stay; with equal payloads those of the largest page_id are all responses. A task writes one archive under its own name and
    renames it, so that a repeated attempt leaves the same archive.
    """
    spark, path = pages.sparkSession, local_path(folder)
    bound_batches(spark)
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, n = f"{path}/pages-{task.partitionId():06d}.warc.gz", 0
        with open(f"{name}.{task.taskAttemptId()}", "wb") as out:
            out.write(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:archive:{task.partitionId()}>", "WARC-Date": "1970-01-01T00:00:00+00:00", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
            for batch in text_slices(batches, "html", 16_000_000):
                for row in batch.to_pylist():
                    payload = row["html"].encode()
                    origin = row["origin"] if row["origin"] != row["page_id"] else None
                    for data in page_records(row["page_id"], row["again"], row["url"], payload, payload_digest(payload), origin, segment_bytes, chunk_bytes):
                        out.write(data)
                        n += 1
        os.replace(out.name, name)
        yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("key", F.sha2("html", 256))
    marked = texts.join(first_copies(texts, least_revisit), F.col("key") == F.col("copied"), "left").select("page_id", "url", "html", "origin")
    if texts.groupBy("page_id").count().where("count > 1 OR page_id IS NULL").isEmpty():
        marked = marked.withColumn("again", F.lit(0))
    else:
        marked = marked.withColumn("again", F.row_number().over(Window.partitionBy("page_id").orderBy("html", "url")) - 1)
    return written(marked.mapInArrow(write, "archive string, records long"), "archives")


def parse_records(data: Iterator[bytes], archive: str) -> Iterator[dict]:
    """The records of an archive, read as a stream; a truncated one raises an error that names the archive."""
    unpacker, buffer = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal unpacker
        for raw in data:
            while raw:
                buffer.extend(unpacker.decompress(raw))
                raw = unpacker.unused_data
                if unpacker.eof:
                    unpacker = zlib.decompressobj(31)
            return True
        return False

    while buffer or more():
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError(f"{archive} ends within a record's head")
        lines = bytes(buffer[:end]).decode().split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        while len(buffer) < end + 8 + length:
            if not more():
                raise ValueError(f"{archive} ends within a record")
        block = bytes(buffer[end + 4 : end + 4 + length])
        del buffer[: end + 8 + length]
        yield {
            "record_id": headers.get("warc-record-id"), "type": headers["warc-type"], "uri": headers.get("warc-target-uri"), "origin": headers.get("warc-segment-origin-id"),
            "segment": int(headers["warc-segment-number"]) if "warc-segment-number" in headers else None,
            "total_length": int(headers["warc-segment-total-length"]) if "warc-segment-total-length" in headers else None,
            "refers_to": headers.get("warc-refers-to"), "digest": headers.get("warc-payload-digest"), "block": block, "archive": archive,
        }


def read_records(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives (archive: path)."""
    schema = pa.schema([(k, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for k, t in (x.split() for x in RECORD.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["archive"].to_pylist():
                rows, size = [], 0
                with open(name, "rb") as f:
                    for row in parse_records(iter(lambda: f.read(1 << 20), b""), name):
                        rows.append(row)
                        size += len(row["block"])
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.repartition(max(1, archives.count()), "archive").mapInArrow(read, RECORD)


def decoded(whole: DataFrame) -> DataFrame:
    """Takes HTTP heads off whole blocks, decodes chunked framing and verifies payload digests.

    Adds payload_bytes, payload_digest and problem (null if all is well; a wrong record is reported, not dropped).
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, problems = [], [], []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                size = digest = None
                problem = row["problem"]
                try:
                    if not problem:
                        head, _, body = b"".join(row["blocks"]).partition(b"\r\n\r\n")
                        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                        stated = (row["digest"] or "").removeprefix("sha1:")
                        if row["type"] == "revisit":
                            size, digest = int(fields[b"content-length"]), stated
                        else:
                            body = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                            size, digest = len(body), payload_digest(body)
                            problem = None if digest == stated else "payload digest differs"
                except (ValueError, KeyError) as e:
                    problem = f"payload can't be decoded: {e}"
                sizes.append(size)
                digests.append(digest)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("record_id", "type", "uri", "refers_to")), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(problems, pa.string())], names=["record_id", "type", "uri", "refers_to", "payload_bytes", "payload_digest", "problem"])

    return whole.mapInArrow(decode, "record_id string, type string, uri string, refers_to string, payload_bytes long, payload_digest string, problem string")


def reassembled(records: DataFrame) -> DataFrame:
    """Records with all their blocks in order: one of unsegmented records, those of the segments of others.

    Segments are grouped by the record that they continue and ordered by segment number; numbers must run
    from 1 without gaps, the last must state a total length, and the blocks must have that length.
    Repeated segments, missing ones and wrong lengths give a problem. A group is one page's segments.
    """
    columns = ("record_id", "type", "uri", "refers_to", "digest", "blocks", "problem")
    single = records.where("segment IS NULL AND type IN ('response', 'revisit')").withColumn("blocks", F.array("block")).withColumn("problem", F.lit(None).cast("string"))
    parts = records.where("segment IS NOT NULL").withColumn("id", F.coalesce("origin", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total_length").alias("total"), F.max_by("total_length", "segment").alias("last_total"), first("type"), first("uri"), first("digest"),
    )
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    gaps = F.transform("parts", lambda p: p["segment"]) != F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    problem = F.when(gaps, "segments are missing or repeated").when(F.col("last_total").isNull(), "no total length").when(length != F.col("last_total"), "total length differs")
    return single.select(*columns).unionByName(joined.select(F.col("id").alias("record_id"), F.coalesce("type", F.lit("continuation")).alias("type"), "uri", F.lit(None).cast("string").alias("refers_to"), "digest", F.transform("parts", lambda p: p["block"]).alias("blocks"), problem.alias("problem")))


def read_pages(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and problem of each page in the archives."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)(:again:\d+)?>$", 1).try_cast("long")
    out = decoded(reassembled(read_records(archives)))
    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"), "problem")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc")))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
bits AS (SELECT page_id, html, list_reduce(list_transform(range(1, 41), lambda k: (['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'])[CAST(position(substr(sha1(html), k, 1) IN '0123456789abcdef') AS BIGINT)]), lambda a, b: a || b) AS b FROM p),
coded AS (SELECT page_id, html, list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST(16 * CAST(substr(b, 5 * k + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * k + 2, 1) AS INTEGER) + 4 * CAST(substr(b, 5 * k + 3, 1) AS INTEGER) + 2 * CAST(substr(b, 5 * k + 4, 1) AS INTEGER) + CAST(substr(b, 5 * k + 5, 1) AS INTEGER) AS INTEGER), 1)), lambda a, b: a || b) AS digest FROM bits),
last AS (SELECT html, max(page_id) AS origin FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM coded JOIN last USING (html)
"""
