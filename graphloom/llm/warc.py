"""WARC archives: an index first, then coalesced ranged reads.

Writing: each task writes one archive of gzip members, one a record, and gives an index row for each: file, offset, length,
URL, digest. The index is a table in the shared folder. Reading: index rows are selected, dealt out by file and byte block,
sorted by offset, and neighbouring ranges are joined into one read of at most ``READ_BYTES``.

Files are written and read through pyarrow's file systems, so the folder may be on any store they reach. An attempt of a
task writes a file of its own name and only the index rows of the attempt that succeeded are kept, so repeated or lost
tasks leave at worst a file that no index names.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, new_path, table

LEAST_REVISIT = 1000
READ_BYTES, GAP_BYTES, BLOCK_BYTES = 8 << 20, 64 << 10, 64 << 20
INDEX = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_ID = "urn:page:"


#: Names under which Hadoop knows stores that pyarrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def opened(folder: str):
    """(pyarrow file system, path in it) of a folder as Spark names it."""
    from pyarrow import fs

    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else folder)


def _clean(value: str) -> str:
    """A header value must stay on its line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, when: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Record-ID", f"<{_ID}{page_id}>"), ("WARC-Date", when), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_ID}{refers_to}>")], http)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; ValueError if it is not whole."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not mark or not first.startswith("WARC/1."):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    if len(rest) != n + 4:
        raise ValueError("a WARC record of another length than stated")
    return headers, rest[:n]


def _gzip(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str, when: str | None = None, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the index (INDEX), which is a written table.

    Of rows with equal payloads of at least ``least_revisit`` bytes, those with the largest page_id are responses and the
    others revisit it. Null html: an empty payload. Null url: no target header. Rows that repeat a page_id are recorded
    each. Other columns are not read. Which rows revisit is settled on digests alone: html is shuffled once, by page_id."""
    spark = pages.sparkSession
    when = when or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_revisit).select("digest", "page_id")
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    revisits = materialize(large.join(first, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out = None
        try:
            for frame in frames:
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(_gzip(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", when), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                index = []
                for page_id, url, payload, digest, refers_to in frame.itertuples(index=False):
                    refers_to = None if pd.isna(refers_to) else int(refers_to)
                    data = _gzip(page_record(page_id, url, payload, digest, refers_to, when))
                    index.append((page_id, url, "response" if refers_to is None else "revisit", digest, len(payload), name, out.tell(), len(data)))
                    out.write(data)
                yield pd.DataFrame(index, columns=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    # as strings, for pandas would make doubles of longs with nulls
    return materialize(rows.withColumn("refers_to", F.col("refers_to").cast("string")).mapInPandas(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names (all or a selection), as RECORD; payload is null for revisits, whose payload is
    that of the response they refer to. ``payload_bytes`` of a response is counted and its digest computed from what was
    read; those of a revisit are what its headers state, the length of the payload in its HTTP header."""
    spark = index.sparkSession
    ranges = index.select("file", "offset", "length", F.floor(F.col("offset") / BLOCK_BYTES).alias("block"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(n, "file", "block").sortWithinPartitions("file", "offset")

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Runs of ranges that are read at once."""
        name, run, start, end = None, [], 0, 0
        for frame in frames:
            for file, offset, length in zip(frame["file"], frame["offset"], frame["length"]):
                if file != name or offset - end > GAP_BYTES or max(end, offset + length) - start > READ_BYTES:
                    if run:
                        yield name, run
                    name, run, start = file, [], offset
                run.append((offset, length))
                end = offset + length
        if run:
            yield name, run

    def read_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        name, source = None, None
        for file, run in joined(frames):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, store.open_input_file(f"{root}/{file}")
            start = run[0][0]
            data = source.read_at(run[-1][0] + run[-1][1] - start, start)
            rows = []
            for offset, length in run:
                headers, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"{file}: the record at {offset} doesn't hold what its headers state")
                number = lambda key: int(headers[key].strip("<>").removeprefix(_ID)) if key in headers else None
                rows.append((number("warc-record-id"), headers.get("warc-target-uri"), kind, digest, size, number("warc-refers-to"), payload if payloads and kind == "response" else None))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
            yield out.astype({"refers_to": "Int64"})
        if source is not None:
            source.close()

    return ranges.mapInPandas(read_runs, RECORD)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc_round_trip": op6_warc_round_trip}
#: Equal payloads are found by the text itself.
ORACLE_SQL = {
    "op6_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
        w AS (SELECT page_id, h, n, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
            CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM w"""
}
