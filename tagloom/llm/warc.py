"""WARC archives: written by Spark, read back by boundary-chain verification.

Writing: the text sink with the record separator as its line ending makes files
of WARC records, compressed; offsets are those of the
uncompressed file. Pages of equal large payloads are one response and revisits.

Reading: every occurrence of the magic that starts a line and has a well-formed
header is a candidate; it names its successor, the offset after its block. Some
candidates are text inside payloads. Tasks emit the candidate-to-successor table;
pointer jumping from each file's start keeps the candidates that are reachable,
so magic inside a payload is rejected whatever it looks like.
"""
from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
MIN_SHARED = 1000
#: Pages in a file: with long pages, a file stays within a task's memory.
RECORDS_PER_FILE = 256
_DATE = "2020-01-01T00:00:00Z"
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")


def revisit_plan(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url", min_shared: int = MIN_SHARED) -> DataFrame:
    """A row for each page: _id, _url, _html, _size, _sha1, refers_to (null: a response).

    Of equal payloads of at least ``min_shared`` bytes the largest page_id is the
    response; repeated rows of that id are responses too. Null html is empty; a
    null page_id loses to any other. Only digests and ids are grouped, and each
    group is pre-aggregated, so a payload that a third of all pages share is fine.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("_id"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url") if url in pages.columns else F.lit("").alias("_url"),
        body.alias("_html"),
        F.octet_length(body).cast("bigint").alias("_size"),
        F.sha1(body.cast("binary")).alias("_sha1"),
    )
    first = (
        rows.filter(F.col("_size") >= min_shared)
        .groupBy("_sha1")
        .agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(F.col("_sha1").alias("_s"), "_first")
    )
    joined = rows.join(first, F.col("_sha1") == F.col("_s"), "left")
    other = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    return joined.withColumn("refers_to", F.when(other, F.col("_first"))).drop("_s", "_first")


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, **options) -> None:
    """Write one record for each page under ``path``, in files of bounded records."""
    p = revisit_plan(pages, **options)
    crlf = F.lit("\r\n")
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), crlf,
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.lit(">"), crlf,
        F.lit(f"WARC-Date: {_DATE}\r\nWARC-Target-URI: "), F.regexp_replace("_url", r"[\x00-\x20\x7f]", "%20"), crlf,
        F.lit("Content-Type: text/html; charset=utf-8\r\nWARC-Payload-Digest: sha1:"), F.col("_sha1"), crlf,
        F.lit("WARC-Payload-Length: "), F.col("_size").cast("string"), crlf,
        F.coalesce(F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"), crlf), F.lit("")),
        F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("_size").cast("string")), crlf, crlf,
    )
    record = F.concat(head, F.when(revisit, "").otherwise(F.col("_html")))
    (
        p.select(record.alias("value"))
        .write.option("lineSep", END.decode())
        .option("maxRecordsPerFile", records_per_file)
        .option("compression", "gzip")
        .text(path)
    )


def _field(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?:^|\r\n)" + name + rb":[ \t]*([^\r\n]*)", head, re.I)
    return m.group(1).strip() if m else None


def candidates(content: bytes):
    """(offset, successor, header, start of block, end of block) of every candidate."""
    at = content.find(b"WARC/1.")
    while at >= 0:
        m = _HEAD.match(content, at)
        if m:
            size = _field(m.group(1), b"Content-Length")
            if size is not None and size.isdigit():
                end = m.end() + int(size)
                if content[end : end + 4] == END:
                    yield at, end + 4, m.group(1), m.end(), end
        at = content.find(b"WARC/1.", at + 1)


def candidate_table(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, successor, and what the record there says: a row for each candidate."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    schema = "file string, offset bigint, successor bigint, record_id string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, sound boolean"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    text = lambda x: None if x is None else x.decode("utf-8", "replace")

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                content = content.as_py()
                if content[:2] == b"\x1f\x8b":
                    content = gzip.decompress(content)
                rows = []
                for at, after, head, a, e in candidates(content):
                    kind, said = text(_field(head, b"WARC-Type")), text(_field(head, b"WARC-Payload-Digest"))
                    said = said.rpartition(":")[2].lower() if said else None
                    if kind == "revisit":
                        n = _field(head, b"WARC-Payload-Length")
                        size, digest = int(n) if n and n.isdigit() else None, said
                    else:
                        size, digest = e - a, hashlib.sha1(content[a:e]).hexdigest()
                    rows.append(
                        (file, at, after, text(_field(head, b"WARC-Record-ID")), kind, text(_field(head, b"WARC-Refers-To")), size, digest, said in (None, digest))
                    )
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, schema)


def reachable(links: DataFrame) -> DataFrame:
    """Of (file, offset, successor) those reachable from offset 0, by pointer jumping.

    A file's candidates are bounded by the file, which the writer bounds; each
    round doubles the jump, so a chain of n records takes log2(n) rounds.
    """

    def jump(frame: pd.DataFrame) -> pd.DataFrame:
        offset = np.sort(frame["offset"].to_numpy())
        order = np.argsort(frame["offset"].to_numpy(), kind="stable")
        successor = frame["successor"].to_numpy()[order]
        n = len(offset)
        to = np.searchsorted(offset, successor)
        to = np.where((to < n) & (offset[np.minimum(to, n - 1)] == successor), to, n)
        to = np.append(to, n)  # n: beyond the end, or nowhere
        reach = np.zeros(n + 1, bool)
        reach[0] = n > 0 and offset[0] == 0
        for _ in range(max(1, int(n).bit_length())):
            reach[to[reach]] = True
            to = to[to]
        keep = reach[:n]
        return pd.DataFrame({"file": frame["file"].iloc[:1].repeat(int(keep.sum())).to_numpy(), "offset": offset[keep]})

    return links.select("file", "offset", "successor").groupBy("file").applyInPandas(jump, "file string, offset bigint")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``: those of the candidate table that are reachable."""
    found = stored(candidate_table(spark, path), "warc-candidates")
    kept = reachable(found).withColumnsRenamed({"file": "_f", "offset": "_o"})
    return found.join(kept, (found["file"] == kept["_f"]) & (found["offset"] == kept["_o"])).drop("_f", "_o")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tagloom/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1)
    records = read_archives(spark, path)
    return records.select(
        F.nullif(number("record_id"), F.lit("")).cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.nullif(number("refers_to"), F.lit("")).cast("bigint").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha1(h) AS s FROM p),
g AS (SELECT s, max(page_id) AS f, count(*) AS c FROM d WHERE n >= 1000 GROUP BY s)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.s AS payload_digest,
       CASE WHEN g.c > 1 AND d.page_id IS DISTINCT FROM g.f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.c > 1 AND d.page_id IS DISTINCT FROM g.f THEN g.f END AS refers_to
FROM d LEFT JOIN g ON d.s = g.s AND d.n >= 1000
"""
