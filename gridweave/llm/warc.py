"""WARC archives: a writer with revisit records, and a splittable reader of gzip-per-record files.

Writer: each task writes gzip-per-record archives in the shared folder (through the file system
that the folder's URI names), under a name of its own attempt, and reports them; only archives
that a successful attempt reported are part of the result, so lost executors and repeated
attempts leave no half files in it.  A payload of at least ``least`` bytes is stored once, by the
smallest page_id; later equal ones are revisit records that refer to it.

Reader: files are cut into byte ranges.  A task scans its range for the gzip magic, and at each
hit tries to decode a member that starts with a WARC version line; hits inside compressed data
fail that and are passed over.  A record belongs to the range in which its member starts, even
where it ends in a later one, so ranges need no knowledge of each other and records are read once.

Defined cases: null html is an empty payload; null urls become an empty target; rows with equal
page_id are separate records (those that share the smallest page_id of a payload are all
responses); a null page_id is larger than all others and written as an empty id; an empty table
gives one empty set of archives; other columns are ignored.  Read records of other writers may have
header bytes that are not UTF-8 (replaced) and ids that are no whole numbers (null).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import file_system, shared_dir, stored, table

MAGIC = b"\x1f\x8b\x08"
LEAST, FILE_BYTES, RANGE_BYTES, CHUNK = 100, 64 << 20, 8 << 20, 1 << 20


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + c.flush()


def field(text: str | None) -> str:
    """A header value on one line."""
    return "" if text is None else "".join(" " if c in "\r\n\x00" else c for c in text)


def decided(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, digest, first (the page that the payload is stored with, null for short ones)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = rows.where(F.octet_length("payload") >= least)
    # min() passes over nulls; only payloads that occur more than once need a join
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return rows.join(firsts, "digest", "left")


def write(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; returns the manifest (path, bytes, records) of those that count."""

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        out, path, size, records = None, "", 0, 0
        for pdf in batches:
            for page_id, url, payload, digest, first in zip(pdf.page_id.tolist(), pdf.url.tolist(), pdf.payload.tolist(), pdf.digest.tolist(), pdf["first"].tolist(), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, records = f"{folder}/{name}", 0, 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                # ids come as strings: a null beside them would make them floats
                number = page_id if isinstance(page_id, str) else ""
                source = first if isinstance(first, str) and first != number else None
                headers = [("WARC-Type", "revisit" if source is not None else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Target-URI", field(url)), ("Page-ID", number), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(len(payload)))]
                if source is not None:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page", source)]
                m = member(headers, b"" if source is not None else payload)
                out.write(m)
                size, records = size + len(m), records + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "bytes": [size], "records": [records]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [records]})

    rows = decided(pages, least).select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("first").cast("string"))
    return stored(rows.mapInPandas(archive, "path string, bytes long, records long"), f"{folder}/manifest")


def inflate(read, start: int) -> tuple[bytes, int] | None:
    """The whole member at ``start`` and its compressed length, or None if there is no record there."""
    d, parts, at, seen = zlib.decompressobj(31), [], start, 0
    while True:
        piece = read(at, 1 << 14 if at == start else CHUNK)
        try:
            got = d.decompress(piece)
        except zlib.error:
            return None
        parts.append(got)
        seen += len(got)
        if seen >= 5 and not b"".join(parts[:2] if len(parts) > 1 and len(parts[0]) < 5 else parts[:1]).startswith(b"WARC/"):
            return None
        at += len(piece)
        if d.eof:
            whole = b"".join(parts)
            return (whole, at - len(d.unused_data) - start) if whole.startswith(b"WARC/") else None
        if not piece:
            return None


def parse(record: bytes) -> tuple[dict[str, str], bytes] | None:
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    if not gap or not fields.get("Content-Length", "").isdecimal():
        return None
    n = int(fields["Content-Length"])
    return (fields, rest[:n]) if len(rest) >= n else None


def records_in(read, start: int, stop: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records whose members start in [start, stop) of a file of ``end`` bytes."""
    at = start
    while at < stop:
        piece = read(at, min(CHUNK, stop - at) + len(MAGIC) - 1)
        hit = piece.find(MAGIC)
        if hit < 0:
            at += max(1, min(CHUNK, stop - at))
            continue
        at += hit
        if at >= stop:
            return
        got = inflate(read, at)
        record = parse(got[0]) if got else None
        if record is None:
            at += 1
            continue
        yield at, *record
        at += got[1]


def read(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the files (path, bytes): path, offset, type, page_id, url, digest, refers_to, payload_bytes, payload."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    # round robin: a file's ranges go to different tasks
    dealt = ranges.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                fs, at = file_system(r.path)
                with fs.open_input_file(at) as f:
                    rows, held = [], 0
                    for offset, h, payload in records_in(lambda a, n, f=f: f.read_at(n, a), r.start, min(r.start + range_bytes, r.bytes), r.bytes):
                        length = whole(h.get("Payload-Length"))
                        rows.append((r.path, offset, h.get("WARC-Type"), whole(h.get("Page-ID")), h.get("WARC-Target-URI"), h.get("WARC-Payload-Digest", "").removeprefix("sha256:"), whole(h.get("Refers-To-Page")), len(payload) if length is None else length, payload))
                        held += len(payload)
                        if held > CHUNK << 3:
                            yield frame(rows)
                            rows, held = [], 0
                    yield frame(rows)

    return dealt.mapInPandas(scan, ", ".join(f"{n} {t}" for n, t in RECORD))


RECORD = [("path", "string"), ("offset", "long"), ("type", "string"), ("page_id", "long"), ("url", "string"), ("digest", "string"), ("refers_to", "long"), ("payload_bytes", "long"), ("payload", "binary")]


def whole(text: str | None) -> int | None:
    """A header's whole number of 64 bits; none for anything else (archives of other writers)."""
    return int(text) if text and len(text) < 20 and text.removeprefix("-").isdecimal() and abs(int(text)) < 2**63 else None


def frame(rows: list[tuple]) -> pd.DataFrame:
    columns = zip(*rows, strict=True) if rows else [()] * len(RECORD)
    return pd.DataFrame({n: pd.array(list(c), "Int64") if t == "long" else pd.Series(list(c), dtype=object) for (n, t), c in zip(RECORD, columns, strict=True)})


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/archives")
    back = read(manifest)
    # a response's digest and length are taken anew from what was read, a revisit's from its header
    whole = F.col("type") == "response"
    return back.select(
        "page_id", F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(whole, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
