"""WARC archives with revisits resolved.

1. *Headers*: the payload digest (SHA-1) and length of every page, computed in
   the JVM.
2. *Resolution*: headers are shuffled by digest; of equal payloads of at least
   ``min_bytes`` bytes, the page with the largest id keeps its response and the
   others become revisits that refer to it.  The winner per digest is an
   aggregate with partial sums (one row a digest and task), and pages join it by
   digest; adaptive execution splits a digest that holds many of the pages.
3. *Archives*: every record gets fresh headers, and the records are written as
   gzip files to the shared folder by Spark's text writer, which commits whole
   tasks: a record ends in two line ends, which is the writer's line separator.
   A file holds ``PER_FILE`` records at most, as it is read back as one value.
4. *Reading*: archive files are inflated as a stream and cut into records by
   their Content-Length, never by searching for separators in payloads.  The
   digest of every response is verified.

Defined cases: a null payload is empty; equal pages under one id are all
responses if that id is the largest; a null id is never referred to while a
page with an id has the same payload, and is written as ``null`` and a name of
its own; line ends and
blanks in a url are escaped, a null url is written as ``urn:none``; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import shared_path

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PER_FILE = 10_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
KINDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_of_hex(hexed: Column) -> Column:
    """Base 32 of 40 hexadecimal digits: each 5 of them are 20 bits, which are 4 letters."""
    letters = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(hexed, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.lit(ALPHABET).substr(place, F.lit(1)))
    return F.concat(*letters)


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``n``, ``sha1``, ``refers_to`` (null for a response)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("n"),
        F.sha1(body.cast("binary")).alias("sha1"),
    )
    headers = given.where(F.col("n") >= min_bytes)
    # One row a digest, far below the payloads: hashed within a partition, so that payloads need no sort.
    first = headers.groupBy("sha1", "n").agg(F.max("page_id").alias("winner")).hint("shuffle_hash")
    joined = given.join(first, ["sha1", "n"], "left")
    other = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return joined.select("page_id", "url", "payload", "n", "sha1", F.when(other, F.col("winner")).alias("refers_to"))


def records(resolved: DataFrame, date: str | None = None) -> DataFrame:
    """One column of WARC records, each without the two line ends that close it; dated now unless a date is given."""
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.concat(F.lit("null:"), F.uuid())), F.lit(">"))
    made = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.col("url"), "[\\x00-\\x20\\x7f]", "%20")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("n").cast("string"),
        F.lit(END + END),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit(f"{END}WARC-Date: "),
        made,
        F.lit(f"{END}WARC-Target-URI: "),
        F.coalesce(url, F.lit("urn:none")),
        F.lit(f"{END}WARC-Payload-Digest: sha1:"),
        base32_of_hex(F.col("sha1")),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Profile: {PROFILE}{END}WARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END + END),
    )
    return resolved.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, date: str | None = None, min_bytes: int = 0) -> None:
    """Deduplicated archives in ``path``."""
    out = records(resolve(pages, min_bytes), date)
    out.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive that comes in parts."""
    held = bytearray()
    more = True

    def fill(n: int) -> bool:
        nonlocal more
        while more and len(held) < n:
            part = next(parts, None)
            if part is None:
                more = False
            else:
                held.extend(part)
        return len(held) >= n

    while fill(1):
        end = -1
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("archive ends within a header")
        lines = bytes(held[:end]).decode("utf-8").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should start")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        if not fill(end + 4 + n + 4) or held[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("archive ends within a record")
        block = bytes(held[end + 4 : end + 4 + n])
        del held[: end + 8 + n]
        yield headers, block


def inflate(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of a gzip file of one or more members."""
    while content:
        z = zlib.decompressobj(31)
        part = z.decompress(content, size)
        while part or z.unconsumed_tail:
            yield part
            part = z.decompress(z.unconsumed_tail, size) if not z.eof else b""
        if not z.eof:
            raise ValueError("archive file is cut")
        content = z.unused_data


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``path``; ``payload`` is null for revisits, or for all if not asked for."""

    def number(name: str) -> int | None:
        value = name.removeprefix("<urn:x-page:").removesuffix(">")
        return None if value.startswith("null") else int(value)

    names = [x.split()[0] for x in KINDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(inflate(content.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    told = dict(x.split(": ", 1) for x in http.decode("latin-1").split(END)[1:])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = headers["WARC-Type"] == "response"
                    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"wrong payload digest in {headers['WARC-Record-ID']}")
                    refers = headers.get("WARC-Refers-To")
                    rows.append(
                        (number(headers["WARC-Record-ID"]), int(told["Content-Length"]), digest, headers["WARC-Type"])
                        + (number(refers) if refers else None, payload if payloads and response else None)
                    )
                    size += len(block)
                    if size > 1 << 24 or len(rows) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, KINDS)


def archive(pages: DataFrame, min_bytes: int = 0) -> str:
    """Write archives to a fresh place in the shared folder; returns the place."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes=min_bytes)
    return path
