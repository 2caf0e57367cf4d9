"""WARC archives through a chunked record table.

Every payload is a run of rows (record, chunk number, data, whether it is the last): Spark cuts it into chunks of
a bounded number of bytes before anything else sees it, so no Python worker and no line of an archive ever holds
a whole record. The table is passed twice. The first pass carries a SHA-1 and a length along each record's rows
and keeps only those, a small table in the shared folder. On that table it is decided which records are
responses and which revisits, by an aggregate that is combined before the shuffle and a join of digests. The
second pass joins the pages with what was decided for them (the only time that payloads are shuffled, by page and
not by digest, so that a page copied many times is no hot key) and turns chunk rows into lines of a WARC/1.0 file:
header lines, then each chunk with its length (HTTP chunked transfer coding). The length of a record follows from
its number of bytes, so its headers are known before its data. Spark's text writer makes the files on any file
system that it can write; each file is compressed, so one task reads it from start to end. Reading runs over the
lines again, and length and SHA-1 grow chunk by chunk.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the response
and the others are revisits of it without a payload.

Defined results: a null html is an empty payload; a null url leaves the target out; a null page_id is always a
response and stays null; rows that repeat a page_id and its payload are all responses if it is the largest, and
share a record id; rows that repeat a page_id with other payloads are records of their own; other columns are
never read. The two passes are matched by page_id, length and a 64-bit hash of the payload; should two payloads of
one page_id agree in all of these, reading finds a digest that is not its payload's and raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 32_768
LEAST = 1000
DATE = "2000-01-01T00:00:00Z"
KEY = ["page_id", "payload_bytes", "payload_hash"]


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_hash): the payload as bytes, and what matches the two passes."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_hash": F.xxhash64("payload")})


def chunk_rows(rows: DataFrame, keep: list[str | Column], chunk: int = CHUNK) -> DataFrame:
    """The chunked record table (keep..., chunk, last, data) of ``rows`` with a payload; an empty payload is one empty chunk.

    The chunks of a record follow one another within its partition. Chunk numbers are made first and bytes cut out
    row by row, so chunks are never held as a list.
    """
    count = F.greatest(F.ceil(F.octet_length("payload") / chunk), F.lit(1)).cast("int")
    numbered = rows.select(*keep, "payload", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    start = F.col("chunk") * chunk
    return numbered.select(*keep, "chunk", (start + chunk >= F.octet_length("payload")).alias("last"), F.substring("payload", start + 1, F.lit(chunk)).alias("data"))


def digests(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(page_id, payload_bytes, payload_hash, payload_digest) of each page, its SHA-1 carried along its chunk rows."""
    import pyarrow as pa

    def run(batches):
        digest = hashlib.sha1()
        for batch in batches:
            ends, found = [], []
            for i, (last, data) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5))):
                digest.update(data.as_buffer())
                if last:
                    ends.append(i)
                    found.append(digest.hexdigest())
                    digest = hashlib.sha1()
            if ends:
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(ends)) for k in range(3)), pa.array(found, pa.string())], names=[*KEY, "payload_digest"])

    return chunk_rows(records(pages), KEY, chunk).mapInArrow(run, "page_id long, payload_bytes long, payload_hash long, payload_digest string")


def described(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_hash, payload_digest, record_type, refers_to), once for rows that are equal in KEY."""
    same = ["payload_digest", "payload_bytes"]
    copies = found.where(F.col("payload_bytes") >= least).groupBy(*same).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.coalesce(F.col("page_id") < F.col("last"), F.lit(False))
    once = found.groupBy(*KEY).agg(F.max("payload_digest").alias("payload_digest"))
    return once.join(copies, same, "left").select(*KEY, "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def head_lines(page_id, url, size: int, digest: str, kind: str, refers_to, chunk: int) -> Iterator[bytes]:
    """The lines of one record before its payload, without their CRLF."""
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    if kind == "response":
        http.append("Transfer-Encoding: chunked")
    length = sum(len(x) + 2 for x in http) + 2
    if kind == "response":
        whole, rest = divmod(size, chunk)
        length += whole * (len(f"{chunk:x}") + chunk + 4) + (len(f"{rest:x}") + rest + 4 if rest else 0) + 5
    named = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>"]
    if url is not None:
        named.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    named += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        named += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"X-Payload-Length: {size}"]
    named += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}", ""]
    for line in (*named, *http, ""):
        yield line.encode()


def lines(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The lines (value) of an archive for chunk rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to, chunk, last, data)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out: list[bytes] = []
            for i, (number, last) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist())):
                kind = batch.column(4)[i].as_py()
                if number == 0:
                    out.extend(head_lines(*(batch.column(k)[i].as_py() for k in range(6)), chunk=chunk))
                if kind == "response":
                    if data := batch.column(8)[i].as_py():
                        out += (b"%x" % len(data), data)
                    if last:
                        out += (b"0", b"")
                if last:
                    out += (b"", b"")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))


def write(pages: DataFrame, path: str, least: int = LEAST, chunk: int = CHUNK) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC/1.0 files below ``path``."""
    from .common import drop, save

    found = save(digests(pages, chunk), "digests")
    kinds = described(found, least)
    rows = records(pages).alias("p").join(kinds.alias("k"), F.expr("p.page_id <=> k.page_id AND p.payload_bytes = k.payload_bytes AND p.payload_hash = k.payload_hash"))
    keep = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = rows.select("p.page_id", "url", "p.payload_bytes", "payload_digest", "record_type", "refers_to", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")).alias("payload"))
    lines(chunk_rows(rows, keep, chunk), chunk).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    drop(pages.sparkSession, found)


class Reader:
    """A machine that takes the lines of a file one by one, as bytes, and calls ``part`` with each chunk of a payload and the SHA-1 up to its end."""

    def __init__(self, part=None):
        self.part, self.state, self.head, self.left = part, "start", {}, 0
        self.digest, self.size, self.chunk, self.held = hashlib.sha1(), 0, 0, []

    def _data(self, data: bytes) -> None:
        self.digest.update(data)
        self.size += len(data)
        if self.part:
            self.held.append(data)

    def feed(self, data: bytes):
        """The finished record (headers, payload length, payload SHA-1) if this line ends one."""
        if self.state == "data":
            if len(data) == self.left:
                self._data(data)
                if self.part:
                    self.part(self.head, self.chunk, b"".join(self.held), self.digest.hexdigest())
                    self.held.clear()
                self.state, self.chunk = "size", self.chunk + 1
            elif len(data) + 2 <= self.left:
                self._data(data + b"\r\n")
                self.left -= len(data) + 2
            else:
                raise ValueError(f"a chunk runs over in {self.head}")
            return None
        line = data.decode()
        if self.state == "size":
            self.left = int(line, 16)
            self.state = "data" if self.left else "end"
        elif self.state == "start":
            if line:
                if line != "WARC/1.0":
                    raise ValueError(f"not the start of a record: {line[:80]!r}")
                self.state, self.head = "head", {}
                self.digest, self.size, self.chunk = hashlib.sha1(), 0, 0
        elif self.state == "head":
            if line:
                name, _, value = line.partition(": ")
                self.head[name] = value
            else:
                self.state = "http"
        elif self.state == "http":
            if not line:
                self.state = "size" if self.head["WARC-Type"] == "response" else "end2"
        elif self.state == "end":
            self.state = "end2"
        elif self.state == "end2":
            self.state = "start"
            return self.head, self.size, self.digest.hexdigest()
        return None


def _lines_of(spark, path: str) -> DataFrame:
    """The lines below ``path`` as bytes: a chunk may end within a character."""
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").cast("binary"))


def _page(value: str) -> int | None:
    value = value.rpartition(":")[2].rstrip(">")
    return None if value == "null" else int(value)


def read(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record below ``path``.

    A response's length and digest are taken from its payload, and the digest must be the one its header has.
    """
    import pyarrow as pa

    def run(batches):
        reader = Reader()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            out = []
            for line in batch.column(0):
                if found := reader.feed(line.as_py()):
                    head, size, digest = found
                    kind, claimed = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "revisit":
                        size, digest = int(head["X-Payload-Length"]), claimed
                    elif digest != claimed:
                        raise ValueError(f"payload and digest differ: {head}")
                    out.append((_page(head["WARC-Record-ID"]), size, digest, kind, _page(head["WARC-Refers-To"]) if kind == "revisit" else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _lines_of(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_chunks(spark, path: str) -> DataFrame:
    """The chunk table of the responses below ``path``: (page_id, chunk, data, digest), digest being the SHA-1 of the payload up to this chunk's end."""
    import pyarrow as pa

    def run(batches):
        out: list[tuple] = []
        reader = Reader(lambda head, k, data, digest: out.append((_page(head["WARC-Record-ID"]), k, data, digest)))
        for batch in batches:
            for line in batch.column(0):
                reader.feed(line.as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.string()))], names=["page_id", "chunk", "data", "digest"])
                out.clear()

    return _lines_of(spark, path).mapInArrow(run, "page_id long, chunk long, data binary, digest string")


def op7_warc(spark, sf_dir):
    from .common import scratch, table

    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), l AS (
  SELECT d, n, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d, n
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.page_id < l.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < l.last THEN l.last END AS refers_to
FROM p LEFT JOIN l ON p.d = l.d AND p.n = l.n
"""
