"""WARC archives: one gzip member per record, and a sequential reader.

``plan_records`` decides which records are responses and which revisit an equal payload; ``write_archives`` writes them
from the executors into a shared folder, each task its own files, and returns a manifest of the files that its successful
attempts wrote, so a lost executor's leftovers are never read; ``read_archives`` reads archives in sequence: it inflates
bit by bit, frames blocks by Content-Length and verifies the block and payload digests. Memory is bounded by the largest
record on both sides, and when reading by the records that are returned together: 500 of them and 32 MB of payloads at most, but for a single larger one.

Null payloads are empty. Payloads shorter than ``least`` bytes are always responses. Of equal payloads, all rows with the
smallest page id are responses (repeated rows); a row without a page id revisits if another row has one, else it is a
response. Null URLs have no WARC-Target-URI. Extra columns aren't archived, so their names can't clash. An empty table gives no archive and an empty
result. A damaged record is returned with its ``problem``, and the reader goes on behind it if its member can be passed.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, shared_folder, small_batches, stored

DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive after which a task starts another, and of one read.
ARCHIVE, CHUNK = 64 << 20, 1 << 16
#: Parts that the rows of one payload are dealt over.
SALTS = 32
MANIFEST = "path string, records bigint, bytes bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, problem string"


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """``page_id, url, payload, payload_bytes, digest, refers_to``; ``refers_to`` is null for responses, whose payload alone is carried."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    seen = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # one page may be repeated very often: its rows are dealt over salts, to each of which the digest's first row is copied.
    # Written, so that Spark knows the size: small ones are broadcast and payloads stay where they are.
    salts = seen.select(F.col("digest").alias("digest_"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    salts = stored(salts, "warc-firsts")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(salts, (F.col("digest") == F.col("digest_")) & (F.col("salt") == F.col("salt_")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", "digest", refers.alias("refers_to"))


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC record as a gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        block += payload or b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records under ``folder`` (a URI that all executors reach) and return the manifest, cut from its lineage."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _place(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, path, count, size = None, "", 0, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    path = f"{folder}/{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(_place(path)[1]), 0, 0
                whole = [None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to)]
                data = record(whole[0], row.url, row.payload, int(row.payload_bytes), row.digest, whole[1])
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE:
                    out.close()
                    yield pd.DataFrame([(path, count, size)], columns=["path", "records", "bytes"])
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame([(path, count, size)], columns=["path", "records", "bytes"])

    small_batches(records.sparkSession)
    # page ids as strings: pandas would turn integers with nulls into floats
    safe = records.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return cut(safe.mapInPandas(write, MANIFEST))


class Broken(ValueError):
    """A record that isn't as its headers say."""


class Reader:
    """Records of one archive in sequence, from anything with ``read(n)``."""

    def __init__(self, source):
        self.source, self.raw = source, b""

    def _member(self) -> None:
        self.inflate, self.ready = zlib.decompressobj(31), b""

    def _more(self) -> bool:
        """Inflate up to another chunk of this member; false at its end."""
        while not self.inflate.eof:
            if not self.raw and not (raw := self.source.read(CHUNK)):
                raise Broken("the archive ends inside a record")
            self.raw = self.raw or raw
            try:
                got = self.inflate.decompress(self.raw, CHUNK)
            except zlib.error as e:
                raise Broken(f"not a gzip member: {e}") from e
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.ready += got
                return True
        return False

    def _until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self._more():
                raise Broken("the record ends inside its header")
        got, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return got

    def _exactly(self, size: int) -> bytes:
        parts, have = [self.ready], len(self.ready)
        while have < size:
            self.ready = b""
            if not self._more():
                raise Broken("the block is shorter than its Content-Length")
            parts.append(self.ready)
            have += len(self.ready)
        data = b"".join(parts)
        self.ready = data[size:]
        return data[:size]

    def _record(self) -> dict:
        first, _, rest = self._until(b"\r\n\r\n").decode("utf-8", "replace").partition("\r\n")
        if not first.startswith("WARC/"):
            raise Broken("no WARC version line")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest.split("\r\n"))}
        block = self._exactly(int(head.get("content-length", "-1")))
        if self._exactly(4) != b"\r\n\r\n" or self.ready or self._more():
            raise Broken("the record goes on behind its Content-Length")
        problem = None
        if (want := head.get("warc-block-digest")) and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
            problem = "block digest"
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
        kind = head.get("warc-type", "")
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or size and int(size[1]) != len(payload)):
            problem = problem or "payload digest"
        return {"page_id": head.get("x-page-id"), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": head.get("x-refers-to-page-id"), "payload_bytes": int(size[1]) if size else len(payload), "payload_digest": digest, "payload": payload if kind == "response" else None, "problem": problem}

    def __iter__(self) -> Iterator[dict]:
        while True:
            if not self.raw and not (raw := self.source.read(CHUNK)):
                return
            self.raw = self.raw or raw
            self._member()
            try:
                yield self._record()
            except ValueError as e:
                yield dict.fromkeys(["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]) | {"problem": str(e)}
                try:
                    while self._more():
                        self.ready = b""
                except Broken:
                    return


def read_archives(manifest: DataFrame, payloads: bool = True, rows: int = 500, size: int = 32 << 20) -> DataFrame:
    """The records of the archives in ``manifest.path``; without ``payloads``, only what describes them."""
    kind = RECORD.replace("page_id bigint", "page_id string").replace("refers_to bigint", "refers_to string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in kind.split(", ")]
        for batch in batches:
            for path in batch.path:
                store, at = _place(path)
                with store.open_input_stream(at) as source:
                    held: list[dict] = []
                    held_bytes = 0
                    for found in Reader(source):
                        more = len(found["payload"] or b"") if payloads else 0
                        if held and (len(held) >= rows or held_bytes + more > size):
                            yield pd.DataFrame(held, columns=names).astype({"payload_bytes": "Int64"})
                            held, held_bytes = [], 0
                        held.append(found if payloads else found | {"payload": None})
                        held_bytes += more
                    if held:
                        yield pd.DataFrame(held, columns=names).astype({"payload_bytes": "Int64"})

    files = manifest.count()
    found = manifest.select("path").repartition(max(1, files)).mapInPandas(read, kind)
    return found.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write all pages as archives into the shared folder and read them back."""
    return read_archives(write_archives(plan_records(pages, least), shared_folder(pages.sparkSession, "warc")), payloads=False)


#: DuckDB's form of what comes back, over pages without repeated rows.
ROUND_TRIP_SQL = """
WITH rows AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT r.page_id, r.payload_bytes, r.payload_digest,
       CASE WHEN f.first IS NULL OR r.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r.page_id <> f.first THEN f.first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM rows r LEFT JOIN firsts f USING (payload_digest)
"""
