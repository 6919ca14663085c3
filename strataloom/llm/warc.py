"""WARC archives with revisit resolution.

Only headers (id, digest, length) are shuffled by payload digest: partial maxima per task find the original of each
repeated payload, whatever its number of copies. Pages then become response or revisit records with fresh headers in
archives of gzip members, one member a record. Reading parses the archives as streams, checks every digest, and joins
revisit records to their original responses by payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir
from .token_store import _files, _folder

#: Fixed value: the profile of revisits with identical payloads in WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_HEADERS = "page_id long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to_id string"


def record_id(page_id: int | None, digest: str, url: str | None) -> str:
    """A record's URN, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{url}')}>"


def _uri(url: str | None) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds one record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(digest, original): the largest page id of each payload that two or more pages have."""
    headers = pages.select("page_id", "digest", "bytes").where((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull())
    return headers.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row below ``path``; the manifest (file, records, bytes) of complete archives is returned.

    The payload is the page in UTF-8, empty for null. Of payloads of ``min_bytes`` or more that are equal, the one with the
    largest page id is a response and the others revisit it; rows that repeat that id stay responses, and so do rows with
    a null id. A null url becomes about:blank, control characters and blanks in it are escaped. Other columns are not read,
    whatever their names. A page of any length is one record; an empty table has an empty manifest.
    A task that runs again writes other file names, and only files in the manifest count.
    """
    folder = _folder(path)
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    source = source.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("bytes", F.octet_length("body"))
    originals = _originals(source, min_bytes)
    # Revisits as ids only: a payload is never shuffled by its digest, which thousands of pages may share.
    heads = source.select("page_id", "digest", "bytes", "url").where(F.col("bytes") >= min_bytes)
    urls = heads.join(originals, "digest").where("page_id = original").groupBy("digest").agg(F.max("url").alias("r_url"), F.max("original").alias("original"))
    revisits = heads.join(urls, "digest").where("page_id <> original").select(F.col("page_id").alias("v_page"), F.col("digest").alias("v_digest"), "original", "r_url").distinct()
    rows = source.join(revisits, (F.col("page_id") == F.col("v_page")) & (F.col("digest") == F.col("v_digest")), "left")

    def write(batches: Iterator[pa.RecordBatch]):
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        made: list[list] = []
        out = None
        for b in batches:
            for page, url, text, digest, original, r_url in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or made[-1][2] >= file_bytes:
                    if out:
                        out.close()
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    made.append([name, 0, len(info)])
                payload = text.encode("utf-8", "surrogatepass")
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                block = http if original is not None else http + payload
                fields = [
                    ("WARC-Type", "response" if original is None else "revisit"),
                    ("WARC-Record-ID", record_id(page, digest, url)),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", _uri(url)),
                    ("Content-Type", "application/http; msgtype=response"),
                    ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
                    ("WARC-Block-Digest", _sha1(block)),
                ]
                if page is not None:
                    fields.append(("X-Page-Id", str(page)))
                if original is not None:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original, digest, r_url)), ("WARC-Refers-To-Target-URI", _uri(r_url)), ("WARC-Refers-To-Date", date)]
                raw = _record(fields, block)
                out.write(raw)
                made[-1][1] += 1
                made[-1][2] += len(raw)
        if out:
            out.close()
        cols = list(zip(*made)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["file", "records", "bytes"])

    made = rows.select("page_id", "url", "body", "digest", "original", "r_url").mapInArrow(write, "file string, records long, bytes long")
    return materialize(made, "warc-manifest")


class _Members:
    """The bytes of a file of gzip members as one stream, with little of it in memory."""

    def __init__(self, stream, chunk: int = 1 << 20):
        self.stream, self.chunk = stream, chunk
        self.raw, self.held, self.unpack = b"", bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.unpack.eof:
            self.raw = self.unpack.unused_data
            self.unpack = zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.stream.read(self.chunk)
            if not self.raw:
                return False
        self.held += self.unpack.decompress(self.raw)
        self.raw = b""
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (k := self.held.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.held)
            if not self._more():
                return b""
        out = bytes(self.held[: k + len(mark)])
        del self.held[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record; blocks go by their length, whatever they hold."""
    members = _Members(stream)
    while head := members.until(b"\r\n\r\n"):
        version, *lines = head.decode("utf-8").strip().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = members.take(int(fields["content-length"]))
        members.take(4)
        yield fields, block


def read_warc(spark: SparkSession, path: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Header rows of all response and revisit records in the manifest's archives, with the payload if asked for.

    Digests and lengths of responses are taken from the payload and held against the header: a difference is an error.
    """
    folder = _folder(path)
    schema = _HEADERS + ", payload binary" * payloads

    def read(batches):
        files, base = _files(folder)
        names = [x.strip().split()[0] for x in schema.split(",")]
        for b in batches:
            for name in b.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows: list[tuple] = []
                    size = 0
                    for fields, block in parse_warc(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"digest of {fields['warc-record-id']} differs")
                        page = fields.get("x-page-id")
                        row = (None if page is None else int(page), fields["warc-record-id"], kind, fields.get("warc-target-uri"), None if payload is None else len(payload), digest, fields.get("warc-refers-to"))
                        rows.append((*row, payload) if payloads else row)
                        size += len(block) if payloads else 256
                        if size > 8 << 20:
                            yield _batch(rows, names)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, names)

    def _batch(rows, names):
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(zip(*rows), names)], names=names)

    n = max(1, manifest.count())
    return manifest.select("file").repartition(n).mapInArrow(read, schema)


def resolve_revisits(headers: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record.

    Revisits take length and page id from the original response with their payload digest; one whose original is in no
    archive keeps null there.
    """
    responses = headers.where("record_type = 'response'")
    sources = responses.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("its_bytes"))
    plain = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = headers.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type").join(sources, "payload_digest", "left")
    return plain.unionByName(again.select("page_id", F.col("its_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def warc_round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and resolve their revisits.

    Odd rows as in :func:`write_warc`; each row of the pages gives one row, an empty table none.
    """
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    manifest = write_warc(pages, path, min_bytes)
    headers = materialize(read_warc(spark, path, manifest), "warc-headers")
    return resolve_revisits(headers, min_bytes)


#: DuckDB SQL for the round trip over ``pages``.
ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM m
"""
