"""WARC archives: a gzip member per record, and a sequential reader.

Archives are rows of a Parquet table that Spark writes to the shared folder, so they are
where every executor can read them and a lost executor takes none along; files of other
makers are read with Spark's binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: An archive is closed when it has grown to so many bytes.
ARCHIVE_BYTES = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"


def record_id(page: int | None) -> str:
    """A name for a page's record that is the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def write_record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One record as one gzip member; a revisit keeps the HTTP head and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    uri = "".join(c if c.isprintable() else "?" for c in url or "urn:none")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page)), ("WARC-Date", _EPOCH), ("WARC-Target-URI", uri),
        ("X-Page-ID", "" if page is None else str(page)), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode() + block + b"\r\n\r\n") + squeeze.flush()


def read_members(archive: bytes, step: int = 1 << 16) -> Iterator[bytearray]:
    """The gzip members of an archive one after another, decompressed a step at a time."""
    at = 0
    while at < len(archive):
        inflate = zlib.decompressobj(31)
        out = bytearray()
        while not inflate.eof:
            if at >= len(archive):
                raise ValueError("the archive ends inside a gzip member")
            piece = archive[at : at + step]
            out += inflate.decompress(piece)
            at += len(piece) - len(inflate.unused_data)
        yield out


def _fields(head: bytes | bytearray) -> dict[str, str]:
    """Header fields behind the first line, names in lower case; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse_record(raw: bytearray) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block, framed by Content-Length."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    fields = _fields(raw[:end])
    size = int(fields["content-length"])
    block = bytes(raw[end + 4 : end + 4 + size])
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its Content-Length")
    return fields, block


def read_digest(field: str) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a digest field (base32 or hex); null where hashlib has no such algorithm or the value has another length."""
    kind, _, value = field.partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    n = hashlib.new(kind).digest_size
    if len(value) == 2 * n and all(c in "0123456789abcdefABCDEF" for c in value):
        return kind, value.lower()
    try:
        bare = value.upper().rstrip("=")
        raw = base64.b32decode(bare + "=" * (-len(bare) % 8))
    except ValueError:
        return None
    return (kind, raw.hex()) if len(raw) == n else None


def _verify(field: str | None, data: bytes, what: str) -> None:
    known = read_digest(field) if field else None
    if known and hashlib.new(known[0], data).hexdigest() != known[1]:
        raise ValueError(f"a record's {what} digest differs")


def read_record(raw: bytearray) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of a record; digests are verified where they are given.

    The payload of an HTTP response is what follows its head, that of any other record its block; a revisit has none.
    payload_digest is the SHA-1 in hex: the one given, else that of the payload. page_id and refers_to are of this
    module's own fields, null in other makers' files. payload_bytes is what the HTTP head says, else the payload's length.
    """
    fields, block = parse_record(raw)
    _verify(fields.get("warc-block-digest"), block, "block")
    kind = fields.get("warc-type", "")
    http: dict[str, str] = {}
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head)
    given = fields.get("warc-payload-digest")
    whole = kind != "revisit"
    if whole:
        _verify(given, payload, "payload")
    said = read_digest(given) if given else None
    digest = said[1] if said and said[0] == "sha1" else hashlib.sha1(payload).hexdigest() if whole else None
    size = http.get("content-length", "")
    n = int(size) if size.isdecimal() and (not whole or int(size) == len(payload)) else len(payload) if whole else None
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return (int(page) if page else None, fields.get("warc-target-uri"), n, digest, kind, int(refers) if refers else None, payload if whole else None)


def read_archive(archive: bytes) -> Iterator[tuple]:
    """The records of an archive; raises ValueError at the first that is damaged."""
    for raw in read_members(archive):
        yield read_record(raw)


def read_leniently(archive: bytes) -> Iterator[tuple]:
    """The records of an archive with a last value, null: what is wrong with a record, whose other values are null then.

    A record that can't be read, or whose digest differs, doesn't end the archive; a member that can't be decompressed does, as nothing says where the next begins.
    """
    members = read_members(archive)
    while True:
        try:
            raw = next(members)
        except StopIteration:
            return
        except (ValueError, zlib.error) as e:
            yield (*[None] * 7, str(e))
            return
        try:
            yield (*read_record(raw), None)
        except KeyError:
            yield (*[None] * 7, "a record has no Content-Length")
        except ValueError as e:
            yield (*[None] * 7, str(e))


def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html) -> the same with n_bytes, digest and refers_to (null for a response).

    Small payloads go past the join. Counts are combined before the shuffle, and a payload of very many pages is dealt over
    several join partitions by Spark's skew handling, as the join needs no grouping after it.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.withColumns({"html": html, "n_bytes": F.octet_length(html).cast("long"), "digest": F.sha1(F.encode(html, "utf-8"))})
    large = pages.filter(F.col("n_bytes") >= least_bytes)
    last = large.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = large.join(last, ["digest", "n_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    columns = ["page_id", "url", "html", "n_bytes", "digest"]
    small = pages.filter(F.col("n_bytes") < least_bytes).select(*columns, F.lit(None).cast("long").alias("refers_to"))
    return joined.select(*columns, refers.alias("refers_to")).unionByName(small)


def write_archives(pages: DataFrame, least_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A table of archives (column `warc`) with a record for each row of (page_id, url, html).

    Of records with equal payloads of at least least_bytes, that with the largest page_id is a
    response and the others are revisits of it; smaller payloads are all responses. A null html is
    an empty payload, and a very long one is a record like any other. Rows that repeat the largest page_id are all responses, under one record id; a null page_id is a
    revisit if another row with that payload has an id, else a response. Other columns are left out; an empty table gives no archives.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, size = [], 0
        for batch in batches:
            for page, url, html, n, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                archive.append(write_record("response" if refers is None else "revisit", page, url, html.encode(), digest, n, refers))
                size += len(archive[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(archive)], pa.binary())], ["warc"])
                    archive, size = [], 0
        if archive:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(archive)], pa.binary())], ["warc"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return mark_revisits(rows, least_bytes).mapInArrow(write, "warc binary")


def read_archives(archives: DataFrame, column: str = "warc") -> DataFrame:
    """The records of a table of archives, read one after another inside each archive; a damaged one is a row of nulls with its problem."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "problem"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for row in read_leniently(archive.as_py() or b""):
                    rows.append(row)
                    size += len(row[-2] or b"")
                    if size > ARCHIVE_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return archives.select(column).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.gz files of this or another maker, a gzip member per record, through Spark's own file reader."""
    return read_archives(spark.read.format("binaryFile").load(path), "content")


def op7(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages).write.parquet(folder)
    own = F.coalesce("record_type", F.raise_error(F.concat(F.lit("an archive of this job is damaged: "), F.col("problem"))))
    return read_archives(spark.read.parquet(folder)).withColumn("record_type", own).drop("payload", "url", "problem")


OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM g
"""
