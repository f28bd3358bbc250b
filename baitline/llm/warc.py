"""WARC archives of pages: written, normalised to one gzip member per record, read back.

* Write.  Spark writes the records of each partition as one gzip stream, the
  monolithic form that cannot be entered in the middle.  Which record of equal
  payloads is the response is found on digests alone; its revisits carry none.
* Normalise.  Each file is inflated once, as a stream.  Every record becomes a
  gzip member of its own, and a sidecar beside the archive gives each member's
  offset and length.  Files appear under their names only when whole, so that a
  task may be run again.
* Read.  Sidecar rows are dealt to tasks, which seek to each member.

Only one record is held inflated at a time.  Files are written through
``pyarrow.fs`` by the scheme of the shared folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.plans.session import scratch_path

from .store import stored

#: Payloads of fewer bytes are never revisited.
LEAST = 100
#: Records in one monolithic file.
PER_FILE = 20_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PIECE = 1 << 18
_SIDECAR = "archive string, offset long, length long, record string, kind string"


def revisits(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = LEAST) -> DataFrame:
    """Id, digest and first id of the records that revisit another one of an equal payload."""
    payload = F.coalesce(F.col(text_col), F.lit(""))
    marks = stored(
        pages.where(F.octet_length(payload) >= least).select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest")),
        "warc-digests",
    )
    shared = marks.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return marks.join(shared, "digest").where("NOT id <=> first").select("id", "digest", "first").distinct()


def write_monolithic(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> None:
    """Write all pages as WARC files, each one gzip stream."""
    # stored, so that Spark knows its size and moves the payloads only where it is large
    again = stored(revisits(pages, id_col, text_col), "warc-revisits")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), text.alias("body"), F.sha2(text, 256).alias("digest"))
    rows = rows.alias("p").join(
        again.alias("r"), F.col("p.id").eqNullSafe(F.col("r.id")) & (F.col("p.digest") == F.col("r.digest")), "left"
    ).select("p.*", "r.first", F.col("r.digest").isNotNull().alias("revisit"))
    size = F.octet_length("body")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit(f"WARC-Date: {_DATE}\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", " "),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), size.cast("string"),
        F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("\r\n")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.when(F.col("revisit"), F.lit(0)).otherwise(size + len(_HTTP)).cast("string"), F.lit("\r\n\r\n"),
    )
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.concat(F.lit(_HTTP), F.col("body")))
    # the writer ends each row with a line feed: the last byte of the record's end
    rows.select(F.concat(head, body, F.lit("\r\n\r")).alias("value")).write.option("compression", "gzip").option(
        "lineSep", "\n"
    ).option("maxRecordsPerFile", PER_FILE).text(path)


def _inflated(content) -> bytes:
    """The bytes of a gzip file, member after member, in pieces."""
    view, engine, at = memoryview(content), zlib.decompressobj(31), 0
    rest = b""
    while at < len(view) or rest:
        piece = rest or view[at : at + _PIECE]
        at += 0 if rest else len(piece)
        yield engine.decompress(piece)
        rest = b""
        if engine.eof:
            rest, engine = engine.unused_data, zlib.decompressobj(31)


def _records(pieces):
    """Head and block of each record of a stream of bytes."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = re.search(rb"(?im)^content-length:\s*(\d+)", held[:end])
                need = end + 4 + int(length[1]), end + 4
            total, start = need
            if len(held) < total + 4:
                break
            yield bytes(held[:start]), bytes(held[start:total])
            del held[: total + 4]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def _field(head: bytes, name: str) -> str | None:
    found = re.search(rf"(?im)^{name}:[ \t]*(.*?)\r$".encode(), head)
    return found[1].decode() if found else None


def _place(store: fs.FileSystem, temporary: str, final: str) -> None:
    if store.get_file_info(final).type != fs.FileType.NotFound:
        store.delete_file(final)
    store.move(temporary, final)


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite every file of ``source`` below ``target``; returns the sidecar rows.

    An empty source gives no archive and no row.
    """
    base, folder = fs.FileSystem.from_uri(target)
    base.create_dir(folder)

    def rewrite(batches):
        store, folder = fs.FileSystem.from_uri(target)
        for batch in batches:
            done = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = path.rsplit("/", 1)[-1].split(".")[0]
                archive, sidecar, mark = f"{folder}/{name}.warc.gz", f"{folder}/{name}.index", uuid.uuid4().hex
                offset, lines = 0, []
                with store.open_output_stream(f"{folder}/_{name}.{mark}", compression=None) as out:
                    for head, block in _records(_inflated(content.as_buffer())):
                        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = engine.compress(head + block + b"\r\n\r\n") + engine.flush()
                        out.write(member)
                        lines.append("\t".join([f"{name}.warc.gz", str(offset), str(len(member)), _field(head, "WARC-Record-ID") or "", _field(head, "WARC-Type") or ""]))
                        offset += len(member)
                with store.open_output_stream(f"{folder}/_{name}.{mark}.index", compression=None) as out:
                    out.write("".join(x + "\n" for x in lines).encode())
                _place(store, f"{folder}/_{name}.{mark}", archive)
                _place(store, f"{folder}/_{name}.{mark}.index", sidecar)
                done.append((f"{name}.warc.gz", len(lines), offset))
            columns = list(zip(*done)) if done else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.int64()])], ["archive", "records", "bytes"]
            )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    stored(files.mapInArrow(rewrite, "archive string, records long, bytes long"), "warc-archives")
    return sidecars(spark, target)


def sidecars(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(_SIDECAR).option("sep", "\t").option("pathGlobFilter", "*.index").csv(target)


def read_records(index: DataFrame, target: str, kind: str) -> DataFrame:
    """Records by their members: id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the bytes that were read, and
    must agree with its head; a revisit's are stated by its head.
    """

    def fetch(batches):
        store, folder = fs.FileSystem.from_uri(target)
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length, _, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    name, file = archive, store.open_input_file(f"{folder}/{archive}")
                file.seek(offset)
                head, block = next(_records([zlib.decompress(file.read(length), 31)]))
                size, digest = int(_field(head, "X-Payload-Length")), _field(head, "WARC-Payload-Digest").removeprefix("sha256:")
                sort = _field(head, "WARC-Type")
                if sort == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"payload of {archive} at {offset} is damaged")
                ids = [(_field(head, f) or "")[len("<urn:page:") : -1] or None for f in ("WARC-Record-ID", "WARC-Refers-To")]
                rows.append((ids[0], size, digest, sort, ids[1]))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    read = index.mapInArrow(fetch, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return read.withColumn("id", F.col("id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write, normalise and read all pages; a row per page.

    A null payload counts as empty, a null URL as blank.  Rows without an id are
    archived too (revisits of the smallest id with their payload; without any
    id in the group all are responses).  Rows that repeat the id and payload of
    a response are responses, for they would revisit themselves.  Other columns
    are not written.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    source, target = scratch_path(spark, "warc-monolithic"), scratch_path(spark, "warc")
    write_monolithic(pages, source, id_col, url_col, text_col)
    return read_records(normalise(spark, source, target), target, kind).withColumnRenamed("id", id_col)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM f
"""
