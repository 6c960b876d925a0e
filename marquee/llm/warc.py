"""WARC archives whose records are Zstandard frames over a shared dictionary.

Writer: a dictionary is trained on a bounded sample of the records to be archived (DICT_SAMPLE
records, the first DICT_SAMPLE_PART bytes of each) and stands in a skippable frame at the head of every file, as the public
.warc.zst format has it, so each file can be read alone. Each record is one frame. Of records with
equal payloads the one with the smallest id is a response, the others are revisits that name it.
Tasks write files of about FILE_BYTES bytes into the given folder through the store's file system;
each file's name holds a random part, and only the files named by the finished job's manifest count, so a task
that runs twice leaves an unused file and no doubled records.

Reader: files are opened in tasks and read frame by frame; memory holds one record.

Defined results: a null payload is empty; null ids and addresses are kept (no id: no header);
repeated rows are separate records, and
all rows of the smallest id of a payload are responses; further columns of the input are left out,
whatever their names; an empty table gives no files and an empty result. A payload shorter than
`min_bytes` is always a response.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import fresh_path, materialise

DICT_MAGIC = 0x184D2A5D
DICT_SAMPLE = 600
DICT_SAMPLE_PART = 16 << 10
DICT_BYTES = 64 << 10
FILE_BYTES = 32 << 20
LEVEL = 3
DAY = "1970-01-01T00:00:00Z"

MANIFEST = "path string, records long, bytes long"
RECORD = "record_type string, page_id long, url string, payload_digest string, refers_to long, payload binary, payload_bytes long"


def open_store(path: str):
    """(file system, path in it) of a folder named by a plain path or an address."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def train_dictionary(payloads: DataFrame) -> bytes:
    """A dictionary from a bounded sample, the same for the same rows; empty if there is too little to learn from."""
    keyed = payloads.select(F.xxhash64("page_id", "url").alias("h"), F.substring("payload", 1, DICT_SAMPLE_PART).alias("payload"))
    chosen = keyed.select("h").distinct().orderBy("h").limit(DICT_SAMPLE).agg(F.max("h")).first()[0]
    if chosen is None:
        return b""
    got = keyed.filter(F.col("h") <= chosen).groupBy("h").agg(F.min("payload").alias("payload")).orderBy("h").toArrow()["payload"].to_pylist()
    samples, total = [], 0
    for x in got:
        if x:
            samples.append(bytes(x))
            total += len(x)
    if len(samples) < 8 or total < 4 * 1024:
        return b""
    try:
        return zstd.train_dictionary(min(DICT_BYTES, total // 8), samples, level=LEVEL).as_bytes()
    except zstd.ZstdError:  # records too alike or too short to train on
        return b""


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds sha1 (hex), and first (smallest id with that payload) and n where payloads repeat. Equal
    payloads meet in a sum per digest; the join is many-to-one, so a hot digest can be split."""
    keyed = pages.withColumn("sha1", F.sha1("payload"))
    groups = (
        keyed.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    return keyed.join(groups.hint("shuffle_hash"), "sha1", "left")


def headers(kind: str, page_id, url, digest: str, refers_to, body: bytes) -> bytes:
    """Head of one record: its block is `body`."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    seed = f"{page_id}"
    lines.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>")
    lines.append(f"WARC-Date: {DAY}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(refers_to))}>")
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _write(folder: str, dictionary: bytes):
    """Rows -> archive files; gives the manifest of the files written."""

    def run(batches):
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        zdict = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstd.ZstdCompressor(level=LEVEL, dict_data=zdict, write_content_size=True)
        head = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        out, path, n, size = None, None, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())}
            )

        for batch in batches:
            for page_id, url, payload, sha1, first, is_revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, n, size = f"{base}/part-{uuid.uuid4().hex}.warc.zst", 0, len(head)
                    out = store.open_output_stream(path)
                    out.write(head)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                http = HTTP_HEAD % len(payload)
                body = http if is_revisit else http + payload
                kind = "revisit" if is_revisit else "response"
                frame = press.compress(headers(kind, page_id, url, digest, first, body) + body + b"\r\n\r\n")
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, payload binary) to the folder; returns the stored manifest."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    dictionary = train_dictionary(rows)
    marked = mark_revisits(rows, min_bytes)
    again = marked["n"].isNotNull() & ((marked["page_id"] != marked["first"]) | marked["page_id"].isNull() & marked["first"].isNotNull())
    out = marked.select("page_id", "url", "payload", "sha1", F.when(again, F.col("first")).alias("first"), F.coalesce(again, F.lit(False)).alias("again"))
    return materialise(out.mapInArrow(_write(folder, dictionary), MANIFEST), "manifest")


def frames(stream, step: int = 1 << 15):
    """Records of one archive file: a leading skippable frame gives the dictionary, each further frame a record."""
    head = stream.read(8)
    zdict, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_MAGIC:
        zdict = zstd.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0]))
        rest = b""
    unpack = zstd.ZstdDecompressor(dict_data=zdict)
    one, parts, begun = unpack.decompressobj(), [], False
    while True:
        if not rest:
            rest = stream.read(step)
            if not rest:
                break
        parts.append(one.decompress(rest))
        rest, begun = b"", True
        if one.eof:
            yield b"".join(parts)
            rest, one, parts, begun = one.unused_data, unpack.decompressobj(), [], False
    if begun:
        raise ValueError("archive ends within a record")


def parse_record(record: bytes):
    """(type, page_id, url, digest as stated, refers_to, stored payload, payload length stated by the response head)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    whole = lambda k: int(fields[k]) if k in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return fields["WARC-Type"], whole("X-Page-ID"), url, digest, whole("X-Refers-To-Page-ID"), payload, length


def _read(with_payload: bool, most_bytes: int = 8 << 20):
    """Paths -> records; a response whose payload does not have the digest it states is an error."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_store(path)
                rows, held = [], 0
                with store.open_input_stream(at) as stream:
                    for record in frames(stream):
                        kind, page_id, url, digest, refers_to, payload, length = parse_record(record)
                        if kind == "response":
                            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if found != digest or len(payload) != length:
                                raise ValueError(f"record of page {page_id} in {path} is damaged")
                        rows.append((kind, page_id, url, digest, refers_to, payload if with_payload else None, length))
                        held += len(record) if with_payload else 200
                        if held > most_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the files in a manifest. A revisit has no payload of its own."""
    spread = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(_read(with_payload), RECORD)


def archive_folder(spark: SparkSession, name: str = "archive") -> str:
    return fresh_path(spark, name)


def full_payloads(records: DataFrame) -> DataFrame:
    """Records with the payload of the response a revisit refers to."""
    at = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload").alias("_own"))
    at = at.withColumn("_k", F.row_number().over(W.partitionBy("refers_to").orderBy(F.length("_own").desc()))).filter("_k = 1").drop("_k")
    return records.join(at, "refers_to", "left").withColumn("payload", F.coalesce("_own", "payload")).drop("_own")
