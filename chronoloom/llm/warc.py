"""WARC archives: written as whole-file gzip streams, normalised to one member per record with an index.

``write_monolithic`` writes records with Spark's own text writer: the record separator of WARC is the
writer's line separator and its gzip codec makes one stream per file. ``normalise`` inflates each such
stream once, rewrites every record as a gzip member of its own and notes where it lies. Members and index
lines go to one partitioned text table in a single pass, so archive and sidecar of a part are written by
the same task and committed together; a lost executor repeats its parts. ``read_archives`` reads all
records and holds them against the index; ``fetch`` cuts chosen ones out of their archives by it.

All reading and writing is done by Spark, so the folder may be in any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, column, make_folder

SEPARATOR = "\r\n\r\n"
LEAST_BYTES = 100  # of a payload that a revisit may stand for
FILE_RECORDS = 20_000  # of a monolithic file at most
CHUNK = 1 << 20
SALTS = 16
#: A gzip member ends with the length of what it holds, low byte first. Below 16 MiB the last byte is
#: zero, and the text writer adds it as its line separator; longer records get an empty member behind.
NUL = "\u0000"
_LONG = 1 << 24
ARCHIVE, INDEX = 0, 1
_EMPTY = bytes.fromhex("1f8b08000000000002ff0300000000000000") + b"\x00\x00"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    payload: bytes


# -- records ----------------------------------------------------------------------------------------


def _describe(pages: DataFrame) -> DataFrame:
    """page_id, url, payload with its length and digest, and the page that a revisit refers to.

    Of equal payloads of at least ``LEAST_BYTES`` the page with the smallest id is the response. Payloads
    that recur are found by a count and joined back with salt, so a payload that fills a third of the
    table is dealt over ``SALTS`` tasks and more.
    """
    stages = Stages(pages.sparkSession, "digests")
    rows = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    long_ones = rows.where(F.col("payload_bytes") >= LEAST_BYTES)
    counted = long_ones.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    recurring = stages.write(counted.where("n > 1").select("payload_digest", "first"), "recurring")
    salted = recurring.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    found = rows.join(salted, ["payload_digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("page_id"))
    return found.withColumn("refers_to", F.when(revisit, F.col("first"))).drop("salt", "first")


def _head() -> list:
    """The header lines of a record as columns; a revisit carries no payload."""
    uid = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    is_revisit = F.col("refers_to").isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), uid(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("WARC-Refers-To: "), uid(F.col("refers_to"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(is_revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return [F.concat_ws("\r\n", *lines), F.when(is_revisit, "").otherwise(F.col("payload"))]


def write_monolithic(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    """Write a record per row of ``pages`` into files that are each one gzip stream.

    A null html is an empty payload, a null url leaves its header out. Rows with the same id and payload
    are all responses if that id is the smallest. A null id is recorded as ``none`` and never referred to
    by others. An empty table writes files without records. Other columns aren't read.
    """
    rows = pages.select(
        column(id_col).cast("long").alias("page_id"),
        column(url_col).alias("url"),
        F.coalesce(column(html_col), F.lit("")).alias("payload"),
    )
    head, body = _head()
    record = _describe(rows).select(F.concat(head, F.lit(SEPARATOR), body).alias("value"))
    writer = record.write.option("lineSep", SEPARATOR).option("compression", "gzip")
    writer.option("maxRecordsPerFile", FILE_RECORDS).text(path)


# -- normalising ------------------------------------------------------------------------------------


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, each from its first header line to its closing blank lines."""
    held, end = bytearray(), SEPARATOR.encode()
    need = None
    for chunk in stream:
        held += chunk
        while True:
            if need is None:
                head = held.find(end)
                if head < 0:
                    break
                need = head + 4 + _content_length(bytes(held[:head])) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError(f"{len(held)} bytes after the last whole record")


def _content_length(head: bytes) -> int:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            return int(value)
    raise ValueError("a record without Content-Length")


def inflate(data: bytes) -> Iterator[bytes]:
    """Inflate gzip data piece by piece, whether it is one stream or many members."""
    view = memoryview(data)
    machine = zlib.decompressobj(31)
    at = 0
    while at < len(view) or machine.unconsumed_tail:
        piece = machine.unconsumed_tail or view[at : at + CHUNK]
        if not machine.unconsumed_tail:
            at += len(piece)
        out = machine.decompress(piece, CHUNK)
        if out:
            yield out
        if machine.eof:
            rest = machine.unused_data
            at -= len(rest)
            machine = zlib.decompressobj(31)
    if (out := machine.flush()):
        yield out


def deflate(record: bytes) -> bytes:
    """A record as a gzip member whose last byte is zero (see ``NUL``)."""
    machine = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = machine.compress(record) + machine.flush()
    return member + _EMPTY if len(record) >= _LONG else member


def parse(record: bytes) -> Record:
    head, _, rest = record.partition(SEPARATOR.encode())
    lines = [line.partition(": ") for line in head.decode().split("\r\n")[1:]]
    return Record({k: v for k, _, v in lines}, rest[: -len(SEPARATOR)])


def _members(batches: Iterator[pa.RecordBatch]):
    """Members and index lines of all files of a partition. Their archive is one file: offsets go on."""
    part, offset, seq = TaskContext.get().partitionId(), 0, 0
    kinds, seqs, values, held = [], [], [], 0

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(seqs, pa.int64()), pa.array(values, pa.binary())], ["kind", "seq", "value"]
        )

    for files in batches:
        for content in files.column("content"):
            for record in records(inflate(content.as_buffer())):
                member = deflate(record)
                headers = parse(record).headers
                line = {
                    "part": part, "offset": offset, "length": len(member), "id": headers["WARC-Record-ID"],
                    "type": headers["WARC-Type"], "uri": headers.get("WARC-Target-URI"),
                    "digest": headers["WARC-Payload-Digest"],
                }
                kinds += [ARCHIVE, INDEX]
                seqs += [seq, seq]
                values += [member[:-1], json.dumps(line).encode()]
                offset, seq, held = offset + len(member), seq + 1, held + len(member)
                if held > CHUNK:
                    yield batch()
                    kinds, seqs, values, held = [], [], [], 0
    yield batch()


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite the monolithic files below ``source`` as member-wise archives with indexes below ``target``.

    ``target/kind=0`` holds the archives (concatenated gzip members), ``target/kind=1`` for each the
    index: JSON objects with offset and length, ended by a zero byte. Archive and index of a part have the
    same file name. A source without records gives two empty folders.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz")
    found = files.load(source).select("content")
    members = found.mapInArrow(_members, "kind int, seq bigint, value binary")
    ordered = members.sortWithinPartitions("kind", "seq").select("kind", F.col("value").cast("string").alias("value"))
    ordered.write.partitionBy("kind").option("lineSep", NUL).text(target)
    for kind in (ARCHIVE, INDEX):
        make_folder(spark, f"{target}/kind={kind}")


# -- reading ----------------------------------------------------------------------------------------

_READ = (
    "name string, offset bigint, length bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "url string, payload binary"
)


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if digits in ("", "none") else int(digits)


def members(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each record of an archive, member after member."""
    at, found = 0, None
    while at < len(data):
        machine, start, out = zlib.decompressobj(31), at, []
        while not machine.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a member")
            piece = data[at : at + (1 << 16)]
            out.append(machine.decompress(piece))
            at += len(piece)
        at -= len(machine.unused_data)
        record = b"".join(out)
        if record:
            if found:
                yield found
            found = (start, at - start, record)
        else:  # the empty member behind a long record
            found = (found[0], at - found[0], found[2])
    if found:
        yield found


def _row(record: bytes, with_payload: bool) -> tuple:
    parsed = parse(record)
    head = parsed.headers
    kind, size = head["WARC-Type"], int(head["X-Payload-Length"])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(parsed.payload), hashlib.sha256(parsed.payload).hexdigest()) != (size, digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} isn't what its headers say")
    return (
        _number(head["WARC-Record-ID"]), size, digest, kind, _number(head.get("WARC-Refers-To")),
        head.get("WARC-Target-URI"), parsed.payload if with_payload and kind == "response" else None,
    )


def _walk(batches: Iterator[pa.RecordBatch], with_payload: bool):
    for batch in batches:
        for name, archive in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
            rows = []
            for offset, length, record in members(memoryview(archive.as_buffer())):
                rows.append((name, offset, length, *_row(record, with_payload)))
                if len(rows) >= 1000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)


def _cut(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for name, archive, places in zip(
            batch.column("name").to_pylist(), batch.column("content"), batch.column("places").to_pylist(), strict=True
        ):
            data = memoryview(archive.as_buffer())
            rows = []
            for p in places:
                record = b"".join(inflate(data[p["offset"] : p["offset"] + p["length"]]))
                rows.append((name, p["offset"], p["length"], *_row(record, True)))
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    types += [pa.int64(), pa.string(), pa.binary()]
    names = [f.split(" ")[0] for f in _READ.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _files(spark: SparkSession, path: str, kind: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/kind={kind}")
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: name of the archive, offset, length, page_id, type, uri, digest."""
    lines = spark.read.option("lineSep", NUL).text(f"{path}/kind={INDEX}")
    fields = F.from_json("value", "offset bigint, length bigint, id string, type string, uri string, digest string")
    name = F.regexp_extract("_metadata.file_path", "([^/]+)$", 1)
    digits = F.regexp_extract("i.id", "^<urn:page:(-?[0-9]+)>$", 1)
    rows = lines.select(name.alias("name"), fields.alias("i"))
    page = F.when(digits != "", digits).cast("bigint").alias("page_id")
    return rows.select("name", "i.offset", "i.length", page, "i.type", "i.uri", "i.digest")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Archives are read member by member; a response's payload is checked against its digest and length, and
    a record counts only where the index has it at that place. A revisit's payload is null: it is that of
    ``refers_to``.
    """
    found = _files(spark, path, ARCHIVE).mapInArrow(lambda it: _walk(it, with_payload), _READ)
    listed = read_index(spark, path).select("name", "offset", "length")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    return found.join(listed, ["name", "offset", "length"], "left_semi").select(*columns)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records of the page_ids in ``wanted``, each cut out of its archive by the index."""
    places = read_index(spark, path).join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    places = places.groupBy("name").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    both = _files(spark, path, ARCHIVE).join(places, "name").select("name", "content", "places")
    return both.mapInArrow(_cut, _READ).drop("name", "offset", "length")
