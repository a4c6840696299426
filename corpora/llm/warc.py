"""Web archives: a writer that marks equal payloads as revisits, and a sequential reader.

An archive is a run of gzip members, one per record. Tasks write archives under names of their
own into a folder that all machines share and return a manifest row for each; what a lost task
left behind is in no manifest and is never read. The reader takes an archive from front to
back with incremental decompression, frames each record by its Content-Length and checks the
length, the block digest and the payload digest.

Nulls: a null payload is empty; a null id or url is left out of the record. Rows with the id
of the kept response and its payload (repeated rows) are responses too. An empty table gives
an empty manifest and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpora.session import materialize, scratch_path

#: A profile name that the format defines for records with a payload seen before.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 1 << 16
_SALTS = 64


def _shared_folder(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of the session's file system, as pyarrow names it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, place = whole.split(":", 1)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if scheme not in ("file", "hdfs", "viewfs", "s3", "gs"):
        raise ValueError(f"archives cannot be written to {whole}")
    return f"{scheme}://{place.removeprefix('//')}"


def with_revisits(
    pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000
) -> DataFrame:
    """``id``, ``url``, ``payload`` (bytes) and ``refers_to`` of every row.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is the
    response; ``refers_to`` of the others is its id. Groups are found by digest and size, which
    are summed up before they are shuffled. Only digests found more than once are joined back.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), body.alias("payload"))
    size = F.octet_length("payload")
    own = F.concat(F.lit("alone-"), F.xxhash64("id", "url"))  # spreads the rows that are never joined
    digest = F.concat(F.sha1("payload"), F.lit("-"), size)
    rows = rows.withColumn("digest", F.when(size >= least, digest).otherwise(own))
    groups = rows.where(size >= least).groupBy("digest")
    shared = groups.agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1").select(F.col("digest").alias("d"), "first")
    # a payload that a third of all rows have meets its response in many tasks
    repeated = shared.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(_SALTS)))
    joined = salted.join(repeated, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    refers = F.when(F.col("id").isNull() | (F.col("id") < F.col("first")), F.col("first"))
    return joined.select("id", "url", "payload", refers.alias("refers_to"))


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields)]
    lines += [f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def _member(id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One compressed record for a page."""
    name = "none" if id is None else str(id)
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.split())))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += b"Content-Length: %d\r\n\r\n" % len(payload)
    fields.append(("WARC-Payload-Digest", _digest(payload)))
    if refers_to is None:
        return _record(fields, head + payload)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _record(fields, head)


def write_archives(
    records: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", archive_bytes: int = 1 << 30
) -> DataFrame:
    """Write the rows of ``with_revisits`` as archives; returns the manifest (path, records, bytes).

    A task begins a new archive when one has ``archive_bytes``. The manifest is kept beside the
    archives, so that reading it again does not write again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root)
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = _member(*(c[row].as_py() for c in batch.columns), date)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    out = done.append((f"{base}/{name}", count, size))
        if out is not None:
            out.close()
            done.append((f"{base}/{name}", count, size))
        paths, counts, sizes = zip(*done) if done else ((), (), ())
        columns = [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "records", "bytes"])

    base = _shared_folder(records.sparkSession, folder)
    rows = records.select("id", "url", "payload", "refers_to")
    made = rows.mapInArrow(write, "path string, records bigint, bytes bigint")
    return materialize(made, "archives")


def read_members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record, from a stream that is read once.

    Each gzip member is one record: its header ends at the first empty line, its block has the
    number of bytes that Content-Length says, and two line ends follow.
    """
    pending = stream.read(_BLOCK)
    while pending:
        unpacker, chunks = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not pending:
                raise ValueError("the archive ends within a record")
            chunks.append(unpacker.decompress(pending))
            pending = unpacker.unused_data if unpacker.eof else stream.read(_BLOCK)
        pending = pending or stream.read(_BLOCK)
        whole = b"".join(chunks)
        head, found, rest = whole.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not found or not version.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields["Content-Length"])
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError("the block is not as long as its record says")
        yield fields, rest[:length]


def _checked(fields: dict[str, str], block: bytes) -> tuple:
    """Id, url, type, target, payload and its stated digest of a record whose digests hold."""
    if fields["WARC-Block-Digest"] != _digest(block):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not hold")
    payload = block.partition(b"\r\n\r\n")[2]
    stated = fields["WARC-Payload-Digest"]
    kind = fields["WARC-Type"]
    if kind == "response" and stated != _digest(payload):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not hold")
    digest = base64.b32decode(stated.removeprefix("sha1:")).hex()
    names = [fields.get(k, "") for k in ("WARC-Record-ID", "WARC-Refers-To")]
    id, target = (n.removeprefix("<urn:page:").removesuffix(">") or None for n in names)
    return (
        None if id == "none" else id, fields.get("WARC-Target-URI"), kind, target, digest,
        len(payload) if kind == "response" else None, payload,
    )


def read_archives(manifest: DataFrame, id_type: str = "bigint", with_payload: bool = True) -> DataFrame:
    """Records of the archives that ``manifest`` lists, one archive to a task.

    Columns: ``id``, ``url``, ``record_type``, ``refers_to``, ``payload_digest`` (hex SHA-1 of
    the full payload), ``payload_bytes`` (null for a revisit, which has no payload of its own)
    and ``payload``. A record whose length or digests do not hold fails the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as stream:
                    rows, size = [], 0
                    for fields, block in read_members(stream):
                        rows.append(_checked(fields, block))
                        size += len(block) if with_payload else 200
                        if size > 1 << 24:
                            yield as_batch(rows)
                            rows, size = [], 0
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)

    names = ["id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    names += ["payload"] * with_payload
    kinds = "id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint"
    archives = manifest.select("path")
    one_each = archives.repartitionByRange(max(1, archives.count()), "path")
    found = one_each.mapInArrow(read, kinds + ", payload binary" * with_payload)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def with_full_size(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` of revisits, taken from the response they refer to.

    Fails if a revisit's target is missing or has another digest. Targets are joined as narrow
    rows, one for each id and digest.
    """
    targets = records.where("record_type = 'response' and id is not null")
    targets = targets.groupBy(F.col("id").alias("t"), F.col("payload_digest").alias("d"))
    targets = targets.agg(F.max("payload_bytes").alias("b"))
    same = (F.col("refers_to") == F.col("t")) & (F.col("payload_digest") == F.col("d"))
    lost = F.raise_error(F.concat(F.lit("no such response: "), F.col("refers_to").cast("string")))
    size = F.coalesce("payload_bytes", "b", lost.cast("bigint"))
    return records.join(targets, same, "left").withColumn("payload_bytes", size).drop("t", "d", "b")


def archived(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read their records back, without payloads."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[id]
    manifest = write_archives(with_revisits(pages, id, url, payload), scratch_path(spark, "warc"))
    # two passes read the records; the archives are unpacked once
    return with_full_size(materialize(read_archives(manifest, kind, with_payload=False), "records"))
