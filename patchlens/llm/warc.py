"""WARC archives: writing pages with revisits of equal payloads, and a reader that survives damage.

Archives are files of gzip members, one record each. The reader takes a member only if it
inflates, passes its checksum and holds one whole record of the stated length. After a failed
check it looks for the next place where a member (or, in archives that are not compressed, a
version line) starts and holds up, goes on from there, and logs the bytes in between as a gap.

Where a payload of at least `least` bytes occurs several times, the record of the smallest id
is a response and the others are revisits that name it. A revisit has no payload; its block
is the message header, which tells the length, and its digest is that of the payload.

Defined cases: a null payload counts as empty; a null address is written as an empty one;
rows without an id are written as responses with the id "none" and read back with a null id;
rows with the same id and payload are all written as responses; files that hold nothing readable give one gap; other columns are not archived.
"""

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.operators import joins

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
LEAST = 100

FIELDS = {
    "file": "string", "start": "bigint", "size": "bigint", "gap": "boolean", "reason": "string", "record_type": "string", "id": "string",
    "target": "string", "refers_to": "string", "payload_bytes": "bigint", "payload_digest": "string", "digest_ok": "boolean", "payload": "binary",
}


def header(lines: list[tuple[str, str]], block: bytes) -> bytes:
    rows = [VERSION, *(f"{k}: {v}".encode() for k, v in lines), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(rows) + b"\r\n\r\n"


def record(kind: str, own: str, target: str, digest: str, payload: bytes, first: str | None) -> bytes:
    """One record as it stands in an archive, before compression."""
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{own}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    lines += [("WARC-Target-URI", " ".join(target.split())), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        lines += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        block = message
    else:
        block = message + payload
    lines.append(("Content-Type", "application/http; msgtype=response"))
    return header(lines, block) + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


# --- reading ------------------------------------------------------------------------------


def parse(raw: bytes, at: int) -> tuple[dict[str, str], int, int] | str:
    """(fields, start of the block, end of the record) of the record at `at`, or what is wrong with it."""
    if raw[at : at + 5] != b"WARC/":
        return "no version line"
    head = raw.find(b"\r\n\r\n", at)
    if head < 0:
        return "unfinished header"
    first, *lines = raw[at:head].split(b"\r\n")
    if first not in (b"WARC/1.0", VERSION):
        return "unknown version"
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            return "malformed header line"
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdecimal() or "warc-type" not in fields:
        return "missing header field"
    block, end = head + 4, head + 4 + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        return "wrong length"
    return fields, block, end + 4


def contents(raw: bytes, fields: dict[str, str], block: int, end: int) -> dict | str:
    """The values of a parsed record, or what is wrong with its payload."""
    message, _, payload = raw[block : end - 4].partition(b"\r\n\r\n")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    told = next((x.split(b":")[1].strip() for x in message.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    ok = None
    if not revisit:
        ok = hashlib.sha256(payload).hexdigest() == stated
        if stated and not ok:
            return "payload does not match its digest"
    bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
    return {
        "record_type": fields["warc-type"], "id": bare(fields.get("warc-record-id")), "target": fields.get("warc-target-uri"),
        "refers_to": bare(fields.get("warc-refers-to")), "payload_bytes": int(told) if revisit and told.isdigit() else len(payload),
        "payload_digest": stated, "digest_ok": ok, "payload": None if revisit else payload,
    }


def inflate(raw: bytes, at: int) -> tuple[bytes, int] | str:
    """(content, end) of the gzip member at `at`."""
    unpacker = zlib.decompressobj(31)
    try:
        content = unpacker.decompress(memoryview(raw)[at:])
    except zlib.error as failure:
        return f"damaged member: {failure}"
    if not unpacker.eof:
        return "unfinished member"
    return content, len(raw) - len(unpacker.unused_data)


def whole_at(raw: bytes, at: int) -> tuple[list[dict], int] | str:
    """The records of the member or plain record at `at` and where it ends, or why there is none."""
    if raw[at : at + 3] == GZIP:
        found = inflate(raw, at)
        if isinstance(found, str):
            return found
        content, end = found
        records, inner = [], 0
        while inner < len(content):
            parsed = parse(content, inner)
            if isinstance(parsed, str):
                return parsed
            values = contents(content, *parsed)
            if isinstance(values, str):
                return values
            records.append(values)
            inner = parsed[2]
        return (records, end) if records else "empty member"
    parsed = parse(raw, at)
    if isinstance(parsed, str):
        return parsed
    values = contents(raw, *parsed)
    return values if isinstance(values, str) else ([values], parsed[2])


def next_start(raw: bytes, at: int) -> int:
    """The next place where a member or a version line may begin; the end if there is none."""
    places = [p for p in (raw.find(GZIP, at), raw.find(b"WARC/1.", at)) if p >= 0]
    return min(places, default=len(raw))


def salvage(raw: bytes) -> Iterator[dict]:
    """All records that hold up, and the gaps between them, in file order."""
    at, lost_from, why = 0, None, ""
    while at < len(raw):
        found = whole_at(raw, at)
        if isinstance(found, str):
            if lost_from is None:
                lost_from, why = at, found
            at = next_start(raw, at + 1)
            continue
        if lost_from is not None:
            yield {"start": lost_from, "size": at - lost_from, "gap": True, "reason": why}
            lost_from = None
        records, end = found
        for values in records:
            yield {"start": at, "size": end - at, "gap": False, "reason": ""} | values
        at = end
    if lost_from is not None:
        yield {"start": lost_from, "size": len(raw) - lost_from, "gap": True, "reason": why}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record and per gap of every archive under the path, any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from patchlens.llm.warc import FIELDS, salvage

        kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        kind = pa.schema([pa.field(name, kinds[t]) for name, t in FIELDS.items()])
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                for values in salvage(raw.as_py()):
                    rows.append({"file": name} | values)
                    size += len(values.get("payload") or b"")
                    if size > 8 << 20 or len(rows) >= 5_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return files.select("path", "content").mapInArrow(read, ", ".join(f"{k} {t}" for k, t in FIELDS.items()))


# --- writing ------------------------------------------------------------------------------


def write_archives(
    pages: DataFrame, folder: str, own: str = "page_id", target: str = "url", text: str = "html", least: int = LEAST, roll: int = 64 << 20
) -> DataFrame:
    """Write the archives of each partition into the shared folder; rows (file, records, bytes) of what was written.

    A retried task writes the same file again under another name and then moves it into place.
    """
    shared_store(folder)  # there is a folder to read even if there are no pages
    rows = pages.select(
        F.col(own).alias("own"), F.coalesce(F.col(target), F.lit("")).alias("target"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    keyed = F.when((F.octet_length("payload") >= least) & F.col("own").isNotNull(), F.col("digest"))
    firsts = rows.select("own", keyed.alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("own").alias("first"), F.count("*").alias("copies"))
    # Only copies need their first record; for all others the join finds nothing and the row is a response.
    firsts = firsts.where("copies > 1").select(F.col("digest").alias("_digest"), "first")
    salted = spread(rows.withColumn("_key", keyed), firsts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from patchlens.llm.warc import member, record

        task = TaskContext.get()
        store, place = shared_store(folder)
        batch = next(batches, None)
        number = 0
        while batch is not None:  # a new archive whenever one has grown to `roll` bytes
            name = f"part-{task.partitionId():05d}-{number:04d}.warc.gz"
            own_name = f"{place}/_{name}.{task.taskAttemptId()}"
            n = size = 0
            with store.open_output_stream(own_name, compression=None) as out:
                while batch is not None and size < roll:
                    for own, target, payload, digest, kind, first in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                        packed = member(record(kind, "none" if own is None else str(own), target, digest, payload, first))
                        out.write(packed)
                        n, size = n + 1, size + len(packed)
                    batch = next(batches, None)
            store.move(own_name, f"{place}/{name}")
            number += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    return salted.mapInArrow(write, "file string, records bigint, bytes bigint")


def spread(rows: DataFrame, firsts: DataFrame, salts: int = 32) -> DataFrame:
    """rows with kind and first; the copies of one payload are dealt over `salts` tasks."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("own", "target"), F.lit(salts)))
    right = firsts.select(F.col("_digest").alias("_key"), "first", F.explode(joins.salts(F.lit(salts))).alias("_salt"))
    joined = left.join(right, ["_key", "_salt"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("own"))
    return joined.select(
        "own", "target", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first").cast("string")).alias("first")
    )


def shared_store(uri: str):
    """(file system, path) of a folder in any store that Arrow opens."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    store.create_dir(place, recursive=True)
    return store, place
