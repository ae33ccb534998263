"""WARC archives: a deterministic sharded writer and the reader that checks it.

Records are sorted by (id, payload digest), null ids first, and cut into shards of
about equal bytes.  The cuts are quantiles of that order by bytes, taken from rows
that a hash of id and digest picks (all rows of small tables): they follow from the
rows alone, not from how they lie or what range the ids span.  Each shard is one sorted stream; its writer rolls to a new
file when the compressed size is reached, one gzip member for each record, and
makes every header and digest anew from the payload.  Files are written below a
temporary name of the task attempt, listed in a manifest, and moved to their
final names by a second job that may be run again; a lost or repeated task leaves
nothing but temporary files, which go at the end.  Texts are shuffled once;
decisions on duplicates travel to their records as small marker rows of the same
sort, so that no hot payload meets itself in a join of texts.

Defined results: a null payload is empty; payloads below ``DEDUP_BYTES`` are all
responses; a row with a null id is a response without an id; rows repeated with
one id and payload are all written, as responses if that id is the smallest;
control characters in a URL are percent-encoded and a null URL is empty; further
columns are not archived; an empty table writes no file.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm.storage import shared_folder, stored

DEDUP_BYTES = 100
MOST_SHARDS, SHARD_BYTES, ROLL_BYTES = 65_536, 16 << 20, 64 << 20
#: Rows that the cuts are taken from, for each shard and at most (in expectation).
SHARD_SAMPLE, MOST_SAMPLE = 32, 1 << 19
#: Digits of a digest that place a record among those of its id.
_DIGITS = 16
DATE, GZIP_LEVEL = "1970-01-01T00:00:00Z", 6
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard long, roll int, name string, temporary string, records long, bytes long, sha256 string"
_RECORD = (
    "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}:{digest}'.encode()).hexdigest()[:32])}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; with refers_to a revisit, without payload."""
    digest = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if refers_to is None:
        block += payload
    else:
        fields |= {
            "WARC-Profile": _PROFILE,
            "WARC-Refers-To": record_id(refers_to, digest),
            "X-Refers-To-Page-Id": str(refers_to),
        }
    fields |= {
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Files:
    """The files of one task: temporary names of its own, rolled by compressed size."""

    def __init__(self, folder: str, roll_bytes: int) -> None:
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.temporary = f"{self.path}/_temporary/{uuid.uuid4().hex}"
        self.store.create_dir(self.temporary, recursive=True)
        self.roll_bytes, self.out, self.shard, self.roll = roll_bytes, None, None, 0
        self.done: list[tuple] = []

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.roll = shard, 0
        elif self.size + len(member) > self.roll_bytes:
            self.close()
            self.roll += 1
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.roll:05d}.warc.gz"
            self.out = self.store.open_output_stream(f"{self.temporary}/{self.name}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append(
                (self.shard, self.roll, self.name, f"{self.temporary}/{self.name}", self.records, self.size, self.sha.hexdigest())
            )
            self.out = None


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark, refers = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["page_id"], row["digest"])
                if row["kind"] == 0:
                    mark, refers = key, row["refers_to"]
                    continue
                files = files or _Files(folder, roll_bytes)
                made = record(row["page_id"], row["url"], row["payload"], refers if key == mark else None)
                files.add(row["shard"], _gzip_member(made))
        if files is not None:
            files.close()
            columns = zip(*files.done, strict=True)
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = [x.split()[0] for x in _MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    return write


def _committer(folder: str):
    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if store.get_file_info(row["temporary"]).type == fs.FileType.File:
                    store.move(row["temporary"], f"{path}/{row['name']}")
                if store.get_file_info(f"{path}/{row['name']}").size != row["bytes"]:
                    raise OSError(f"{row['name']} is not whole")
            yield batch

    return commit


def _key(page_id: int | None, digest: str) -> tuple[int, str]:
    return (-(1 << 63) - 1 if page_id is None else page_id, digest[:_DIGITS])


def shard_cuts(sizes: DataFrame, per_shard: int, n_shards: int) -> list[tuple[int, str]]:
    """The keys at which shards begin, but for the first; of sizes (page_id, digest, n)."""
    wanted = min(SHARD_SAMPLE * n_shards, MOST_SAMPLE)
    one_in = max(1, sizes.count() // wanted)
    picked = (
        sizes.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(one_in)) == 0)
        .groupBy("page_id", F.left("digest", F.lit(_DIGITS)).alias("digest"))
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    keys = sorted((_key(r["page_id"], r["digest"]), r["n"] * one_in) for r in picked)
    cuts, since = [], 0
    for key, n in keys:
        if since >= per_shard:
            cuts.append(key)
            since = 0
        since += n
    return cuts


def _shard_of(spark: SparkSession, cuts: list[tuple[int, str]]):
    shared = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf(T.LongType())
    def shard(page_ids: pa.Array, digests: pa.Array) -> pa.Array:
        at = shared.value
        keys = map(_key, page_ids.to_pylist(), digests.to_pylist())
        return pa.array([bisect.bisect_right(at, k) for k in keys], type=pa.int64())

    return shard


def write_warc(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES
) -> DataFrame:
    """Archive page_id, url and html below folder; returns the manifest, one row for each file."""
    whole = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    sizes = stored(whole.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n")), "warc-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    per_shard = max(shard_bytes, total // MOST_SHARDS + 1)
    n_shards = int(total // per_shard) + 1
    shard = _shard_of(pages.sparkSession, shard_cuts(sizes, total // n_shards + 1, n_shards))
    large = sizes.where(F.col("n") >= DEDUP_BYTES)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("__n")).where("__n > 1")
    marks = (
        large.join(first, "digest")
        .where("page_id <> refers_to")
        .select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to", F.lit(0).alias("kind"))
        .distinct()
    )
    rows = whole.select("*", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind")).unionByName(marks)
    manifest = (
        rows.withColumn("shard", shard("page_id", "digest"))
        .repartition(n_shards, "shard")
        .sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
        .mapInArrow(_writer(folder, roll_bytes), _MANIFEST)
    )
    written = stored(manifest, "warc-written")
    done = stored(written.mapInArrow(_committer(folder), _MANIFEST), "warc-manifest")
    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
        store.delete_dir(f"{path}/_temporary")
    return done.drop("temporary")


def _records(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a file, one gzip member after another."""
    data = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            data = data or stream.read(chunk)
            if not data:
                if parts:
                    raise OSError("the archive ends within a record")
                return
            parts.append(member.decompress(data))
            data = member.unused_data
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload; raises if lengths or digests do not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise OSError("not a WARC record of the length that it gives")
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise OSError(f"{fields['WARC-Record-ID']}: block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
        raise OSError(f"{fields['WARC-Record-ID']}: payload digest")
    return fields, http, payload


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        schema = pa.schema(
            [
                ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ]
        )
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in _records(stream):
                        f, http, _ = parse_record(data)
                        size = re.search(rb"\r\nContent-Length: (\d+)", http)
                        page, refers = f.get("X-Page-Id"), f.get("X-Refers-To-Page-Id")
                        rows.append(
                            {
                                "page_id": page and int(page),
                                "target_uri": f["WARC-Target-URI"],
                                "payload_bytes": int(size[1]),
                                "payload_digest": f["WARC-Payload-Digest"].removeprefix("sha256:"),
                                "record_type": f["WARC-Type"],
                                "refers_to": refers and int(refers),
                            }
                        )
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of all files of a manifest; every length and digest is checked."""
    return manifest.select("name").repartition(max(1, manifest.count()), "name").mapInArrow(_reader(folder), _RECORD)


def op7_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder).drop("target_uri")


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
