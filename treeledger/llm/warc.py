"""WARC archives with a Zstandard dictionary.

Each archive is one file: a skippable frame that holds the dictionary, then one frame for each record. The dictionary is
trained once from at most SAMPLE_ROWS of the records to be archived (those with the smallest key hashes; the
archives themselves hold every record whole): of each, WINDOWS windows of WINDOW_BYTES that are spread over the whole payload. Every archive
embeds it, so each can be read by itself. A record whose payload is archived elsewhere is written as a revisit.

Archives are written through `pyarrow.fs` under a folder that all executors share, under names of the attempt that writes them. The
list of archives is a table that Spark commits once all is written, so what a lost or speculative attempt left is in no list.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.common import materialize, scratch_path

#: Fixed values of the formats: the skippable frame that holds a dictionary, a dictionary's and a frame's first bytes.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"

SAMPLE_ROWS = 512
WINDOWS, WINDOW_BYTES = 8, 1024
DICTIONARY_BYTES = 65_536
LEVEL = 6
LEAST_REVISITED = 1000
#: An archive is closed once its payloads reach this size.
BYTES_AN_ARCHIVE = 256 << 20
SALTS = 64
#: Archives are read by at most so many tasks.
READERS = 20_000


@dataclass
class Record:
    kind: str
    page_id: int | None  # of a page without an id: none
    url: str
    payload: bytes
    n_bytes: int
    digest: str
    refers_to: int | None


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing when the samples are too few or too small to train one from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def render(r: Record) -> bytes:
    """One record: WARC headers, the HTTP response's headers and, unless it is a revisit, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.n_bytes}\r\n\r\n".encode()
    block = http if r.kind == "revisit" else http + r.payload
    head = [
        "WARC/1.1", f"WARC-Type: {r.kind}", f"WARC-Record-ID: <urn:page:{'' if r.page_id is None else r.page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {r.url}", f"WARC-Payload-Digest: sha1:{r.digest}",
    ]
    if r.kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{r.refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Record:
    """The record of one frame; a response's length and digest are taken from its payload, and its stated digest must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(s[len("<urn:page:") : -1]) if len(s) > len("<urn:page:>") else None
    stated = named["WARC-Payload-Digest"].removeprefix("sha1:")
    n = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    kind = named["WARC-Type"]
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"record {named['WARC-Record-ID']} does not hold the payload that it states")
    return Record(kind, number(named["WARC-Record-ID"]), named["WARC-Target-URI"], payload, n, stated, number(named["WARC-Refers-To"]) if kind == "revisit" else None)


def write_archive(out, records: Iterator[Record], dictionary: bytes) -> int:
    """Write an archive to an open stream; returns the number of records."""
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
    if packed:
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    maker = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    n = 0
    for r in records:
        out.write(maker.compress(render(r)))
        n += 1
    return n


def read_archive(stream: io.RawIOBase) -> Iterator[Record]:
    """The records of an archive, one frame at a time."""
    head, dictionary = stream.read(8), None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_FRAME:
        raw = stream.read(struct.unpack("<II", head)[1])
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw)
        left = b""
    else:
        left = head
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while left or (left := stream.read(1 << 18)):
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(left))
            if frame.eof:
                break
            if not (left := stream.read(1 << 18)):
                raise ValueError("the archive ends within a record")
        left = frame.unused_data
        yield parse(b"".join(parts))


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes and payload_digest of every row."""
    url = F.coalesce("url", F.lit(""))
    # Line breaks would end the header that holds the url.
    url = F.replace(F.replace(url, F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))
    rows = pages.select(F.col("page_id").cast("long"), url.alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))


def planned(pages: DataFrame) -> DataFrame:
    """Payloads with refers_to (null for responses).

    Only digests and ids are shuffled to find the copies. The largest page_id of each digest is copied to every salt,
    so copies of one payload, however many, are spread over as many tasks.
    """
    rows = payloads(pages)
    large = rows.where(F.col("payload_bytes") >= LEAST_REVISITED)
    latest = large.groupBy("payload_digest").agg(F.max("page_id").alias("latest"), F.min("page_id").alias("first"), F.count("*").alias("n"), F.count("page_id").alias("named"))
    latest = latest.where("first <> latest OR named BETWEEN 1 AND n - 1")
    latest = latest.select("payload_digest", "latest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pair = lambda df: df.select(F.col("page_id").isNull().alias("nameless"), F.coalesce("page_id", F.lit(0)).alias("id"), "payload_digest")
    copies = pair(large).withColumn("salt", F.pmod(F.hash("nameless", "id"), F.lit(SALTS))).join(latest, ["payload_digest", "salt"])
    copies = copies.where("nameless OR id <> latest").select("nameless", "id", "payload_digest", F.col("latest").alias("refers_to")).distinct()
    # By digest too: rows that share a page_id may hold other payloads, which are no copies.
    keyed = rows.withColumns({"nameless": F.col("page_id").isNull(), "id": F.coalesce("page_id", F.lit(0))})
    return keyed.join(copies, ["nameless", "id", "payload_digest"], "left").select(*rows.columns, "refers_to")


def sampled(pages: DataFrame) -> list[bytes]:
    """Records of the windows that the dictionary is trained from."""
    keyed = payloads(pages).withColumn("k", F.xxhash64("payload_digest", "url", "page_id"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.substring("payload", (i * F.col("payload_bytes") / WINDOWS).cast("int") + 1, F.lit(WINDOW_BYTES)))
    # A page that is shorter than its windows together is taken as it is.
    whole = F.array(F.substring("payload", 1, WINDOWS * WINDOW_BYTES))
    parts = F.when(F.col("payload_bytes") <= WINDOWS * WINDOW_BYTES, whole).otherwise(parts)
    # Keys first, as a sort would carry the payloads along.
    keys = [r["k"] for r in keyed.select("k").orderBy("k").limit(SAMPLE_ROWS).collect()]
    rows = keyed.where(F.col("k") <= (keys[-1] if keys else 0)).select("page_id", "url", parts.alias("parts")).limit(SAMPLE_ROWS).collect()
    out = []
    for r in rows:
        first, *more = map(bytes, r["parts"])
        out += [render(Record("response", r["page_id"], r["url"], first, len(first), hashlib.sha1(first).hexdigest(), None)), *more]
    return out


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, bytes_an_archive: int = BYTES_AN_ARCHIVE) -> DataFrame:
    """Write archives under `folder` and return the written list of them: path, records."""
    dictionary = train(sampled(pages))

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()

        def rows():
            for b in batches:
                for r in b.to_pylist():
                    yield Record("response" if r["refers_to"] is None else "revisit", r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["payload_digest"], r["refers_to"])

        def some(first):
            left, r = bytes_an_archive, first
            while r is not None:
                yield r
                left -= r.n_bytes
                r = next(every, None) if left > 0 else None

        every = rows()
        for k, first in enumerate(every):
            path = f"{root}/archive-{task.partitionId():06d}-{k:04d}-{task.taskAttemptId()}.warc.zst"
            with fs.open_output_stream(path, compression=None) as out:
                n = write_archive(out, some(first), dictionary)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return materialize(spark, planned(pages).mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream):
                        rows.append((r.page_id, r.url, r.n_bytes, r.digest, r.kind, r.refers_to))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("path").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write every page's record, read the archives back; returns what read_archives does.

    Null html is an empty payload, a null url an empty one. A row with a null page_id has a record too, which names no page; it can
    revisit a page but not be referred to. Repeated rows are written as often as they occur; with an equal page_id neither refers to the other. Rows
    of one page_id with different html are told apart by their payloads. An empty table gives no rows. Line breaks in a url are written as %0A and %0D.
    Other columns are ignored. Archives stay under the shared folder.
    """
    folder = scratch_path(spark, "warc")
    written = write_archives(spark, pages, folder)
    return read_archives(written.repartition(max(1, min(READERS, written.count()))), folder)
