"""WARC records in seekable zstandard bundles.

Records are grouped into independent frames, a footer seek table lists the frames, and an index maps each record identifier to its bundle, its
frame and its offset in that frame. Equal payloads are stored once: one record of them is the response, the others are revisit records that refer
to it. Bundles are written under names of the task's attempt, and only those in the written index are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.llm.common import batch, fresh_path, join_keys, open_fs, rows_of, sweep, text_or_empty, written
from isoline.llm.seekable import SeekableReader, SeekableWriter

#: Revisit rows that are broadcast at most (about 40 bytes each).
BROADCAST_REVISITS = 200_000
FRAMES_A_TASK, MOST_TASKS = 64, 20_000
INDEX = "page_id bigint, bundle string, frame int, frame_offset bigint, record_bytes bigint"
_INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("record_bytes", pa.int64())])
_PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    x = urn.strip("<>").rpartition(":")[2]
    return None if x == "none" else int(x)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with an HTTP head and the payload, or a revisit (identical-payload-digest) with the head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "about:blank").split())),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(f: io.BytesIO) -> tuple[dict, dict, bytes] | None:
    """(WARC fields, HTTP fields, payload) of the record at the file's position, or None at its end."""
    if not (line := f.readline()):
        return None
    if line != b"WARC/1.1\r\n":
        raise ValueError("no WARC record here")

    def fields(g) -> dict:
        out = {}
        while (x := g.readline()) not in (b"\r\n", b""):
            k, _, v = x.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            out[k] = v
        return out

    head = fields(f)
    block = io.BytesIO(f.read(int(head["Content-Length"])))
    f.read(4)
    block.readline()
    http = fields(block)
    return head, http, block.read()


def _write(folder: str, frame_bytes: int):
    def run(batches):
        name = f"{folder}/bundle-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.zst"
        files, path = open_fs(name)
        files.create_dir(open_fs(folder)[1], recursive=True)
        out = writer = None
        for b in rows_of(batches, 500):
            if out is None:
                out = files.open_output_stream(path, compression=None)
                writer = SeekableWriter(out, 1 << 62)  # frames end between records
            rows = {f.name: [] for f in _INDEX}
            for page_id, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                data = warc_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers)
                for k, v in zip(rows, (page_id, name, len(writer.frames), writer.held, len(data)), strict=True):
                    rows[k].append(v)
                writer.write(data)
                if writer.held >= frame_bytes:
                    writer.end_frame()
            yield batch(_INDEX, rows)
        if out is not None:
            writer.close()
            out.close()

    return run


def write_bundles(pages: DataFrame, *, folder: str | None = None, least_bytes: int = 0, frame_bytes: int = 1 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the bundles and returns their index (page_id, bundle, frame, frame_offset, record_bytes), itself a written table.

    Of pages with equal payloads of at least least_bytes, the one with the largest page_id is the response. A null payload is empty. Pages with a
    null id are responses and nothing refers to them. Rows that repeat an id are written each. An empty table writes no bundle. In a folder of its own
    (none given), files that lost attempts left are removed.
    """
    own, folder = folder is None, folder or fresh_path(pages.sparkSession, "warc")
    all_pages = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(payload_col).alias("html"))
    digest = F.unhex(F.sha1("html"))
    digests = written(all_pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least_bytes)).select("page_id", digest.alias("digest")), "payload-digests")
    last = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first"), F.count("*").alias("copies")).where("first <> refers_to").select("digest", "refers_to", "copies")
    revisits = join_keys(digests, last, "digest", "copies").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    revisits = written(revisits, "revisits")
    keyed = all_pages.withColumn("digest", digest)
    few = revisits.count() <= BROADCAST_REVISITS  # else payloads are dealt by their page
    records = keyed.join(F.broadcast(revisits) if few else revisits.hint("shuffle_hash"), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    index = written(records.mapInArrow(_write(folder, frame_bytes), INDEX), "warc-index")
    if own:
        sweep(pages.sparkSession, folder, [r["bundle"] for r in index.select("bundle").distinct().collect()])  # a row for each bundle
    return index


def _read(batches):
    for b in batches:
        for name, first, last in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            files, path = open_fs(name)
            with files.open_input_file(path) as source:
                reader = SeekableReader(source, source.size())
                for k in range(first, last + 1):
                    f, out = io.BytesIO(reader.frame(k)), {x.name: [] for x in _PAGES}
                    while (record := parse_record(f)) is not None:
                        head, http, payload = record
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and sha1_base32(payload) != digest:
                            raise ValueError(f"{name}, frame {k}: payload digest")
                        refers = _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                        for c, v in zip(out, (_page(head["WARC-Record-ID"]), int(http["Content-Length"]), digest, head["WARC-Type"], refers), strict=True):
                            out[c].append(v)
                    yield batch(_PAGES, out)


def read_bundles(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Per record, from the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to. Frame checksums and payload digests are verified.

    Each task reads about FRAMES_A_TASK frames of one bundle, so the archive's size sets the number of tasks.
    """
    parts = index.groupBy("bundle", F.expr(f"frame div {FRAMES_A_TASK}").alias("part")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    parts = written(parts.select("bundle", "first", "last"), "warc-parts")
    dealt = parts.repartition(min(MOST_TASKS, max(1, parts.count())))  # a number given here is not merged by adaptive execution
    return dealt.mapInArrow(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def read_record(bundle: str, frame: int, frame_offset: int) -> tuple[dict, dict, bytes]:
    """One record by its index entry, decompressing its frame only."""
    files, path = open_fs(bundle)
    with files.open_input_file(path) as source:
        f = io.BytesIO(SeekableReader(source, source.size()).frame(frame))
    f.seek(frame_offset)
    return parse_record(f)
