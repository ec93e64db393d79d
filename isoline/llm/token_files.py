"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A shard holds the ids of its documents as little-endian unsigned 32-bit integers, one after another; beside it lies an index (its document ids
and token counts as Arrow). Documents are range-partitioned by doc_id, so shard order is doc_id order and a shard's first global position is the
sum of the ids of those before it. A task writes under a name of its own attempt; only files that the committed manifest names are read, so
retried and speculative tasks do no harm.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.llm.common import batch, fresh_path, open_fs, rows_of, sweep, text_or_empty, written
from isoline.llm.seekable import SeekableReader, SeekableWriter
from isoline.llm.tokenizing import encoder

INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def _write(tokenizer_path: str, end_id: int, folder: str, frame_bytes: int):
    def run(batches):
        end, part = int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        name, total, docs = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex[:8]}", 0, 0
        files, path = open_fs(name)
        files.create_dir(open_fs(folder)[1], recursive=True)
        out = index = writer = None
        for b in rows_of(batches, 1024, 1 << 22):
            if out is None:
                out = files.open_output_stream(f"{path}.ids.zst", compression=None)
                writer = SeekableWriter(out, frame_bytes)
                index_file = files.open_output_stream(f"{path}.index.arrow", compression=None)
                index = pa.ipc.new_file(index_file, INDEX)
            ns = []
            for ids in encoder(tokenizer_path).encode(b.column(1).to_pylist()):
                writer.write(ids + end)
                ns.append(len(ids) // 4 + 1)
            index.write_batch(batch(INDEX, {"doc_id": b.column(0).to_pylist(), "n_tokens": ns}))
            total, docs = total + sum(ns), docs + len(ns)
        if out is not None:
            writer.close()
            out.close()
            index.close()
            index_file.close()
            yield pa.RecordBatch.from_pydict({"shard_part": pa.array([part], pa.int32()), "shard": [name], "n_docs": pa.array([docs], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, *, end_id: int, folder: str | None = None, frame_bytes: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns their manifest (shard_part, shard, n_docs, n_ids), itself a written table.

    Order: doc_id ascending with null ids first; rows of one doc_id by their text. Null text is empty: the end id alone. An empty table writes no shard.
    In a folder of its own (none given), files that lost attempts left are removed.
    """
    own, folder = folder is None, folder or fresh_path(docs.sparkSession, "token-files")
    ordered = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(_write(tokenizer_path, end_id, folder, frame_bytes), "shard_part int, shard string, n_docs bigint, n_ids bigint"), "token-manifest")
    if own:
        sweep(docs.sparkSession, folder, [r["shard"] for r in manifest.select("shard").collect()])  # a row for each shard
    return manifest


def _read(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            files, path = open_fs(name)
            with files.open_input_file(f"{path}.index.arrow") as listed, files.open_input_file(f"{path}.ids.zst") as f:
                index = pa.ipc.open_file(listed)
                reader = SeekableReader(f, f.size())
                held, frame = bytearray(), 0
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    out = {"doc_id": part.column(0), "start": [], "n_tokens": part.column(1), "ids_crc32": []}
                    for n in part.column(1).to_pylist():
                        while len(held) < 4 * n:
                            held += reader.frame(frame)
                            frame += 1
                        out["start"].append(at)
                        out["ids_crc32"].append(zlib.crc32(held[: 4 * n]))
                        del held[: 4 * n]
                        at += n
                    yield pa.RecordBatch.from_arrays([out["doc_id"], pa.array(out["start"], pa.int64()), out["n_tokens"], pa.array(out["ids_crc32"], pa.int64())], schema=schema)


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Frame checksums are verified."""
    rows, at = [], 0
    for r in sorted(manifest.select("shard_part", "shard", "n_ids").collect()):  # a row for each shard, not for each document
        rows.append((r["shard"], at))
        at += r["n_ids"]
    shards = spark.createDataFrame(rows, "shard string, first bigint")
    return shards.repartition(max(1, len(rows))).mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_document(shard: str, position: int) -> bytes:
    """The ids of the document at a position of the shard's index, decompressing only the frames that hold them."""
    files, path = open_fs(shard)
    ns = pa.ipc.open_file(files.open_input_file(f"{path}.index.arrow")).read_all()["n_tokens"].to_pylist()
    with files.open_input_file(f"{path}.ids.zst") as f:
        return SeekableReader(f, f.size()).read(4 * sum(ns[:position]), 4 * ns[position])
