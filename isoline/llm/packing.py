"""Best-fit packing by minimum bin slack.

Every text becomes ids plus an end id; only documents longer than the capacity are cut. Only the histogram of piece lengths (at most
`capacity` rows, however large the corpus) reaches the driver. There each bin takes the longest length left and a bitset subset-sum
programme over the lengths still available finds the fullest feasible filling; that pattern is then removed as often as the counts allow.
Pieces are numbered within their length (local rank plus the offset of their task), and a rank finds its sequence in the plan, whose size the capacity
bounds. Every piece keeps its ids, written once to the shared folder; `sequences` joins the pieces of a sequence to what a training job reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoline.llm.common import BROADCAST_IDS, batch, fresh_path, rows_of, text_or_empty
from isoline.llm.tokenizing import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, pack_part int, pack_rank bigint"
PLAN = "length bigint, rank_from bigint, rank_to bigint, first_sequence bigint, times bigint, first_offset bigint"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths (given in descending order) with the largest sum of at most room."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(counts[n], room // n)):
            new = (reach | reach << n) & mask
            if new == reach:
                break
            steps.append((n, reach))
            reach = new
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        if not before >> left & 1:
            used[n] = used.get(n, 0) + 1
            left -= n
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern: length -> times, how many bins follow it), by minimum bin slack."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths, bins = sorted(counts, reverse=True), []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        used = fullest(lengths, counts, capacity - top) if top < capacity else {}
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        bins.append((used, times))
        lengths = [n for n in lengths if counts[n]]
    return bins


def plan_table(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, rank end, first sequence, times in a sequence, offset in it), in order of length and rank."""
    at: dict[int, int] = {}
    rows, sequence = [], 0
    for used, times in bins:
        offset = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            rows.append((n, at.get(n, 0), at.get(n, 0) + k * times, sequence, k, offset))
            at[n] = at.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def _cut(tokenizer_path: str, end_id: int, capacity: int):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("pack_part", pa.int32()), ("pack_rank", pa.int64())])
        ranks, part, end = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        enc = encoder(tokenizer_path)
        for b in rows_of(batches, 256):
            out = {f.name: [] for f in schema}
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    x = ids[at : at + 4 * capacity]
                    n = len(x) // 4
                    for k, v in zip(out, (doc_id, p, at // 4, n, x, part, int(ranks[n])), strict=True):
                        out[k].append(v)
                    ranks[n] += 1
            yield batch(schema, out)
        enc.older = {}
        pa.default_memory_pool().release_unused()

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit integers), ids_crc32 of these, sequence_id, offset.

    A null or empty text is the end id alone. Null ids and repeated rows are packed like any other row. No rows give no rows. Other columns
    of docs are not read. Ties in length are broken by task and order of reading, so sequence numbers may differ between runs; their number may not.
    """
    if not 0 < capacity < 1 << 19:
        raise ValueError("capacity must be in 1 .. 2**19 - 1")
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "pieces")
    cut = docs.select(F.col(id_col).cast("bigint"), text_or_empty(text_col)).mapInArrow(_cut(tokenizer_path, end_id, capacity), PIECES)
    cut.write.parquet(path)
    pieces = spark.read.schema(PIECES).parquet(path)
    per_part = pieces.groupBy("pack_part", "length").count()
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_table(plan_bins(histogram, capacity))  # a filling ends with a length used up, so there are at most `capacity` of them
    plan = F.broadcast(spark.createDataFrame(plan.tolist(), PLAN))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("pack_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select("pack_part", "length", F.coalesce(before, F.lit(0)).alias("pack_before"))
    if offsets.count() <= BROADCAST_IDS:
        offsets = F.broadcast(offsets)
    rank = F.col("pack_rank") + F.col("pack_before")
    ranked = pieces.join(offsets, ["pack_part", "length"]).withColumn("rank", rank).join(plan, "length").where("rank >= rank_from and rank < rank_to")
    return ranked.selectExpr("doc_id", "piece", "start", "length", "ids", "crc32(ids) AS ids_crc32", "first_sequence + (rank - rank_from) div times AS sequence_id", "first_offset + (rank - rank_from) % times * length AS offset")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of what `pack` returns: sequence_id, length, ids, parts (doc_id, piece, start, length, offset, in order of offset)."""
    piece = F.struct("offset", "length", "doc_id", "piece", "start", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(piece)).alias("all"))  # at most `capacity` tokens
    part = F.transform("all", lambda x: F.struct(*(x[k].alias(k) for k in ("doc_id", "piece", "start", "length", "offset"))))
    return rows.select("sequence_id", "length", F.aggregate("all", F.lit(b""), lambda ids, x: F.concat(ids, x["ids"])).alias("ids"), part.alias("parts"))
