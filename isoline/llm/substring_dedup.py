"""Removal of passages that occur more than once: seed and extend over winnowed anchors.

1. Seeds. Of the digests of every `seed` words, the least (leftmost, in a tie) in each run of length - seed + 1 of them is an anchor. The choice depends on
   the words alone, so two equal windows of `length` words have the same anchor at the same place. An anchor stands for a run of consecutive windows.
2. Documents meet on anchors that occur more than once; all others are done with.
3. Extension, both ways at once. What an anchor's windows span to its left and right is compared by digest: where the whole span occurs again, all its
   windows do. Of one anchor's different spans (classes), those that occur once are taken apart into windows and met with the windows of one member of
   every other class of that anchor, which finds how far each of them really extends. No pairs of occurrences are made at any point: equal things are
   counted, with partial sums, and looked up by `join_keys`, so an anchor that a third of all documents share is spread over all tasks.
4. Windows that repeat are joined to maximal spans, and their words are removed. A text that occurs more than once and has a window is a repeat as a whole.

Digests have 64 bits; spans and windows are compared among those with the same anchor digest only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.llm.common import Scratch, batch, counted, join_keys, rows_of, text_or_empty, written

BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # ASCII white space


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ x >> np.uint64(32)


class Digests:
    """Digests of any runs of words of one text, from sums of word hashes times powers."""

    def __init__(self, hashes: np.ndarray):
        while len(_POWERS[0]) <= len(hashes):
            for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
                _POWERS[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(_POWERS[k]), b, np.uint64)]))
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _POWERS[0][: len(hashes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * _POWERS[1][starts]
        return _mixed(x + (ends - starts).astype(np.uint64))


def leftmost_minima(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of its least one, the leftmost in a tie."""
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        have += step
    return at


def anchors_of(hashes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor digest, span digest, first window, windows) of each run of windows with one anchor."""
    windows = len(hashes) - length + 1
    if windows < 1:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    digests, starts = Digests(hashes), np.arange(len(hashes) - seed + 1)
    grams = digests.of(starts, starts + seed)
    at = leftmost_minima(grams, length - seed + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    end = np.r_[first[1:], windows]
    return grams[at[first]], digests.of(first, end + length - 1), first, end - first


def _seeds(length: int, seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("anchors", pa.list_(pa.int64())), ("spans", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("runs", pa.list_(pa.int32()))])

    def run(batches):
        known = _WordHashes()
        for b in rows_of(batches, 1000):
            out = {"doc_id": b.column(0), "digest": b.column(1), "n_words": [], "anchors": [], "spans": [], "firsts": [], "runs": []}
            for text in b.column(2).to_pylist():
                words = words_of(text)
                found = anchors_of(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), length, seed)
                out["n_words"].append(len(words))
                for k, v in zip(("anchors", "spans", "firsts", "runs"), found, strict=True):
                    out[k].append(v.view(np.int64))
            yield batch(schema, out)

    return run


def _windows(length: int):
    """(row, text, asked) to the windows of the asked runs; weight: 2 if the run's span occurs again."""
    schema = pa.schema([("row", pa.int64()), ("anchor", pa.int64()), ("window", pa.int64()), ("first", pa.int32()), ("weight", pa.int32())])

    def run(batches):
        known = _WordHashes()
        for b in rows_of(batches, 200):
            parts = {f.name: [np.empty(0, np.int64)] for f in schema}
            for row, text, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                digests = Digests(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                for x in asked:
                    at = np.arange(x["first"], x["first"] + x["run"])
                    for k, v in (("row", row), ("anchor", x["anchor"]), ("weight", x["weight"])):
                        parts[k].append(np.full(len(at), v, np.int64))
                    parts["first"].append(at)
                    parts["window"].append(digests.of(at, at + length).view(np.int64))
            yield batch(schema, {k: np.concatenate(v) for k, v in parts.items()})

    return run


def covered(n: int, firsts: np.ndarray, runs: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in one of the windows."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, firsts, 1)
    np.add.at(change, firsts + runs + length - 1, -1)
    return np.cumsum(change[:n]) > 0


def _removed(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())])

    def run(batches):
        for b in rows_of(batches, 1000):
            out = {f.name: [] for f in schema}
            for doc_id, text, whole, firsts, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                gone = np.full(len(words), bool(whole))
                if not whole and firsts:
                    gone = covered(len(words), np.array(firsts), np.array(runs), length)
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                left = words if not len(edges) else [w for w, g in zip(words, gone, strict=True) if not g]
                for k, v in zip(out, (doc_id, len(words), int(gone.sum()), [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()], b" ".join(left).decode("utf-8", "surrogatepass")), strict=True):
                    out[k].append(v)
            yield batch(schema, out)

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def repeated_windows(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """texts: doc_id, text. Returns digest (of a text with a window that occurs again), copies, whole, firsts, runs: its repeated windows, or whole for all."""
    scratch = Scratch(texts.sparkSession, "substring-dedup")
    found = texts.select("doc_id", _digest(F.col("text")).alias("digest"), "text").mapInArrow(_seeds(length, seed), "doc_id bigint, digest binary, n_words bigint, anchors array<bigint>, spans array<bigint>, firsts array<int>, runs array<int>")
    seeds = scratch.written(found.select(F.monotonically_increasing_id().alias("row"), "*").where(F.size("anchors") > 0), "seeds")
    copies = scratch.written(seeds.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    # seeds that meet
    runs = seeds.select("row", F.inline(F.arrays_zip("anchors", "spans", "firsts", "runs"))).toDF("row", "anchor", "span", "first", "run")
    again = scratch.written(runs.groupBy("anchor").agg(F.count("*").alias("met")).where("met > 1"), "anchors")
    met = scratch.written(join_keys(runs, again, "anchor", "met").drop("met"), "met")
    # whole spans
    classes = scratch.written(met.groupBy("anchor", "span").agg(F.count("*").alias("members"), *(F.first(c).alias(c) for c in ("row", "first", "run"))), "classes")
    spans = scratch.written(classes.where("members > 1").select("anchor", "span", "members"), "spans")
    settled = join_keys(met, spans, ["anchor", "span"], "members").select("row", "first", "run")
    # spans that occur once, against one member of each other class of their anchor
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("members") == 1).alias("single")).where("kinds > 1 and single > 0").select("anchor", "kinds")
    asked = join_keys(classes, scratch.written(mixed, "mixed"), "anchor", "kinds")
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "run", F.least("members", F.lit(2)).cast("int").alias("weight"))).alias("asked"))  # no more than a document's windows
    asked = scratch.written(asked.join(seeds.select("row", "doc_id", "digest"), "row").withColumn("id", F.coalesce("doc_id", F.lit(-1))).drop("doc_id"), "asked")
    wanted = scratch.written(asked.select("digest").distinct(), "wanted")
    known = texts.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), _digest(F.col("text")).alias("digest"), "text").join(counted(wanted), "digest", "left_semi")
    # texts that occur again may come several times; all their spans have the weight 2 anyway
    windows = known.join(asked, ["digest", "id"]).select("row", "text", "asked").mapInArrow(_windows(length), "row bigint, anchor bigint, window bigint, first int, weight int")
    windows = scratch.written(windows, "windows")
    shared = scratch.written(windows.groupBy("anchor", "window").agg(F.sum("weight").alias("times"), F.count("*").alias("rows")).where("times > 1").drop("times"), "shared")
    single = join_keys(windows, shared, ["anchor", "window"], "rows").where("weight = 1").select("row", "first", F.lit(1).alias("run"))
    # by document; of texts that occur again nothing more is needed
    copied = scratch.written(join_keys(seeds.select("row", "digest"), copies, "digest", "copies").select("row"), "copied")
    some = settled.unionByName(single).join(copied, "row", "left_anti").groupBy("row").agg(F.collect_list(F.struct("first", "run")).alias("x"))
    some = some.join(seeds.select("row", "digest"), "row").select("digest", F.lit(1).cast("bigint").alias("copies"), F.lit(False).alias("whole"), F.col("x.first").alias("firsts"), F.col("x.run").alias("runs"))
    none = F.lit(None).cast("array<int>")
    out = written(some.unionByName(copies.select("digest", "copies", F.lit(True).alias("whole"), none.alias("firsts"), none.alias("runs"))), "repeated-windows")
    scratch.clear()
    return out


def remove_repeats(docs: DataFrame, *, length: int = 35, seed: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans (start and end of the removed words), kept (the other words, joined by one space).

    Words stand between ASCII white space and are compared as they are. A word goes if one of its windows of `length` words also starts anywhere else in
    docs, same document included; all occurrences go. Null and empty texts have no words; texts shorter than a window lose nothing. Rows that repeat an id
    are documents of their own, as are null ids. Empty tables give no rows. Other columns of docs are not read.
    """
    if not 0 < seed <= length:
        raise ValueError("seed must be in 1 .. length")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = repeated_windows(texts, length, seed)
    every = join_keys(texts.withColumn("digest", _digest(F.col("text"))), found, "digest", "copies", how="left")
    return every.select("doc_id", "text", "whole", "firsts", "runs").mapInArrow(_removed(length), "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string")
