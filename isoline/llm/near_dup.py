"""Near-duplicate groups by b-bit MinHash.

1. Each text becomes its set of word shingles; HASHES minima over it give BANDS band keys and a packed signature of the minima's low BITS bits.
   Documents with equal sets form a class, and only class representatives go on, so thousands of exact copies cost one entry.
2. Candidates are representatives that share a band key. Every member of a bucket is paired with one centre only (a star), the member that meets
   most others in its buckets; the packed signatures give a collision-corrected similarity by bit counts, and pairs far below the limit go.
3. The pairs that are left are confirmed on the full shingle sets, and confirmed links are joined into components.
4. A star can miss a link between two members that are not linked to its centre, so buckets whose members are not all in one component are met again:
   members outside the centre's component against the bucket's members in other components. The join itself asks for a high estimate, also from a longer
   signature (LONG minima) that only texts of such buckets get; what is left is confirmed and joined in the same way.
   After that every candidate pair is either inside one component or has been refused.

Six rows in 42 bands miss a pair of similarity 0.8 with probability 3e-6 and one of 0.9 with 2e-14; the estimate is refused five standard deviations below the limit (3e-7).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.llm.common import Scratch, batch, counted, held, join_keys, rows_of, text_or_empty, written
from isoline.llm.graph import connected_components

ROWS, BANDS, BITS = 6, 42, 2
HASHES = ROWS * BANDS
WORDS64 = -(-HASHES * BITS // 64)
_rng = np.random.default_rng(20240607)
A = (_rng.integers(1, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
#: Minima of the longer signature, for texts in buckets that a star does not settle.
LONG = 4096
#: Pairs that one sending of a text serves; members of a bucket that one task compares with as many others.
PAIRS_A_TEXT, BLOCK_ROWS = 256, 4096
BAND_SEEDS = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
A_LONG = (_rng.integers(1, 1 << 32, LONG, dtype=np.uint64) | 1).astype(np.uint32)
B_LONG = _rng.integers(0, 1 << 32, LONG, dtype=np.uint64).astype(np.uint32)
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles: A-Z in lower case, words between ASCII white space; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(held("words", _WordHashes).__getitem__, words), np.uint64, len(words))
    w = min(width, len(words))
    out = np.full(len(h) - w + 1, w, np.uint64)
    for k in range(w):
        out = (out ^ h[k : len(h) - w + 1 + k]) * MIX[0]
        out ^= out >> np.uint64(29)
        out *= MIX[1]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(shingles: np.ndarray, a: np.ndarray = A, b: np.ndarray = B) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least, step = np.full(len(a), 0xFFFFFFFF, np.uint32), max(1, 65_536 // len(a))
    for at in range(0, len(x), step):
        part = x[at : at + step, None] * a
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each (mixed) minimum, as 64-bit integers."""
    m = least ^ least >> np.uint32(15)
    m = m * np.uint32(0x2C1B3C6D)
    m ^= m >> np.uint32(13)
    bits = np.zeros(-(-len(least) * BITS // 64) * 64, np.uint8)
    for k in range(BITS):
        bits[k : len(least) * BITS : BITS] = m >> np.uint32(k) & np.uint32(1)
    return np.packbits(bits).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * BAND_SEEDS).sum(axis=1, dtype=np.uint64)
    keys ^= keys >> np.uint64(31)
    return (keys * MIX[1] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])

    def run(batches):
        for b in rows_of(batches, 2000):
            out = {f.name: [] for f in schema}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width)
                out["doc_id"].append(doc_id)
                out["n_shingles"].append(len(s))
                if len(s):
                    least = minima(s)
                    out["set_digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    out["bands"].append(band_keys(least))
                    out["sig"].append(packed(least))
                else:
                    for k in ("set_digest", "bands", "sig"):
                        out[k].append(None)
            yield batch(schema, out)
        held("words", _WordHashes).clear()
        pa.default_memory_pool().release_unused()

    return run


def _sign_long(width: int):
    schema = pa.schema([("rep", pa.int64()), ("long_sig", pa.list_(pa.int64()))])

    def run(batches):
        for b in rows_of(batches, 500):
            yield batch(schema, {"rep": b.column(0), "long_sig": [packed(minima(shingle_set(t, width), A_LONG, B_LONG)) for t in b.column(1).to_pylist()]})

    return run


def _differ(a: Column, b: Column) -> Column:
    """Minima that differ in one pair of packed words (a minimum differs if either of its two bits does)."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _corrected(differ: Column, hashes: int) -> Column:
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(hashes))) - chance) / (1 - chance)


def estimate_long(sig_a: str, sig_b: str) -> Column:
    return _corrected(F.aggregate(F.zip_with(sig_a, sig_b, _differ), F.lit(0), lambda n, x: n + x), LONG)


def estimate(sig_a: str, sig_b: str) -> Column:
    """Collision-corrected similarity from packed signatures, by bit counts."""
    return _corrected(sum((_differ(F.col(sig_a)[k], F.col(sig_b)[k]) for k in range(1, WORDS64)), _differ(F.col(sig_a)[0], F.col(sig_b)[0])), HASHES)


def _confirm(width: int, percent: int):
    """A scalar pandas function: are the texts' full shingle sets similar enough? Equal neighbours on the right side are hashed once."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, held = [], None, None
        for a, b in zip(left, right, strict=True):
            if b != last:
                last, held = b, shingle_set(b, width)
            s = shingle_set(a, width)
            both = len(np.intersect1d(s, held, assume_unique=True))
            out.append(bool(len(s)) and 100 * both >= percent * (len(s) + len(held) - both))
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(run, "boolean")


def _of_repeated_ids(texts: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """near_duplicates of a table in which a doc_id has different sets: each row is a node of its own, then groups that share a doc_id are joined."""
    rows = written(texts.where("doc_id is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    grouped = near_duplicates(rows, width=width, percent=percent, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    owners = written(rows.select("row", "doc_id").join(grouped, "row").select("doc_id", "component_id").distinct(), "owners")
    least = owners.groupBy("component_id").agg(F.min("doc_id").alias("v"))
    component = connected_components(owners.join(least, "component_id").select(F.col("doc_id").alias("u"), "v"), "shared")
    entry = signed.select("doc_id", "n_shingles").join(component.toDF("doc_id", "component"), "doc_id", "left")
    found = F.coalesce("component", "doc_id")
    return entry.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(found == F.col("doc_id"), F.lit(True)).alias("kept"))


def _confirmed(scratch: Scratch, texts: DataFrame, pairs: DataFrame, width: int, percent: int, label: str) -> DataFrame:
    """pairs (u, v) of representatives: those whose full sets are similar enough.

    A text that many pairs name is sent once for each PAIRS_A_TEXT of them, so neither its pairs nor its copies land in one task.
    """
    likely = scratch.written(pairs.distinct(), f"{label}-likely")
    dealt, counts = likely, {}
    for end, other in (("u", "v"), ("v", "u")):
        counts[end] = scratch.written(likely.groupBy(end).agg(F.count("*").alias("pairs")), f"{label}-{end}")
        parts = F.ceil(F.col("pairs") / PAIRS_A_TEXT)
        dealt = join_keys(dealt, counts[end], end, "pairs").withColumn(f"part_{end}", F.pmod(F.xxhash64(other), parts).cast("int")).drop("pairs")
    asked = scratch.written(counts["u"].select("u").union(counts["v"].select("v")).distinct().toDF("doc_id"), f"{label}-asked")
    known = scratch.written(texts.join(counted(asked), "doc_id", "left_semi"), f"{label}-texts")
    for end in "uv":
        sent = known.toDF(end, f"text_{end}").join(counts[end], end)
        sent = sent.select(end, f"text_{end}", F.explode(F.sequence(F.lit(0), F.ceil(F.col("pairs") / PAIRS_A_TEXT).cast("int") - 1)).alias(f"part_{end}"))
        dealt = dealt.join(sent, [end, f"part_{end}"])
    return scratch.written(dealt.where(_confirm(width, percent)("text_u", "text_v")).select("u", "v"), f"{label}-links")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. Null and empty texts have no shingles and are linked
    with nothing. Rows that repeat a doc_id are one node of the graph. A null doc_id cannot be named by a group: such a row has a null component and
    is kept. Long texts are used whole. Empty tables give no rows. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-dup")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign(width), "doc_id bigint, n_shingles bigint, set_digest binary, bands array<bigint>, sig array<bigint>"), "signatures")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("set_digest")).alias("a"), F.max(F.xxhash64("set_digest")).alias("b")).where("a <> b")
    if not several.isEmpty():
        return _of_repeated_ids(texts, signed, width, percent)
    named = signed.where("doc_id is not null and set_digest is not null")
    # equal sets have equal signatures; a third of all rows may be copies, so rows are reduced in each task before the shuffle
    same = named.groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")))
    reps = scratch.written(same, "classes")
    entries = reps.select("rep", F.explode("bands").alias("band"))
    buckets = scratch.written(entries.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = scratch.written(join_keys(entries, buckets, "band", "size"), "members")
    # how many others a text meets in all its buckets: the text that a group's copies were made from meets most of them
    met = scratch.written(members.groupBy("rep").agg(F.sum("size").alias("met")).join(reps.select("rep", "n_shingles", "sig", "bands"), "rep"), "met")
    members = scratch.written(members.drop("size").join(met.select("rep", "met", "n_shingles", "sig"), "rep"), "members-met")
    centres = scratch.written(members.groupBy("band").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("centre"), F.count("*").alias("size")), "centres")
    sized = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    differs = 0.75 * (1 - percent / 100)
    slack = lambda hashes: 5 * (differs * (1 - differs) / hashes) ** 0.5 / 0.75  # noqa: E731  five standard deviations
    middles = scratch.written(centres.join(met.select(F.col("rep").alias("centre"), F.col("n_shingles").alias("n_centre"), F.col("sig").alias("sig_centre")), "centre"), "middles")
    likely = F.expr("rep <> centre") & sized("n_shingles", "n_centre") & (estimate("sig", "sig_centre") >= percent / 100 - slack(HASHES))
    star = join_keys(members, middles, "band", "size").where(likely).select(F.greatest("rep", "centre").alias("u"), F.least("rep", "centre").alias("v"))
    links = _confirmed(scratch, texts, star, width, percent, "star")
    component = scratch.written(connected_components(links, write=scratch.written), "star-components")

    of = lambda name, out: component.toDF(name, out)
    middle = scratch.written(centres.join(of("centre", "middle"), "centre", "left").select("band", "size", F.coalesce("middle", "centre").alias("middle")), "middle-components")
    placed = join_keys(members.select("band", "rep"), middle, "band", "size").join(of("rep", "own"), "rep", "left")
    placed = scratch.written(placed.select("band", "rep", "size", F.coalesce("own", "rep").alias("own"), "middle"), "placed")
    apart = placed.where("own <> middle").groupBy("band").agg(F.max("size").alias("size"))  # buckets with members in another component than their centre
    apart = scratch.written(apart, "apart")
    if not apart.isEmpty():
        mixed = join_keys(placed.select("band", "rep", "own", (F.col("own") != F.col("middle")).alias("off")), apart, "band", "size")
        mixed = scratch.written(mixed, "mixed")
        asked = scratch.written(mixed.select(F.col("rep").alias("doc_id")).distinct(), "mixed-asked")
        fine = texts.join(counted(asked), "doc_id", "left_semi").mapInArrow(_sign_long(width), "rep bigint, long_sig array<bigint>").dropDuplicates(["rep"])
        mixed = scratch.written(mixed.join(fine.join(met.select("rep", "n_shingles", "sig", "bands"), "rep"), "rep"), "mixed-signatures")
        # a bucket is cut into blocks, and each block of it meets each other one in a key of its own
        blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
        block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        every = F.explode(F.sequence(F.lit(0), blocks - 1))
        side = lambda x, at_u, at_v: mixed.select(*(F.col(c).alias(f"{c}_{x}") for c in mixed.columns), at_u.alias(f"at_u_{x}"), F.col("size").alias("size"), F.col("rep").alias("rep")).select("*", at_v.alias(f"at_v_{x}"))
        # a pair is met once: from its member outside the centre's component (the larger, if both are), and in the first bucket that the two share
        once = F.expr("band_u = band_v and at_u_u = at_u_v and at_v_u = at_v_v and own_u <> own_v and off_u and (not off_v or rep_u > rep_v)")
        alike = (estimate("sig_u", "sig_v") >= percent / 100 - slack(HASHES)) & (estimate_long("long_sig_u", "long_sig_v") >= percent / 100 - slack(LONG))
        first = F.array_min(F.array_intersect("bands_u", "bands_v")) == F.col("band_u")
        left, right = side("u", block, every).drop("rep", "size").where("off_u"), side("v", every, block).drop("rep", "size")
        pairs = left.join(right, once & sized("n_shingles_u", "n_shingles_v") & alike & first).select(F.greatest("rep_u", "rep_v").alias("u"), F.least("rep_u", "rep_v").alias("v"))
        more = _confirmed(scratch, texts, pairs, width, percent, "rest")
        if not more.isEmpty():
            component = scratch.written(connected_components(links.unionByName(more), write=scratch.written), "components")
    # classes with their components, then rows with their classes: hot classes are met by a broadcast
    found = reps.select("set_digest", "rep", "copies").join(component.toDF("rep", "component"), "rep", "left")
    found = written(found.select("set_digest", "copies", F.coalesce("component", "rep").alias("component_id")), "class-components")
    scratch.clear()
    out = join_keys(named.select("doc_id", "n_shingles", "set_digest"), found, "set_digest", "copies").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("doc_id is null or set_digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("*", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
