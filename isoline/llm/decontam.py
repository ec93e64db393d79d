"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Fixed masks pick some of consecutive token positions and ignore the rest, so a seed survives substitutions at ignored positions. The masks of an item
are such that every pattern of substitutions within the limit leaves one of them whole at some place of the window, so no overlap goes unproposed. Test
seeds are joined with the seeds at every position of every training text; around each hit the benchmark item is aligned with the text and tokens are
compared position by position.

The corpus is read once for hits, whatever the benchmark's size: up to BROADCAST_SEEDS the test seeds are broadcast; beyond it a bit table of fixed size is, and
only positions that pass it are shuffled to the seeds. Each distinct hit (document, item, shift) is verified once, in the documents that have hits only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.llm.common import written

#: By the tokens of a window, masks that keep a seed under every pattern of at most a fifth of its tokens substituted (tests try them all). LONG_MASKS
#: does from 9 tokens on, with 4 substitutions at most.
LONG_MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 3, 6, 8))
SHORT_MASKS = {
    5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    7: ((0, 1, 3, 4),),
    8: ((0, 1, 3, 4),),
}
#: Most seeds, and most distinct hits, that are broadcast (about 24 and 60 bytes each, in a hash relation some four times that).
BROADCAST_SEEDS, BROADCAST_HITS = 500_000, 100_000
#: Rows of the bit table, 64 bits each.
BIT_WORDS = 1 << 20


def masks_of(w: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """Masks one of which is whole in any w aligned tokens of which percent are equal."""
    wrong = max(0, w - max(1, -(-w * percent // 100)))
    if w >= 9 and wrong <= min(w, 20) // 5:
        return LONG_MASKS
    if w in SHORT_MASKS and wrong <= 1:
        return SHORT_MASKS[w]
    # the longest run of equal tokens has at least this length
    return (tuple(range(-(-(w - wrong) // (wrong + 1)))),)


def tokens(text: Column) -> Column:
    """Hashes of the text's tokens: letters and digits in lower case."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(h: Column, at: Column, masks: list[tuple[int, ...]]) -> Column:
    """The seeds at a position, as an array with nulls where a mask runs over the end."""
    return F.array(*(F.when(at + (m[-1] + 1) <= F.size(h), F.xxhash64(F.lit(k), *(F.get(h, at + o) for o in m))) for k, m in enumerate(masks)))


def _passing(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """The positions whose seeds may be among the test seeds, by a broadcast of at most BIT_WORDS words."""
    word, bit = F.col("seed").bitwiseAND(F.lit(BIT_WORDS - 1)), F.shiftright("seed", 20).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    bits = seeds.select(word.alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))
    return found.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(one) != 0).drop("word", "bits")


def overlaps(docs: DataFrame, benchmark: DataFrame, *, window: int = 20, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_digest: bool = False, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, matched, of_tokens, first_token.

    An item and a text overlap when, in some alignment, at least percent of the tokens are equal in some window of
    min(window, item length) consecutive item tokens. matched is the largest such count, of_tokens the window, first_token the text token at which
    the first best window starts (of equally good windows the first). Seeds propose every alignment within the limit; items without tokens match nothing.
    Null texts are empty; null ids form one document, and items with a null id one item; rows that repeat an id are joined into one result row per item;
    empty tables give no rows; other columns are not read. with_digest adds text_digest, the sha2-256 of the text, to the key.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), tokens(F.col(item_text_col)).alias("item_h")).where(F.size("item_h") > 0).distinct()
    sizes = [r[0] for r in items.select(F.least(F.size("item_h"), F.lit(window))).distinct().collect()]  # at most window rows
    families = {n: masks_of(n, percent) for n in sizes}
    masks = sorted({m for f in families.values() for m in f} or {(0,)})
    at = F.explode(F.sequence(F.lit(0), F.size("item_h") - 1))
    length = F.least(F.size("item_h"), F.lit(window))
    own = F.array(*(length.isin([n for n, f in families.items() if m in f]) for m in masks))[F.col("k")]
    seeds = items.select("item_id", "item_h", at.alias("item_at")).select("item_id", "item_h", "item_at", F.posexplode(_seeds(F.col("item_h"), F.col("item_at"), masks)).alias("k", "seed"))
    seeds = written(seeds.where(F.col("seed").isNotNull() & own).select("item_id", "item_at", "seed").distinct(), "test-seeds")
    few = seeds.count() <= broadcast_seeds
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("text_digest"), text.alias("text"))
    texts = keyed.select("doc_id", "text_digest", tokens(F.col("text")).alias("h")).where(F.size("h") > 0)
    placed = texts.select("doc_id", "text_digest", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("at"))
    found = placed.select("doc_id", "text_digest", "at", F.explode(_seeds(F.col("h"), F.col("at"), masks)).alias("seed")).where(F.col("seed").isNotNull())
    hits = found.join(F.broadcast(seeds), "seed") if few else _passing(found, seeds).join(seeds, "seed")
    hits = written(hits.select("doc_id", "text_digest", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "seed-hits")
    mine = hits.toDF("hit_id", "hit_digest", "hit_item", "shift")
    mine = F.broadcast(mine) if hits.count() <= broadcast_hits else mine.hint("shuffle_hash")
    near = keyed.join(mine, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_digest") == F.col("hit_digest"))).select("doc_id", "text_digest", "hit_item", "shift", tokens(F.col("text")).alias("h"))
    near = near.join(F.broadcast(items) if few else items, F.col("hit_item").eqNullSafe(F.col("item_id")))  # an item has a seed for every nine of its tokens at least, so few seeds are few tokens
    equal = F.transform(F.sequence(F.lit(0), F.size("item_h") - 1), lambda i: F.get("h", F.col("shift") + i).eqNullSafe(F.get("item_h", i)).cast("int"))
    sums = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("w")), lambda i: F.aggregate(F.slice("equal", i + 1, F.col("w")), F.lit(0), lambda a, x: a + x))
    keys = ["doc_id", "text_digest"] if with_digest else ["doc_id"]
    near = near.select(*keys, "item_id", "shift", length.alias("w"), equal.alias("equal"), F.size("item_h").alias("n")).select(*keys, "item_id", "shift", "w", sums.alias("sums"))
    near = near.select(*keys, "item_id", "w", "shift", F.array_max("sums").alias("matched"), "sums").where(F.col("matched") * 100 >= F.col("w") * percent)
    near = near.select(*keys, "item_id", "w", "matched", F.greatest(F.lit(0), F.col("shift") + F.array_position("sums", F.col("matched")) - 1).alias("first"))
    best = near.groupBy(*keys, "item_id").agg(F.max("matched").alias("matched"), F.max("w").alias("of_tokens"), F.max(F.struct("matched", -F.col("first"))).alias("best"))
    return best.select(*keys, "item_id", F.col("matched").cast("bigint").alias("matched"), F.col("of_tokens").cast("bigint").alias("of_tokens"), (-F.col("best.col2")).cast("bigint").alias("first_token"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose text overlaps no benchmark item. Null ids are told apart by their texts."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = written(overlaps(docs, benchmark, with_digest=True, **options).select(F.col("doc_id").alias("__bad_id"), F.col("text_digest").alias("__bad_digest")).distinct(), "contaminated")
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__bad_id")) & (F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)) == F.col("__bad_digest"))
    return docs.join(F.broadcast(bad) if bad.count() <= options.get("broadcast_hits", BROADCAST_HITS) else bad.hint("shuffle_hash"), same, "left_anti")
