"""Phrase collocations: exact weighted n-gram counts, cut scores, and the best phrases of each language.

1. Texts are split into pieces, and equal pieces of a language become one row with a multiplicity (partial sums before the shuffle), so the copies that a
   corpus is full of are cut into n-grams once.
2. n-grams are counted out of core: tasks cut slices of pieces, add up what a slice repeats, and send (lang, n-gram, weight) by the hash of the two, what a
   slice has for a bucket in one compressed Arrow block; each bucket's blocks stream into a duckdb table that may spill, which sums them and keeps n-grams
   at or above the threshold. First single words, then pairs, then three to five words: an n-gram cannot be frequent unless all its words and pairs are, so
   others are not sent. What is frequent is told by a table of FILTER_BITS bits, whose size does not grow with the data; if it fills up, more is sent than
   needed, and the counts are the same.
3. A candidate's parts lie in other buckets: each cut sends a lookup request for its first part and one for its rest, which meet the counts by a shuffle
   (parts that very many candidates ask for, by a broadcast of a bounded number of keys). Scores are whole-number decimals.
4. Candidates inside a longer one that is as frequent go, and each language's first phrases are ranked.
"""

from __future__ import annotations

import os
import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isoline.llm.common import Scratch, join_keys, text_or_empty, written

LONGEST = 5
#: Bits of the table of n-grams that may be frequent (a power of two, 64 at least).
FILTER_BITS = 1 << 26
#: Bytes of pieces whose n-grams are added up before they are sent.
SLICE_BYTES = 6_000_000
DUCKDB_MEMORY = "256MB"

#: Buckets for each shuffle partition.
BUCKETS = 4
BLOCKS = "bucket int, block binary"
COUNTS = "lang string, words int, gram string, f bigint, code bigint"
_GRAMS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("gram", pa.string()), ("weight", pa.int64())])
_BLOCKS = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])
_COUNTS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("gram", pa.string()), ("f", pa.int64()), ("code", pa.int64())])
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def pieces(lang: Column, text: Column) -> list[Column]:
    """lang and one row for each piece: words joined by one space."""
    spaced = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", "abcdefghijklmnopqrstuvwxyz "), " {2,}", " ")
    return [F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(spaced, r"[.,;:!?\x0A-\x0D]+")).alias("piece")]


def _hashes(words: list[str | None]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _codes(lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """One code for each n-gram from the hashes of its language and words, the same in all tasks."""
    x = lang * _ODD[2]
    for w in words:
        x = (x ^ w) * _ODD[0]
        x ^= x >> np.uint64(32)
    x *= _ODD[1]
    return x ^ x >> np.uint64(29)


def _may_be(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = codes & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _slices(batches):
    """Arrow tables of SLICE_BYTES of pieces, or of one batch."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(1).nbytes
        if size >= SLICE_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def slice_grams(slice_: pa.Table, lengths: list[int], words_known: np.ndarray | None, pairs_known: np.ndarray | None):
    """Weighted n-grams of one slice (lang, piece, times), each n-gram once: a table and the n-grams' codes for each length."""
    lang = slice_.column(0).combine_chunks().dictionary_encode()
    cut = pc.split_pattern(slice_.column(1).combine_chunks(), " ")
    tokens, offsets = cut.values.dictionary_encode(), cut.offsets.to_numpy()
    piece = np.repeat(np.arange(len(cut)), np.diff(offsets))
    word = tokens.indices.to_numpy().astype(np.int64)
    times = slice_.column(2).to_numpy()[piece]
    lang_of = lang.indices.to_numpy().astype(np.int64)[piece]
    hash_word, hash_lang = _hashes(tokens.dictionary.to_pylist()), _hashes(lang.dictionary.to_pylist())
    of_word, of_lang = hash_word[word], hash_lang[lang_of]
    # exact numbers of the n-grams of this slice: that of the one before, and the next word's
    keys, number = np.unique(lang_of << 32 | word, return_inverse=True)
    single = [keys & 0xFFFFFFFF]
    owner = keys >> 32
    good = np.ones(len(word), bool) if words_known is None else _may_be(_codes(of_lang, of_word), words_known)
    pair = good[:-1] & good[1:] & (piece[:-1] == piece[1:])
    if pairs_known is not None:
        pair &= _may_be(_codes(of_lang[:-1], of_word[:-1], of_word[1:]), pairs_known)
    at = np.arange(len(word))
    for n in range(1, max(lengths) + 1):
        if n > 1:
            # n-grams at `at` of n - 1 words go on by a word where the pair at its end allows it
            ok = at + n - 2 < len(pair)
            ok[ok] = pair[at[ok] + n - 2]
            at, before = at[ok], number[ok]
            keys, number = np.unique(before << 32 | word[at + n - 1], return_inverse=True)
            single = [c[keys >> 32] for c in single] + [keys & 0xFFFFFFFF]
            owner = owner[keys >> 32]
        if n in lengths and len(keys):
            weight = np.zeros(len(keys), np.int64)
            np.add.at(weight, number, times[at])
            gram = pc.binary_join_element_wise(*(tokens.dictionary.take(pa.array(c)) for c in single), " ")
            yield pa.table([lang.dictionary.take(pa.array(owner)), pa.array(np.full(len(keys), n, np.int32)), gram, pa.array(weight)], schema=_GRAMS), _codes(hash_lang[owner], *(hash_word[c] for c in single))


def blocks(grams: pa.Table, codes: np.ndarray, buckets: int):
    """Record batches of (bucket, block): the n-grams of each bucket as one compressed Arrow stream."""
    bucket = (codes >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")  # within a bucket neighbours still share words
    grams, bucket = grams.take(pa.array(order)), bucket[order]
    edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)].tolist()
    for at in range(0, len(edges) - 1, 256):
        own, out = list(zip(edges[at : at + 256], edges[at + 1 : at + 257])), []
        for s, e in own:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _GRAMS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(grams.slice(s, e - s).combine_chunks())
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[[s for s, _ in own]].astype(np.int32)), pa.array(out, pa.binary())], schema=_BLOCKS)


def _cut(lengths: list[int], words_known, pairs_known, buckets: int):
    def run(batches):
        words, pairs = (None if x is None else x.value for x in (words_known, pairs_known))
        for x in _slices(batches):
            if x.num_rows:
                for grams, codes in slice_grams(x, lengths, words, pairs):
                    yield from blocks(grams, codes, buckets)

    return run


def _counted(least: int):
    """Sums the rows of a task's bucket in duckdb. What spills lies in the task's own folder, as Spark's spills do, and goes with it."""

    def run(batches):
        with tempfile.TemporaryDirectory(prefix="bucket-") as folder:
            con = duckdb.connect(os.path.join(folder, "bucket.duckdb"), config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": folder})
            con.execute("CREATE TABLE grams (lang VARCHAR, words INTEGER, gram VARCHAR, weight BIGINT)")
            held, size, some = [], 0, False

            def store() -> None:
                nonlocal held, size, some
                if held:
                    some, rows = True, pa.concat_tables(held)  # noqa: F841  read by duckdb under its name
                    con.execute("INSERT INTO grams SELECT * FROM rows")
                    held, size = [], 0

            for b in batches:
                for block in b.column(1):
                    held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
                    size += held[-1].num_rows
                    if size >= 100_000:
                        store()
            store()
            if some:
                found = con.execute("SELECT lang, words, gram, CAST(sum(weight) AS BIGINT) AS f FROM grams GROUP BY lang, words, gram HAVING sum(weight) >= ?", [least]).to_arrow_reader(20_000)
                for b in found:
                    split = [x.split(" ") for x in b.column(2).to_pylist()]
                    langs, code = _hashes(b.column(0).to_pylist()), np.empty(b.num_rows, np.uint64)
                    counts = np.array([len(x) for x in split])
                    for n in np.unique(counts):
                        own = np.flatnonzero(counts == n)
                        code[own] = _codes(langs[own], *(_hashes([split[i][k] for i in own]) for k in range(n)))
                    yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, _COUNTS, strict=False)), pa.array(code.view(np.int64))], schema=_COUNTS)
            con.close()

    return run


def _bits(counts: DataFrame) -> np.ndarray:
    """The bit table of the codes of counts; at most FILTER_BITS / 64 rows reach the driver."""
    at = F.col("code").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = counts.select(F.shiftrightunsigned(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast(code & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_grams(units: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """units: lang, piece, times. Returns lang, words, gram, f, code of every n-gram of up to LONGEST words with f >= least."""
    spark, known, found = units.sparkSession, [None, None], []
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k, lengths in enumerate(([1], [2], list(range(3, LONGEST + 1)))):
        sent = units.mapInArrow(_cut(lengths, *known, buckets), BLOCKS).repartition("bucket")
        found.append(scratch.written(sent.mapInArrow(_counted(least), COUNTS), f"frequent-{lengths[0]}"))
        if k < 2:
            known[k] = spark.sparkContext.broadcast(_bits(found[-1]))
    return found[0].unionByName(found[1]).unionByName(found[2])


def collocations(docs: DataFrame, *, least: int = 100, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first `most` phrases of 2 to 5 words: lang, rank, phrase, a, l, r, n, score.

    A null text has no pieces, a null lang is `und`. Rows count as often as they occur, whatever their ids. A language without candidates, a table without
    pieces and an empty table give no rows. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    cut = docs.select(*pieces(F.col(lang_col), text_or_empty(text_col))).select("lang", F.trim("piece").alias("piece")).where("piece <> ''")
    units = scratch.written(cut.groupBy("lang", "piece").agg(F.count("*").alias("times")), "pieces", "zstd")
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = scratch.written(units.groupBy("lang").agg(F.sum(F.col("times") * words).alias("n")), "totals")
    grams = scratch.written(frequent_grams(units, least, scratch).drop("code"), "frequent")
    candidates = grams.where("words > 1").select("lang", F.col("gram").alias("phrase"), "words", F.col("f").alias("a"))
    # cuts ask for their parts
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = scratch.written(cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right")), "cuts")
    for side, f in (("left", "l"), ("right", "r")):
        asked = cuts.groupBy("lang", side).agg(F.count("*").alias("asked"))
        parts = asked.join(grams.select("lang", F.col("gram").alias(side), F.col("f").alias(f)), ["lang", side])
        cuts = join_keys(cuts, scratch.written(parts, f"parts-{f}"), ["lang", side], "asked").drop("asked", side)
    exact = "cast({} as decimal(19,0))".format
    scored = cuts.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    scored = scored.withColumn("score", F.expr(f"({exact('1000 * a')} * {exact('n')}) div ({exact('l')} * {exact('r')})"))
    lowest = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # words inside a longer candidate: a candidate of one word more is as frequent then, too
    longer = candidates.where("words > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    left = lowest.join(longer, ["lang", "phrase"], "left").where("inside is null or inside < a")
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")  # Spark cuts each task's rows to the first ones before the shuffle
    first = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    out = written(first.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "collocations")
    scratch.clear()
    return out
