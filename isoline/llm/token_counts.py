"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, n_tokens) with a folder for each tokenizer digest, so a call reads only its own tokenizer's part.
Documents are digested where they are read; digests that the cache lacks are misses, one text of each distinct miss is encoded and its count appended,
and the counts are joined back by digest. Content is normalised only as far as the counts cannot change: null is the empty text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.llm.common import batch, fresh_path, join_keys, path_exists, rows_of, text_or_empty, written
from isoline.llm.tokenizing import encoder, tokenizer_digest

#: Digests of misses that are broadcast at most (about 60 bytes each); beyond it distinct texts are dealt by digest.
BROADCAST_MISSES = 100_000


def _encode(tokenizer_path: str):
    def run(batches):
        schema = pa.schema([("content_digest", pa.binary()), ("n_tokens", pa.int64())])
        if tokenizer_path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
            count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            count = encoder(tokenizer_path).count
        for b in rows_of(batches, 256):
            yield batch(schema, {"content_digest": b.column(0), "n_tokens": count(b.column(1).to_pylist())})

    return run


def cached_counts(spark: SparkSession, cache_path: str, tokenizer_path: str) -> DataFrame | None:
    """(content_digest, n_tokens) of one tokenizer, each digest once; None where nothing is cached for it yet."""
    path = f"{cache_path}/tokenizer_digest={tokenizer_digest(tokenizer_path)}"
    if not path_exists(spark, path):
        return None
    # two calls at once may both append a digest: the counts are equal
    return spark.read.schema("content_digest binary, n_tokens bigint").parquet(path).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def compact_cache(spark: SparkSession, cache_path: str, new_path: str, tokenizer_path: str, files: int = 64) -> None:
    """Writes one tokenizer's part of the cache to new_path with each digest once, in at most `files` files; the old cache stays as it is."""
    found = cached_counts(spark, cache_path, tokenizer_path)
    if found is not None:
        found.coalesce(files).write.parquet(f"{new_path}/tokenizer_digest={tokenizer_digest(tokenizer_path)}")


def token_counts(docs: DataFrame, tokenizer_path: str, *, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    cache_path: where the cache is kept from call to call; None starts an empty one for this call. Null text counts as empty (0 bytes);
    null and repeated ids are kept row by row; an empty table gives no rows and leaves the cache as it is; other columns are not read.
    """
    spark = docs.sparkSession
    cache_path = cache_path or fresh_path(spark, "token-cache")
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text, 256)).alias("content_digest")
    keyed = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest, F.octet_length(text).cast("bigint").alias("n_bytes")), "content-digests")
    distinct = keyed.groupBy("content_digest").agg(F.count("*").alias("copies"))
    before = cached_counts(spark, cache_path, tokenizer_path)
    misses = written((distinct if before is None else distinct.join(before, "content_digest", "left_anti")).select("content_digest"), "token-misses")
    n = misses.count()
    if n:
        # a text is kept once in each task before the shuffle and once after it, whether its copies share an id or have none
        texts = docs.select(digest, text.alias("text"))
        few = before is not None and n <= BROADCAST_MISSES
        new = (texts.join(F.broadcast(misses), "content_digest", "left_semi") if few else texts).groupBy("content_digest").agg(F.first("text").alias("text"))
        new = new if before is None or few else new.join(misses, "content_digest", "left_semi")
        new = new.mapInArrow(_encode(tokenizer_path), "content_digest binary, n_tokens bigint")
        new.write.mode("append").parquet(f"{cache_path}/tokenizer_digest={tokenizer_digest(tokenizer_path)}")
    counts = cached_counts(spark, cache_path, tokenizer_path)
    if counts is None:
        counts = spark.createDataFrame([], "content_digest binary, n_tokens bigint")
    sized = written(distinct.join(counts, "content_digest"), "token-counts")
    return join_keys(keyed, sized, "content_digest", "copies").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
