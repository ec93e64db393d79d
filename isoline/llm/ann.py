"""Approximate nearest neighbours: an inverted file of coarse centroids over product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed. There are about as many lists as the square root of the number of vectors:
beyond COARSE of them, a list is a coarse centroid plus one of a set of finer ones for what is left of a vector. A query visits the lists whose centroids have the largest inner
product with it; there asymmetric distance tables (one lookup for each sub-space) rank the codes, and the best are ranked again by the exact inner
product in double precision. Equal vectors are one entry that carries its smallest identifiers, which is all that a top k can need of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoline.llm.common import rows_of, written

#: Rows that centroids and codebooks are fitted on at most; rows of a list (and queries) that one task holds at once.
SAMPLE_ROWS, BLOCK_ROWS, BLOCK_QUERIES, SUBSPACES, CODEWORDS = 20_000, 8_192, 2_048, 16, 256
#: Coarse centroids, and finer ones, at most: 262,144 lists, the square root of 7e10 vectors. Scores that a query batch holds at once.
COARSE, FINE, HELD_SCORES = 2_048, 128, 1 << 22


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; empty clusters keep their centroid."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(c.dtype)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ c.T - half, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class IvfPq:
    """The fitted part of the index: coarse centroids and one codebook of residuals for each sub-space."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES):
        x = sample.astype(np.float32)
        self.dim = x.shape[1]
        self.coarse, self.fine = kmeans(x, min(lists, COARSE)), np.zeros((1, x.shape[1]), np.float32)
        if lists > COARSE:
            self.fine = kmeans(x - self.coarse[nearest(x, self.coarse)], min(FINE, -(-lists // COARSE)), 6)
        self.centroids = (self.coarse[:, None] + self.fine[None]).reshape(-1, self.dim)
        self.sample, self.sample_list = x, self.assign(x)
        rest = x - self.centroids[self.sample_list]
        self.cuts = [p for p in np.array_split(np.arange(self.dim), min(subspaces, self.dim))]
        self.books = [kmeans(np.ascontiguousarray(rest[:, p]), CODEWORDS, 6) for p in self.cuts]
        # how far a coded inner product may be off, for all but a thousandth of pairs
        coded = np.concatenate([b[nearest(np.ascontiguousarray(rest[:, p]), b)] for p, b in zip(self.cuts, self.books, strict=True)], axis=1)
        some = np.linspace(0, len(x) - 1, min(256, len(x))).astype(int)
        self.slack = float(np.quantile(np.abs(x[some] @ (rest - coded).T), 0.999)) if len(x) else 0.0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: its nearest coarse centroid, then the nearest finer one of what is left."""
        own = nearest(x, self.coarse)
        return own if len(self.fine) == 1 else own * len(self.fine) + nearest(x - self.coarse[own], self.fine)

    def probes(self, k: int, target: float, asked: int = 256) -> int:
        """Lists to visit so that, in the sample, the share `target` of the k nearest lies in them: few on clustered data, many on data without structure."""
        q = self.sample[np.linspace(0, len(self.sample) - 1, min(asked, len(self.sample))).astype(int)]
        order = np.argsort(np.argsort(-(q @ self.centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
        best = np.argsort(-(q @ self.sample.T), axis=1, kind="stable")[:, 1 : k + 1]
        return int(np.quantile(np.take_along_axis(order, self.sample_list[best], axis=1), target)) + 1 if best.size else len(self.centroids)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float32)
        own = self.assign(x)
        rest = x - self.centroids[own]
        return own, np.stack([nearest(np.ascontiguousarray(rest[:, p]), b).astype(np.uint8) for p, b in zip(self.cuts, self.books, strict=True)], axis=1)

    def adc(self, queries: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products, queries by codes: the centroid's plus a table entry for each sub-space."""
        q = queries.astype(np.float32)
        out = np.repeat((q @ self.centroids[list_id])[:, None], len(codes), axis=1)
        for m, (p, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (q[:, p] @ b.T)[:, codes[:, m]]
        return out


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _index(model: IvfPq):
    def run(batches):
        for b in batches:
            if b.num_rows:
                own, codes = model.encode(_vectors(b.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list_id", "ids", "v", "code"])

    return run


def _visit(model: IvfPq, sizes: np.ndarray, probes: int, least: int, k: int):
    """Each query with the lists it visits (the `probes` best, and more until they hold `least` entries) and a floor: the score of the 3k-th best of the
    sample's vectors in those lists. What scores less is not among the k best found, so it need not be sent on."""

    def run(batches):
        for b in rows_of(batches, max(1, min(256, HELD_SCORES // max(len(model.centroids), len(model.sample))))):
            if not b.num_rows:
                continue
            q = _vectors(b.column(1)).astype(np.float32)
            order = np.argsort(-(q @ model.centroids.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            n = np.maximum(min(probes, order.shape[1]), np.minimum((held < least).sum(axis=1) + 1, order.shape[1]))
            at = np.repeat(np.arange(len(q)), n)
            lists = np.concatenate([o[:m] for o, m in zip(order, n, strict=True)]).astype(np.int32)
            visited = np.zeros((len(q), order.shape[1]), bool)
            visited[at, lists] = True
            near, floor = np.where(visited[:, model.sample_list], q @ model.sample.T, -np.inf), np.full(len(q), -np.inf)
            if near.shape[1] > 3 * k:
                floor = -np.partition(-near, 3 * k, axis=1)[:, 3 * k].astype(np.float64)
            floor -= 1e-4 * np.abs(np.where(np.isfinite(floor), floor, 0))
            yield pa.RecordBatch.from_arrays([pa.array(lists), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(floor[at])], names=["list_id", "query_id", "q", "floor"])

    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _scan(model: IvfPq, k: int, rerank: int):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        list_id = entries.column("list_id")[0].as_py()
        v = _vectors(entries.column("v").combine_chunks()).astype(np.float64)
        codes = np.frombuffer(b"".join(entries.column("code").to_pylist()), np.uint8).reshape(len(v), -1)
        ids = entries.column("ids").to_pylist()
        all_q, query_ids, out = _vectors(queries.column("q").combine_chunks()).astype(np.float64), queries.column("query_id").to_pylist(), ([], [], [])
        floors = queries.column("floor").to_numpy()
        for at in range(0, len(all_q), 256):
            q = all_q[at : at + 256]
            near = model.adc(q, list_id, codes)
            for i, (own, floor) in enumerate(zip(query_ids[at : at + 256], floors[at : at + 256], strict=True)):
                # what may reach the floor, and the `rerank` best in any case
                row = np.flatnonzero(near[i] >= floor - model.slack)
                if len(row) < rerank:
                    row = np.argpartition(-near[i], rerank)[:rerank] if len(v) > rerank else np.arange(len(v))
                scores = v[row] @ q[i]
                rows = []
                for j in np.argsort(-scores, kind="stable"):
                    s = float(scores[j])
                    if s < floor or (len(rows) > k and s < rows[k][0]):
                        break
                    rows += [(s, i) for i in ids[row[j]] if i != own]
                rows.sort(key=lambda r: (-r[0], r[1]))
                for s, i in rows[:k]:
                    out[0].append(own)
                    out[1].append(i)
                    out[2].append(s)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, *, k: int = 20, lists: int | None = None, target_recall: float = 0.97, rerank: int | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per query and neighbour: query_id, rank (from 1), vec_id, score (exact inner product), nearest first, ties to the smaller vec_id.

    queries are rows with the same two columns; a query's own id is no neighbour of it. Fewer candidates than k give them all. Vectors that are null,
    zero, hold null or non-finite components, or have another length than most, take no part, nor do rows with null ids; repeated rows count once. Empty
    tables give no rows. Other columns are not read.

    Components of doubles are kept and scored as doubles, others as floats.

    lists: centroids (default: the square root of the number of different vectors, COARSE * FINE at most). target_recall: the recall at k that the number of
    visited lists is set for, measured on the sample that the centroids are fitted on. rerank: codes of a list that are ranked exactly (default 3k).
    """
    spark = vectors.sparkSession
    kind = "array<double>" if dict(vectors.dtypes)[vector_col] == "array<double>" else "array<float>"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast(kind)
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))

    usual = usable(vectors).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if usual is None:
        return empty
    of_size = F.size("v") == usual["n"]
    by_value = Window.partitionBy("v").orderBy("id")
    some_ids = usable(vectors).where(of_size).distinct().withColumn("place", F.row_number().over(by_value)).where(F.col("place") <= k + 1)  # limited before the shuffle too
    entries = written(some_ids.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids", "v"), "distinct-vectors")
    different = entries.count()
    lists = max(1, min(COARSE * FINE, lists or round(different**0.5), different))
    # the sample is drawn where the vectors lie: a share of them by hash, a tenth more than needed, and the surplus goes on the driver
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.1 * (sample_rows + 100) / max(different, 1)))
    sample = entries.where(share).select(F.xxhash64("v").alias("h"), F.col("ids")[0].alias("i"), "v").toArrow().sort_by([("h", "ascending"), ("i", "ascending")]).slice(0, sample_rows)
    model = IvfPq(_vectors(sample.column("v").combine_chunks()), lists)
    lists = len(model.centroids)
    index = written(entries.mapInArrow(_index(model), f"list_id int, ids array<bigint>, v {kind}, code binary"), "ivf-pq")
    sizes = np.zeros(lists, np.int64)
    for r in index.groupBy("list_id").count().collect():  # a row for each list
        sizes[r["list_id"]] = r["count"]
    probes = model.probes(k, target_recall)
    visits = written(usable(queries).where(of_size).distinct().select("id", "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_visit(model, sizes, probes, 4 * (k + 1), k), f"list_id int, query_id bigint, q {kind}, floor double"), "ivf-visits")
    asked = {r["list_id"]: r["count"] for r in visits.groupBy("list_id").count().collect()}
    # a list or its queries may be of any size: both are cut into blocks, and each block of entries meets each block of queries
    plan = spark.createDataFrame([(i, int(-(-sizes[i] // BLOCK_ROWS)) or 1, -(-n // BLOCK_QUERIES)) for i, n in asked.items()], "list_id int, v_blocks int, q_blocks int")
    left = index.join(F.broadcast(plan), "list_id").select("list_id", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("v_blocks")).alias("v_block"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"), "ids", "v", "code")
    right = visits.join(F.broadcast(plan), "list_id").select("list_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("v_blocks").cast("bigint") - 1)).alias("v_block"), F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int").alias("q_block"), "query_id", "q", "floor")
    keys = ["list_id", "v_block", "q_block"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_scan(model, k, rerank or 3 * k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
