"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Words are counted over all training documents. The most frequent words are units of their own, the others belong to tail units by their last bytes. The
model predicts a unit from the two before it (element-wise context weights, numpy), and within a tail unit a member from the same context: of the HEAD most
frequent words the first MOST_MEMBERS of each unit are members with vectors of their own, so members grow with the vocabulary up to that bound; all rarer
words of a unit are one member, shared by their smoothed counts. Every partition trains one pass over its tokens from the same start, units against noise units and members against
noise members of their unit, and the parameters are averaged in Spark, by tokens and by how often a partition met a member. For units the normaliser of every
context pair is one matrix product; within a unit it is a sum over its members. So all token log-probabilities are normalised.

The counts of the HEAD most frequent words are broadcast (a bounded table that takes the hot keys out of the join); all other words of a document are
joined with the full count table by word, so no count is ever left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.llm.common import batch, crc_remainder, rows_of, text_or_empty, written

HELD_OUT_MODULUS, HELD_OUT = 7, 2
HEAD, OWN_UNITS, TAIL_UNITS, DIM, NOISE, BATCH = 1 << 18, 1536, 512, 16, 32, 8192
UNITS, MEMBER_NOISE = OWN_UNITS + TAIL_UNITS, 2
#: Words of a tail unit that have vectors of their own, most frequent first.
MOST_MEMBERS = 255
#: Training tokens of a task at least.
TASK_TOKENS = 2_000_000
#: Bytes of texts that are scored at once, beside the number of texts.
GROUP_BYTES = 1 << 22
#: Scores of members that are held at once, about what a processor's cache takes.
HELD_SCORES = 1 << 16
END = b" "  # no word holds a space
_TABLES: dict = {}


def words_of(text: str) -> list[bytes]:
    """A-Z in lower case; what stands between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def tail_unit(word: bytes) -> int:
    return OWN_UNITS + zlib.crc32(word[-3:]) % TAIL_UNITS


def _count(batches):
    schema, counts = pa.schema([("word", pa.binary()), ("c", pa.int64())]), Counter()
    for b in rows_of(batches, 200):
        for text in b.column(0).to_pylist():
            counts.update(words_of(text))
        counts[END] += b.num_rows
        if len(counts) > 200_000:
            yield batch(schema, {"word": list(counts), "c": list(counts.values())})
            counts.clear()
    if counts:
        yield batch(schema, {"word": list(counts), "c": list(counts.values())})


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a table of one text column; each text adds one END."""
    return texts.mapInArrow(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, head: int) -> tuple[list[bytes], np.ndarray]:
    """Words and counts of the most frequent words, most frequent first, at most `head` of them and END.

    A histogram of counts (some hundred rows) gives the count from which there are no more than that, so nothing but those words leaves its place.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    room, least = head, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    common = F.lit(False) if least is None else step >= least
    top = counts.where(common | (F.col("word") == F.lit(END))).toArrow()
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.float64)
    order = sorted(range(len(words)), key=lambda k: (-c[k], words[k]))
    return [words[k] for k in order], c[order]


class Vocabulary:
    """Head words with their counts and units; for each tail unit the total and the number of its words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, tail_n: np.ndarray, tail_v: np.ndarray):
        self.n, self.v, self.base_log = n, v, float(np.log10(n + v + 1))
        own = [w for w in words if w != END][: OWN_UNITS - 1]
        self.index = {w: i for i, w in enumerate(words)}
        units = {w: i + 1 for i, w in enumerate(own)} | {END: 0}
        self.unit = np.array([units.get(w, -1) if w in units else tail_unit(w) for w in words], np.int64)
        self.c = counts
        mass = np.zeros(UNITS)
        np.add.at(mass, self.unit[self.unit < OWN_UNITS], counts[self.unit < OWN_UNITS])
        mass[OWN_UNITS:] = tail_n
        self.noise = (mass + 1) / (mass.sum() + UNITS)
        self.head_base = np.log10(counts + 1.0) - self.base_log
        # members of tail unit k: start[k] is all its rarer words, head words follow
        every = np.flatnonzero(self.unit >= OWN_UNITS)
        every = every[np.argsort(self.unit[every], kind="stable")]  # by unit, and the most frequent first
        k = self.unit[every] - OWN_UNITS
        held = np.bincount(k, minlength=TAIL_UNITS)
        place = np.arange(len(every)) - (np.cumsum(held) - held)[k]
        tail, k_tail, place = every[place < MOST_MEMBERS], k[place < MOST_MEMBERS], place[place < MOST_MEMBERS]
        held = np.minimum(held, MOST_MEMBERS)
        self.start = np.concatenate([[0], np.cumsum(held + 1)])
        self.member = np.full(len(words), -1, np.int64)
        self.member[every] = self.start[k]
        self.member[tail] = self.start[k_tail] + 1 + place
        rest = tail_n - np.bincount(k_tail, counts[tail], TAIL_UNITS) + tail_v - held + 1.0
        self.rest_log = np.log10(rest)
        # what a head word that has no vector of its own gets within all the rarer ones
        self.head_inner = np.zeros(len(words))
        shared = every[self.member[every] == self.start[k]]
        self.head_inner[shared] = np.log10(counts[shared] + 1.0) - self.rest_log[self.unit[shared] - OWN_UNITS]
        weight = np.empty(self.start[-1])
        weight[self.start[:-1]] = rest
        weight[self.member[tail]] = counts[tail] + 1
        self.member_cdf = np.concatenate([[0.0], np.cumsum(weight)])
        whole = np.repeat(self.member_cdf[self.start[1:]] - self.member_cdf[self.start[:-1]], held + 1)
        self.member_log = np.log(weight / whole).astype(np.float32)

    def members(self, i: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The member of each word with head index i and unit u; -1 for own units."""
        m = np.where(u >= OWN_UNITS, self.start[np.maximum(u - OWN_UNITS, 0)], -1)
        known = (i >= 0) & (m >= 0)
        m[known] = self.member[i[known]]
        return m

    def units(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(head index or -1, unit) of each word."""
        i = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        u = self.unit[i] if len(self.unit) else np.zeros(len(i), np.int64)
        for k in np.flatnonzero(i < 0):
            u[k] = tail_unit(words[k])
        return i, u


class LogBilinear:
    """score(w | w1, w2) = q_w . (c1 * r_w1 + c2 * r_w2) + b_w; w1 is the unit before, w2 the one before that."""

    NAMES = ("r", "q", "c", "b")

    def __init__(self, noise: np.ndarray, seed: int = 11, member_log: np.ndarray = np.zeros(0, np.float32)):
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.1, (UNITS, DIM)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (UNITS, DIM)).astype(np.float32)
        self.c = np.ones((2, DIM), np.float32)
        self.b = np.log(noise).astype(np.float32)[:, None]
        self.log_noise, self.cdf = np.log(NOISE * noise).astype(np.float32), np.cumsum(noise)
        #: vector and, last, bias of each member, predicted within its unit
        self.z = np.zeros((len(member_log), DIM + 1), np.float32)
        self.z[:, DIM] = member_log

    def train_members(self, sums: np.ndarray, met: np.ndarray, vocabulary: Vocabulary, u: np.ndarray, m: np.ndarray, p: np.ndarray, rng, rate: float) -> None:
        """One step for tokens with tail unit u, member m and context vector p, against noise members of the same unit."""
        lo, hi = vocabulary.member_cdf[vocabulary.start[u - OWN_UNITS]], vocabulary.member_cdf[vocabulary.start[u - OWN_UNITS + 1]]
        at = lo[:, None] + rng.random((len(u), MEMBER_NOISE)) * (hi - lo)[:, None]
        noise = np.clip(np.searchsorted(vocabulary.member_cdf, at, side="right") - 1, vocabulary.start[u - OWN_UNITS, None], vocabulary.start[u - OWN_UNITS + 1, None] - 1)
        every = np.concatenate([m[None], noise.T])  # one row of tokens for the data and each noise member
        who, inverse, times = np.unique(every, return_inverse=True, return_counts=True)
        inverse, z, shift = inverse.reshape(every.shape), self.z[who], vocabulary.member_log[who] + np.float32(np.log(MEMBER_NOISE))
        d = np.zeros((DIM + 1, len(who)), np.float64)
        for k, i in enumerate(inverse):
            own = z[i]
            s = np.einsum("nd,nd->n", own[:, :DIM], p) + own[:, DIM] - shift[i]
            g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - np.float32(k == 0)
            for j in range(DIM):
                d[j] += np.bincount(i, g * p[:, j], len(who))
            d[DIM] += np.bincount(i, g, len(who))
        d = d.T.astype(np.float32)
        sums[who] += d * d
        self.z[who] = z - np.float32(rate) * d / np.sqrt(sums[who])
        met[who] += times

    def member_logs(self, vocabulary: Vocabulary, u: np.ndarray, m: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """log p(member | unit, context) of tokens with tail units, normalised over the unit's members."""
        out, order = np.empty(len(u)), np.argsort(u, kind="stable")
        cuts = np.flatnonzero(np.diff(u[order])) + 1
        x = np.concatenate([self.c[0] * self.r[w1] + self.c[1] * self.r[w2], np.ones((len(u), 1), np.float32)], axis=1)
        columns = np.ascontiguousarray(self.z.T)
        for part in np.split(order, cuts) if len(u) else ():
            a, b = vocabulary.start[u[part[0]] - OWN_UNITS], vocabulary.start[u[part[0]] - OWN_UNITS + 1]
            step = max(1, HELD_SCORES // (b - a))
            for at in range(0, len(part), step):
                some = part[at : at + step]
                s = x[some] @ columns[:, a:b]
                s -= s.max()
                own = s[np.arange(len(some)), m[some] - a]
                np.exp(s, out=s)
                total = s @ np.ones(b - a, np.float32)
                if total.min() < 1e-30:  # scores of these tokens lie too far apart for one shift
                    s = x[some] @ columns[:, a:b]
                    s -= s.max(axis=1, keepdims=True)
                    own, total = s[np.arange(len(some)), m[some] - a], np.exp(s).sum(axis=1)
                out[some] = own - np.log(total)
        return out

    def train(self, chunks, rate: float = 0.08, seed: int = 5, vocabulary: Vocabulary | None = None) -> tuple[int, np.ndarray]:
        """One pass of noise-contrastive estimation over chunks (w, w1, w2, member) of equal-length arrays, noise units shared within a chunk; the number of tokens, and how often each member was met."""
        rng, total = np.random.default_rng(seed), 0
        member_sums, met = np.full_like(self.z, 1.0), np.zeros(len(self.z), np.int64)
        sums = {n: np.full_like(getattr(self, n), 1e-2) for n in self.NAMES}
        for w, w1, w2, member in chunks:
            total += len(w)
            noise = np.minimum(np.searchsorted(self.cdf, rng.random(NOISE)), UNITS - 1)
            r1, r2, qw, qn = self.r[w1], self.r[w2], self.q[w], self.q[noise]
            p = self.c[0] * r1 + self.c[1] * r2
            data = (p * qw).sum(axis=1) + self.b[w, 0] - self.log_noise[w]
            other = p @ qn.T + (self.b[noise, 0] - self.log_noise[noise])
            g = (1 / (1 + np.exp(-np.clip(data, -30, 30))) - 1).astype(np.float32)
            h = (1 / (1 + np.exp(-np.clip(other, -30, 30)))).astype(np.float32)
            dp = g[:, None] * qw + h @ qn
            grad = {"q": _scatter(w, g[:, None] * p), "r": _scatter(w1, dp * self.c[0]) + _scatter(w2, dp * self.c[1]), "c": np.stack([(dp * r1).sum(axis=0), (dp * r2).sum(axis=0)]), "b": np.bincount(w, g, UNITS).astype(np.float32)[:, None]}
            np.add.at(grad["q"], noise, h.T @ p)
            np.add.at(grad["b"][:, 0], noise, h.sum(axis=0))
            for n in self.NAMES:
                d = grad[n] / np.float32(len(w) ** 0.5)
                sums[n] += d * d
                getattr(self, n).__isub__(rate * d / np.sqrt(sums[n]))
            tail = np.flatnonzero(member >= 0)
            if len(tail):
                self.train_members(member_sums, met, vocabulary, w[tail], member[tail], p[tail], rng, 2 * rate)
        return total, met

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, normaliser): log p(w | w1, w2) = first[w1, w] + second[w2, w] - normaliser[w1, w2]."""
        first, second = (self.c[0] * self.r) @ self.q.T, (self.c[1] * self.r) @ self.q.T + self.b[:, 0]
        m1, m2 = first.max(axis=1), second.max(axis=1)
        z = np.exp(first - m1[:, None]) @ np.exp(second - m2[:, None]).T
        return first, second, np.log(np.maximum(z, 1e-37)) + m1[:, None] + m2[None]


def _scatter(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    flat = (at[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(flat, values.ravel(), UNITS * DIM).astype(np.float32).reshape(UNITS, DIM)


def _contexts(units: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit before and the one before that; END stands before a text. ends: index after each text's last token."""
    w1, w2 = np.roll(units, 1), np.roll(units, 2)
    starts = np.concatenate([[0], ends[:-1]])
    w1[starts] = 0
    w2[starts] = 0
    second = starts[ends - starts > 1] + 1
    w2[second] = 0
    return w1, w2


def _cut(vocabulary: Vocabulary, texts: list[str]) -> tuple:
    """The words of texts, END after each, one after another: (words, ends, head index, unit, the unit before, the one before that)."""
    words, ends = [], []
    for t in texts:
        words += words_of(t)
        words.append(END)
        ends.append(len(words))
    ends = np.array(ends, np.int64)
    i, u = vocabulary.units(words)
    u[ends - 1] = 0
    return words, ends, i, u, *_contexts(u, ends)


def _train(vocabulary, start: LogBilinear):
    def run(batches):
        voc, model = vocabulary.value, start

        def chunks():
            held, n = [], 0
            for b in rows_of(batches, 64):
                _, ends, i, u, w1, w2 = _cut(voc, b.column(0).to_pylist())
                held.append((u, w1, w2, voc.members(i, u)))
                n += len(u)
                if n >= BATCH:
                    every = [np.concatenate(x) for x in zip(*held, strict=True)]
                    whole = n // BATCH * BATCH
                    for at in range(0, whole, BATCH):
                        yield tuple(x[at : at + BATCH] for x in every)
                    held, n = [tuple(x[whole:] for x in every)], n - whole
            if n:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

        tokens, met = model.train(chunks(), vocabulary=voc)
        for at in range(0, len(met), 1 << 16):  # members in short rows of their own
            who = at + np.flatnonzero(met[at : at + (1 << 16)])
            if len(who):
                values = pa.array((model.z[who] * met[who, None]).ravel(), pa.float32())
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, DIM + 1), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([None] * len(who), pa.string()), pa.array(who, pa.int32()), pa.array(met[who].astype(np.float64)), x], names=_PARTS)
        if tokens:
            flat = [(f"{n}{i:05d}", (row * np.float64(tokens)).tolist()) for n in model.NAMES for i, row in enumerate(getattr(model, n))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in flat]), pa.array([None] * len(flat), pa.int32()), pa.array([float(tokens)] * len(flat)), pa.array([v for _, v in flat], pa.list_(pa.float32()))], names=_PARTS)

    return run


def _average(parts: DataFrame, model: LogBilinear) -> LogBilinear:
    """Weighted mean of the partitions' parameters; 3 * UNITS + 2 rows and one for each member ((MOST_MEMBERS + 1) * TAIL_UNITS at most) reach the driver, however many partitions there are."""
    sums = [F.sum(F.get("x", F.lit(k)).cast("double")).alias(f"x{k}") for k in range(DIM + 1)]
    found = parts.groupBy("name", "member").agg(F.sum("tokens").alias("tokens"), *sums).toArrow()
    names, members, tokens = found.column("name").to_pylist(), found.column("member").to_pylist(), found.column("tokens").to_numpy()
    x = np.stack([found.column(f"x{k}").to_numpy(zero_copy_only=False) for k in range(DIM + 1)], axis=1) / np.maximum(tokens, 1e-300)[:, None]
    who = np.array([k for k, n in enumerate(names) if n is None], np.int64)
    model.z[np.array([members[k] for k in who], np.int64)] = x[who]
    for k, name in enumerate(names):
        if name is not None:
            target = getattr(model, name[0])
            target[int(name[1:])] = x[k, : target.shape[1]]
    return model


_PARTS = ["name", "member", "tokens", "x"]
_ROWS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()), ("tail_log", pa.float64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def _score(vocabulary, model: LogBilinear, key: str):
    """A row for each document with what its head words and the model's units give, and a row for each of its other words."""

    def run(batches):
        voc = vocabulary.value
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = model.tables()
        first, second, norm = _TABLES[key]
        uid = TaskContext.get().partitionId() << 40
        for b in rows_of(batches, 512, GROUP_BYTES):
            words, ends, i, u, w1, w2 = _cut(voc, b.column(1).to_pylist())
            n = np.diff(ends, prepend=0)
            total = lambda x, starts=ends - n: np.add.reduceat(x, starts)
            tail, known = np.flatnonzero(u >= OWN_UNITS), i >= 0
            logs = (first[w1, u] + second[w2, u] - norm[w1, w2]).astype(np.float64)
            logs[tail] += model.member_logs(voc, u[tail], voc.members(i, u)[tail], w1[tail], w2[tail])
            head = lambda values, i=i, known=known: np.where(known, values[np.maximum(i, 0)], 0) if len(values) else np.zeros(len(i))
            base = head(voc.head_base)
            base[ends - 1] -= np.where(known[ends - 1], 0, voc.base_log)  # no training document: END itself is unknown
            # rarer words of each document, END apart
            rare = np.setdiff1d(np.flatnonzero(~known), ends - 1, assume_unique=True)
            others = Counter(zip(np.searchsorted(ends, rare, side="right").tolist(), map(words.__getitem__, rare.tolist()), strict=True))
            who, docs, none = [d for d, _ in others], b.column(0).to_pylist(), [0] * len(others)
            yield batch(_ROWS, {
                "uid": [*range(uid, uid + len(n)), *(uid + d for d in who)],
                "doc_id": [*docs, *(docs[d] for d in who)],
                "word": [*(END + (uid + d).to_bytes(8, "big") for d in range(len(n))), *(w for _, w in others)],
                "tf": [*([0] * len(n)), *others.values()],
                "tail_log": [*([0.0] * len(n)), *(float(voc.rest_log[tail_unit(w) - OWN_UNITS]) for _, w in others)],
                "n_tokens": [*n.tolist(), *none],
                "n_known": [*total((head(voc.c) > 0).astype(np.int64)).tolist(), *none],
                "base": [*total(base).tolist(), *none],
                "score": [*(total(logs) / np.log(10) + total(head(voc.head_inner))).tolist(), *none],
            })
            uid += len(n)

    return run


def score_texts(docs: DataFrame, *, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Documents with crc32(doc_id) mod 7 = 2 are held out of all counts and training. Null text is empty: its end token alone. Null ids are trained on and
    scored row by row, as are repeated rows. Without training documents every word has the probability that the smoothing leaves. An empty table gives no
    rows; other columns are not read. The score depends, within the noise of training, on how the input is partitioned.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    train = texts.where(crc_remainder("doc_id", HELD_OUT_MODULUS) != HELD_OUT).select("text")
    counts = written(word_counts(train), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, c = frequent(counts, head)
    own = spark.createDataFrame([(w,) for w in [x for x in words if x != END][: OWN_UNITS - 1]] + [(END,)], "word binary")
    last = F.expr("case when octet_length(word) <= 3 then word else substring(word, octet_length(word) - 2, 3) end")
    tail_n, tail_v = np.zeros(TAIL_UNITS), np.zeros(TAIL_UNITS)
    for r in counts.join(F.broadcast(own), "word", "left_anti").groupBy((F.crc32(last) % TAIL_UNITS).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tail_n[r["k"]], tail_v[r["k"]] = r["n"], r["v"]
    vocabulary = Vocabulary(words, c, n, v, tail_n, tail_v)
    sent = spark.sparkContext.broadcast(vocabulary)
    model = LogBilinear(vocabulary.noise, member_log=vocabulary.member_log)
    # a task sends a row for each member that it met, so tasks are given TASK_TOKENS at least; partitions are put together where they lie
    tasks = min(train.rdd.getNumPartitions(), -(-n // TASK_TOKENS) or 1)
    model = _average(train.coalesce(max(1, tasks)).mapInArrow(_train(sent, model), "name string, member int, tokens double, x array<float>"), model)
    rows = texts.mapInArrow(_score(sent, model, uuid.uuid4().hex), "uid bigint, doc_id bigint, word binary, tf bigint, tail_log double, n_tokens bigint, n_known bigint, base double, score double")
    joined = rows.join(counts.select("word", "c"), "word", "left").select("uid", "doc_id", "n_tokens", "n_known", "tf", "base", "score", "tail_log", F.coalesce("c", F.lit(0)).alias("c"))
    log_c = F.log10(F.col("c") + 1.0)
    summed = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("tf") * (log_c - vocabulary.base_log)).alias("base_score"),
        F.sum(F.col("score") + F.col("tf") * (log_c - F.col("tail_log"))).alias("score"),
    )
    return summed.select("doc_id", (crc_remainder("doc_id", HELD_OUT_MODULUS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
