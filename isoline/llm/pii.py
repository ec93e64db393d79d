"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans (email, ip, card, phone). Sites of a text are its base spans and its other email-like tokens (also with spaces around the @) and
numbers of seven digits or more. Neighbouring sites share chain potentials; sites with equal content (the same mailbox, the same last digits) share skip
potentials, and numbers that differ in one of their last ten digits weaker ones, however far apart: a free site with the base spans of its key, so that its
evidence does not fall with the number of copies, and with the next free site of the key.

The weights are fitted by pseudo-likelihood on counts of all texts, with base spans as labels. A site is seen without the marks that its pattern asks for
(plus signs, separators, domain endings), so labels are told from shape, the word before, neighbours and twins; free sites with a labelled twin are left out,
as their label is what is sought. Loopy belief propagation, in blocks of bounded memory, then labels the free sites of every document; a site that its own
pattern refused bears the odds of MISSED against any label, and shape and word are bounded, so they alone never label it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.llm.common import batch, rows_of, text_or_empty

KINDS = ("email", "ip", "card", "phone")
N_LABELS, N_SHAPES, N_WORDS, EDGE_LABEL = len(KINDS) + 1, 16, 17, len(KINDS) + 1  # label 0: none; EDGE_LABEL: no neighbour
#: The odds of a label that the patterns missed; the bound of what shape and word before say; the probability from which a span is added.
MISSED, BOUND, CERTAIN, ROUNDS = 0.02, 2.0, 0.9, 20
#: Prior means of the weights for agreement with an equal and with a similar site (the fit may move them), and the precision of the prior.
EQUAL_PRIOR, SIMILAR_PRIOR, PRECISION = 9.0, 3.0, 1.0
#: Characters before a site in which the word before it is sought; messages computed at once.
WORD_WINDOW, MESSAGES = 40, 1 << 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start at the first digit of a run: if that start fails, so do the others of the run
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![0-9])\+?\(?[0-9][0-9(). -]*[0-9]")
_WORD = re.compile(r"[A-Za-z]+")
_EDGE = ".,;:!?#$%&*()[]<>{}\"'|"

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind and start: leftmost and non-overlapping in each kind; failing matches are dropped without a retry."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _free(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Email-like and number-like tokens that overlap no base span. Scans stop at the next @, so their cost is linear."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start, stop, after = at, at + 1, text.find("@", at + 1)
        last = len(text) if after < 0 else after
        if start > end + 1 and text[start - 1] == " ":
            start -= 1
        if stop < last - 1 and text[stop] == " ":
            stop += 1
        low, high = start, stop
        while start > end and not text[start - 1].isspace():
            start -= 1
        while stop < last and not text[stop].isspace():
            stop += 1
        whole = stop
        while stop > high and text[stop - 1] in _EDGE:
            stop -= 1
        while start < low and text[start] in _EDGE:
            start += 1
        if start < low and stop > high:
            found.append((start, stop))
        end, at = whole, after
    found += [(m.start(), m.end()) for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7 and len(_DIGIT.findall(m[0])) >= 7]
    out, k, end = [], 0, 0
    spans = sorted((s, e) for _, s, e in taken)
    for s, e in sorted(found):
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if s >= end and not (k < len(spans) and spans[k][0] < e):
            out.append((s, e))
            end = e
    return out


def _mailbox(token: str) -> str:
    """The local part and the first label of the domain, so that a mailbox without its domain ending has the key of the whole one."""
    local, _, domain = token.partition("@")
    label = domain.split(".")[0]
    return f"{local}@{label}" if local and label else token


def _shape_key(token: str) -> tuple[int, str]:
    """The shape without the marks that patterns ask for, and the content that equal sites share."""
    if "@" in token:
        return 0, f"@{_mailbox(token.replace(' ', '').strip(_EDGE).lower())}"
    digits = "".join(_DIGIT.findall(token))
    n = len(digits)
    size = (n > 7) + (n > 9) + (n > 12) + (n > 15) + (n > 19)
    return 1 + 2 * size + (token.count(".") >= 3), f"{int(n > 15)}{digits if n > 15 else digits[-7:]}"


def _similar_keys(token: str) -> list[str]:
    """Keys that two numbers share if they differ in one of their last ten digits."""
    digits = "" if "@" in token else "".join(_DIGIT.findall(token))[-10:]
    return [f"{digits[:k]}?{digits[k + 1 :]}" for k in range(10)] if len(digits) == 10 else []


class Sites:
    """The sites of a text: spans with labels (-1 where free), keys, shapes, the word before, and the labels of base spans with equal and similar content."""

    def __init__(self, text: str, base: list[Span]):
        self.spans, end = [], 0
        for s, e, label in sorted([*((s, e, k + 1) for k, s, e in base), *((s, e, -1) for s, e in _free(text, base))]):
            if s >= end:
                self.spans.append((s, e, label))
                end = e
        n = len(self.spans)
        self.label = np.array([x[2] for x in self.spans], np.int64).reshape(n)
        self.shape, self.word, self.keys = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for i, (s, e, _) in enumerate(self.spans):
            self.shape[i], key = _shape_key(text[s:e])
            self.keys.append(key)
            before = _WORD.findall(text[max(0, s - WORD_WINDOW) : s])
            self.word[i] = 1 + zlib.crc32(before[-1].lower().encode()) % (N_WORDS - 1) if before else 0
        known = np.flatnonzero(self.label > 0)
        held: dict[str, np.ndarray] = {}
        near: dict[str, np.ndarray] = {}
        for i in known:
            held.setdefault(self.keys[i], np.zeros(N_LABELS, np.int64))[self.label[i]] += 1
            for k in _similar_keys(text[self.spans[i][0] : self.spans[i][1]]):
                near.setdefault(k, np.zeros(N_LABELS, np.int64))[self.label[i]] += 1
        self.equal, self.similar = np.zeros((n, N_LABELS), np.int64), np.zeros((n, N_LABELS), np.int64)
        if held:
            for i in range(n):
                own = np.eye(N_LABELS, dtype=np.int64)[self.label[i]] if self.label[i] > 0 else 0
                if self.keys[i] in held:
                    self.equal[i] = held[self.keys[i]] - own
                found = [near[k] - own for k in (_similar_keys(text[self.spans[i][0] : self.spans[i][1]]) if near else []) if k in near]
                if found:  # an equal number is found under every key, a similar one under one: what all keys share is not counted
                    self.similar[i] = np.maximum(0, np.max(found, axis=0) - self.equal[i])
        self.equal, self.similar = np.minimum(self.equal, 2), np.minimum(self.similar, 2)


def following(keys: list[str], among: list[int]) -> list[tuple[int, int]]:
    """Pairs of following sites of one key, of the sites in among."""
    last: dict[str, int] = {}
    out = []
    for i in among:
        if keys[i] in last:
            out.append((last[keys[i]], i))
        last[keys[i]] = i
    return out


#: Of 11 states of a site's twins, how many of them have each label: none; one or more of label 1 to 4; one or more without a label.
TWINS = np.zeros((11, N_LABELS))
for _k in range(1, N_LABELS):
    TWINS[2 * _k - 1, _k], TWINS[2 * _k, _k] = 1, 2
TWINS[9, 0], TWINS[10, 0] = 1, 2
_SIZES = (N_SHAPES, N_WORDS, N_LABELS + 1, N_LABELS + 1, 11, 11, N_LABELS)


def _twin_state(counts: np.ndarray) -> np.ndarray:
    k = counts.argmax(axis=1)
    return np.where(counts.max(axis=1) == 0, 0, np.where(k == 0, 8, 2 * k - 2) + counts.max(axis=1))


class SkipChain:
    """Log potentials: shape (shape, label), word (word before, label), chain (label, label; EDGE_LABEL at the ends), equal and similar (label, label)."""

    def __init__(self):
        same, diagonal = np.zeros((N_LABELS, N_LABELS)), np.arange(1, N_LABELS)
        same[diagonal, diagonal] = 1
        self.shape, self.word = np.zeros((N_SHAPES, N_LABELS)), np.zeros((N_WORDS, N_LABELS))
        self.chain = np.zeros((N_LABELS + 1, N_LABELS + 1))
        self.equal, self.similar = EQUAL_PRIOR * same, SIMILAR_PRIOR * same

    NAMES = ("shape", "word", "chain", "equal", "similar")

    def fit(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> SkipChain:
        """Maximises the pseudo-likelihood of counted sites, with a Gaussian prior around the weights given, by gradient steps of adaptive size."""
        if not len(codes):
            return self
        s, w, left, right, eq, sim, y = np.unravel_index(codes, _SIZES)
        weight = counts / counts.sum()
        start = {n: getattr(self, n).copy() for n in self.NAMES}
        first, second = ({n: np.zeros_like(v) for n, v in start.items()} for _ in range(2))
        hot = np.eye(N_LABELS)[y]
        for t in range(1, rounds + 1):
            z = self.shape[s] + self.word[w] + self.chain[left, :N_LABELS] + self.chain[:N_LABELS, right].T + TWINS[eq] @ self.equal + TWINS[sim] @ self.similar
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - hot) * weight[:, None]
            grad = {n: PRECISION / counts.sum() * (getattr(self, n) - start[n]) for n in self.NAMES}
            np.add.at(grad["shape"], s, g)
            np.add.at(grad["word"], w, g)
            np.add.at(grad["chain"][:, :N_LABELS], left, g)
            np.add.at(grad["chain"].T[:, :N_LABELS], right, g)
            grad["equal"] += TWINS[eq].T @ g
            grad["similar"] += TWINS[sim].T @ g
            for n in self.NAMES:
                first[n] = 0.9 * first[n] + 0.1 * grad[n]
                second[n] = 0.99 * second[n] + 0.01 * grad[n] ** 2
                getattr(self, n).__isub__(0.1 * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.99**t)) + 1e-12) / (1 + t / 30))
        return self

    def beliefs(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Loopy sum-product over the edges: the sites' label probabilities. unary in logs, one row a site; chain and skip are arrays of site pairs."""
        edges = np.concatenate([chain, skip]).reshape(-1, 2)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        m = len(edges)
        tables = np.stack([self.chain[:N_LABELS, :N_LABELS], self.equal, self.chain[:N_LABELS, :N_LABELS].T, self.equal.T])
        kind = np.concatenate([np.repeat([0, 1, 2, 3], [len(chain), len(skip)] * 2)]).astype(np.int8)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        message, belief = np.zeros((2 * m, N_LABELS)), unary.copy()
        for _ in range(ROUNDS if m else 0):
            moved, new = 0.0, np.empty_like(message)
            for at in range(0, 2 * m, MESSAGES):
                part = slice(at, at + MESSAGES)
                x = (belief[source[part]] - message[back[part]])[:, :, None] + tables[kind[part]]
                top = x.max(axis=1)
                out = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
                out -= out.max(axis=1, keepdims=True)
                moved = max(moved, float(np.abs(out - message[part]).max()))
                new[part] = (message[part] + out) / 2
            message = new
            belief = unary.copy()
            for k in range(N_LABELS):
                belief[:, k] += np.bincount(target, message[:, k], len(unary))
            if moved < 1e-3:
                break
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), both by kind and start."""
        base = base_spans(text)
        if "@" not in text and not _DIGIT.search(text):
            return base, base
        sites = Sites(text, base)
        free = np.flatnonzero(sites.label < 0)
        if not len(free):
            return base, base
        odds = self.shape[sites.shape[free]] + self.word[sites.word[free]]
        unary = np.clip(odds - odds[:, :1], -BOUND, BOUND)
        unary[:, 1:] += np.log(MISSED)
        unary += sites.equal[free] @ self.equal + sites.similar[free] @ self.similar
        # a neighbour that is a base span, or none at all, adds a row of the chain's potential; free neighbours get an edge
        around = np.concatenate([[EDGE_LABEL], sites.label, [EDGE_LABEL]])
        before, after = around[free], around[free + 2]
        unary[before > 0] += self.chain[before[before > 0], :N_LABELS]
        unary[after > 0] += self.chain[:N_LABELS, after[after > 0]].T
        place = np.cumsum(sites.label < 0) - 1
        chain = np.stack([place[free[after < 0]], place[free[after < 0]] + 1], axis=1)
        skip = place[np.array(following(sites.keys, free.tolist()), np.int64).reshape(-1, 2)]
        p = self.beliefs(unary, chain, skip)
        best = p.argmax(axis=1)
        new = [(int(best[j]) - 1, *sites.spans[i][:2]) for j, i in enumerate(free.tolist()) if best[j] and p[j, best[j]] >= CERTAIN]
        return base, sorted(base + new)


def _count(batches):
    counts: Counter = Counter()
    for b in rows_of(batches, 1000):
        for text in b.column(0).to_pylist():
            if "@" not in text and not _DIGIT.search(text):
                continue
            sites = Sites(text, base_spans(text))
            if not sites.spans:
                continue
            y = np.maximum(sites.label, 0)
            around = np.concatenate([[EDGE_LABEL], y, [EDGE_LABEL]])
            equal, repeats = sites.equal.copy(), Counter(sites.keys)
            lone = (sites.label < 0) & (equal.sum(axis=1) == 0)
            equal[lone, 0] = [min(2, repeats[sites.keys[i]] - 1) for i in np.flatnonzero(lone)]
            seen = (sites.label > 0) | lone & (sites.similar.sum(axis=1) == 0)  # a token that the patterns missed says nothing against its twin
            code = np.ravel_multi_index((sites.shape, sites.word, around[:-2], around[2:], _twin_state(equal), _twin_state(sites.similar), y), _SIZES)
            counts.update(code[seen].tolist())
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["code", "n"])


def fit_pii(docs: DataFrame, text_col: str = "text") -> SkipChain:
    """Weights from counts over all texts. What reaches the driver is a row for each kind of site met, of which there can be six million at most."""
    found = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow().sort_by("code")
    return SkipChain().fit(found.column("code").to_numpy(), found.column("n").to_numpy().astype(np.float64))


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _find(model: SkipChain):
    def run(batches):
        for b in rows_of(batches, 1000):
            out = {f.name: [] for f in _OUT}
            out["doc_id"] = b.column(0)
            for text in b.column(1).to_pylist():
                base, every = model.spans(text)
                for i, k in enumerate(KINDS):
                    out[f"n_{k}"].append(sum(x[0] == i for x in base))
                out["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                out["spans"].append(spans_text(every))
            yield batch(_OUT, out)

    return run


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added ones).

    Positions are code points, ends exclusive. Null texts are empty and have no spans; null and repeated ids are kept row by row; an empty table gives
    no rows; other columns are not read.
    """
    model = fit_pii(docs, text_col)
    types = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_find(model), f"doc_id bigint, {types}, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the union is replaced, named by the first."""
    out, at, end = [], 0, -1
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[at:s], f"<{KINDS[k]}>"]
        end = at = max(end, e)
    return "".join(out) + text[at:]


def redact_column(model: SkipChain, text: Column) -> Column:
    """The text column with its personal data replaced; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, model.spans(t)[1]) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)
