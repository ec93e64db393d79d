"""Substring removal against a brute-force comparison of all windows."""

import re
from collections import Counter

import numpy as np
import pytest

from isoline.llm.substring_dedup import anchors_of, leftmost_minima, remove_repeats

rng = np.random.default_rng(11)


def some(n, vocabulary=40):
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


PASSAGES = [some(60), some(35), some(34), some(120)]
LINE = some(14)
TEXTS = [None, "", " \t\n ", PASSAGES[0], PASSAGES[0], "Word " + PASSAGES[0], "a b " + PASSAGES[1] + " c", PASSAGES[1] + " d", PASSAGES[2] + " e", PASSAGES[2] + " f", "x " * 90, "z " * 36, "z " * 35 + "q"]
for k in range(40):  # near copies with one changed word, passages in different company, one line in every text
    words = PASSAGES[3].split()
    words[int(rng.integers(0, len(words)))] = f"edit{k % 7}"
    TEXTS.append(" ".join(words) if k % 2 else f"{some(20)}\n{LINE}\t{some(int(rng.integers(5, 30)))} {PASSAGES[k % 3]} {some(9)}")
TEXTS += [some(4000, 6), f"{PASSAGES[3]} {some(50)} {PASSAGES[3]}", "café x " * 40, f"Q {PASSAGES[0].upper()}"]
ROWS = [(k, t, "src", 1, "clash") for k, t in enumerate(TEXTS)] + [(5, TEXTS[6], "src", 1, None), (None, PASSAGES[1], None, None, None), (None, None, None, None, None), (20, TEXTS[20], "src", 2, None)]
SCHEMA = "doc_id bigint, text string, source string, n_words int, digest string"  # n_words and digest clash


def brute(rows, length):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[s : s + length]) for w in cut for s in range(len(w) - length + 1))
    out = []
    for (doc_id, *_), w in zip(rows, cut, strict=True):
        gone = set()
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone.update(range(s, s + length))
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_leftmost_minima():
    for width in (1, 2, 3, 7, 8, 24):
        g = rng.integers(0, 5, 100)
        assert leftmost_minima(g, width).tolist() == [s + int(np.argmin(g[s : s + width])) for s in range(100 - width + 1)]


def test_runs_cover_all_windows():
    h = rng.integers(0, 1 << 60, 500).astype(np.uint64)
    _, _, first, run = anchors_of(h, 35, 12)
    assert first[0] == 0 and (first[1:] == (first + run)[:-1]).all() and first[-1] + run[-1] == 466
    assert all(len(x) == 0 for x in anchors_of(h[:34], 35, 12))


@pytest.mark.parametrize("length,seed", [(35, 12), (5, 2), (8, 8)])
def test_removal_equals_brute_force(spark, length, seed):
    rows = [tuple(r) for r in remove_repeats(spark.createDataFrame(ROWS, SCHEMA).repartition(7), length=length, seed=seed).collect()]
    assert sorted(((d, n, gone, kept) for d, n, gone, _, kept in rows), key=repr) == brute(ROWS, length)
    assert all(sum(e - s for s, e in spans) == gone for _, _, gone, spans, _ in rows)
    assert all(a[1] < b[0] for *_, spans, _ in rows for a, b in zip(spans, spans[1:]))


def test_hot_groups(spark):
    """Many copies of one text and one line in all texts: hot keys take the broadcast way."""
    rows = [(k, PASSAGES[0] if k % 3 else f"{some(25)} {LINE} {some(25)}", "s", 1, None) for k in range(1800)]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA), length=35)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=repr) == brute(rows, 35)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert remove_repeats(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()[0].n_words == 0
