"""Phrase collocations against a plain count of all n-grams."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from isoline.llm import collocations as co

rng = np.random.default_rng(12)
LINES = ["As far as the eye can see", "all rights reserved", "the one and only", "of the of the of the"]
TEXTS = []
for _ in range(300):
    words = [f"v{k}" for k in rng.zipf(1.5, int(rng.integers(0, 40))) % 60]
    for _ in range(int(rng.integers(0, 4))):
        words.insert(int(rng.integers(0, len(words) + 1)), LINES[int(rng.integers(0, 4))])
    TEXTS.append("".join(w + str(rng.choice([" ", "  ", "\t", ", ", ".\n", ";", "\x0b", " \x1c", "  "], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.03, 0.02, 0.02, 0.03])) for w in words))
TEXTS += [None, "", " ., ", "É é É é", "the " * 3000, "x" * 30_000, TEXTS[0], TEXTS[0]]
ROWS = [(k, t, (None, "en", "de", "und")[k % 4], "clash", 1) for k, t in enumerate(TEXTS)] + [(None, None, None, None, None), (3, TEXTS[3], "en", None, None)]
SCHEMA = "doc_id bigint, text string, lang string, piece string, f int"  # piece and f clash


def brute(rows, least, most):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            counts[lang or "und"].update(tuple(w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        c = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in c.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        found = []
        for p, a in c.items():
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if inside[p] < a:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize("least,most", [(5, 2000), (20, 7)])
def test_equals_brute_force(spark, monkeypatch, least, most):
    monkeypatch.setattr(co, "FILTER_BITS", 256)  # a table that fills up must not change the counts
    monkeypatch.setattr(co, "SLICE_BYTES", 500)
    got = co.collocations(spark.createDataFrame(ROWS, SCHEMA).repartition(5), least=least, most=most).collect()
    assert sorted(map(tuple, got)) == brute(ROWS, least, most)
    assert len(got) > 20


def test_products_beyond_64_bits(spark):
    """a * n and l * r of a large corpus: the score is exact where doubles and longs are not."""
    a, n, l, r = 3_000_000_000_017, 17_000_000_000_000, 3_000_000_000_018, 5_000_000_000_003
    exact = "cast({} as decimal(19,0))".format
    got = spark.sql(f"select ({exact('1000 * a')} * {exact('n')}) div ({exact('l')} * {exact('r')}) as s from values ({a}L, {n}L, {l}L, {r}L) as t(a, n, l, r)").first().s
    assert got == 1000 * a * n // (l * r)


def test_nothing(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert co.collocations(spark.createDataFrame([(1, None, None, None, None), (2, ". ,", "en", None, None)], SCHEMA), least=1).count() == 0
