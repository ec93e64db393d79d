"""The filter audit against a plain simulation of every order."""

import re
from itertools import permutations

import pytest

from isoline.llm.filter_audit import filter_audit

NUMBERS = " ".join(map(str, range(1000, 1250)))
TEXTS = ["short text", NUMBERS, NUMBERS, NUMBERS + " #", "word " * 300, "Word " * 300, None, "", NUMBERS.replace("1", "X"), "ÄÖ " * 250, "a\x1cb|\x0bc", NUMBERS, "x" * 50_000, "Word " * 300]
ROWS = [(k, t, f"s{k % 3}" if k % 5 else None, "clash", 7) for k, t in enumerate(TEXTS)] + [(1, NUMBERS, "s1", None, None), (None, NUMBERS, "s1", None, None), (None, None, None, None, None), (3, "other", "s9", None, None)]
SCHEMA = "doc_id bigint, text string, source string, part string, kept int"  # part and kept clash with result columns
LABELS = [(1, 1, 0, "x"), (2, 1, 1, "x"), (3, 0, 1, "x"), (3, 1, 0, "x"), (5, None, 1, "x"), (None, 1, 1, "x"), (11, 1, 1, "x"), (99, 1, 1, "x")]
LABEL_SCHEMA = "doc_id bigint, quality int, toxic int, part string"


def brute(rows, labels):
    docs = []
    for doc_id, text, source, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), any(doc_id is not None and r[0] is not None and r[0] < doc_id and (r[1] or "") == t for r in rows)), strict=True) if bad}
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        docs.append((source or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                gone, stay = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                every = [d for d in docs if d[0] == part]
                out[part, "".join(order), k + 1] = [len(stay), len(gone), sum(f in d[1] for d in every) - len(gone), sum(d[1] == {f} for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = stay
    shapley = {}
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + x[1]
    return {(p, o, s, *x, shapley[p, o[s - 1]]) for (p, o, s), x in out.items()}


def test_audit_equals_simulation(spark):
    docs, labels = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(LABELS, LABEL_SCHEMA)
    got = filter_audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 600 * len({r[2] or "" for r in ROWS})
    assert set(rows) == brute(ROWS, LABELS)


@pytest.mark.parametrize("with_labels", [True, False])
def test_empty_tables(spark, with_labels):
    labels = spark.createDataFrame(LABELS if with_labels else [], LABEL_SCHEMA)
    assert filter_audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    if not with_labels:
        rows = filter_audit(spark.createDataFrame(ROWS, SCHEMA), labels).collect()
        assert {tuple(r) for r in rows} == brute(ROWS, [])
