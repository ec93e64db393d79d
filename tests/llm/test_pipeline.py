"""The pipeline's stages and run() against plain brute-force versions, and on rows with nulls, repeats, clashing columns and empty tables."""

import itertools
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from isoline.llm import pii, quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, hit_id int"  # the last three clash with inner names
PHRASES = ["the river ran slowly past the old mill", "children played in the long summer grass", "a letter arrived from the northern town", "she opened the window and looked at the sea", "the train left the station before noon"]


def prose(k: int, n: int = 60) -> str:
    rng = np.random.default_rng(k)
    return ". ".join(f"{PHRASES[i].capitalize()} near w{k}x{j}" for j, i in enumerate(rng.integers(0, len(PHRASES), n // 10))) + "."


ITEM = "which planet of the solar system has the largest number of known moons today"
BASE = [(k, prose(k)) for k in range(120)]
JUNK = [(k, f"$$$ ### %%% {k} @@@ ||| $$$ ^^^") for k in range(200, 320)]
NEAR = [(500, BASE[3][1] + " Extra."), (501, BASE[3][1]), (502, BASE[5][1].replace("river", "stream", 1))]
LEAK = [(600, prose(600) + " " + ITEM + " " + prose(601)), (601, prose(602) + " " + ITEM.replace("largest", "highest") + " " + prose(603))]
PRIVATE = [(700, prose(700) + " Write to jan.doe@mail.example.org or call +44 20 7946 0958 now. " + prose(701) + " Again 442079460958.")]
PLAIN = BASE + JUNK + NEAR + LEAK + PRIVATE
ROWS = [(k, t, "en", "web", len(t), 0.5, "x", k) for k, t in PLAIN]
ODD = [(None, prose(800), None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (801, None, "en", "web", 0, 1.0, "y", 1), (802, "", "en", "web", 0, 1.0, "y", 1), (1, BASE[1][1], "en", "web", 5, 0.1, "z", 2), (803, "long " * 300_000, "en", "web", 1, 1.0, "y", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k < 200), 0) for k, _ in BASE + JUNK], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM, "q")], "item_id bigint, text string, doc_id string").write.parquet(f"{d}/benchmark.parquet")
    return d


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))


def plain_near(rows):
    sets = [set(zip(*(words(t or "")[i:] for i in range(5)))) or ({tuple(words(t or ""))} if words(t or "") else set()) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] == rows[j][0] or sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)), key=lambda x: rows[x][0])
            group[b] = a
    return {r[0] for i, r in enumerate(rows) if rows[top(i)][0] == r[0]}


def plain_leak(text):
    t, item = re.findall(r"[^\W_]+", (text or "").lower()), ITEM.split()
    return any(100 * sum(0 <= s + j < len(t) and t[s + j] == x for j, x in enumerate(item)) >= 80 * len(item) for s in range(-len(item), len(t)))


def plain_redacted(text):
    return text.replace("jan.doe@mail.example.org", "<email>").replace("+44 20 7946 0958", "<phone>").replace("442079460958", "<phone>")


def test_run_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in BASE + NEAR + LEAK + PRIVATE)  # junk goes, clean documents stay
    rows = [(k, t) for k, t in PLAIN if k < 200 or k >= 500]
    stay = plain_near(rows)
    assert stay == {k for k, _ in BASE + LEAK + PRIVATE}
    clean = [(k, plain_redacted(t)) for k, t in rows if k in stay and not plain_leak(t)]
    assert len(clean) == len(BASE + PRIVATE)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: [*tok.encode(t, add_special_tokens=False).ids, 0] for k, t in clean}
    got, by = corpus_pipeline.run(spark, folder).collect(), {}
    assert sorted(r.doc_id for r in got) == sorted(want)  # none of them is longer than a sequence
    for r in got:
        assert (r.piece, r.start, r.length, r.ids_crc32) == (0, 0, len(want[r.doc_id]), zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()))
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by) == -(-sum(map(len, want.values())) // 2048)


def rows_of(df):
    return sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_on_odd_rows(spark, folder, name, stage):
    odd, empty = spark.createDataFrame(ROWS + ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    after = stage(spark, odd, folder)
    assert after.schema.names == odd.schema.names and stage(spark, empty, folder).count() == 0
    before = sorted(json.dumps(dict(zip(odd.columns, r)), sort_keys=True) for r in ROWS + ODD)
    got = rows_of(after)
    if name == "personal data":
        assert len(got) == len(before)
    else:
        assert not set(got) - set(before)
    lost = {json.loads(x)["doc_id"] for x in set(before) - set(got)} if name != "personal data" else set()
    if name == "near duplicates":
        assert lost == {500, 501, 502, 1}  # of the two rows of document 1 the least by all columns stays
        assert sum(json.loads(x)["doc_id"] == 1 for x in got) == 1
    if name == "benchmark decontamination":
        assert lost == {600, 601}


def test_packing_of_odd_rows(spark, folder):
    odd = spark.createDataFrame(ODD, SCHEMA)
    got = corpus_pipeline.packing_stage(spark, odd, folder).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in got) == sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)
    assert corpus_pipeline.packing_stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_base_spans_are_the_patterns():
    """The contract's expressions, read by re, on random strings of the characters that matter."""
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    rng = np.random.default_rng(2)
    parts = ["a.b", "@", "c.org", ".", " ", "-", "+", "4111 1111 1111 1111", "4111111111111112", "10.0.0.1", "256.1.1.1", "+44 20 7946 0958", "(0)", "12", "007", "é", "_", "%", "+1", "\n", "x-y"]
    for _ in range(3000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 14)))
        want = [(k, m.start(), m.end()) for k, (r, ok) in enumerate(rules) for m in re.finditer(r, text) if ok(m[0])]
        assert pii.base_spans(text) == want, text


def test_pii_recall_of_planted_repeats(spark):
    """Numbers without a plus and addresses with spaces, whose whole forms stand elsewhere in the document: nearly all are found, and no lone number is."""
    rng, rows = np.random.default_rng(5), []
    for k in range(300):
        n = rng.integers(10**8, 10**9)
        phone, bare, mail = f"+44 20 {n % 10000:04d} {n // 10000 % 10000:04d}", f"4420{n % 10000:04d}{n // 10000 % 10000:04d}", f"user{k}@host{k}.org"
        rows.append((k, f"call {phone} or write {mail} today. " + prose(k) + f" again {bare} and {mail.replace('@', ' @ ')} end" if k % 2 else prose(k) + f" order {rng.integers(10**9, 10**10)} shipped"))
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[k].count("phone") == 2 and got[k].count("email") == 2 for k in range(1, 300, 2)) >= 147
    assert all(got[k] == "" for k in range(0, 300, 2))


def test_quality_score_is_a_sum_of_tables():
    """The vectorised score against one bin at a time, and held-out accuracy on overlapping classes."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, len(quality.FEATURES)))
    clean = x[:, 0] + 0.5 * x[:, 1] + 1.5 * (x[:, 2] > 0) * (x[:, 3] > 0) - 0.4
    y = (clean + rng.logistic(size=4000) * 0.3 > 0).astype(float)
    m = quality.PairwiseGam(rounds=60, pair_rounds=30).fit(x[:3000], y[:3000])
    got = m.score(x[3000:])
    for row, p in zip(x[3000:3050], got):
        bins = [sum(e <= v for e in edges) for v, edges in zip(row, m.edges)]
        f = m.intercept + sum(t[b] for t, b in zip(m.tables, bins)) + sum(t[bins[i] * 8 // max(8, len(m.tables[i])), bins[j] * 8 // max(8, len(m.tables[j]))] for i, j, t in m.pairs)
        assert p == pytest.approx(1 / (1 + np.exp(-f)))
    best = ((clean[3000:] > 0) == (y[3000:] > 0)).mean()  # of the rule that the labels were made with, before noise
    assert ((got > 0.5) == (y[3000:] > 0)).mean() > best - 0.05


def test_quality_ignores_odd_labels(spark):
    good, bad = [(k, f"plain words and more words {k}.") for k in range(100)], [(k, f"### {k} $$$ %%%") for k in range(100, 200)]
    d = spark.createDataFrame([(*r, 9.0, 1) for r in good + bad], "doc_id bigint, text string, score double, predicted int")
    labels = [(k, int(k < 100), 5.0) for k in range(200)]
    odd = labels + labels[:40] + [(None, 1, 0.0), (3, None, 0.0), (4, 7, 0.0)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, score double")
    got = quality.classify(d, make(odd)).where("held_out").collect()
    assert all(r.predicted == (r.doc_id < 100) for r in got)
