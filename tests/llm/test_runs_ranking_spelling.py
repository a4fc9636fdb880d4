"""Periodic runs, pairwise ranking and spelling variants against brute force and held-out labels; awkward inputs."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import periodic_runs, queries, ranking, spelling
from cohortlab.llm.common import read_table
from tests.llm.conftest import prose

# --- periodic runs -------------------------------------------------------------------------------------------


def lyndon_brute(s):
    def is_lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))

    return [max(j - i for j in range(i + 1, len(s) + 1) if is_lyndon(s[i:j])) for i in range(len(s))]


def runs_brute(s, min_length, min_exponent):
    """Stretches of equality at each distance, less those with a smaller period."""
    out = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(s[x] == s[x + d] for x in range(i, i + length - d)) for d in range(1, q))
            if j > i and length >= min_length and length >= min_exponent * q and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_lyndon_array(s):
    assert periodic_runs.lyndon_array(np.array(s)).tolist() == lyndon_brute(s)


@pytest.mark.parametrize(("min_length", "min_exponent"), [(2, 2), (5, 3), (6, 4)])
def test_runs_of_several_texts(min_length, min_exponent):
    rng = random.Random(min_exponent)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.randrange(60), rng.choice([1, 2, 3, 12])
            t = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 8)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
            texts.append(t)
        got = periodic_runs.runs_of_texts(texts, min_length, min_exponent)
        assert [list(map(tuple, r.tolist())) for r in got] == [runs_brute(t, min_length, min_exponent) for t in texts]


def test_extensions_of_a_long_repetitive_sequence():
    s = np.tile([1, 2, 1, 1, 2], 4000)
    assert periodic_runs.runs_of(s, np.zeros(len(s), bool)).tolist() == [[0, 20000, 5]]
    thue_morse = np.array([bin(i).count("1") & 1 for i in range(1 << 14)])
    assert not len(periodic_runs.runs_of(thue_morse, np.zeros(len(thue_morse), bool)))  # it has no cube


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_of_documents(docs, rows):
    got = periodic_runs.find_runs(docs).collect()
    want = []
    for i, text, _ in rows:
        w = words_of(text)
        if len(w) > 1000:
            runs = []  # random words
        else:
            runs = runs_brute(w, 6, 4)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in got), key=str) == sorted(want, key=str)
    assert any(r.runs for r in got)


def test_runs_of_nothing(no_docs):
    assert periodic_runs.find_runs(no_docs).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(no_docs, min_exponent=1)


def test_runs_query_against_brute_force(spark, sf_small):
    texts = {r.doc_id: r.text for r in read_table(spark, sf_small, "documents").collect()}
    got = {r.doc_id: r for r in queries.op11_baier_runs(spark, sf_small).collect()}
    assert set(got) == set(texts)
    seen = 0
    for doc_id, text in texts.items():
        w, h = words_of(text), zlib.crc32(str(doc_id).encode())
        if len(w) > 700:
            continue
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_brute(w, 6, 4)
        r = got[doc_id]
        assert r.n_runs == len(runs)
        if runs:
            seen += 1
            best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert seen > 5


# --- pairwise ranking ----------------------------------------------------------------------------------------


def test_weights_have_no_gradient():
    rng = np.random.default_rng(1)
    d = rng.normal(0.3, 1, (500, 4))
    w = ranking.bradley_terry(d, ridge=0.01)
    p = 1 / (1 + np.exp(d @ w))
    assert np.abs(-(d * p[:, None]).mean(0) + 0.01 * w).max() < 1e-6


def test_pairs_take_every_document():
    for good, bad in ((1, 1), (5, 2), (2, 5), (40, 7), (7, 40)):
        a, b = ranking.preference_pairs(good, bad, 4)
        assert set(a) == set(range(good)) and set(b) == set(range(bad))
        assert len(a) == len(b) == 4 * max(good, bad)


def test_threshold_is_a_quantile_between_the_labels():
    s = np.array([0.1, 0.2, 0.9, 0.3, 1.5, 1.1])
    y = np.array([0, 0, 1, 0, 1, 1])
    assert ranking.threshold_of(s, y) == pytest.approx(0.6)
    assert ranking.threshold_of(np.ones(4), np.array([0, 1, 0, 1])) == 1.0


def labelled(spark, rng_seed=3, n=120):
    rng = random.Random(rng_seed)
    texts, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(i, 60)
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + "###" for w in text.split()), "Er " * 60, " | ".join(text.split())])
        texts.append((i, text, None))
        labels.append((i, int(good)))
    return texts, labels, spark.createDataFrame(texts, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_ranking_of_held_out_documents(spark):
    _, labels, docs, truth = labelled(spark)
    want = dict(labels)
    m = ranking.fit(docs, truth)
    got = ranking.score(docs, m).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_labels_of_held_out_documents_teach_nothing(spark):
    _, labels, docs, truth = labelled(spark)
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    turned = spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in labels], "doc_id long, quality int")
    one, two = ranking.fit(docs, truth), ranking.fit(docs.repartition(5), turned)
    assert (one.weights == two.weights).all() and one.threshold == two.threshold


def test_ranking_of_awkward_rows(docs, rows, no_docs, spark):
    _, _, texts, truth = labelled(spark)
    m = ranking.fit(texts, truth.unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 7), (5, 0), (5, 1)], "doc_id long, quality int")))
    got = ranking.score(docs, m).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert len({r.score for r in got if r.doc_id in (7, 8, 9)}) == 1 and all(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id == 13}) == 1
    assert ranking.score(no_docs, m).collect() == []
    nothing = ranking.fit(texts, truth.limit(0))
    assert {r.score for r in ranking.score(docs, nothing).collect()} == {0.0}
    assert {r.predicted for r in ranking.score(docs, ranking.fit(texts, truth.where("quality = 1"))).collect()} == {1}
    assert ranking.fit(no_docs, truth).weights is None


def test_ranking_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in read_table(spark, sf, "labels").collect()}
    got = [r for r in queries.op12_pairwise_quality(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.97
    good, bad = ([r.score for r in got if truth[r.doc_id] == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.99


# --- spelling variants ---------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def near_brute(words):
    words = sorted(words)
    return {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", max_size=7), max_size=25))
def test_scan_of_a_sorted_list(words):
    words = sorted(words)
    assert {(words[i], words[j]) for i, j in spelling.scan(words)} == near_brute(words)


@pytest.mark.parametrize("limit", [3, 1000])
def test_pairs_once_however_small_the_blocks(spark, limit):
    rng = random.Random(8)
    words = {"".join(rng.choice(["a", "b", "th", "é"]) for _ in range(rng.randrange(1, 8))) for _ in range(250)} | {"a" * k for k in range(1, 12)}
    vocabulary = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long").repartition(3)
    got = [tuple(sorted((r.word, r.near))) for r in spelling.near_pairs(vocabulary, limit).collect()]
    assert Counter(got) == Counter(near_brute(words))


def forms_brute(counts, min_count=5, ratio=5):
    words = {w: n for w, n in counts.items() if n >= min_count}
    near = {w: [] for w in words}
    for a, b in near_brute(words):
        near[a].append(b), near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("limit", [2, 1000])
def test_forms_and_roots(spark, limit):
    counts = {"colour": 700, "color": 6, "colours": 140, "coloured": 5, "colourse": 28, "colurse": 5, "kolour": 140, "colour1": 4, "zebra": 9, "zebras": 9, "zebrax": 9}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.group_variants(frame, limit=limit).collect()
    assert sorted(map(tuple, got)) == forms_brute(counts)
    assert {r.word: r.root for r in got}["colurse"] == "colour"  # three forms on


def test_words_of_documents(docs, rows):
    want = Counter()
    for _, text, _ in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        want.update(w for w in re.findall("[A-Za-zÀ-ÿ]+", lowered) if len(w) >= 6)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == want
    got = spelling.group_variants(spelling.word_counts(docs)).collect()
    assert sorted(map(tuple, got)) == forms_brute(want)


def test_words_counted_in_parts(docs, monkeypatch):
    whole = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    batches = docs.select("doc_id", "text").toArrow().to_batches()
    monkeypatch.setattr(spelling, "PART", 5)
    got = Counter()
    parts = list(spelling._counts(batches, "[A-Za-zÀ-ÿ]{6,}", 6, None))
    for p in parts:
        got.update(dict(zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)))
    assert got == whole and len(parts) > 3


def test_slips_lose_one_letter():
    counts = {f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}": 2 for i in range(4000)}
    changed = [(w, x) for w, (x, n) in zip(counts, queries.with_slips(5, counts), strict=True) if x != w]
    assert len(changed) > 5
    for w, x in changed:
        h = zlib.crc32(f"5:{w}".encode())
        assert h % 199 == 0 and x == w[: h % len(w)] + w[h % len(w) + 1 :]


def test_spelling_of_nothing(no_docs):
    assert spelling.group_variants(spelling.word_counts(no_docs)).collect() == []
