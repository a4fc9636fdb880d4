"""Scores and verdicts by brute force: quality (op5), toxicity (op7); magnitudes (op2), long words (op5), urls (op8)."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlab.llm import embedding_dedup, quality, toxicity, warc
from cohortlab.llm.common import read_table, scratch_path
from tests.llm.conftest import prose


# --- quality -------------------------------------------------------------------------------------------------
def char_class(c):
    if c in " \t\n\v\f\r":
        return "space"
    if c in ".,;:'\"()-?":
        return "stop"
    if c == "!":
        return "mark"
    if c in "#*$%&|<>":
        return "symbol"
    if ord(c) < 0x2FFF:
        return "capital" if c.isupper() else "small" if c.isalnum() else "other"
    return "other"


def histograms(text):
    common = set(quality.WORDS)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = Counter(char_class(c) for c in text or "")
    known = Counter()
    for w in words:
        bare = w.strip(".,;:'\"()-?!#*$%&|<>").lower()
        known[bare if bare in common else None] += 1
    return words, chars, known


def js_distance(a, b):
    n, m = sum(a.values()), sum(b.values())
    if not n or not m:
        return 0.0
    total = 0.0
    for k in set(a) | set(b):
        p, q = a.get(k, 0) / n, b.get(k, 0) / m
        mean = (p + q) / 2
        total += (p * math.log2(p / mean) if p else 0) + (q * math.log2(q / mean) if q else 0)
    return math.sqrt(max(total / 2, 0))


def allowance(n, reference):
    return math.sqrt(max(sum(v > 0 for v in reference.values()) - 1, 0) / (8 * max(n, 1) * math.log(2)))


def brute_verdicts(rows):
    """kept of (doc_id, text, lang) rows, by the docstring."""
    made = {}
    for i, (_, text, lang) in enumerate(rows):
        words, chars, known = histograms(text)
        seen = defaultdict(list)
        for k in range(len(words) - 7):
            seen[tuple(words[k : k + 8])].append(k)
        repeated = {x for at in seen.values() if len(at) > 1 for k in at for x in range(k, k + 8)}
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        made[i] = (lang, len(words), chars, known, failed)

    def references(some):
        sums = defaultdict(lambda: (Counter(), Counter()))
        for lang, _, chars, known, _ in some:
            for side, h in enumerate((chars, known)):
                for k, v in h.items():
                    sums[lang][side][k] += math.floor(1e6 * v / max(sum(h.values()), 1))
        whole = (Counter(), Counter())
        for pair in sums.values():
            for side in (0, 1):
                whole[side].update(pair[side])
        return lambda lang: sums[lang] if lang is not None and lang in sums else whole

    sound = [m for m in made.values() if not m[4]]
    first = references(sound)
    near = [m for m in sound if js_distance(m[2], first(m[0])[0]) <= quality.TRIM + allowance(sum(m[2].values()), first(m[0])[0])]
    final = references(near)
    out = []
    for i, (doc_id, _, _) in enumerate(rows):
        lang, n, chars, known, failed = made[i]
        a, b = final(lang)
        bad = sum(chars.values()) >= quality.MIN_CHARS and js_distance(chars, a) > quality.MAX_CHAR_DISTANCE + allowance(sum(chars.values()), a)
        bad |= n >= quality.MIN_JUDGED_WORDS and js_distance(known, b) > quality.MAX_WORD_DISTANCE + allowance(n, b)
        out.append((doc_id, not failed and not bad))
    return out


def test_quality_verdicts_by_brute_force(spark, sf_small):
    rows = [(r.doc_id, r.text, r.lang) for r in read_table(spark, sf_small, "documents").collect()]
    got = {r.doc_id: r.kept for r in quality.quality_rules(read_table(spark, sf_small, "documents")).collect()}
    want = dict(brute_verdicts(rows))
    assert got == want and 0 < sum(want.values()) < len(want)


def test_long_punctuation_does_not_hide_a_common_word():
    places = quality.CommonWords()
    assert places[b"the" + b"!" * 60] == places[b"the"] == places[b'"The",'] < len(quality.WORDS)
    assert places[b"the" * 30] == len(quality.WORDS)


def test_kept_rows_carry_every_column(spark):
    clean = [(i, ". ".join(prose(i * 7 + k, 12).capitalize() for k in range(9)) + ".", "en", {"a": i}, [i, None]) for i in range(12)]
    docs = spark.createDataFrame([*clean, (90, "### " * 60, "en", None, None)], "doc_id long, text string, lang string, `odd name` map<string,int>, chars array<int>")
    kept = quality.keep_sound(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r["odd name"]["a"], r.chars[0]) for r in kept.collect()} == {(i, i, i) for i in range(12)}


# --- toxicity ------------------------------------------------------------------------------------------------
def brute_density(text, weights, exceptions):
    """Every place and entry tried one by one."""
    words = toxicity.fold(text)
    line = f" {' '.join(words)} "
    best = {}
    for at in range(len(line)):
        for entry, w in weights.items():
            if line.startswith(entry, at):
                best[at] = max(best.get(at, 0.0), w)
    for at in range(len(line)):
        for phrase in exceptions:
            if line.startswith(phrase, at):
                for k in [k for k in best if at <= k < at + len(phrase)]:
                    del best[k]
    return 100 * sum(best.values()) / max(len(words), toxicity.LENGTH_FLOOR) if words else 0.0


def test_scores_by_brute_force(spark, docs, rows):
    lexicon = toxicity.Lexicon({" river ": 4.0, " stone": 3.5, " ston": 5.0, " lamp ": 3.25}, (" river stone ", " lamp garden "), 1.7, -4.0)
    got = toxicity.score(docs, lexicon).collect()
    want = []
    for i, t, _ in rows:
        if len(t or "") < 20_000:
            x = math.log1p(brute_density(t, lexicon.weights, lexicon.exceptions))
            want.append((i, round(1 / (1 + math.exp(-(1.7 * x - 4.0))), 9)))
    assert sorted(((r.doc_id, round(r.score, 9)) for r in got if r.doc_id != 12), key=str) == sorted((w for w in want if w[0] != 12), key=str)
    assert len({s for _, s in want}) > 3


def test_exceptions_are_learned_and_act(spark):
    rows, labels = [], []
    for i in range(600):
        words = prose(i, 30).split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(7, "grublord")
        elif i % 40 == 1:
            words[9:9] = ["saint", "grublord"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, truth)
    assert " saint grublord " in lexicon.exceptions and " grublord " in lexicon.weights
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, lexicon).collect()}
    assert all(got[i] == t for i, t in labels)


def test_words_of_few_texts_need_no_fixed_number(spark):
    """Chance decides how many texts an entry needs: five of five toxic ones do among a few hundred candidates, one of one does not."""
    rows = [(i, prose(i, 12) + (" vilescum" if i < 5 else " oncebad" if i == 5 else "")) for i in range(200)]
    docs = spark.createDataFrame([(i * 5 + 1, t) for i, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i * 5 + 1, int(i < 6)) for i, _ in rows], "doc_id long, toxic int")
    weights = toxicity.fit(docs, labels).weights
    assert " oncebad " not in weights


# --- vectors and archives ------------------------------------------------------------------------------------
@pytest.mark.parametrize("scale", [1e200, 1e-200, 1.0])
def test_vectors_of_any_magnitude(spark, scale):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (6, 16))
    rows = [(i, [float(v) * scale for v in x]) for i, x in enumerate(np.concatenate([base, base + rng.normal(0, 0.05, base.shape)]))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (1, i % 6) for i in range(12)}


def test_urls_read_back_as_written(spark):
    urls = ["http://a.example/x y\n", "http://a.example/100%25/%0A", "http://ü.example/日本?q=a b", None, "", "plain"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    manifest = warc.write_packages(pages, scratch_path(spark, "warc-test"))
    assert {r.page_id: r.url for r in warc.read_packages(manifest).collect()} == dict(enumerate(urls))
