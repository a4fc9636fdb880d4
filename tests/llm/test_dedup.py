"""Near duplicates (documents, vectors), repeated passages and licenses against brute force."""

import itertools
import re

import numpy as np
import pytest

from cohortlab.llm import embedding_dedup, license_scan, minhash_dedup
from cohortlab.llm.common import WordHashes, connected_components, save
from cohortlab.llm.fm_index import FMIndex
from cohortlab.llm.substring import remove_repeats
from tests.llm.conftest import prose


def components(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows):
    known = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    links = [
        (a, b)
        for (a, x), (b, y) in itertools.combinations(known, 2)
        if x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    return components([i for i, _ in known], links)


def test_near_duplicates_match_brute_force(docs, rows):
    got = minhash_dedup.near_duplicates(docs).collect()
    want = brute_near(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    sizes = {(i, len(shingles(t))) for i, t, _ in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes
    assert len({r.component_id for r in got if r.doc_id in (0, 1, 2, 3)}) == 1


def test_near_duplicates_of_nothing(no_docs):
    assert minhash_dedup.near_duplicates(no_docs).collect() == []


def test_a_large_group_of_near_copies_needs_no_pairs(spark):
    """Copies at all distances around the threshold: exactly the brute-force components."""
    from tests.llm.conftest import BASE, edited

    rows = [(i, edited(BASE, i, 0.002 * (i % 60)), "en") for i in range(400)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = brute_near(rows)
    assert {r.doc_id: r.component_id for r in got} == want


def test_exploded_tables_are_not_broadcast_by_an_estimate(spark, monkeypatch):
    """A row for each band is 32 times what the optimizer takes it for; only sizes as measured decide, and the session's settings come back."""
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{text} end{i}") for i in range(40)], "doc_id long, text string")
    key, before, plans = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), {}
    held = minhash_dedup.save

    def spy(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return held(df, label)

    monkeypatch.setattr(minhash_dedup, "save", spy)
    out = minhash_dedup.near_duplicates(docs)
    assert spark.conf.get(key) == before
    for plan in (plans["dedup-members"], plans["dedup-links"], out._jdf.queryExecution().executedPlan().toString()):
        assert "Join" in plan and "BroadcastHashJoin" not in plan
    assert out.where("kept").count() == 1


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 2**63, 800, dtype=np.uint64)) for _ in range(2))
    ka, kb, ku = (minhash_dedup.registers(minhash_dedup.minima([x])).astype(int) for x in (a, b, np.union1d(a, b)))
    assert (np.maximum(ka, kb) == ku).all()
    common = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x, y = np.union1d(a[:100], common), np.union1d(b[:100], common)
    kx, ky = (minhash_dedup.registers(minhash_dedup.minima([s])).astype(np.uint16) for s in (x, y))
    j = minhash_dedup.estimate(kx, ky, np.array([400.0]), np.array([400.0]))[0]
    assert abs(j - 300 / 500) < 0.2


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5000, 5000)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == components({x for e in chain + star for x in e}, chain + star)


# --- passages ------------------------------------------------------------------------------------------------


def brute_repeats(rows, k=13):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t, _ in rows]
    for i, w in words:
        for a in range(len(w) - k + 1) if i is not None else ():
            g = tuple(w[a : a + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(docs, rows):
    got = remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)


def test_repeats_of_nothing(no_docs):
    assert remove_repeats(no_docs).collect() == []


def test_hot_anchor_is_taken_apart(spark, monkeypatch):
    from cohortlab.llm import substring
    from tests.llm.conftest import PASSAGE, prose

    monkeypatch.setattr(substring, "HOT", 5)
    rows = [(i, f"{prose(100 + i, 20)} {PASSAGE} {prose(200 + i, 20)}", "en") for i in range(30)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows)


def test_fm_index_counts():
    text = [list("abracadabra"), list("barbara"), list("abba")]
    index = FMIndex(text, np.array([0, 1, 2]))
    covered = [{p for a, b in x for p in range(a, b)} for x in index.matched(3)]
    assert covered == [set(), set(), set()]  # no three letters of "barbara" or "abba" stand in an earlier text
    code = {w: i + 1 for i, w in enumerate(dict.fromkeys(x for s in text for x in s))}
    for pattern in ("a", "ab", "bra", "bar", "abba", "ra"):
        lo, hi = np.array([0]), np.array([index.n])
        for c in reversed(pattern):
            lo, hi = index.step(np.array([code[c]]), lo, hi)
        want = sum("".join(s).startswith(pattern, p) for s in text for p in range(len(s)))
        assert int(hi[0] - lo[0]) == want


# --- vectors -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for group in range(30):
        centre = rng.normal(size=24)
        for k in range(8):
            v = centre + rng.normal(size=24) * (0.05 + 0.04 * k)
            rows.append((len(rows), [float(x) for x in v], group))
    rows += [(500, rows[0][1], 0), (501, [2 * x for x in rows[0][1]], 0), (502, None, 0), (503, [], 0), (504, [0.0] * 24, 0)]
    rows += [(505, [float("nan")] * 24, 0), (506, [None] + [1.0] * 23, 0), (507, [1.0, 2.0, 3.0], 0), (508, [1.0, 2.0, 3.1], 0), (None, rows[0][1], 0)]
    rows += [(509, [0.5, -1.5], 0), (509, [0.5, -1.5], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")


def test_vectors_match_brute_force(vectors):
    rows, table = vectors
    good = {}
    for i, (v, x, _) in enumerate(rows):
        if v is not None and x and None not in x and np.isfinite(x).all() and np.any(x):
            good[i] = np.array(x) / np.linalg.norm(x)
    links = [(i, j) for i in good for j in good if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.95]
    low = components([rows[i][0] for i in good], [(rows[i][0], rows[j][0]) for i, j in links])
    want = []
    for i, (v, _, _) in enumerate(rows):
        c = low.get(v, v) if i in good else v
        want.append((v, sum(a == i for a, _ in links), c, v is None or c == v))
    got = embedding_dedup.near_vectors(table).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_large_buckets_meet_in_parts(vectors, monkeypatch):
    rows, table = vectors
    want = sorted(map(tuple, embedding_dedup.near_vectors(table).collect()), key=str)
    monkeypatch.setattr(embedding_dedup, "PART", 2)
    assert sorted(map(tuple, embedding_dedup.near_vectors(table).collect()), key=str) == want


def test_vectors_of_nothing(vectors):
    assert embedding_dedup.near_vectors(vectors[1].limit(0)).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * z
    met = np.zeros(len(a), bool)
    for t in range(embedding_dedup.TABLES):
        ca, cb = embedding_dedup.buckets(a, t), embedding_dedup.buckets(b, t)
        met |= (ca[:, :1] == cb).any(1) | (ca == cb[:, :1]).any(1)
    assert met.mean() > 0.99


# --- licenses ------------------------------------------------------------------------------------------------


def license_shares(text):
    """Of each template the share of its word triples in any stretch of s + 1 triples, and in any of 2 s (s: the next power of two)."""
    def triples(t):
        w = re.findall(r"(?:[a-z0-9]|[^\W_\x00-\x7f])+", t.lower())
        return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]

    have, out = triples(text or ""), {}
    for name, template in license_scan.TEMPLATES.items():
        want, scale = triples(template), 4
        while scale < len(want):
            scale *= 2
        want = set(want)

        def best(n, want=want):
            return max((len(want & set(have[i : i + n])) / len(want) for i in range(max(1, len(have) - n + 1))), default=0.0)

        out[name] = best(scale + 1), best(2 * scale)
    return out


def test_licenses_against_raw_words(spark, docs, rows):
    planted = [(1000 + i, f"{prose(i, 20 + 7 * i)} {t} {prose(i + 50, 30)}") for i, t in enumerate(license_scan.TEMPLATES.values())]
    planted += [(2000, " ".join(license_scan.TEMPLATES["mit-notice"].split()[:55])), (2001, license_scan.TEMPLATES["mit-notice"].replace("software", "thing", 1))]
    texts = [(i, t) for i, t, _ in rows if i is not None and len(t or "") < 5000] + planted
    got = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, {})[r.license_id] = r.containment
    for i, t in texts:
        shares, mine = license_shares(t), found.get(i, {})
        assert all(shares[n][1] >= license_scan.CONTAINMENT for n in mine), (i, mine)
        families = {license_scan.family_of(n) for n in mine}
        must = {n for n, (run, _) in shares.items() if run >= license_scan.CONTAINMENT}
        assert {license_scan.family_of(n) for n in must} <= families, (i, must)
    assert all(set(found[1000 + i]) >= {n} for i, n in enumerate(license_scan.TEMPLATES))
    assert "apache-2.0-line" in found[17]


def test_near_relatives_are_told_apart(spark):
    names = [n for n in license_scan.TEMPLATES if license_scan.family_of(n) == "gpl"]
    rows = [(i, f"{prose(i, 30)} {license_scan.TEMPLATES[n]} {prose(i + 9, 30)}") for i, n in enumerate(names)]
    both = f"{license_scan.TEMPLATES['gpl-3.0-header']} {prose(3, 200)} {license_scan.TEMPLATES['lgpl-3.0-header']}"
    got = license_scan.scan_licenses(spark.createDataFrame([*rows, (99, both)], "doc_id long, text string")).collect()
    for i, n in enumerate(names):
        assert {r.license_id for r in got if r.doc_id == i} == {n}
    assert {r.license_id for r in got if r.doc_id == 99} == {"gpl-3.0-header", "lgpl-3.0-header"}


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("own-1.0", "You may do with this text whatever the owner of the text allows."), (None, "x"), ("empty", None)], "license_id string, text string")
    templates = license_scan.template_table(table)
    assert list(templates) == ["own-1.0"]
    docs = spark.createDataFrame([(1, "Note. you may do with THIS text, whatever the owner of the text allows!"), (2, "nothing of that")], "doc_id long, text string")
    assert [(r.doc_id, r.license_id) for r in license_scan.scan_licenses(docs, templates=templates).collect()] == [(1, "own-1.0")]
    with pytest.raises(ValueError, match="more than 0"):
        license_scan.template_table(table, limit=0)


def test_all_templates_are_found_inside_long_texts(spark):
    rows = [(i, f"{prose(i, 37 * i % 90)}\n{text}\n{prose(i + 50, 45)}") for i, text in enumerate(license_scan.TEMPLATES.values())]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(i, n) for i, n in enumerate(license_scan.TEMPLATES)} <= {(r.doc_id, r.license_id) for r in got if r.containment == 1.0}


def test_licenses_of_nothing(no_docs):
    assert license_scan.scan_licenses(no_docs).collect() == []


def test_saved_tables_read_back(docs):
    assert save(docs, "test").count() == docs.count()
