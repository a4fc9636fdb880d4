"""Encoding, packing, sharding, quality, toxicity and archives against brute force, round trips and held-out accuracy."""

import hashlib
import io
import random
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortlab.llm import bpe, packing, quality, sharding, toxicity, warc
from cohortlab.llm.common import WordHashes, scratch_path
from cohortlab.llm.wordbpe import WordEncoder
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# --- encoding ------------------------------------------------------------------------------------------------


def test_encode_and_decode_match_the_library(docs, rows, library):
    got = bpe.decode(bpe.encode(docs)).collect()
    want = [(i, ids_of(library, t)) for i, t, _ in rows]
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in got)
    both = bpe.encode(docs, decoded=True).collect()
    assert sorted(map(str, both)) == sorted(map(str, got))


def test_encode_of_nothing(no_docs):
    assert bpe.decode(bpe.encode(no_docs)).collect() == []


def test_words_of_odd_characters(library):
    encoder = WordEncoder(packing.default_vocabulary())
    rng = random.Random(5)
    pools = ["abz'sTRvemlld ", "áéÉßſıİŸ½²ªº \t\n\x0b\x85\xa0 ", "日本語ไทยहिन्दी́̈‍", "<|endoftext|><|startoftext|>", "0123456789#!?€☃😀"]
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(pools)) if rng.random() < 0.97 else "<|endoftext|>" for _ in range(rng.randrange(40)))
        assert list(np.frombuffer(encoder.encode_texts([text])[0], "<u4")) == ids_of(library, text), repr(text)


# --- packing -------------------------------------------------------------------------------------------------


def check_pieces(pieces, rows, library, length):
    docs = Counter()
    spots = {}
    for p in pieces:
        assert 0 < p["length"] <= length and p["offset"] + p["length"] <= length
        spots.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        docs[p["doc_id"], p["doc_tokens"]] += p["length"]
    for s, parts in spots.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or s == max(spots)
    want = Counter()
    for i, t, _ in rows:
        n = len(ids_of(library, t)) + 1
        want[i, n] += n
    assert docs == want


@pytest.mark.parametrize("length", [64, 4096])
def test_pieces_cover_every_document_once(docs, rows, library, length):
    pieces = [r.asDict() for r in packing.pack(docs, length=length, with_ids=True).collect()]
    check_pieces(pieces, rows, library, length)
    known = {i: np.array([*ids_of(library, t), 2], "<u4") for i, t, _ in rows if i is not None}
    for p in pieces:
        ids = np.array(p["ids"], "<u4")
        assert zlib.crc32(ids.tobytes()) == p["ids_crc32"] and len(ids) == p["length"]
        if p["doc_id"] is not None:
            assert (known[p["doc_id"]][p["start"] : p["start"] + p["length"]] == ids).all()


def test_more_partitions_than_written_files(spark, library):
    rows = [(i, prose(i, 5 + i % 40), None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(60)
    check_pieces([r.asDict() for r in packing.pack(docs, length=256).collect()], rows, library, 256)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, v in (("spark.sql.shuffle.partitions", "50"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
            spark.conf.set(k, v)
        got = sharding.shard_documents(docs, shards=7).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 7, i // 7) for i in range(300))


def test_whole_sequences(docs):
    pieces = packing.pack(docs, length=128, with_ids=True).cache()
    got = packing.sequences(pieces, length=128).collect()
    assert sum(r.n_tokens for r in got) == sum(r.length for r in pieces.collect())
    assert all(len(r.ids) == 128 for r in got) and sum(r.n_tokens < 128 for r in got) <= 1


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs).collect() == []


# --- sharding ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation_and_its_inverse(n):
    rows = np.arange(n)
    p = sharding.permute(rows, n)
    assert sorted(p) == list(rows) and (sharding.permute(p, n, inverse=True) == rows).all()
    shard, slot = sharding.locate(n - 1, n, shards=5)
    assert sharding.row_at(shard, slot, n, shards=5) == n - 1


def test_shards(docs, rows):
    got = sharding.shard_documents(docs, shards=4).collect()
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    again = sharding.shard_documents(docs.repartition(7), shards=4).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))  # files and partitions don't matter
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    for number, r in enumerate(order):  # computable from the row number, but for rows that repeat
        if sum(x[:3] == r[:3] for x in got) == 1:
            assert sharding.locate(number, len(got), 4) == (r.shard, r.slot)


def test_shards_of_nothing(no_docs):
    assert sharding.shard_documents(no_docs).collect() == []


# --- quality -------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = text.encode().split()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(grams)
    hit = {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text),
        dup,
        len(hit),
        len(words) < 20 or 100 * len(hit) > 30 * len(words),
    )


def test_base_statistics(docs, rows):
    got = quality.quality_rules(docs).collect()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = sorted(((i, *brute_quality(t)) for i, t, _ in rows), key=str)
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_junk_goes_and_prose_stays(spark):
    clean = [(i, ". ".join(prose(i * 7 + k, 12).capitalize() for k in range(9)) + ".", "en") for i in range(40)]
    junk = [(100, " | ".join(prose(5, 80).split()), "en"), (101, prose(6, 90).upper().replace(" ", "!! "), "en"), (102, " ".join(w + "$$$" for w in prose(8, 90).split()), None)]
    got = quality.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {100, 101, 102}
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.keep_sound(docs).collect()} == {i for i, _, _ in clean}


def test_distance_against_the_formula():
    p, q = np.array([[3.0, 1.0, 0.0]]), np.array([[1.0, 1.0, 2.0]])
    a, b = p[0] / 4, q[0] / 4
    m = (a + b) / 2
    want = 0.5 * sum(x * np.log2(x / y) for x, y in zip(a, m) if x) + 0.5 * sum(x * np.log2(x / y) for x, y in zip(b, m) if x)
    assert abs(quality.distance(p, q)[0] - want**0.5) < 1e-12


def test_quality_of_nothing(no_docs):
    assert quality.quality_rules(no_docs).collect() == [] and quality.keep_sound(no_docs).collect() == []


def test_repeated_words_of_short_and_periodic_texts():
    hashes = WordHashes()
    assert quality.repeated_words(hashes.of([b"a"] * 8)) == 0
    assert quality.repeated_words(hashes.of([b"a"] * 9)) == 9
    assert quality.repeated_words(hashes.of([])) == 0


# --- toxicity ------------------------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("1D10T! іdiоt id­iot") == ["idiot", "idiot", "idiot"]
    assert toxicity.fold(None) == [] and toxicity.fold(" .,") == []


def labelled(spark, n=900):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = prose(i, 40).split()
        if toxic:
            for w in rng.sample(["vilescum", "grublord", "v1lescum"], 2):
                words.insert(rng.randrange(40), w)
        elif rng.random() < 0.2:
            words.insert(5, "vilescum")
            words.insert(6, "remover")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "a grublord and a vilescum grublord")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_and_exceptions(spark):
    docs, labels, truth = labelled(spark)
    lexicon = toxicity.fit(docs, labels)
    got = toxicity.score(docs, lexicon).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].predicted == 1 and by_id[900].predicted == by_id[901].predicted == 0
    assert any("remover" in p for p in lexicon.exceptions)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels, truth = labelled(spark, 300)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in truth.items()]
    other = spark.createDataFrame(flipped, "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, other)


def test_toxicity_without_labels_or_rows(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    assert toxicity.score(no_docs, toxicity.Lexicon()).collect() == []


# --- archives ------------------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a.example/", "<p>short</p>"),
    (2, "http://b.example/x y\n", "<p>short</p>"),
    (5, "http://c.example/", "<html>" + "same " * 40),
    (3, None, "<html>" + "same " * 40),
    (9, "http://d.example/", "<html>" + "same " * 40),
    (4, "http://e.example/", None),
    (6, "http://f.example/", ""),
    (7, "http://g.example/", "ü\r\n\r\nWARC/1.1\r\n" * 9000),
    (None, "http://h.example/", "<html>" + "same " * 40),
    (8, "http://i.example/", "x" * 100),
    (8, "http://i.example/", "x" * 100),
    (10, "http://j.example/", "x" * 99),
    (11, "http://j.example/", "x" * 99),
]


def test_records_round_trip(spark):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string")
    manifest = warc.write_packages(pages, scratch_path(spark, "warc-test"), package_bytes=2000)
    got = warc.read_packages(manifest).collect()
    assert manifest.count() > 1 and len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and first[h] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None, None if revisit else raw))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    out = [tuple(bytes(r[n]) if isinstance(r[n], bytearray) else r[n] for n in names) for r in got]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_archives_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, pages).collect() == []


@pytest.mark.parametrize("zip64", [False, True])
def test_directories(monkeypatch, zip64):
    if zip64:  # the writer then uses ZIP64 records for what would fit the short ones
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    members = {"a/data": b"0123456789" * 50, "b/ü": b"xyz" * 30, "c": b""}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            z.writestr(name, data)
        z.writestr("packed", b"p" * 500, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    raw = out.getvalue()
    assert (b"PK\x06\x06" in raw) == zip64
    directory = warc.ZipDirectory(lambda at, n: raw[at : at + n], len(raw))
    for name, data in members.items():
        at, n = directory.stored(name)
        assert raw[at : at + n] == data
    with pytest.raises(ValueError):
        directory.stored("packed")


def test_archive_without_an_index_is_scanned(spark, tmp_path):
    records = [warc.record(i, "http://x.example/", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), "response", None) for i in range(50)]
    packed = b"".join(map(_gzip, records))
    path = tmp_path / "plain.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/other.warc.gz", packed)
    got = warc.read_packages(spark.createDataFrame([(str(path),)], "path string")).collect()
    assert {(r.page_id, bytes(r.payload)) for r in got} == {(i, b"payload %d" % i) for i in range(50)}


def _gzip(raw):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def test_damaged_payloads_are_noticed():
    raw = warc.record(1, None, b"abc", hashlib.sha256(b"abc").hexdigest(), "response", None)
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
