r"""Substring deduplication: passages that an earlier document has go, found with compressed FM-indexes per shard.

Words are ``[^\x20\x09-\x0D]+``; a window is ``WINDOW`` consecutive words.  A word goes if a window that covers it also starts in a
document with a smaller id (windows are judged on the input).  Kept words are joined by one space.

1. Documents are dealt to blocks by a hash of their id, packed and compressed; the texts move once for finding and once for cutting.
2. Seeds: the smallest hash of the 4-word runs in a window is the window's anchor, so equal windows have equal anchors wherever they
   stand.  Blocks send their distinct anchors, shortened to 32 bits and packed, to the anchor's home partition, which answers
   with those that two documents or more have (a shortened anchor can only add candidates).  Copies of a whole text are
   found by a key of the text beforehand: they go as a whole and send nothing.
3. Segments: runs of windows with one shared anchor.  Equal segments are merged map-side first; segments of an anchor with very many
   different segments are taken apart into single windows, so that no anchor, however common, fills a shard.
4. Shards, by anchor: an FM-index (suffix order, BWT, wavelet matrix) over the shard's distinct segments; backward search computes the
   matching statistics of each segment against those of earlier documents and reports intervals of ``WINDOW`` words or more.
   Shards have a bounded size and grow in number with the corpus.
5. Intervals go back to the occurrences and are cut out of the texts.

Null and empty texts have no words.  A row with a null id is neither cut nor a source of cuts.  Rows that share an id are one document: none is
cut for the other's sake.  Very long texts are ordinary.  An empty table gives no row.  Columns other than id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.broadcast import broadcast_if_small
from cohortlab.llm.bpe import balanced_keys
from cohortlab.llm.common import WordHashes, discard, measured_broadcasts, save, small_batches, split_words, window_hashes
from cohortlab.llm.fm_index import FMIndex
from cohortlab.session import shuffle_partitions

WINDOW, SEED = 13, 4
#: Windows of one segment, words of one shard, and different segments of an anchor beyond which windows stand alone.
SEGMENT_WINDOWS, SHARD_WORDS, HOT = 32, 300_000, 2_000
#: Bytes of text a task gathers before it packs them.
BUFFER = 16 << 20

CHUNK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("texts", pa.binary())])
SENT = pa.schema([("home", pa.int64()), ("block", pa.int64()), ("values", pa.binary()), ("twice", pa.binary())])
OCCURRENCE = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("anchor", pa.int64()), ("words", pa.string())]
)
RESULT = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _row(words: list[bytes]) -> int:
    """Tells rows of one id apart."""
    return int.from_bytes(_key(words)[:8], "little", signed=True)


def _keys(batches):
    for batch in batches:
        words = [split_words(t) for t in batch.column(1).to_pylist()]
        n = pa.array([len(w) for w in words], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), n, pa.array([_key(w) for w in words], pa.binary()), pa.array([_row(w) for w in words], pa.int64())],
            names=["doc_id", "n_words", "key", "row"],
        )


def _chunks(batches):
    pack = zstandard.ZstdCompressor(level=3)
    held: dict[int, tuple[list, list, list]] = {}
    size = 0

    def flush():
        for block, (ids, tags, texts) in held.items():
            row = {"block": block, "ids": ids, "tags": tags, "lengths": [len(t) for t in texts], "texts": pack.compress(b"".join(texts))}
            yield pa.RecordBatch.from_pylist([row], CHUNK)
        held.clear()

    for batch in batches:
        for block, doc, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            ids, tags, texts = held.setdefault(block, ([], [], []))
            ids.append(doc), tags.append(tag), texts.append(raw)
            size += len(raw)
        if size >= BUFFER:
            yield from flush()
            size = 0
    yield from flush()


def _unpack(chunks: pa.Table):
    unpack = zstandard.ZstdDecompressor()
    for row in chunks.to_pylist():
        raw, at = unpack.decompress(row["texts"]), 0
        for doc, tag, n in zip(row["ids"], row["tags"], row["lengths"], strict=True):
            yield doc, tag, raw[at : at + n]
            at += n


def blocks_of(docs: DataFrame, id_col: str, text_col: str, tag: Column | None = None) -> DataFrame:
    """Packed documents, one shuffle partition per block; a document's block depends on its id alone."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    keys = F.array(*[F.lit(k).cast("long") for k in balanced_keys(spark, n)])
    doc = F.col(id_col).cast("long")
    block = F.get(keys, F.pmod(F.xxhash64(doc), F.lit(n)).cast("int"))
    tag = F.lit(0) if tag is None else tag
    rows = docs.select(block.alias("block"), doc.alias("doc_id"), tag.cast("long").alias("tag"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_chunks, "block long, ids array<long>, tags array<long>, lengths array<long>, texts binary").repartition(n, "block")


def anchors(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor over concatenated documents: (anchor, first window, windows) of each run."""
    grams = window_hashes(h, SEED)
    width = WINDOW - SEED + 1
    least, have = grams, 1
    while have < width:
        shift = min(have, width - have)
        least = np.minimum(least[:-shift], least[shift:])
        have += shift
    starts = np.cumsum(sizes) - sizes
    number = np.maximum(sizes - WINDOW + 1, 0)
    total = int(number.sum())
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(total) + np.repeat(starts - (np.cumsum(number) - number), number)
    value = least[at]
    doc = np.repeat(np.arange(len(sizes)), number)
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]))
    return value[new], at[new], np.diff(np.concatenate([new, [total]]))


def _runs(documents, hashes: WordHashes, skip: set):
    """Documents in groups: (docs, words of each, offsets, anchor runs); ``skip`` holds copies by (id, row)."""
    docs, words, size = [], [], 0

    def group():
        sizes = np.array([len(w) for w in words], np.int64)
        flat = [x for w in words for x in w]
        return docs, words, flat, sizes, anchors(hashes.of(flat), sizes)

    for doc, _, raw in documents:
        w = raw.split()
        if doc is None or len(w) < WINDOW or (skip and (doc, _row(w)) in skip):
            continue
        docs.append(doc), words.append(w)
        size += len(w)
        if size >= 100_000:
            yield group()
            docs, words, size = [], [], 0
    if docs:
        yield group()


def _skips(table: pa.Table) -> set:
    rows = table.filter(pa.compute.equal(table["what"], "copy")).to_pydict()
    return set(zip(rows["doc_id"], rows["row"], strict=True))


def _short(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Home partition and shortened value of anchors."""
    return (values % np.uint64(n)).astype(np.int64), (values // np.uint64(n) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as compressed differences."""
    return zstandard.ZstdCompressor(level=3).compress(np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) if len(values) else b""


def _unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint32)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4")[:, 0], dtype=np.uint32)


def _send(chunks: pa.Table, copies: pa.Table, keys: list[int]) -> pa.Table:
    """Distinct anchors of a block by home; ``twice`` are those that two of its documents have."""
    if not len(chunks):
        return SENT.empty_table()
    block, hashes, values, docs = chunks["block"][0].as_py(), WordHashes(), [], []
    ids: dict[int, int] = {}
    for some, _, _, sizes, (value, at, _) in _runs(_unpack(chunks), hashes, _skips(copies)):
        numbers = np.array([ids.setdefault(d, len(ids)) for d in some], np.int64)
        values.append(value)
        docs.append(numbers[np.searchsorted(np.cumsum(sizes), at, side="right")])
    if not values:
        return SENT.empty_table()
    value, doc = np.concatenate(values), np.concatenate(docs)
    home, short = _short(value, len(keys))
    order = np.lexsort((doc, short, home))
    home, short, doc = home[order], short[order], doc[order]
    first = np.concatenate([[True], (home[1:] != home[:-1]) | (short[1:] != short[:-1])])
    begin = np.flatnonzero(first)
    several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
    home, short = home[begin], short[begin]
    rows = []
    for p in np.unique(home):
        mine = home == p
        rows.append({"home": keys[p], "block": block, "values": _pack(short[mine]), "twice": _pack(short[mine & several])})
    return pa.Table.from_pylist(rows, SENT)


def _shared(batches):
    """Per home: which anchors two documents have; the answer to each block, packed."""
    homes: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            homes.setdefault(row["home"], []).append(row)
    for rows in homes.values():
        each = [_unpacked(r["values"]) for r in rows]
        value, count = np.unique(np.concatenate(each), return_counts=True)
        hits = np.union1d(value[count > 1], np.concatenate([_unpacked(r["twice"]) for r in rows]))
        out = [{"home": r["home"], "block": r["block"], "values": _pack(x[np.isin(x, hits, assume_unique=True)]), "twice": b""} for r, x in zip(rows, each, strict=True)]
        yield pa.RecordBatch.from_pylist([x for x in out if x["values"]], SENT)


def _occurrences(chunks: pa.Table, answers: pa.Table, keys: list[int]) -> pa.Table:
    """Segments of a block whose anchors are shared."""
    if not len(chunks):
        return OCCURRENCE.empty_table()
    block, hashes = chunks["block"][0].as_py(), WordHashes()
    number = {k: i for i, k in enumerate(keys)}
    flagged: list[np.ndarray] = [np.empty(0, np.uint64)]
    rows = answers.filter(pa.compute.equal(answers["what"], "anchors")).select(["home", "values"]).to_pylist()
    for r in rows:  # home and value in one number, as below
        flagged.append(_unpacked(r["values"]).astype(np.uint64) | np.uint64(number[r["home"]]) << np.uint64(32))
    hits = np.unique(np.concatenate(flagged))
    out: dict[str, list] = {k: [] for k in OCCURRENCE.names}
    for docs, words, flat, sizes, (value, at, length) in _runs(_unpack(chunks), hashes, _skips(answers)):
        home, short = _short(value, len(keys))
        ok = np.flatnonzero(np.isin(short.astype(np.uint64) | home.astype(np.uint64) << np.uint64(32), hits))
        if not len(ok):
            continue
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, at[ok], side="right")
        own = {int(i): _row(words[i]) for i in np.unique(doc)}
        for i, v, a, n in zip(doc.tolist(), value[ok].view(np.int64).tolist(), at[ok].tolist(), length[ok].tolist(), strict=True):
            begin = a - int(ends[i] - sizes[i])
            for k in range(0, n, SEGMENT_WINDOWS):
                stop = min(n, k + SEGMENT_WINDOWS) + WINDOW - 1
                out["block"].append(block), out["doc_id"].append(docs[i]), out["row"].append(own[i]), out["start"].append(begin + k), out["anchor"].append(v)
                out["words"].append(b" ".join(flat[a + k : a + stop]).decode("utf-8", "surrogatepass"))
    return pa.Table.from_pydict(out, OCCURRENCE)


def _search(shard: pa.Table) -> pa.Table:
    """Matching statistics of a shard's segments against those of earlier documents."""
    words = [w.split(" ") for w in shard["words"].to_pylist()]
    found = FMIndex(words, shard["first"].to_numpy()).matched(WINDOW)
    flat = [[x for ab in f for x in ab] for f in found]
    return pa.Table.from_arrays([shard["key"], shard["first"], pa.array(flat, pa.list_(pa.int64()))], names=["key", "first", "cuts"])


def _cut(chunks: pa.Table, cuts: pa.Table) -> pa.Table:
    out: dict[str, list] = {k: [] for k in RESULT.names}
    by: dict[tuple, list] = {}
    for doc, row, a, b in zip(*(cuts[c].to_pylist() for c in ("doc_id", "row", "a", "b")), strict=True):
        by.setdefault((doc, row), []).append((a, b))
    touched = {doc for doc, _ in by}
    for doc, tag, raw in _unpack(chunks):
        words = raw.split()
        spans = by.get((doc, _row(words))) if doc in touched else None
        kept = words
        if spans:
            gone = np.zeros(len(words) + 1, np.int64)
            for a, b in spans:
                gone[a] += 1
                gone[b] -= 1
            stay = np.cumsum(gone[:-1]) == 0
            kept = [words[i] for i in np.flatnonzero(stay)]
        out["doc_id"].append(doc), out["tag"].append(tag), out["n_words"].append(len(words)), out["n_removed"].append(len(words) - len(kept))
        out["kept_text"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
    return pa.Table.from_pydict(out, RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """``doc_id, tag, n_words, n_removed, kept_text`` of every row; ``tag`` (a long of the caller's) tells the caller's rows apart."""
    spark = docs.sparkSession
    small_batches(spark)
    n = shuffle_partitions(spark)
    keys = balanced_keys(spark, n)
    block_of = F.get(F.array(*[F.lit(k).cast("long") for k in keys]), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = save(rows.mapInArrow(_keys, "doc_id long, n_words long, key binary, row long"), "substring-keys")
    texts = texts.where(f"doc_id is not null and n_words >= {WINDOW}")
    firsts = texts.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    with measured_broadcasts(spark):
        copies = save(texts.join(firsts, "key").where("doc_id > first").select(block_of.alias("block"), "doc_id", "row", "n_words").distinct(), "substring-copies")

    blocks = blocks_of(docs, id_col, text_col, tag)
    none = F.lit(None)
    copy_rows = copies.select("block", F.lit("copy").alias("what"), "doc_id", "row", none.cast("long").alias("home"), none.cast("binary").alias("values"))
    sent = blocks.groupBy("block").cogroup(copy_rows.groupBy("block")).applyInArrow(
        lambda left, right: _send(left, right, keys), "home long, block long, values binary, twice binary"
    )
    answers = sent.repartition(n, "home").mapInArrow(_shared, "home long, block long, values binary, twice binary")
    told = copy_rows.unionByName(
        answers.select("block", F.lit("anchors").alias("what"), none.cast("long").alias("doc_id"), none.cast("long").alias("row"), "home", "values")
    )
    occurrences = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        lambda left, right: _occurrences(left, right, keys), "block long, doc_id long, row long, start long, anchor long, words string"
    )
    seen = save(occurrences, "substring-segments")

    distinct = save(seen.groupBy("words", "anchor").agg(F.min("doc_id").alias("first")), "substring-distinct")
    hot = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot"))
    hot = broadcast_if_small(save(hot, "substring-hot"))

    def parts(table: DataFrame) -> DataFrame:
        """Segments as they are, those of hot anchors as single windows."""
        marked = table.withColumn("key", F.unhex(F.md5("words"))).join(hot, "anchor", "left")
        words = F.split("words", " ")
        single = marked.where("hot").withColumn("w", words).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - WINDOW)))
        window = F.concat_ws(" ", F.slice("w", F.col("i") + 1, WINDOW))
        single = single.withColumn("words", window).withColumn("key", F.unhex(F.md5("words"))).withColumn("offset", F.col("i").cast("long"))
        return marked.where("hot is null").withColumn("offset", F.lit(0).cast("long")).unionByName(single.drop("w", "i")).withColumn("hot", F.coalesce("hot", F.lit(False)))

    whole = parts(distinct)
    indexed = whole.where("not hot").select("key", "anchor", "first", "words").unionByName(
        whole.where("hot").groupBy("key").agg(F.xxhash64("key").alias("anchor"), F.min("first").alias("first"), F.first("words").alias("words"))
    )
    size = distinct.agg(F.sum(F.size(F.split("words", " "))).alias("n")).first()["n"] or 0
    shards = max(n, -(-size // SHARD_WORDS))
    searched = indexed.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(_search, "key binary, first long, cuts array<long>")
    searched = save(searched, "substring-found")
    discard(distinct)

    spots = parts(seen).select("block", "doc_id", "row", (F.col("start") + F.col("offset")).alias("start"), F.size(F.split("words", " ")).alias("n"), "key")
    spots = spots.join(searched.hint("merge"), "key")  # windows of hot anchors are exploded rows: no broadcast by an estimate
    pairs = F.transform(F.sequence(F.lit(0), F.expr("cast(size(cuts) div 2 as int)") - 1), lambda i: F.struct(F.get("cuts", (2 * i).cast("int")).alias("a"), F.get("cuts", (2 * i + 1).cast("int")).alias("b")))
    whole_segment = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b")))
    spans = F.when(F.col("doc_id") > F.col("first"), whole_segment).when(F.size("cuts") > 0, pairs)
    cuts = spots.select("block", "doc_id", "row", "start", F.explode(spans).alias("s")).select(
        "block", "doc_id", "row", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b")
    )
    cuts = cuts.unionByName(copies.select("block", "doc_id", "row", F.lit(0).cast("long").alias("a"), F.col("n_words").alias("b")))
    again = blocks_of(docs, id_col, text_col, tag)
    return again.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(_cut, "doc_id long, tag long, n_words long, n_removed long, kept_text string")
