"""BPE encoding over a distinct-word table, decoding through an id-to-piece table.

1. Documents are gathered into blocks: tasks pack runs of documents (about ``CHUNK`` bytes of text, compressed) and deal them evenly over the
   blocks, one shuffle partition each.  The texts move this once; both uses below read the same shuffle.
2. Words: each block's distinct words go to the partition of their hash.  There every distinct word of the corpus is
   encoded once, whichever blocks hold it, and its ids go back to each of these blocks.
3. Join by position: a block splits its texts again, takes the ids of each word from its own part of the table and
   concatenates them in the order of the words.  So the join moves a row per *distinct word of a block*, not per word.
4. Decoding takes the piece of each id from the vocabulary's id-to-piece table (as many rows as the vocabulary, a fixed bound).

Splitting and word encoding are exactly those of the tokenizers library (see ``wordbpe``); special tokens written out in a text are recognised as there.

Null and empty texts have no ids and decode to the empty text.  A null id stays null.  Rows that repeat are encoded each.  Very
long texts are a chunk of their own.  An empty table gives no row.  Columns other than id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import give_back, small_batches
from cohortlab.llm.packing import default_vocabulary
from cohortlab.llm.wordbpe import WordEncoder, id_to_piece
from cohortlab.session import shuffle_partitions

#: Bytes of text in a packed run of documents, and distinct words a task gathers before it hands them on.
CHUNK, WORDS = 1 << 20, 300_000

CHUNKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("texts", pa.binary())])
TABLE = pa.schema([("home", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def balanced_keys(spark: SparkSession, n: int) -> list[int]:
    """Keys k[0..n-1] of which hash partitioning into n parts puts exactly one in each part."""
    rows = spark.range(64 * n + 64).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in sorted(rows, key=lambda r: r["p"])]


def _chunks(batches, keys: list[int]):
    pack, turn = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() * 7919
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0

    def chunk():
        nonlocal ids, texts, size, turn
        row = {"block": keys[turn % len(keys)], "doc_ids": ids, "lengths": [len(t) for t in texts], "texts": pack.compress(b"".join(texts))}
        ids, texts, size, turn = [], [], 0, turn + 1
        return pa.RecordBatch.from_pylist([row], CHUNKS)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            ids.append(doc), texts.append(raw)
            size += len(raw)
            if size >= CHUNK or len(ids) >= 4096:
                yield chunk()
    if ids:
        yield chunk()


def _texts(chunks):
    """Ids and texts of one chunk after the other."""
    unpack = zstandard.ZstdDecompressor()
    for k in range(chunks.num_rows):
        row = chunks.slice(k, 1).to_pylist()[0]
        raw, at, texts = unpack.decompress(row["texts"]), 0, []
        for n in row["lengths"]:
            texts.append(raw[at : at + n].decode("utf-8", "surrogatepass"))
            at += n
        yield row["doc_ids"], texts


def _words(batches, keys: list[int], path: str):
    """Distinct words of the blocks in a partition, by the partition of the word's hash."""
    encoder, pack = WordEncoder(path), zstandard.ZstdCompressor(level=3)
    found: dict[int, set[str]] = {}

    def rows():
        for block, words in found.items():
            parts: dict[int, list[bytes]] = {}
            for w in map(str.encode, words):
                parts.setdefault(xxhash.xxh3_64_intdigest(w) % len(keys), []).append(w)
            some = [{"home": keys[p], "block": block, "words": pack.compress(b"\n".join(sorted(ws)))} for p, ws in parts.items()]
            yield pa.RecordBatch.from_pylist([r | {"counts": b"", "ids": b""} for r in some], TABLE)
        found.clear()

    for batch in batches:
        for block, (_, texts) in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
            words = found.setdefault(block, set())
            for t in texts:
                words.update(encoder.split(t))
        if sum(map(len, found.values())) >= WORDS:
            yield from rows()
    yield from rows()
    give_back()


def _encode_words(batches, path: str):
    """Ids of the words of each row; a word that several blocks hold is encoded once."""
    encoder, pack, unpack = WordEncoder(path), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    known = encoder.cache
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            words = unpack.decompress(row["words"]).decode().split("\n")
            new = [w for w in words if w not in known]
            if len(known) + len(new) > WORDS:
                known.clear()
                new = words
            known.update(zip(new, encoder.encode_words(new), strict=True))
            ids = [known[w] for w in words]
            row["counts"] = pack.compress(np.array([len(x) // 4 for x in ids], "<u4").tobytes())
            row["ids"] = pack.compress(b"".join(ids))
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, TABLE)
    known.clear()
    give_back()


def _join(chunks: pa.Table, table: pa.Table, path: str, schema: pa.Schema) -> pa.Table:
    """Ids of the texts of one block (its words' ids, by position) and, if the schema has it, the decoded text."""
    encoder, unpack = WordEncoder(path), zstandard.ZstdDecompressor()
    pieces = np.array(id_to_piece(path), dtype=object) if "decoded" in schema.names else None
    ids_of: dict[str, bytes] = {}
    for k in range(table.num_rows):
        row = table.slice(k, 1).to_pylist()[0]
        words = unpack.decompress(row["words"]).decode().split("\n")
        ends = np.cumsum(np.frombuffer(unpack.decompress(row["counts"]), "<u4").astype(np.int64)) * 4
        ids, at = unpack.decompress(row["ids"]), 0
        for w, end in zip(words, ends.tolist(), strict=True):
            ids_of[w] = ids[at:end]
            at = end
    get, out = ids_of.__getitem__, []
    for doc_ids, texts in _texts(chunks):  # a batch for each chunk
        flat = [np.frombuffer(b"".join(map(get, encoder.split(t))), "<i4") for t in texts]
        offsets = pa.array(np.cumsum([0, *map(len, flat)], dtype=np.int32))
        columns = [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat)))]
        if pieces is not None:
            columns.append(pa.array([" ".join(pieces[x]) for x in flat], pa.string()))
        out.append(pa.RecordBatch.from_arrays(columns, schema=schema))
    return pa.Table.from_batches(out, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """``doc_id, ids array<int>`` of every row; ``decoded`` adds the text that the ids decode to, in the same task."""
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or default_vocabulary()
    n = shuffle_partitions(spark)
    keys = balanced_keys(spark, n)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = rows.mapInArrow(partial(_chunks, keys=keys), "block long, doc_ids array<long>, lengths array<long>, texts binary")
    blocks = chunks.repartition(n, "block")
    schema = "home long, block long, words binary, counts binary, ids binary"
    words = blocks.mapInArrow(partial(_words, keys=keys, path=path), schema).repartition(n, "home")
    table = words.mapInArrow(partial(_encode_words, path=path), schema)

    shape = pa.schema([*ENCODED, ("decoded", pa.string())]) if decoded else ENCODED

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        return _join(left, right, path, shape)

    columns = "doc_id long, ids array<int>" + (", decoded string" if decoded else "")
    return blocks.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(join, columns)


def _pieces(batches, path: str):
    pieces = np.array(id_to_piece(path), dtype=object)
    for batch in batches:
        ids = batch.column(1)
        flat, at = pieces[ids.flatten().to_numpy(zero_copy_only=False)], 0
        out = []
        for n in ids.value_lengths().fill_null(0).to_pylist():
            out.append(" ".join(flat[at : at + n]))
            at += n
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(out, pa.string())], names=["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: pieces joined by a space, special tokens included, as the library decodes without a decoder."""
    return encoded.select("doc_id", "ids").mapInArrow(
        partial(_pieces, path=vocabulary or default_vocabulary()), "doc_id long, ids array<int>, decoded string"
    )
