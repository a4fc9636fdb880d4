"""Packing by concatenate-and-cut: two-pass prefix sums give every document its global token offset.

Pass one encodes every document once (ids of the vocabulary, then the end id) and writes the packed ids with the partition's number and
the tokens before the document *within its partition*.  The table of partition totals - one row per partition,
whatever the number of documents - is summed up to the offset of each partition.  Pass two adds the two and cuts the
concatenation into windows of ``length`` tokens.  Every piece is a boundary record: where it lies in its document and in its
sequence.  No text and no token is shuffled, only the last sequence is padded, and hot or long documents spread over
as many sequences as they need.

Null and empty texts are documents of the end id alone.  Rows that repeat (even in id) are documents of their own.  A null id
stays null.  An empty table gives no piece.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.broadcast import broadcast_if_small
from cohortlab.llm.common import give_back, save, small_batches
from cohortlab.llm.wordbpe import WordEncoder, id_to_piece

LENGTH, END_ID = 4096, 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode(batches, path: str, end: int):
    encoder, before = WordEncoder(path), 0
    dtype = "<u2" if max(len(id_to_piece(path)), end) < 1 << 16 else "<u4"
    width, tail = np.dtype(dtype).itemsize, np.array([end], dtype).tobytes()
    for batch in batches:
        ids = [x + tail for x in encoder.encode_texts(batch.column(1).to_pylist(), dtype)]
        n = np.array([len(x) // width for x in ids], np.int64)
        starts = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array([width] * len(n), pa.int32()), batch.column(2), pa.array(starts)],
            names=["doc_id", "ids", "doc_tokens", "width", "part", "before"],
        )
    del encoder
    give_back()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids (packed), doc_tokens, width, part, before``, written to the shared folder."""
    small_batches(docs.sparkSession)
    # the partition's number comes from the plan: a task that writes several partitions runs this once for each
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    run = partial(_encode, path=vocabulary or default_vocabulary(), end=end_id)
    return save(rows.mapInArrow(run, "doc_id long, ids binary, doc_tokens long, width int, part int, before long"), "pack-tokens")


def _cut(batches, length: int, with_ids: bool):
    for batch in batches:
        rows = batch.to_pydict()
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        for doc, packed, n, width, at in zip(rows["doc_id"], rows["ids"], rows["doc_tokens"], rows["width"], rows["at"], strict=True):
            ids = np.frombuffer(packed, f"<u{width}").astype("<u4")
            for seq in range(at // length, (at + n - 1) // length + 1):
                a, b = max(at, seq * length), min(at + n, (seq + 1) * length)
                piece = ids[a - at : b - at]
                out["doc_id"].append(doc)
                out["start"].append(a - at)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                out["doc_tokens"].append(n)
                out["sequence_id"].append(seq)
                out["offset"].append(a - seq * length)
                if with_ids:
                    out["ids"].append(piece.astype(np.int32))
        arrays = [pa.array(out[k], pa.int64()) for k in list(out)[:-1]]
        names = list(out)[:-1]
        if with_ids:
            arrays, names = [*arrays, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Boundary records, one per piece; ``with_ids`` adds the piece's token ids."""
    tokens = encode_documents(docs, id_col, text_col, vocabulary, end_id)
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))  # one row per partition of the first pass
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = tokens.join(broadcast_if_small(offsets), "part").select("doc_id", "ids", "doc_tokens", "width", (F.col("base") + F.col("before")).alias("at"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(partial(_cut, length=length, with_ids=with_ids), schema + (", ids array<int>" if with_ids else ""))


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Whole sequences of pieces with ids: ``sequence_id, ids (padded), n_tokens, boundaries`` (at most ``length`` tokens a group)."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return parts.select(
        "sequence_id",
        F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(ids))).alias("ids"),
        F.size(ids).cast("long").alias("n_tokens"),
        F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"))).alias("boundaries"),
    )
