"""Registered queries of the corpus operators (production parameters, whole tables) and their DuckDB twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.bpe import encode
from cohortlab.llm.common import read_table
from cohortlab.llm.embedding_dedup import near_vectors
from cohortlab.llm.license_scan import scan_licenses
from cohortlab.llm.minhash_dedup import near_duplicates
from cohortlab.llm.packing import pack
from cohortlab.llm.periodic_runs import find_runs
from cohortlab.llm.quality import quality_rules
from cohortlab.llm.ranking import fit as fit_ranking
from cohortlab.llm.ranking import score as score_ranking
from cohortlab.llm.sharding import shard_documents
from cohortlab.llm.spelling import group_variants, word_counts
from cohortlab.llm.substring import remove_repeats
from cohortlab.llm.toxicity import fit, score
from cohortlab.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op9_concat_cut_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


@query
def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


@query
def op5_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


@query
def op7_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))


@query
def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, read_table(spark, sf_dir, "pages")).drop("url")


ORACLES["op8_zip_warc"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query
def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = encode(read_table(spark, sf_dir, "documents"), decoded=True)
    return texts.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op6_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op6_fm_index_substrings"] = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM w
), f AS (
  SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN f USING (gram) WHERE doc_id > first_id
), k AS (
  SELECT doc_id, list(pos) AS gone FROM r GROUP BY doc_id
), p AS (
  SELECT d.doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM d JOIN k USING (doc_id)
), s AS (
  SELECT p.doc_id, string_agg(ws[p.pos], ' ' ORDER BY p.pos) AS kept, count(*) AS n_kept
  FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.pos = r.pos WHERE r.pos IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(CASE WHEN k.doc_id IS NULL THEN 0 ELSE len(ws) - coalesce(n_kept, 0) END AS BIGINT) AS n_removed,
       sha256(CASE WHEN k.doc_id IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query
def op2_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


ORACLES["op2_cross_polytope_dedup"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
), c(id, node) AS (
  SELECT vec_id, vec_id FROM e
  UNION
  SELECT c.id, l.b FROM c JOIN l ON l.a = c.node
)
SELECT vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(node) AS component_id, min(node) = vec_id AS kept
FROM e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY vec_id
"""


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op11: one text in ten repeats a part of itself to its end."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


@query
def op11_baier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(read_table(spark, sf_dir, "documents"), prepare=with_period)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # in the order of the runs (start, then period), the first of the greatest exponents stays
    best = F.reduce("runs", F.col("runs")[0], lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"), line.alias("lines"), "kept_text").select(
        "doc_id",
        "n_runs",
        "b.start",
        "b.length",
        "b.period",
        F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("lines", lambda x: F.concat(x, F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_ranking(docs, fit_ranking(docs, read_table(spark, sf_dir, "labels")))


def with_slips(doc_id: int | None, counts: dict[str, int]) -> Iterator[tuple[str, int]]:
    """The words of op13: one word of a text in 199 has lost a letter."""
    seed = zlib.crc32(f"{doc_id}:".encode())
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), seed)
        if h % 199 == 0 and doc_id is not None:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(read_table(spark, sf_dir, "documents"), change=with_slips))


#: CRC-32 of a byte string in SQL: the table of its 256 remainders, and a step a byte.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crc_of
)"""


def _crc(code_list: str) -> str:
    return f"xor(list_reduce({code_list}, lambda c, b: xor(c // 256, crc_of[1 + xor(c % 256, b)]), 4294967295), 4294967295)"


_BYTES = "list_transform(range(strlen({0})), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))"

ORACLES["op11_baier_runs"] = f"""
WITH {_CRC_TABLE}, d0 AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         {_crc(_BYTES.format("CAST(doc_id AS VARCHAR)"))} AS h
  FROM documents, crc_table
), d1 AS (
  SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d0
), d2 AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d1
), d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
         THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws
  FROM d2
), t AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS w FROM d
), m AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n
), s AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS len FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM stretches r WHERE NOT EXISTS (
    SELECT 1 FROM stretches o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.start <= r.start AND o.start + o.len >= r.start + r.len)
), best AS (
  SELECT doc_id, start, len, q, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, start, q) AS place FROM runs
), lists AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || len || ',' || q || chr(10), '' ORDER BY start, q) AS txt FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + q, start + len)) AS i FROM runs
), kept AS (
  SELECT t.doc_id, string_agg(w, ' ' ORDER BY t.i) AS txt FROM t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * len // q AS BIGINT) AS exponent_milli, sha256(coalesce(lists.txt, '')) AS runs_sha256, sha256(coalesce(kept.txt, '')) AS collapsed_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (doc_id) LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_TABLE}, r AS (
  SELECT doc_id, w AS run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w
    FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL
), k AS (
  SELECT doc_id || ':' || run AS id, run, n FROM r
), h AS (
  SELECT run, n, {_crc(_BYTES.format("id"))} AS h FROM k, crc_table
), v AS MATERIALIZED (
  SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS w, n FROM h)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5
), less AS (
  SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM v)
), p AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM less x JOIN less y ON x.rest = y.rest AND x.k = y.k AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM less x JOIN v y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM less x JOIN v y ON x.rest = y.word
), b AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM p
), f AS MATERIALIZED (
  SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN (SELECT * FROM b WHERE place = 1) b USING (word)
), walk(word, node, steps) AS (
  SELECT word, word, 0 FROM f
  UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON f.word = walk.node WHERE f.form IS NOT NULL
)
SELECT f.word, form, arg_max(node, steps) AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word GROUP BY f.word, form, n, n_near, form_n
"""
