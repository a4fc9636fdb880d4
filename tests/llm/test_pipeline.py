"""The pipeline: every stage against what its operator says by itself, and the whole on a small table."""

import corpus_pipeline
from cohortlab.llm import toxicity
from cohortlab.llm.queries import ORACLES, QUERIES
from cohortlab.llm.quality import quality_rules
from tests.llm.conftest import PASSAGE, edited, prose
from tests.llm.test_dedup import brute_near, brute_repeats


def sentences(seed, n=9):
    return ". ".join(prose(seed * 31 + k, 12).capitalize() for k in range(n)) + "."


def tables(spark, tmp_path):
    rows = [(i, sentences(i), "en") for i in range(120)]
    rows += [(200 + i, sentences(i) + " Again here.", "en") for i in range(20)]  # near copies
    rows += [(300 + i, f"{sentences(400 + i)}\n{PASSAGE}\n{sentences(500 + i)}", "en") for i in range(10)]
    rows += [(600 + i, sentences(600 + i).replace(" ", " vilescum ", 6), "en") for i in range(60)]  # toxic
    rows += [(700, " | ".join(prose(5, 80).split()), "en"), (701, None, "en"), (702, "", None), (None, sentences(703), "en"), (705, sentences(705), "en"), (705, sentences(705), "en")]
    data = [(i, t, lang, "src", len(t or "")) for i, t, lang in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(600 <= i < 660)) for i, _, _ in rows if i is not None and i < 700]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return docs, str(tmp_path)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_stages(spark, tmp_path):
    docs, folder = tables(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "substrings", "packing"]

    mild = stages["toxicity"](spark, docs, folder)
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(folder + "/labels.parquet"))).where("predicted = 0")
    assert mild.columns == docs.columns and ids(mild) == ids(scores)
    assert not [i for i in ids(mild) if i is not None and 600 <= i < 660]

    sound = stages["quality"](spark, mild, folder)
    assert sound.columns == docs.columns and ids(sound) == ids(quality_rules(mild).where("kept"))
    assert not {700, 701, 702} & set(ids(sound))

    single = stages["near_duplicates"](spark, sound, folder)
    rows = [(r.doc_id, r.text, r.lang) for r in sound.collect()]
    low = brute_near(rows)
    assert single.columns == docs.columns and ids(single) == sorted((i for i, _, _ in rows if i is None or low[i] == i), key=str)
    assert not [i for i in ids(single) if i is not None and 200 <= i < 220]

    cut = stages["substrings"](spark, single, folder)
    rows = [(r.doc_id, r.text, r.lang) for r in single.collect()]
    want = {(i, kept if n else None) for i, _, n, kept in brute_repeats(rows)}
    text = dict((r.doc_id, r.text) for r in single.collect())
    got = {(r.doc_id, None if r.text == text[r.doc_id] else r.text) for r in cut.collect()}
    assert cut.columns == docs.columns and got == want and cut.count() == single.count()
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    pieces = stages["packing"](spark, cut, folder)
    assert set(ids(pieces)) == set(ids(cut))


def test_run_on_whole_and_empty_tables(spark, tmp_path):
    docs, folder = tables(spark, tmp_path)
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(folder + "/labels.parquet").limit(0).write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_edited_is_an_edit():
    assert edited(PASSAGE, 1, 0.0) == PASSAGE
