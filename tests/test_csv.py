"""CSV against hand-written rows and against pandas, in both directions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.sources import csv_io

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType()), T.StructField("n", T.IntegerType())])

#: name of the file -> its text
FILES = {
    "quotes.csv": 'id,note,n\n1,"say ""hi"", ok",10\n2,"a,b",11\n3,plain "inner" quote,12\n',
    "breaks.csv": 'id,note,n\n4,"two\nlines",13\n5,"crlf\r\ninside, and ""quotes""",14\n6,after,15\n',
    "short.csv": "id,note,n\n7,seven\n8\n9,nine,16,extra\n10,ten,17\n",
    "tokens.csv": 'id,note,n\n11,NA,\n12, NA,18\n13,"",nan\n14,null,1e2\n15,"NA",2.5\n16,  padded  ,19\n',
}
WANT = {
    1: ('say "hi", ok', 10), 2: ("a,b", 11), 3: ('plain "inner" quote', 12), 4: ("two\nlines", 13), 5: ('crlf\r\ninside, and "quotes"', 14), 6: ("after", 15),
    7: ("seven", None), 8: (None, None), 9: ("nine", 16), 10: ("ten", 17),
    11: (None, None), 12: (" NA", 18), 13: (None, None), 14: (None, 100), 15: (None, None), 16: ("  padded  ", 19),
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


def test_hand_written_rows(spark, folder):
    got = {r.id: (r.note, r.n) for r in csv_io.read_survey(spark, folder, SCHEMA).collect()}
    assert got == WANT


def test_line_breaks_told_or_found_give_the_same(spark, folder):
    told = csv_io.read_survey(spark, folder, SCHEMA, line_breaks=True)
    assert sorted(map(str, told.collect())) == sorted(map(str, csv_io.read_survey(spark, folder, SCHEMA).collect()))
    broken = {r.file.rsplit("/", 1)[1] for r in csv_io.files_with_breaks(spark, folder).collect()}
    assert broken == {"breaks.csv"}


def test_malformed_rows_by_file(spark, folder):
    got = {r.file.rsplit("/", 1)[1]: (r.rows, r.malformed, r.cut_short) for r in csv_io.malformed_rows(spark, folder).collect()}
    assert got == {"quotes.csv": (3, 0, 0), "breaks.csv": (3, 0, 0), "short.csv": (4, 3, 2), "tokens.csv": (6, 0, 0)}
    text = {r[csv_io.MALFORMED] for r in csv_io.read_csv_strings(spark, folder).where(F.col(csv_io.MALFORMED).isNotNull()).collect()}
    assert {t.strip() for t in text} == {"7,seven", "8", "9,nine,16,extra"}


def test_cast_failures_of_hand_written_rows(spark, folder):
    got = {r.feature: r.failures for r in csv_io.cast_failures(spark, folder, SCHEMA).collect()}
    assert got == {"id": 0, "note": 0, "n": 1}  # 2.5 is no whole number


def test_reads_what_pandas_reads(spark, folder):
    for name in ("quotes.csv", "breaks.csv", "tokens.csv"):
        frame = pd.read_csv(f"{folder}/{name}", dtype=str)
        want = [tuple(None if pd.isna(x) else x for x in row) for row in frame.itertuples(index=False)]
        raw = csv_io.read_csv_strings(spark, f"{folder}/{name}").drop(csv_io.MALFORMED)
        got = [tuple(r) for r in raw.select(*[csv_io.null_tokens(F.col(c)).alias(c) for c in raw.columns]).collect()]
        assert got == want, name


TEXTS = ['say "hi"', "a,b", "two\nlines", " padded ", '"', '""', "back\\slash", 'mixed, "x"\n,"y"', "tab\there", "é日本", ",", "end\n", "\nstart", "a\r\nb"]


def test_written_file_is_read_by_pandas(spark, tmp_path):
    frame = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "id int, note string").repartition(3)
    csv_io.write_csv(frame, str(tmp_path / "one.csv"), single_file=True, order_by=["id"])
    assert (tmp_path / "one.csv").is_file() and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["one.csv"]
    with open(tmp_path / "one.csv", newline="") as f:
        back = pd.read_csv(f, dtype=str)
    assert [None if pd.isna(x) else x for x in back["note"]] == [*TEXTS, None]
    assert list(back["id"]) == [str(i) for i in [*range(len(TEXTS)), 99]]
    with pytest.raises(FileExistsError):
        csv_io.write_csv(frame, str(tmp_path / "one.csv"), mode="error", single_file=True)


def test_file_written_by_pandas_is_read(spark, tmp_path):
    pd.DataFrame({"id": range(len(TEXTS)), "note": TEXTS, "n": 5}).to_csv(tmp_path / "p.csv", index=False)
    got = {r.id: (r.note, r.n) for r in csv_io.read_survey(spark, str(tmp_path / "p.csv"), SCHEMA).collect()}
    assert got == {i: (t, 5) for i, t in enumerate(TEXTS)}


def test_folder_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], SCHEMA).repartition(4)
    csv_io.write_csv(frame, str(tmp_path / "parts"))
    back = csv_io.read_survey(spark, str(tmp_path / "parts"), SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame.collect()))


def test_empty_files(spark, tmp_path):
    csv_io.write_csv(spark.createDataFrame([], SCHEMA), str(tmp_path / "none.csv"), single_file=True)
    assert (tmp_path / "none.csv").read_text().strip() == "id,note,n"
    assert csv_io.read_survey(spark, str(tmp_path / "none.csv"), SCHEMA).collect() == []


def test_missing_and_reordered_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note,n\n1,x,2\n")
    with pytest.raises(KeyError, match="other"):
        csv_io.read_survey(spark, str(tmp_path), T.StructType([T.StructField("other", T.LongType())]))
    (tmp_path / "b.csv").write_text("note,id,n\ny,2,3\n")
    with pytest.raises(Exception, match="header"):
        csv_io.read_survey(spark, str(tmp_path), SCHEMA).collect()
