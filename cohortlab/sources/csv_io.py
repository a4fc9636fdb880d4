"""Survey CSV in and out (RFC 4180).

Reading: fields may be quoted, a quote inside a quoted field is doubled, and a quoted field may hold delimiters and line breaks.
Every column is read as a string (no inference pass over the data), the usual "no answer" tokens become NULL (as they stand: ``' NA'`` is a
value), then each column is ``try_cast`` to the explicit schema - a bad value gives NULL instead of failing the job, and
``cast_failures`` counts them per column.  A row with too few fields keeps those it has, the others are NULL; of a row with too many
the first ones stay.  Both are kept in ``MALFORMED`` as they stand in the file, and ``malformed_rows`` counts them per file.

A file whose quoted fields hold line breaks cannot be split between tasks.  ``files_with_breaks`` finds those files in one split scan (a
line with an odd number of quotes begins or ends such a field); only they are read whole, all others are split as usual.

A header that has other names or another order than that of the first file raises: columns are never taken by position.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.config import NA_TOKENS
from cohortlab.functions.exprs import require_columns

SURVEY_SCHEMA = T.StructType(
    [
        T.StructField("respondent_id", T.LongType(), False),
        T.StructField("user_type", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("age_group", T.StringType()),
        T.StructField("num_ai_tools_currently_used", T.IntegerType()),
        T.StructField("monthly_spend_on_ai_usd", T.DoubleType()),
        T.StructField("primary_discovery_method", T.StringType()),
        T.StructField("difficulty_finding_tools", T.StringType()),
        T.StructField("trust_concern_frequency", T.StringType()),
        T.StructField("subscription_fatigue", T.StringType()),
        T.StructField("uses_llm_writing_tools", T.IntegerType()),
        T.StructField("uses_image_gen_tools", T.IntegerType()),
        T.StructField("uses_video_gen_tools", T.IntegerType()),
        T.StructField("uses_code_assistant_tools", T.IntegerType()),
        T.StructField("uses_data_analytics_tools", T.IntegerType()),
        T.StructField("uses_voice_audio_tools", T.IntegerType()),
        T.StructField("uses_productivity_tools", T.IntegerType()),
        T.StructField("preferred_subscription_tier", T.StringType()),
        T.StructField("preferred_billing_cadence", T.StringType()),
        T.StructField("bundle_interest", T.StringType()),
        T.StructField("wtp_monthly_usd", T.DoubleType()),
        T.StructField("will_subscribe", T.IntegerType()),
        T.StructField("churn_risk_score", T.DoubleType()),
        T.StructField("estimated_mrr_usd", T.DoubleType()),
    ]
)


#: Column with the text of a row that has too few or too many fields.
MALFORMED = "_malformed"
#: Bytes that are copied at once when parts become one file.
COPIED = 1 << 20
#: Quotes inside quoted fields are doubled, in both directions; blanks belong to the value.
DIALECT = {"sep": ",", "quote": '"', "escape": '"', "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def null_tokens(c: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def _typed(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, (T.IntegerType, T.LongType)):
        # "1.0" and "1e3" are valid integers in exported files; decimals keep every digit, and what is
        # too large for the type is NULL like any other value that does not fit
        number = F.coalesce(c.try_cast("decimal(38,6)"), c.try_cast("double").try_cast("decimal(38,6)"))
        return F.when(number == F.floor(number), number.try_cast(dt.simpleString()))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        number = c.try_cast(dt.simpleString())
        return F.when(~F.isnan(number), number)  # not a number is no answer
    return c.try_cast(dt.simpleString())


def files_with_breaks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(file)``: files in which a quoted field may hold a line break - some line has an odd number of quotes."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.where(quotes % 2 == 1).select("file").distinct()


def _files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The data files under ``path`` (Spark lists them for any reader; nothing is read)."""
    return sorted(spark.read.text(path).inputFiles())


def csv_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Column names of the first file."""
    return spark.read.options(**DIALECT).option("multiLine", True).csv(_files(spark, path)[:1] or path).columns


def read_csv_strings(spark: SparkSession, path: str | Sequence[str], line_breaks: bool | None = None) -> DataFrame:
    """All columns of the CSV files as strings, and ``MALFORMED``.

    ``line_breaks``: whether quoted fields may hold line breaks; None finds out which files have them (one more scan).
    """
    names = csv_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, MALFORMED)])

    def read(files: str | Sequence[str], whole: bool) -> DataFrame:
        # without column pruning every field is looked at, whatever is selected: else no row would have too few of them
        return (
            spark.read.options(**DIALECT)
            .options(multiLine=whole, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED, enforceSchema=False, columnPruning=False)
            .schema(schema)
            .csv(files)
        )

    if line_breaks is not None:
        return read(path, line_breaks)
    broken = {r["file"] for r in files_with_breaks(spark, path).collect()}  # file names, which the driver lists anyway
    if not broken:
        return read(path, False)
    rest = [f for f in _files(spark, path) if f not in broken]
    parts = [read(sorted(broken), True), *([read(rest, False)] if rest else [])]
    return parts[0].unionByName(parts[1]) if rest else parts[0]


def read_survey(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = SURVEY_SCHEMA, tokens: Sequence[str] = NA_TOKENS, line_breaks: bool | None = None
) -> DataFrame:
    """CSV with header -> typed frame of ``schema`` (columns missing from the file raise KeyError)."""
    raw = read_csv_strings(spark, path, line_breaks)
    require_columns(raw, [f.name for f in schema.fields])
    return raw.select(*[_typed(null_tokens(F.col(f"`{f.name}`"), tokens), f.dataType).alias(f.name) for f in schema.fields])


def cast_failures(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = SURVEY_SCHEMA, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Per column: values present in the file that did not cast to the schema type."""
    raw = read_csv_strings(spark, path)
    aggs = []
    for f in schema.fields:
        v = null_tokens(F.col(f"`{f.name}`"), tokens)
        aggs.append(F.count_if(v.isNotNull() & _typed(v, f.dataType).isNull()).cast("long").alias(f.name))
    row = raw.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("feature"), F.col(f"`{f.name}`").alias("failures")) for f in schema.fields])))


def malformed_rows(spark: SparkSession, path: str | Sequence[str], line_breaks: bool | None = None) -> DataFrame:
    """``(file, rows, malformed, cut_short)`` per file: all rows, those with too few or too many fields, and those of them without a last field."""
    raw = read_csv_strings(spark, path, line_breaks)
    odd, last = F.col(MALFORMED).isNotNull(), F.col(f"`{raw.columns[-2]}`")
    return raw.groupBy(F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).cast("long").alias("rows"), F.count_if(odd).cast("long").alias("malformed"), F.count_if(odd & last.isNull()).cast("long").alias("cut_short")
    )


def _address(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a qualified Hadoop path (``file:/x`` is the local ``/x``)."""
    return fs.FileSystem.from_uri(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def _join_files(batches: Iterator[pa.RecordBatch], parts: list[str], target: str) -> Iterator[pa.RecordBatch]:
    """The bytes of ``parts`` one after the other in ``target``, ``COPIED`` at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        store, path = _address(target)
        with store.open_output_stream(path) as out:
            for part in parts:
                store, path = _address(part)
                with store.open_input_stream(path) as f:
                    while chunk := f.read(COPIED):
                        out.write(chunk)
        yield pa.RecordBatch.from_arrays([pa.array([len(parts)], pa.int64())], names=["parts"])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False, order_by: Sequence[str] = ()) -> None:
    """Rows to a CSV folder (one part file per partition), header row, no index; NULL as empty, quotes doubled.

    ``order_by`` sorts the rows over all parts.  ``single_file`` makes ``path`` itself one file, as spreadsheets want it: all tasks sort and
    write parts, then one task copies the parts' bytes behind the header (a fixed buffer, whatever the size), and the file is renamed.
    """
    out = df.orderBy(*order_by) if order_by else df
    if not single_file:
        out.write.mode(mode).options(**DIALECT).csv(path)
        return
    spark = df.sparkSession
    jvm = spark._jvm
    of = jvm.org.apache.hadoop.fs.Path
    target = of(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target) and mode != "overwrite":
        raise FileExistsError(path)
    folder = of(f"{path}.{uuid.uuid4().hex[:8]}.parts")
    spark.createDataFrame([], df.schema).write.options(**DIALECT).csv(of(folder, "head").toString())
    out.write.options(**{**DIALECT, "header": False}).csv(of(folder, "rows").toString())

    def written(kind: str) -> list[str]:
        found = [f.getPath() for f in files.globStatus(of(of(folder, kind), "part-*"))]
        return [f.toString() for f in sorted(found, key=lambda f: int(f.getName().split("-")[1]))]

    whole = of(folder, "whole")
    join = partial(_join_files, parts=[*written("head"), *written("rows")], target=files.makeQualified(whole).toString())
    spark.range(1, numPartitions=1).mapInArrow(join, "parts long").collect()
    files.delete(target, True)
    files.rename(whole, target)
    files.delete(folder, True)
