"""Overview KPIs over a folder that receives survey CSV uploads (Structured Streaming).

The dashboard recomputes its overview every time a file is uploaded.  Here a file
stream reads each new CSV (all columns as text, NA tokens nulled, ``try_cast`` to
the schema — the batch reader's rules) and keeps the per-group KPIs as a
streaming aggregation: the state is one row per group, whatever the number of
files.  Output mode ``complete`` re-emits the small result table per trigger;
the checkpoint lives under the shared checkpoint folder, so a restarted query
resumes without recounting files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlab.config import SURVEY, SurveyColumns
from cohortlab.session import ensure_checkpoint_dir
from cohortlab.sources.csv_io import DIALECT, SURVEY_SCHEMA, _typed, null_tokens


def typed_upload_stream(spark: SparkSession, folder: str, schema: T.StructType = SURVEY_SCHEMA, max_files: int = 100) -> DataFrame:
    # enforceSchema off: a file whose header has other names or another order raises instead of being read by position
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    reader = spark.readStream.schema(text).options(**DIALECT).options(multiLine=True, enforceSchema=False, maxFilesPerTrigger=max_files)
    raw = reader.csv(folder)
    return raw.select(*[_typed(null_tokens(F.col(f.name)), f.dataType).alias(f.name) for f in schema.fields])


def kpis_by_group(stream: DataFrame, key: str, c: SurveyColumns = SURVEY) -> DataFrame:
    """Respondents, subscribe rate (x100), mean WTP, mean tools, mean MRR per group (NULL keys dropped)."""
    return (
        stream.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.avg(c.subscribe) * 100).alias("rate_pct"),
            F.avg(c.wtp).alias("avg_wtp"),
            F.avg(c.tools_count).alias("avg_tools_used"),
            F.avg(c.mrr).alias("avg_mrr"),
        )
    )


def start_kpi_query(spark: SparkSession, folder: str, name: str, key: str = "user_type", processing_time: str | None = None) -> StreamingQuery:
    """Start the streaming KPI aggregation into an in-memory table ``name`` (for dashboards / tests)."""
    ckpt = "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "streams", name])
    w = kpis_by_group(typed_upload_stream(spark, folder), key).writeStream.outputMode("complete").format("memory").queryName(name)
    w = w.option("checkpointLocation", ckpt)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def run_once(spark: SparkSession, folder: str, name: str, key: str = "user_type") -> DataFrame:
    """Process every file present in ``folder`` and return the KPI table (``availableNow`` trigger)."""
    ckpt = "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "streams", name])
    q = (
        kpis_by_group(typed_upload_stream(spark, folder), key)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.table(name)
