import os
import tempfile
import uuid

from pyspark.sql import functions as F

from cohortlab.operators import aggregate as agg
from cohortlab.sources.csv_io import write_csv
from cohortlab.streaming.uploads import start_kpi_query


def test_uploads_accumulate_across_triggers(spark, survey_small):
    folder = tempfile.mkdtemp(prefix="cohortlab-uploads-")
    first = survey_small.where(F.col("respondent_id") % 2 == 0)
    second = survey_small.where(F.col("respondent_id") % 2 == 1)
    write_csv(first, os.path.join(folder, "upload1"))
    name = f"test_kpis_{uuid.uuid4().hex[:8]}"  # fresh checkpoint: a reused name resumes the old state
    q = start_kpi_query(spark, os.path.join(folder, "*"), name)
    try:
        q.processAllAvailable()
        n1 = spark.table(name).agg(F.sum("n")).first()[0]
        assert n1 == first.count()
        write_csv(second, os.path.join(folder, "upload2"))
        q.processAllAvailable()
        got = {r.user_type: (r.n, round(r.rate_pct, 9)) for r in spark.table(name).collect()}
    finally:
        q.stop()
    want = {r.user_type: (r.n, round(r.rate_pct, 9)) for r in agg.rate_by(survey_small, "user_type", "will_subscribe").collect()}
    assert got == want
