import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortlab.session import get_session

    s = get_session("local[4]", app="cohortlab-tests", shuffle_partitions=8, driver_memory="6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SMALL


@pytest.fixture(scope="session")
def survey_small(spark):
    from cohortlab.sources.survey import survey_view

    return survey_view(spark, SMALL).cache()
