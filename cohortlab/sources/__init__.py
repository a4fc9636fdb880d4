from cohortlab.sources.survey import survey_dirty, survey_view
from cohortlab.sources.tables import table

__all__ = ["survey_view", "survey_dirty", "table"]
