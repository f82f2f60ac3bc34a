"""Named queries over the test tables, each with the SQL that says the same."""

from . import archive_gaps, archive_live, archive_more, archive_rules, archive_scores, archive_sensors, archive_sky, archive_states, archive_studies, relational, scores, statistics, timeseries
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "archive_gaps", "archive_live", "archive_more", "archive_rules", "archive_scores", "archive_sensors", "archive_sky", "archive_states", "archive_studies", "relational", "scores", "statistics", "timeseries"]
