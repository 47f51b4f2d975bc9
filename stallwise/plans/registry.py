"""All queries over the reference's own operators, with their SQL."""

from . import deal_queries, metric_queries, outcome_queries, report_queries, state_queries, text_queries, tracking_queries  # noqa: F401  (importing registers)
from .adapters import QUERIES, SQL  # noqa: F401
