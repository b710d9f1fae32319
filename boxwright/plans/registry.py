"""Every query of the library by name, with the SQL that tells the same rows."""

from __future__ import annotations

from boxwright.plans import box_queries, dataset_queries, decision_queries, evaluation_queries, function_queries, io_queries, mining_queries, raster_queries, relational_queries, review_queries  # noqa: F401
from boxwright.plans.core import ORACLES, QUERIES  # noqa: F401
