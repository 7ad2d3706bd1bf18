"""All registered plans."""

from fieldtide.plans import harvest_plans, operation_plans, raster_plans, season_plans, source_plans  # noqa: F401
from fieldtide.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
