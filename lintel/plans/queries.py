"""Imports every query module so the catalog is complete."""

from lintel.plans import q_joins, q_tables, q_takeoff, q_text  # noqa: F401
from lintel.plans.views import catalog

__all__ = ["catalog"]
