"""All panel queries and their SQL: importing the modules registers them."""

from __future__ import annotations

from . import allocation_queries, forecast_queries, queries, risk_queries, table_queries  # noqa: F401
from .queries import ORACLES, QUERIES  # noqa: F401
