"""The registered queries with the SQL each is compared against."""

from playmetrics.queries import charts, games, heldout, models, people, readers, seasons, windows  # noqa: F401
from playmetrics.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
