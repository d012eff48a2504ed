"""Registered queries of the engine's own operators."""

from parlance.queries import evaluation, files, numeric, spoken, text  # noqa: F401
from parlance.queries.registry import QUERIES, SQL
