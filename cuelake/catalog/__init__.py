"""All registered queries."""

from cuelake.catalog import cleaning, evaluation, signals, spans, transcripts  # noqa: F401
from cuelake.catalog.registry import ORACLE, QUERIES  # noqa: F401
