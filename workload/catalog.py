"""All registered queries."""

from workload import loading, review, screening, sources, triage, words  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
