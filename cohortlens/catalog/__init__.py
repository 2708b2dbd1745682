"""All registered queries, one module per category."""

from cohortlens.catalog import aggregates, columns, evaluation, linkage, quality, relations, series, storage, streams  # noqa: F401
from cohortlens.catalog.base import ORACLES, QUERIES  # noqa: F401
