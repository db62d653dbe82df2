"""All registered queries."""

from labelspark.catalog import cleaning, files, labels, modelling, plans, reshaping, scoring, splitting  # noqa: F401
from labelspark.catalog.registry import ORACLE, QUERIES  # noqa: F401
