"""Imports every module that registers queries."""

from riskloom.plans import (  # noqa: F401
    cleaning_queries,
    load_queries,
    quality_queries,
    report_queries,
    text_queries,
)
from riskloom.plans.registry import QUERIES, SQL  # noqa: F401
