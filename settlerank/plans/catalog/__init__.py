"""All registered queries. Importing the package fills the registry."""

from settlerank.plans.catalog import (aggregates, checks, columns, joins, recommend, sources,  # noqa: F401
                                      windows)
from settlerank.plans.registry import CATALOG

__all__ = ["CATALOG"]
