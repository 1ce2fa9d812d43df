"""Plans over the sample tables: each registered query runs one operator on whole tables, most with an SQL twin."""

from reelgraph.plans import (  # noqa: F401
    chunked,
    clusters,
    columns,
    evaluations,
    libraries,
    people,
    registries,
    searches,
    streams,
)
from reelgraph.plans.catalog import CATALOG

__all__ = ["CATALOG"]
