"""The operators bound to the test tables, each with the SQL that states its result."""

from lullmap.bindings import applying, catalogue, detection, gates, monitoring, sourcing, texts
from lullmap.bindings.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "applying", "catalogue", "detection", "gates", "monitoring", "sourcing", "texts"]
