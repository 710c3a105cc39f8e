"""Every registered query of the library proper, with the SQL that must agree where SQL can express it."""

from . import registry
from .operators import chunks, metrics, reconstruction, repositories, rules, services  # noqa: F401  they register their queries
from .plans import containers  # noqa: F401
from .sources import storage  # noqa: F401
from .streaming import ingest  # noqa: F401

QUERIES, SQL = registry.QUERIES, registry.SQL
