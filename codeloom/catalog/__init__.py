"""All registered queries of the library itself."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import cypher, graph, more, resolve, search, text  # noqa: F401, E402
