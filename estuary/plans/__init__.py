"""The registered queries."""

from . import evidence, markets, panels, records, sources, statistics, stores  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
