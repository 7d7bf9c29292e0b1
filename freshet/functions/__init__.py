"""The scalar library of the dialect."""

from freshet.functions import collections, comparisons, datetimes, numeric, strings, variants  # noqa: F401  (they fill the registry)
from freshet.functions.registry import FUNCTIONS

__all__ = ["FUNCTIONS"]
