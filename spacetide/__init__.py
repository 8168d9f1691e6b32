"""Space-time cube and event-trajectory analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames (or Columns); nothing runs
until the caller starts an action, except the few bounded probes that say so in
their docstring.
"""

from .functions import arrays, columns, geodesy, hashing, ranking
from .model import grid_axes, index_cube, long_cube, null_missing
from .operators.verbs import apply, pipe

__all__ = [
    "apply",
    "arrays",
    "columns",
    "geodesy",
    "grid_axes",
    "hashing",
    "index_cube",
    "long_cube",
    "null_missing",
    "pipe",
    "ranking",
]
