"""Panel functions, each a small generator of column stages that the planner runs level by level."""

from .registry import OPS, Op, op  # noqa: F401
from . import canonical, dialects  # noqa: F401  register their functions
