"""Column-level building blocks: semirings and time arithmetic."""

from .semiring import SEMIRINGS, Semiring, semiring
from .timecols import from_micros, micros

__all__ = ["SEMIRINGS", "Semiring", "from_micros", "micros", "semiring"]
