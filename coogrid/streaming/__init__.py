"""Live variants of the measurement operators."""

from .live import closed_section_memory, live_section_memory

__all__ = ["closed_section_memory", "live_section_memory"]
