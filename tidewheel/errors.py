"""Errors of plans and of eager data."""

from __future__ import annotations


class EngineError(Exception):
    """A plan failed while it ran."""


class SourceError(EngineError):
    """A source could not be opened or is not a whole number of elements."""


class OutOfBounds(EngineError, IndexError):
    """A slice or a point update reaches past the end of its series."""


class Overflow(EngineError, OverflowError):
    """A value is out of range for its element type."""


class LengthMismatch(EngineError):
    """Two series of different lengths were combined."""


class SinkIntoSource(EngineError):
    """A plan would write over a file that it reads."""


class ViewError(ValueError):
    """Bytes cannot be seen as elements."""


class SizeMismatch(ViewError):
    def __init__(self, length: int, width: int):
        super().__init__(f"{length} bytes are no whole number of elements of {width} bytes")
        self.length, self.width = length, width


class Misaligned(ViewError):
    pass


class ReadOnly(ViewError):
    pass


#: What the checks inside plans raise, and how terminals report it.
MISMATCH_TEXT = "series of different lengths were combined"
OVERFLOW_TEXT = "value out of range for its element type"
BOUNDS_TEXT = "out of bounds of the series"


def translated(error: Exception) -> Exception:
    """The engine's error for what Spark raised while a plan ran."""
    if isinstance(error, EngineError):
        return error
    text = str(error)
    for kind, mark in ((LengthMismatch, MISMATCH_TEXT), (OutOfBounds, BOUNDS_TEXT), (Overflow, OVERFLOW_TEXT), (SourceError, "SourceError"), (SinkIntoSource, "SinkIntoSource")):
        if mark in text:
            return kind(text.splitlines()[0][:500])
    return EngineError(text[:2000])
