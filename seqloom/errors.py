"""Errors raised by operations that check their arguments."""


class SequenceError(ValueError):
    """Base of all."""


class LengthMismatchError(SequenceError):
    """Two sequences that must have one length have two."""


class OutputTooShortError(SequenceError):
    """A destination is shorter than what goes into it."""


class InvalidSegmentationError(SequenceError):
    """Offsets, lengths or segment numbers that describe no segmentation."""


class InvalidArgumentError(SequenceError):
    """An argument outside its range."""
