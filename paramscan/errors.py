"""Exceptions raised by the engine."""

from __future__ import annotations


class ParamscanError(Exception):
    """Base of all errors of this package."""


class StoreError(ParamscanError):
    """A snapshot store cannot be read or written."""


class CloneError(ParamscanError):
    """A store cannot be copied."""


class DestinationExistsError(CloneError):
    """The destination of a copy is there already."""


class CheckoutError(ParamscanError):
    """A branch cannot be checked out without losing work."""


class SelectionError(ParamscanError):
    """Selected files contradict each other or the configuration."""


class SymlinkError(ValueError):
    """A path leads through a symbolic link."""
