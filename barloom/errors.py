"""What can go wrong, by kind: so that callers can tell a wrong configuration from wrong data or a venue that does not answer."""

from __future__ import annotations


class BarloomError(Exception):
    """Any error that the engine itself raises."""


class ConfigError(BarloomError, ValueError):
    """A parameter or specification that cannot be right."""


class DataError(BarloomError, ValueError):
    """Data that breaks its format."""


class VenueError(BarloomError, RuntimeError):
    """A venue that refuses, or does not answer after retries."""
