"""Errors and warnings of the library."""


class TableLayoutError(Exception):
    """A partition spec doesn't fit the column that it names."""


class LockedTableError(RuntimeError):
    """Another writer holds the table."""


class AppendlakeWarning(UserWarning):
    """A setting works, but likely not as meant."""
