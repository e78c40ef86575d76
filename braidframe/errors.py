"""Errors of the query language."""


class QueryError(ValueError):
    """A query that cannot be compiled; ``start`` and ``end`` are places in its text."""

    def __init__(self, message: str, start: int = -1, end: int = -1) -> None:
        super().__init__(f"{message} (at {start}..{end})" if start >= 0 else message)
        self.start, self.end = start, end


class KeyConflict(ValueError):
    """A row was inserted whose primary or alternate key exists."""


class UnsetColumn(AttributeError):
    """A column was read that the projection left out."""
