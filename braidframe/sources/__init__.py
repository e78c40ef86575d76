"""Where tables come from and go to."""

from .database import Database

__all__ = ["Database"]
