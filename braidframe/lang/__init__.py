"""The query language: ``{projection ; projection} filter``."""

from .nodes import Query
from .parser import parse_expression, parse_query

__all__ = ["Query", "parse_expression", "parse_query"]
