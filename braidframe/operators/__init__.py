"""Tables and their verbs."""

from .join import join, join_identity
from .kv import View
from .store import State
from .table import Table, concat

__all__ = ["State", "Table", "View", "concat", "join", "join_identity"]
