"""What a query will do: our reading of it, and Spark's plan."""

from __future__ import annotations

from ..lang import parse_query
from ..lang.nodes import Call, conjuncts


def outline(query: str) -> str:
    """The steps of a query, outermost first."""
    q = parse_query(query)
    items = [*(q.first or ()), *(q.second or ())]
    lines = []
    if any(i.order for i in items):
        lines.append("sort: " + ", ".join(f"{i.order}{i.path.name}" for i in items if i.order))
    calls = [n for i in items if i.expr is not None for n in i.expr.walk() if isinstance(n, Call)]
    if q.second is not None:
        kind = "window" if any(c.named for c in calls) else "aggregate" if calls else "group"
        lines.append(f"{kind}: by " + (", ".join(i.path.name for i in q.first) or "nothing"))
    elif q.first is not None:
        lines.append("map: " + ", ".join("*" if i.path is None else i.path.name for i in items))
    terms = conjuncts(q.filter)
    if terms:
        lines.append(f"filter: {len(terms)} term{'s' * (len(terms) > 1)}")
    lines.append("scan")
    return "\n".join("  " * n + "- " + x for n, x in enumerate(lines))


def explain(table, query: str | None = None, args: tuple[object, ...] = ()) -> str:
    derived = table.derive(query, *args) if query else table
    plan = derived.df._sc._jvm.PythonSQLUtils.explainString(derived.df._jdf.queryExecution(), "formatted")
    return (outline(query) + "\n\n" if query else "") + plan
