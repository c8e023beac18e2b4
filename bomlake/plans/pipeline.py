"""Operators by name, with dependencies: chosen, put in order and applied to tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Operator:
    name: str
    apply: Callable[[Tables], Tables]
    after: tuple[str, ...] = field(default=())


def ordered(operators: list[Operator]) -> list[Operator]:
    """Dependencies first, peers in their given order; unknown dependencies don't matter."""
    names = [o.name for o in operators]
    if len(set(names)) < len(names):
        raise ValueError(f"operators with the same name: {sorted({n for n in names if names.count(n) > 1})}")
    done: list[Operator] = []
    left = list(operators)
    while left:
        open_names = {o.name for o in left}
        ready = next((o for o in left if not open_names & set(o.after) - {o.name} and o.name not in o.after), None)
        if ready is None:
            raise ValueError(f"a cycle among {sorted(open_names)}")
        done.append(ready)
        left.remove(ready)
    return done


def chosen(operators: list[Operator], enabled: set[str] = frozenset(), disabled: set[str] = frozenset()) -> list[Operator]:
    return [o for o in operators if o.name not in disabled and (not enabled or o.name in enabled)]


def run(operators: list[Operator], tables: Tables, **choice) -> Tables:
    """Lazy throughout: the operators' plans fuse, and Spark plans each table written at the end."""
    return reduce(lambda t, o: {**t, **o.apply(t)}, ordered(chosen(operators, **choice)), dict(tables))


#: The order of the standard operators, as their dependencies give it.
STANDARD = ("prefilter", "attribution", "untracked", "basediff", "extractor", "registry", "lifecycle", "cpe", "dedup", "compliance")
