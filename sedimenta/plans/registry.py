"""Operators that declare what they need and what they give, and the resolver that chains them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.graphs import toposort


@dataclass(frozen=True)
class Option:
    name: str
    default: object
    help: str = ""


@dataclass(frozen=True)
class Operator:
    """transform takes the tables it requires and the options, by name, and returns the tables it provides, by name."""

    name: str
    requires: tuple[str, ...]
    provides: tuple[str, ...]
    transform: Callable[..., dict[str, DataFrame]]
    options: tuple[Option, ...] = ()
    feature: str = ""
    leaf: bool = False


@dataclass
class Registry:
    operators: dict[str, Operator] = field(default_factory=dict)

    def register(self, operator: Operator) -> Operator:
        self.operators[operator.name] = operator
        return operator

    def summon(self, what: str) -> list[Operator]:
        """The operator of that name, or all that provide it."""
        if what in self.operators:
            return [self.operators[what]]
        return [o for o in self.operators.values() if what in o.provides]

    def leaves(self) -> list[Operator]:
        return [o for o in self.operators.values() if o.leaf]

    def features(self) -> list[str]:
        return sorted({o.feature for o in self.operators.values() if o.feature})

    def resolve(self, names: list[str], features: tuple[str, ...] = (), given: tuple[str, ...] = ()) -> list[Operator]:
        """The operators that names need, in an order in which they can run.

        Where two operators provide one table and one of them also requires it, that one refines the other's and comes
        between it and all others that require the table. More than one such is an error, and so is a table nobody provides.
        """
        chosen: dict[str, Operator] = {}
        queue = list(names)
        while queue:
            if queue[0] in given and queue[0] not in self.operators:  # a table that is there needn't be made
                queue.pop(0)
                continue
            found = [o for o in self.summon(queue[0]) if not o.feature or o.feature in features]
            if not found and queue[0] not in given:
                raise ValueError(f"nothing provides {queue[0]}")
            for o in found:
                if o.name not in chosen:
                    chosen[o.name] = o
                    queue += o.requires
            queue.pop(0)
        edges: dict[str, list[str]] = {n: [] for n in chosen}
        for table in {t for o in chosen.values() for t in o.provides}:
            source = [o.name for o in chosen.values() if table in o.provides and table not in o.requires]
            refined = [o.name for o in chosen.values() if table in o.provides and table in o.requires]
            if len(source) > 1 or len(refined) > 1:
                raise ValueError(f"{table} is ambiguous: {sorted(source + refined)}")
            line = source + refined
            for a, b in zip(line, line[1:]):
                edges[a].append(b)
            # what a refiner itself depends on takes the table as it was before
            before = self._upstream(chosen, refined[0], table) if refined else set()
            for o in chosen.values():
                if table in o.requires and o.name not in refined:
                    early = o.name in before
                    edges[source[0] if early and source else line[-1]].append(o.name)
        return [chosen[n] for n in toposort(edges)]

    def _upstream(self, chosen: dict[str, Operator], name: str, but: str) -> set[str]:
        seen, stack = set(), [t for t in chosen[name].requires if t != but]
        while stack:
            t = stack.pop()
            for o in chosen.values():
                if t in o.provides and o.name != name and o.name not in seen:
                    seen.add(o.name)
                    stack += [x for x in o.requires if x != but]
        return seen

    def dot(self, order: list[Operator]) -> str:
        """The order as a Graphviz graph of operators and tables."""
        lines = [f'  "{k} {o.name}" -> "[{t}]"' for k, o in enumerate(order) for t in o.provides]
        lines += [f'  "[{t}]" -> "{k} {o.name}"' for k, o in enumerate(order) for t in o.requires]
        return "digraph plan {\n" + "\n".join(lines) + "\n}\n"


registry = Registry()
