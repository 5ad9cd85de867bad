"""Pattern clauses over typed relations: edges, guards, existence, absence, options and alternatives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Var(str):
    """The name of a variable in a role; any other value in a role is a literal to match."""


def extent(relation: DataFrame, roles: dict) -> DataFrame:
    """The bindings of one edge: variables for roles, literals as filters, repeated variables as equality."""
    rows, seen = relation, {}
    for role, value in roles.items():
        if not isinstance(value, Var):
            rows = rows.filter(F.col(role) == F.lit(value))
        elif value in seen:
            rows = rows.filter(F.col(role) == F.col(seen[value]))
        else:
            seen[value] = role
    return rows.select(*[F.col(role).alias(str(var)) for var, role in seen.items()])


@dataclass(frozen=True)
class Pattern:
    """A conjunction of clauses. Source order has no meaning; Catalyst picks the joins."""

    rows: DataFrame | None = None

    def edge(self, relation: DataFrame, **roles) -> Pattern:
        new = extent(relation, roles)
        if self.rows is None:
            return Pattern(new)
        return Pattern(self.rows.join(new, self._shared(new)))

    def cross(self, relation: DataFrame, **roles) -> Pattern:
        """The one way to combine edges that share no variable."""
        return Pattern(self.rows.crossJoin(extent(relation, roles)))

    def let(self, name: str, value: Column) -> Pattern:
        return Pattern(self.rows.withColumn(name, value))

    def when(self, guard: Column) -> Pattern:
        return Pattern(self.rows.filter(guard))

    def exists(self, relation: DataFrame, **roles) -> Pattern:
        new = extent(relation, roles)
        return Pattern(self.rows.join(new, self._shared(new), "left_semi"))

    def without(self, relation: DataFrame, complete: bool = True, **roles) -> Pattern:
        """Absence; refused for an open relation, whose extent nobody knows. Null keys match nothing and stay."""
        if not complete:
            raise ValueError("absence in an open relation needs a completeness witness")
        new = extent(relation, roles)
        return Pattern(self.rows.join(new, self._shared(new), "left_anti"))

    def optional(self, relation: DataFrame, **roles) -> Pattern:
        new = extent(relation, roles)
        return Pattern(self.rows.join(new, self._shared(new), "left"))

    def any(self, *branches) -> Pattern:
        """Each branch is a function of a pattern; the bindings they share are united."""
        found = [b(self).rows for b in branches]
        names = [c for c in found[0].columns if all(c in f.columns for f in found)]
        out = found[0].select(*names)
        for f in found[1:]:
            out = out.unionByName(f.select(*names))
        return Pattern(out.distinct())

    def yields(self, *values: Column | str) -> DataFrame:
        """The relation of these values: a set."""
        return self.rows.select(*values).distinct()

    def _shared(self, new: DataFrame) -> list[str]:
        shared = [c for c in new.columns if c in self.rows.columns]
        if not shared:
            raise ValueError("a disconnected edge: share a variable or use cross")
        return shared


def first_empty_prefix(start: Pattern, clauses: list[tuple[str, object]]) -> list[tuple[int, str, int]]:
    """Why a pattern has no match: the rows left after each clause, up to the first that leaves none."""
    out, at = [], start
    for k, (name, clause) in enumerate(clauses):
        at = clause(at)
        left = at.rows.count()
        out.append((k, name, left))
        if not left:
            break
    return out
