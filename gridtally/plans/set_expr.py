"""Set expressions: a small tree that builds a DataFrame of members."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class SetExpr:
    """op is inline, group, stored, intersect, union, difference or filter."""

    op: str
    parts: tuple = ()

    @staticmethod
    def inline(*members: str) -> SetExpr:
        return SetExpr("inline", tuple(sorted(set(members))))

    @staticmethod
    def named(name: str) -> SetExpr:
        """A stored set if the name says so, else a group."""
        return SetExpr("stored" if name.startswith("sset_") else "group", (name,))

    def __and__(self, other: SetExpr) -> SetExpr:
        return SetExpr("intersect", (self, other))

    def __or__(self, other: SetExpr) -> SetExpr:
        return SetExpr("union", (self, other))

    def __sub__(self, other: SetExpr) -> SetExpr:
        return SetExpr("difference", (self, other))

    def where(self, tag: str) -> SetExpr:
        return SetExpr("filter", (self, tag))

    def label(self) -> str:
        if self.op == "inline":
            return "{" + ", ".join(self.parts) + "}"
        if self.op in ("group", "stored"):
            return self.parts[0]
        if self.op == "filter":
            return f"{self.parts[0].label()}[{self.parts[1]}]"
        sign = {"intersect": " ∩ ", "union": " ∪ ", "difference": " \\ "}[self.op]
        return "(" + sign.join(p.label() for p in self.parts) + ")"


def members(expr: SetExpr, groups: DataFrame, stored: DataFrame, predicates: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The expression's members; groups and stored have (set_id, member). An unknown predicate raises KeyError."""
    if expr.op == "inline":
        return groups.sparkSession.createDataFrame([(m,) for m in expr.parts], "member string")
    if expr.op in ("group", "stored"):
        source = stored if expr.op == "stored" else groups
        return source.filter(source["set_id"] == expr.parts[0]).select("member").distinct()
    if expr.op == "filter":
        keep = predicates[expr.parts[1]]
        return keep(members(expr.parts[0], groups, stored, predicates))
    parts = [members(p, groups, stored, predicates) for p in expr.parts]
    step = {"intersect": lambda a, b: a.intersect(b), "union": lambda a, b: a.union(b).distinct(), "difference": lambda a, b: a.exceptAll(b)}[expr.op]
    return reduce(step, parts)
