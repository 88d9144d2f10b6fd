"""Calling contexts as column expressions over array<bigint> of function names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NoContext:
    label = "No context"

    def initial(self, name: Column) -> Column:
        return F.array().cast("array<bigint>")

    def merge(self, context: Column, name: Column) -> Column:
        return F.array().cast("array<bigint>")


@dataclass(frozen=True)
class CallString:
    """The last n functions entered; n of 0 and 1 both keep the callee alone."""

    n: int

    @property
    def label(self) -> str:
        return f"{self.n}-context"

    def initial(self, name: Column) -> Column:
        return F.array(name.cast("bigint"))

    def merge(self, context: Column, name: Column) -> Column:
        kept = max(self.n, 1)
        grown = F.concat(context, F.array(name.cast("bigint")))
        return F.slice(grown, F.greatest(F.size(grown) - (kept - 1), F.lit(1)), F.lit(kept))


POLICIES = (NoContext(), CallString(1), CallString(2), CallString(3))


def policy(name: str):
    return next(p for p in POLICIES if p.label == name)


def label(context: Column) -> Column:
    """The text of a context: its names, oldest first, joined by dots."""
    return F.array_join(F.transform(context, lambda c: c.cast("string")), ".")


def _at(text: Column, context: Column) -> Column:
    return F.when(F.size(context) > 0, F.concat(text, F.lit("@"), label(context))).otherwise(text)


def variable(var: Column, context: Column) -> Column:
    return _at(F.concat(F.lit("V"), var.cast("string")), context)


def heap(alloc: Column, context: Column) -> Column:
    return _at(F.concat(F.lit("H"), alloc.cast("string")), context)


def field(base: Column, name: Column, context: Column) -> Column:
    """A field belongs to its base variable, not to the object, so aliases do not share it."""
    return _at(F.concat(F.lit("F"), base.cast("string"), F.lit("."), name.cast("string")), context)
