"""Parameter spaces: seven kinds of parameters, activation, constraints, and their columns.

A space is driver-side metadata. ``resolve`` turns a table of unit values (one column per sampled
parameter) into typed parameter columns, as a chain of projections that Catalyst collapses.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.errors import PlanError
from trialframe.functions.expressions import compile_expression, named
from trialframe.schemas import repeated

BELOW_ONE = math.nextafter(1.0, 0.0)
CONDITIONS = ("eq", "ne", "in", "not_in", "gt", "ge", "lt", "le")


@dataclass(frozen=True)
class Condition:
    """When a parameter is active. An absent value equals nothing; ordering it is an error."""

    parameter: str
    operator: str
    value: object

    def __post_init__(self) -> None:
        if self.operator not in CONDITIONS:
            raise PlanError(f"operator {self.operator!r} is none of {CONDITIONS}")

    def column(self) -> Column:
        actual = named(self.parameter)
        if self.operator in ("in", "not_in"):
            found = reduce(lambda a, b: a | b, (actual.eqNullSafe(F.lit(v)) for v in self.value), F.lit(False))
            return found if self.operator == "in" else ~found
        value = F.lit(self.value)
        if self.operator in ("eq", "ne"):
            same = actual.eqNullSafe(value)
            return same if self.operator == "eq" else ~same
        test = {"gt": actual > value, "ge": actual >= value, "lt": actual < value, "le": actual <= value}[self.operator]
        error = F.raise_error(F.lit(f"{self.parameter} is inactive and cannot be ordered")).cast("boolean")
        return F.when(actual.isNull(), error).otherwise(test)


@dataclass(frozen=True)
class Parameter:
    name: str
    path: str | None = None
    active_when: Condition | None = None

    @property
    def column(self) -> str:
        return self.path or self.name

    sampled = True

    def from_unit(self, unit: Column) -> Column:
        raise PlanError(f"{self.name!r} is not sampled")

    def to_unit(self, value: Column) -> Column:
        raise PlanError(f"{self.name!r} has no inverse")

    def grid_points(self, asked: int) -> int:
        return asked


def _clip(unit: Column) -> Column:
    return F.least(F.greatest(unit, F.lit(0.0)), F.lit(BELOW_ONE))


def _between(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


@dataclass(frozen=True)
class _Range(Parameter):
    low: float = 0.0
    high: float = 1.0
    log: bool = False
    step: float | None = None

    def __post_init__(self) -> None:
        if not self.low < self.high or (self.log and self.low <= 0) or (self.step is not None and self.step <= 0):
            raise PlanError(f"{self.name!r}: bounds must ascend, be positive on a log scale, and steps be positive")

    def _log_unit(self, value: Column) -> Column:
        return (F.log(value) - math.log(self.low)) / (math.log(self.high) - math.log(self.low))

    def _exp(self, u: Column) -> Column:
        return F.exp(F.lit(math.log(self.low)) + u * (math.log(self.high) - math.log(self.low)))


@dataclass(frozen=True)
class Float(_Range):
    def from_unit(self, unit: Column) -> Column:
        u = _clip(unit)
        x = self._exp(u) if self.log else F.lit(float(self.low)) + u * float(self.high - self.low)
        if self.step is not None:  # multiples of the step itself
            x = F.bround(x / float(self.step)) * float(self.step)
        return _between(x, float(self.low), float(self.high))

    def to_unit(self, value: Column) -> Column:
        x = value.cast("double")
        return self._log_unit(x) if self.log else (x - float(self.low)) / float(self.high - self.low)


@dataclass(frozen=True)
class Integer(_Range):
    low: int = 0
    high: int = 1
    step: int | None = None

    def from_unit(self, unit: Column) -> Column:
        u = _clip(unit)
        x = F.bround(self._exp(u)).cast("long") if self.log else F.lit(self.low).cast("long") + F.floor(u * (self.high - self.low + 1))
        if self.step is not None:  # steps from the lower bound
            x = F.lit(self.low) + F.bround((x - self.low) / float(self.step)).cast("long") * self.step
        return _between(x, self.low, self.high).cast("long")

    def to_unit(self, value: Column) -> Column:
        x = value.cast("long").cast("double")
        return self._log_unit(x) if self.log else (x - self.low) / float(max(1, self.high - self.low))


@dataclass(frozen=True)
class _Choice(Parameter):
    values: tuple = ()

    def __post_init__(self) -> None:
        if not self.values:
            raise PlanError(f"{self.name!r} has no values")

    def _array(self) -> Column:
        if len({type(v) for v in self.values}) > 1:  # mixed kinds have text as their common column type
            return F.array(*(F.lit(str(v)) for v in self.values))
        return F.array(*(F.lit(v) for v in self.values))

    def from_unit(self, unit: Column) -> Column:
        n = len(self.values)
        return F.element_at(self._array(), (F.least(F.floor(_clip(unit) * n), F.lit(n - 1)) + 1).cast("int"))

    def to_unit(self, value: Column) -> Column:
        at = F.array_position(self._array(), value)
        return F.when(at > 0, (at - 1) / float(max(1, len(self.values) - 1)))

    def grid_points(self, asked: int) -> int:
        return len(self.values)


@dataclass(frozen=True)
class Categorical(_Choice):
    pass


@dataclass(frozen=True)
class Ordinal(_Choice):
    pass


@dataclass(frozen=True)
class Boolean(Parameter):
    def from_unit(self, unit: Column) -> Column:
        return _clip(unit) >= 0.5

    def to_unit(self, value: Column) -> Column:
        return F.when(value, 1.0).otherwise(0.0)

    def grid_points(self, asked: int) -> int:
        return 2


@dataclass(frozen=True)
class Fixed(Parameter):
    value: object = None
    sampled = False

    def to_unit(self, value: Column) -> Column:
        return F.lit(0.0)


@dataclass(frozen=True)
class Derived(Parameter):
    expression: str = ""
    sources: tuple[str, ...] = ()
    sampled = False


@dataclass(frozen=True)
class Constraint:
    expression: str
    message: str = "constraint violated"


@dataclass(frozen=True)
class Space:
    parameters: tuple[Parameter, ...]
    constraints: tuple[Constraint, ...] = ()
    version: str = "1"
    parent_version: str | None = None
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        twice = repeated(p.name for p in self.parameters) + repeated(p.column for p in self.parameters)
        if twice:
            raise PlanError(f"parameters are named more than once: {sorted(set(twice))}")

    @property
    def sampled(self) -> list[Parameter]:
        """Every parameter that takes a dimension of the design, active or not."""
        return [p for p in self.parameters if p.sampled]

    def with_parameters(self, parameters: list[Parameter], version: str, metadata: dict) -> Space:
        return replace(self, parameters=tuple(parameters), version=version, parent_version=self.version, metadata=metadata)


def unit_column(parameter: Parameter) -> str:
    return f"__unit_{parameter.name}"


def texts_of(parameters) -> tuple[str, ...]:
    """Names of the parameters whose columns are texts."""
    text = lambda p: isinstance(p.value, str) if isinstance(p, Fixed) else isinstance(p, _Choice) and any(isinstance(v, str) for v in p.values)
    return tuple(p.column for p in parameters if text(p))


def violation(space: Space) -> Column:
    """The message of the first constraint that a row fails, or null. Null operands fail."""
    names = [p.column for p in space.parameters if "." not in p.column]
    out = F.lit(None).cast("string")
    for constraint in reversed(space.constraints):
        holds = compile_expression(constraint.expression, names, texts=texts_of(space.parameters)).cast("boolean")
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(constraint.message))
    return out


def project(units: DataFrame, space: Space) -> DataFrame:
    """Typed parameter columns in declaration order; an inactive parameter is null."""
    df = units
    for p in space.parameters:
        if isinstance(p, Derived):
            known = {s: named(s) for s in p.sources}
            value = compile_expression(p.expression, known, texts=texts_of(space.parameters))
        elif isinstance(p, Fixed):
            value = F.lit(p.value)
        else:
            value = p.from_unit(F.col(f"`{unit_column(p)}`"))
        df = df.withColumn(p.column, F.when(p.active_when.column(), value) if p.active_when else value)
    return df.drop(*(unit_column(p) for p in space.sampled))


def resolve(units: DataFrame, space: Space, keep_rejects: bool = False) -> DataFrame:
    """Rows that meet all constraints; with ``keep_rejects`` all rows, and why they fail in ``rejected``."""
    df = project(units, space)
    if keep_rejects:
        return df.withColumn("rejected", violation(space))
    return df.where(violation(space).isNull()) if space.constraints else df
