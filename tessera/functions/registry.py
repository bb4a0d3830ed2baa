"""The function registry: name to signature and builder."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, Window, functions as F


@dataclass(frozen=True)
class Op:
    """build(*columns, *parameters) yields dicts of columns to materialise, gets their columns back, and returns the
    result; a builder without stages just returns it. inputs: the kinds of its column arguments (f value, c condition,
    g group), with * where all further arguments are columns of the last kind; out: its result's kind; window: the
    place of its window length among the parameters; reach: the rows before and after its own that a value depends on,
    from its arguments by name, where that isn't the window alone."""

    name: str
    inputs: str
    out: str
    build: Callable
    window: int | None
    reach: Callable[[dict], tuple[float, float]] | None = None

    def span(self, columns: int, parameters: list, named: dict) -> tuple[float, float]:
        """Rows before and after, given its constants."""
        bound = inspect.signature(self.build).bind(*[None] * columns, *parameters, **named)
        bound.apply_defaults()
        if self.reach is not None:
            return self.reach(bound.arguments)
        if self.window is None:
            return 0, 0
        given = list(bound.arguments.values())[columns + self.window]
        return (ALL, 0) if given is None else (abs(int(given)), 0)


OPS: dict[str, Op] = {}

#: The reach of what depends on every row before (or after).
ALL = math.inf


def all_before(given: dict) -> tuple[float, float]:
    return ALL, 0


def everything(given: dict) -> tuple[float, float]:
    return ALL, ALL


def moved_by(name: str) -> Callable[[dict], tuple[float, float]]:
    """So many rows back, or ahead where the parameter is below nought."""
    return lambda given: (max(int(given[name]), 0), max(-int(given[name]), 0))


def rows_of(name: str, default: int = 0) -> Callable[[dict], tuple[float, float]]:
    return lambda given: (int(given[name] or default), 0)


@dataclass(frozen=True)
class Whole:
    """Yielded in place of a column: an aggregate over the whole panel, one row that is broadcast back to it."""

    value: Column


def op(inputs: str, out: str = "f", name: str | None = None, window: int | None = None, reach: Callable[[dict], tuple[float, float]] | None = None):
    """Registers a builder; window is the place of its window-length parameter among the parameters, if it has one;
    reach tells the rows it depends on where that isn't the window."""

    def register(build):
        OPS[name or build.__name__.rstrip("_")] = Op(name or build.__name__.rstrip("_"), inputs, out, build, window, reach)
        return build

    return register


def alias(name: str, of: str) -> None:
    """Another name for a registered function."""
    OPS[name] = replace(OPS[of], name=name)


def cs():
    """The rows of a date."""
    return Window.partitionBy("di")


def history():
    """The rows of a symbol in the order of dates."""
    return Window.partitionBy("sym").orderBy("di")


def rolling(n: int):
    return history().rowsBetween(-(int(n) - 1), 0)


def within(g: Column):
    return Window.partitionBy("di", g)


def clean(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def periods(n: int, given) -> int:
    n = int(n)
    if n < 2:
        raise ValueError("a window has two rows at least")
    return n // 2 if given is None else int(given)


def decayed(values: dict[str, Column], beta: float, place: Column, *by):
    """Stages: running sums of values in which each row counts beta times for each place it lies back, in the order of
    place (whole numbers from 0) within by. Sums grow from block to block of places, so that no power overflows whatever
    the length; what lies before the block before weighs less than 1e-240."""
    if beta <= 0:
        return {k: F.coalesce(v, F.lit(0.0)) for k, v in values.items()}
    size = max(1, int(560 / -math.log(beta))) if beta < 1 else 1 << 31
    block = F.floor(place / size)
    at = (place - block * size).cast("double")
    inside = Window.partitionBy(*by, block).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    own = yield {k: F.sum(F.coalesce(v, F.lit(0.0)) * F.pow(F.lit(1 / beta), at)).over(inside) for k, v in values.items()} | {"_block": block, "_at": at}
    before = Window.partitionBy(*by).orderBy(own["_block"]).rangeBetween(-1, -1)
    ends = yield {"_end": F.max(F.struct(place.alias("_place"), *(own[k].alias(k) for k in values))).over(before)}
    return {k: (own[k] + F.coalesce(ends["_end"][k], F.lit(0.0)) * beta**size) * F.pow(F.lit(beta), own["_at"]) for k in values}


def gate(x: Column, n: int, least, value: Column) -> Column:
    """value where the window holds enough rows with x; before the window's n-th-least row there is too little."""
    return F.when(F.count(x).over(rolling(n)) >= periods(n, least), value)
