"""Derived columns: date differences, arithmetic, value maps, unit conversions.

A derived cell is present if all its inputs are; else it has the first of UNKNOWN,
NOT_ASSESSED and NOT_APPLICABLE among them. A result that isn't a finite number, or an
integer beyond 64 bits, is UNKNOWN.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.units import UNITS, factor
from quorumlake.model import NOT_APPLICABLE, NOT_ASSESSED, PRESENT, UNKNOWN, Refusal


def _state(frame: DataFrame, name: str) -> Column:
    bare = F.when(F.col(name).isNull(), UNKNOWN).otherwise(PRESENT)
    return F.coalesce(F.col(f"{name}__state"), bare) if f"{name}__state" in frame.columns else bare


def derived(frame: DataFrame, name: str, inputs: Sequence[str], value: Column) -> DataFrame:
    states = [_state(frame, c) for c in inputs]
    any_ = lambda s: reduce(lambda a, b: a | b, [x == s for x in states])
    state = F.when(any_(UNKNOWN), UNKNOWN).when(any_(NOT_ASSESSED), NOT_ASSESSED).when(any_(NOT_APPLICABLE), NOT_APPLICABLE)
    frame = frame.withColumn("_value", value)
    state = state.when(F.col("_value").isNull(), UNKNOWN).otherwise(PRESENT)
    frame = frame.withColumn(f"{name}__state", state)
    return frame.withColumn(name, F.when(F.col(f"{name}__state") == PRESENT, F.col("_value"))).drop("_value")


def _micros(c: Column) -> Column:
    """Microseconds since 1970; dates and times without a zone are UTC's, whatever the session's zone."""
    since = (c.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(18,6)")
    return F.when(F.typeof(c).isin("date", "timestamp_ntz"), (since * 1_000_000).cast("bigint")).otherwise(F.unix_micros(c.cast("timestamp")))


def date_diff(start: Column, end: Column, units: str = "d") -> Column:
    """end less start; dates stand for their midnight in UTC, times without a zone for that time in UTC."""
    if UNITS.get(units, ("",))[0] != "time":
        raise Refusal("UNITS_INCOMPATIBLE", units)
    micros = [_micros(c) for c in (end, start)]
    return (micros[0] - micros[1]).cast("double") / F.lit(1e6 * factor(units, "s"))


def arith(op: str, a: Column, b: Column, integers: bool = False) -> Column:
    """+ - * / of two columns; integers are exact, and their quotient only where it is whole."""
    if integers:
        x, y = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
        made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: F.try_multiply(x.cast("decimal(19,0)"), y.cast("decimal(19,0)")), "/": lambda: F.when(y != 0, F.when(x % y == 0, F.floor(x / y)))}[op]()
        return made.try_cast("bigint")
    x, y = a.cast("double"), b.cast("double")
    made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.when(y != 0, x / F.nullif(y, F.lit(0.0)))}[op]()
    return F.when(~F.isnan(made) & (F.abs(made) < float("inf")), made)


def value_map(c: Column, mapping: Mapping[str, str]) -> Column:
    """The mapped value of a cell's text; null where there is none."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), c.cast("string"))


def unit_convert(c: Column, given: str, wanted: str) -> Column:
    return c.cast("double") * F.lit(factor(given, wanted))


def in_order(steps: Mapping[str, tuple[Sequence[str], Callable[[DataFrame], DataFrame]]]) -> list[str]:
    """Names of derived columns, each after those it is made of."""
    done: list[str] = []
    todo = dict(steps)
    while todo:
        ready = [n for n, (needs, _) in todo.items() if not set(needs) & todo.keys()]
        if not ready:
            raise Refusal("DERIVATION_CYCLE", ", ".join(todo))
        done += ready
        for n in ready:
            del todo[n]
    return done


def build(frame: DataFrame, steps: Mapping[str, tuple[Sequence[str], Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    for name in in_order(steps):
        frame = steps[name][1](frame)
    return frame
