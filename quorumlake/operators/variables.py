"""One value for each unit: columns, pooled aggregates, questions, rows and memberships.

A variable is two columns of the unit's frame: ``x``, the bits of the reasons that leave
the unit out (0: it has a value), and ``val``. Pooled aggregates go up the path one
aggregation a step, each row once for each way to it; sums, counts and extremes
of a step are made of those of the step below, so rows never fan out.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.model import NOT_APPLICABLE, NOT_ASSESSED, PRESENT, Refusal, state_of
from quorumlake.operators.compile import DROPS, Frame, closedness, same_key
from quorumlake.operators.truth import BIT, REASONS, TRUE, UNKNOWN, all_of
from quorumlake.plans.clauses import Clause, Exists
from quorumlake.plans.graph import Step, path_to
from quorumlake.plans.resolve import Resolver

AGGREGATES = ("count", "max", "min", "mean", "some", "every")


@dataclass
class Variable:
    x: Column
    val: Column


def excluded_by(state: Column, found: Column | None = None) -> Column:
    """Bits by which a cell that isn't present leaves its unit out."""
    bits = F.when(state == PRESENT, 0).when(state == NOT_APPLICABLE, BIT["NOT_APPLICABLE"]).when(state == NOT_ASSESSED, BIT["NOT_ASSESSED"]).otherwise(BIT["NO_INFORMATION"])
    return bits if found is None else F.when(found, bits).otherwise(BIT["NO_PARENT"])


def variable(frame: Frame, spec: Mapping[str, Any], resolver: Resolver) -> Variable:
    """A variable as columns of the frame, by what its specification names: a question, an aggregate or a column."""
    if "question" in spec:
        return _question(frame, resolver.clause(spec["question"], frame.table))
    if "aggregate" in spec:
        return _aggregate(frame, spec, resolver)
    target, column = frame.release.column(spec["column"])
    path = () if target.name == frame.table and not spec.get("via") else path_to(frame.release, frame.table, target.name, spec.get("via"))
    if any(s.down for s in path) or column.datatype == "list<category>":
        raise Refusal("AGGREGATE_REQUIRED", spec["column"])
    prefix, found = "", None
    if path:
        got = frame.looked_up(path, [c for c in (column.name, column.state) if c in target.frame.columns])
        prefix, found = got["prefix"], got["found"]
    x = excluded_by(state_of(frame.df, column, prefix), found)
    return _kept(frame, x, F.when(x == 0, F.col(prefix + column.name)))


def _kept(frame: Frame, x: Column, val: Column) -> Variable:
    name = frame.fresh("var")
    frame.df = frame.df.withColumns({f"{name}x": x, f"{name}val": val})
    return Variable(F.col(f"{name}x"), F.col(f"{name}val"))


def _question(frame: Frame, clause: Clause) -> Variable:
    truth = frame.truth(clause)
    return _kept(frame, F.when(truth.v == UNKNOWN, truth.r).otherwise(0), F.when(truth.v != UNKNOWN, truth.v == TRUE))


def _aggregate(frame: Frame, spec: Mapping[str, Any], resolver: Resolver) -> Variable:
    kind = spec["aggregate"]
    if kind not in AGGREGATES:
        raise Refusal("UNKNOWN_AGGREGATE", kind)
    if kind in ("some", "every"):
        leaf = {k: v for k, v in spec.items() if k not in ("aggregate", "empty")}
        question = {"kind": "exists", "quantifier": kind} | leaf if "column" not in spec else {"kind": "value", "quantifier": kind} | leaf
        return _question(frame, resolver.clause(question, frame.table))
    name = spec.get("table") or spec["column"].partition(".")[0]
    path = path_to(frame.release, frame.table, name, spec.get("via"))
    if not path or not path[-1].down or not all(s.down for s in path):
        raise Refusal("INVALID_PATH", "a pooled aggregate goes down")
    column = frame.release.tables[name].columns[spec["column"].partition(".")[2]] if "column" in spec else None
    if kind != "count" and column is None:
        raise Refusal("COLUMN_REQUIRED", kind)
    where = tuple(resolver.clause(c, name) for c in spec.get("where", ()))
    pooled = pool(frame, path, where, column, spec.get("lift", "strict"))
    bits, n = pooled["reasons"], pooled["n"]
    if kind == "count":
        return _kept(frame, bits, F.when(bits == 0, n))
    x = bits.bitwiseOR(pooled["bad"])
    value = {"max": pooled["hi"], "min": pooled["lo"], "mean": F.when(pooled["odd"] > 0, pooled["near"]).otherwise(pooled["sum"].cast("double")) / pooled["k"]}[kind]
    if "empty" in spec:
        return _kept(frame, x, F.when(x == 0, F.coalesce(value, F.lit(spec["empty"]))))
    x = F.when((x == 0) & (pooled["k"] == 0), BIT["NO_ROWS"]).otherwise(x)
    return _kept(frame, x, F.when(x == 0, value))


#: What goes up a pooling path: rows, rows with a value, their sum in fixed point, how many don't fit that, the sum in
#: floating point for those, extremes, bits of bad values.
_PAYLOAD = ("n", "k", "sum", "odd", "near", "lo", "hi", "bad")


def pool(frame: Frame, path: tuple[Step, ...], where: tuple[Clause, ...], column: Any, lift: str) -> dict[str, Column]:
    """Columns of the frame: reasons, and the payload of the rows its units reach by the path."""
    down, last = path[0], len(path) == 1
    coverage = frame.release.covered_by(down.rel)
    child = Frame(frame.release, down.end)
    if last:
        clauses = [child.truth(c) for c in where] + ([child.truth(coverage.record_filter)] if coverage.record_filter is not None else [])
        w = child.keep(all_of(clauses))
        pooled = w.v == TRUE
        state = state_of(child.df, column) if column is not None else F.lit(PRESENT)
        cell = F.col(column.name) if column is not None else F.lit(0)
        if column is not None and column.datatype == "category":
            order = F.array(*[F.lit(v) for v in column.permissible]) if column.ordered else None
            cell = cell if order is None else F.nullif(F.array_position(order, cell), F.lit(0))
        has = pooled & (state == PRESENT) & cell.isNotNull()
        numeric = column is not None and column.datatype in ("number", "integer", "time_offset")
        fixed = F.when(F.abs(cell.cast("double")) < 1e18, cell.cast("decimal(38,12)")) if numeric else F.lit(None).cast("decimal(38,12)")  # sums of 10^8 such values fit
        double = cell.cast("double") if numeric else F.lit(None).cast("double")
        odd = fixed.isNull() | (fixed.cast("double") != double)
        sums = {
            "reasons": F.bit_or(F.when(w.v == UNKNOWN, w.r)), "kept": F.count(F.lit(1)), "n": F.count_if(pooled), "k": F.count_if(has), "sum": F.sum(F.when(has & ~odd, fixed)), "odd": F.count_if(has & odd) if numeric else F.lit(0), "near": F.sum(F.when(has, double)),
            "lo": F.min(F.when(has, cell)), "hi": F.max(F.when(has, cell)), "bad": F.bit_or(F.when(pooled & ~state.isin(PRESENT, NOT_APPLICABLE), excluded_by(state)).when(pooled & (state == PRESENT) & cell.isNull(), BIT["NO_INFORMATION"])),
        }
    else:
        below = pool(child, path[1:], where, column, lift)
        got = {k: child.fresh(k) for k in ("reasons", *_PAYLOAD)}
        child.df = child.df.withColumns({got[k]: below[k] for k in got})
        r = F.col(got["reasons"])
        kept = ~((r > 0) & (r.bitwiseAND(F.lit(~DROPS[lift] & 0xFF)) == 0))
        up = {"n": F.sum, "k": F.sum, "sum": F.sum, "odd": F.sum, "near": F.sum, "lo": F.min, "hi": F.max, "bad": F.bit_or}
        sums = {"reasons": F.bit_or(F.when(kept, r)), "kept": F.count_if(kept)} | {k: f(F.when(kept, F.col(got[k]))) for k, f in up.items()}
    name = frame.fresh("pool")
    fk = [F.col(c).alias(f"{name}fk{i}") for i, c in enumerate(down.rel.columns)]
    grouped = child.df.groupBy(*fk).agg(*[c.alias(name + k) for k, c in sums.items()])
    closed = closedness(frame, Exists((), down, 1, where if last else ()), coverage)
    on = reduce(lambda a, b: a & b, [same_key(F.col(c), F.col(f"{name}fk{i}")) for i, c in enumerate(down.rel.parent_columns)])
    frame.df = frame.df.join(grouped, on, "left")
    why = F.when(closed["out"], BIT["OUT_OF_SCOPE"]).when(closed["closed"], 0).otherwise(closed["why"])
    reasons = F.coalesce(F.col(name + "reasons"), F.lit(0)).bitwiseOR(why)
    if not last:
        reasons = reasons.bitwiseOR(F.when(F.coalesce(F.col(name + "kept"), F.lit(0)) == 0, BIT["NOT_COVERED"]).otherwise(0))
    zero = {k: F.coalesce(F.col(name + k), F.lit(0)) for k in ("n", "k", "odd", "bad")}
    kept_names = {"reasons": reasons, **zero, "sum": F.col(name + "sum"), "near": F.col(name + "near"), "lo": F.col(name + "lo"), "hi": F.col(name + "hi")}
    out = {k: frame.fresh("p" + k) for k in kept_names}
    frame.df = frame.df.withColumns({out[k]: c for k, c in kept_names.items()})
    return {k: F.col(v) for k, v in out.items()}


def materialised(frame: Frame, members: Column, made: Variable) -> DataFrame:
    """(excluded, val, n): how many of the units have each value, and how many are left out for which bits."""
    return frame.df.where(members).groupBy(made.x.alias("excluded"), made.val.alias("val")).agg(F.count(F.lit(1)).alias("n"))


def joint(frame: Frame, members: Column, variables: list[Variable]) -> DataFrame:
    """One row: units with any value, and the others by the union of their reasons' bits."""
    some = reduce(lambda a, b: a | b, [v.x == 0 for v in variables])
    bits = reduce(lambda a, b: a.bitwiseOR(b), [v.x for v in variables])
    left = frame.df.where(members)
    return left.agg(F.count_if(some).alias("n_any"), F.count_if(~some).alias("n_none"), *[F.count_if(~some & (F.shiftright(bits, i).bitwiseAND(F.lit(1)) == 1)).alias(f"x_{r.lower()}") for i, r in enumerate(REASONS)])


def rows_distribution(frame: Frame, members: Column, path: tuple[Step, ...], column: str, where: tuple[Clause, ...] = ()) -> DataFrame:
    """(val, n) over the rows that the units reach; a row counts once for each way to it."""
    rows = frame.df.where(members).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(path[0].rel.parent_columns)])
    for depth, step in enumerate(path):
        last = depth == len(path) - 1
        child = Frame(frame.release, step.end)
        clauses = [child.truth(c) for c in where] if last else []
        coverage = frame.release.covered_by(step.rel)
        if coverage.record_filter is not None:
            clauses.append(child.truth(coverage.record_filter))
        w = child.keep(all_of(clauses))
        wanted = [column] if last else list(path[depth + 1].rel.parent_columns)
        right = child.df.where(w.v == TRUE).select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(step.rel.columns)], *[F.col(c).alias(f"_k{i}" if not last else "val") for i, c in enumerate(wanted)])
        on = reduce(lambda a, b: a & b, [rows[f"_k{i}"] == right[f"_f{i}"] for i in range(len(step.rel.columns))])
        rows = rows.join(right, on).select(*[right[c] for c in right.columns if not c.startswith("_f")])
    return rows.groupBy("val").agg(F.count(F.lit(1)).alias("n"))


def memberships(frame: Frame, members: Column, down: Step, column: str, categories: tuple[str, ...] = (), where: tuple[Clause, ...] = ()) -> DataFrame:
    """(category, n_true, n_known): units with some row of each category, among those whose answer is known.

    A default answer for each unit (what a category none of its rows holds would get) and the pairs
    (unit, category) whose answer is true or differs from it: never units times categories.
    """
    coverage = frame.release.covered_by(down.rel)
    child = Frame(frame.release, down.end)
    clauses = [child.truth(c) for c in where] + ([child.truth(coverage.record_filter)] if coverage.record_filter is not None else [])
    w = child.keep(all_of(clauses))
    definition = child.release.tables[down.end].columns[column]
    state = state_of(child.df, definition)
    vague = (w.v == UNKNOWN) | ((w.v == TRUE) & ~state.isin(PRESENT, NOT_APPLICABLE))
    fk = [F.col(c).alias(f"_f{i}") for i, c in enumerate(down.rel.columns)]
    closed = closedness(frame, Exists((), down, 1), coverage)
    blurred = child.df.where(vague).select(*fk).distinct().withColumn("_vague", F.lit(True))
    on = [F.col(c) == F.col(f"_f{i}") for i, c in enumerate(down.rel.parent_columns)]
    frame.df = frame.df.withColumns({"_open": ~closed["closed"] | closed["out"]}).join(blurred, reduce(lambda a, b: a & b, on), "left").drop(*[f"_f{i}" for i in range(len(fk))])
    units = frame.df.where(members).select(*[F.col(c).alias(f"_u{i}") for i, c in enumerate(down.rel.parent_columns)], (F.col("_open") | F.coalesce(F.col("_vague"), F.lit(False))).alias("_unsure"))
    held = child.df.where((w.v == TRUE) & (state == PRESENT)).select(*fk, F.col(column).alias("category")).distinct()
    pairs = units.join(held, reduce(lambda a, b: a & b, [F.col(f"_u{i}") == F.col(f"_f{i}") for i in range(len(fk))]))
    total = units.agg(F.count_if(~F.col("_unsure"))).first()[0]
    counted = pairs.groupBy("category").agg(F.count(F.lit(1)).alias("n_true"), F.count_if("_unsure").alias("extra"))
    listed = frame.df.sparkSession.createDataFrame([(c,) for c in categories], "category string") if categories else counted.select("category")
    return listed.join(counted, "category", "left").select("category", F.coalesce("n_true", F.lit(0)).alias("n_true"), (F.lit(total) + F.coalesce("extra", F.lit(0))).alias("n_known"))
