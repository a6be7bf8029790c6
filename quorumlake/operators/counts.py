"""Counts over units: accounting, crossings of cohorts with predicates, shared units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.compile import Frame
from quorumlake.operators.truth import FALSE, REASONS, TRUE, UNKNOWN, Truth, any_of
from quorumlake.plans.clauses import All, Clause, flipped, has_lift

#: Reasons an answer can be unknown for; the other two only exclude from analyses.
ANSWER_REASONS = REASONS[:6]


def accounting_columns(truth: Truth, prefix: str = "") -> list[Column]:
    """One pass over the units: counts by answer, unknown ones by reason, and all flags."""
    columns = [F.count_if(truth.v == TRUE).alias(f"{prefix}n_true"), F.count_if(truth.v == FALSE).alias(f"{prefix}n_false"), F.count_if(truth.v == UNKNOWN).alias(f"{prefix}n_unknown")]
    for i, reason in enumerate(ANSWER_REASONS):
        columns.append(F.count_if((truth.v == UNKNOWN) & (F.shiftright(truth.r, i).bitwiseAND(F.lit(1)) == 1)).alias(f"{prefix}u_{reason.lower()}"))
    return [*columns, F.coalesce(F.bit_or(truth.m), F.lit(0)).alias(f"{prefix}flags")]


def account(frame: Frame, clause: Clause) -> DataFrame:
    """One row: a cohort's accounting, unknown units by top-level clause, and how many answers a lift changes."""
    truth = frame.truth(clause)
    columns = accounting_columns(truth)
    for i, part in enumerate(clause.members if isinstance(clause, All) else ()):
        columns.append(F.count_if((truth.v == UNKNOWN) & (frame.truth(part).v == UNKNOWN)).alias(f"unknown_in_{i}"))
    differs = F.lit(0).cast("bigint")
    if has_lift(clause):
        differs = F.count_if(frame.truth(flipped(clause)).v != truth.v)
    return frame.df.agg(*columns, differs.alias("lift_differs"))


def selected(frame: Frame, clause: Clause) -> DataFrame:
    """The unit rows whose answer is true, with the table's own columns."""
    names = frame.release.tables[frame.table].frame.columns
    truth = frame.truth(clause)
    return frame.df.where(truth.v == TRUE).select(*names)


def crossing(frame: Frame, cohorts: dict[str, Clause], predicates: list[Clause]) -> DataFrame:
    """(cohort, predicate, v, r, n): how many units of each cohort answer each predicate so.

    Units in no cohort are dropped, then one aggregation over grouping sets counts all
    predicates; its size doesn't depend on the units.
    """
    members = {name: frame.truth(c) for name, c in cohorts.items()}
    answers = [frame.truth(p) for p in predicates]
    df = frame.df.where(reduce(lambda a, b: a | b, [m.v == TRUE for m in members.values()]))
    inside = F.array_compact(F.array(*[F.when(m.v == TRUE, F.lit(name)) for name, m in members.items()]))
    df = df.select(F.explode(inside).alias("cohort"), *[c.alias(f"{k}{i}") for i, a in enumerate(answers) for k, c in (("v", a.v), ("r", a.r))])
    sets = [["cohort", f"v{i}", f"r{i}"] for i in range(len(answers))]
    names = list(dict.fromkeys(c for s in sets for c in s))
    counted = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(f"v{i}").alias(f"g{i}") for i in range(len(answers))])
    which = reduce(lambda rest, i: F.when(F.col(f"g{i}") == 0, i).otherwise(rest), range(len(answers)), F.lit(None))
    pick = {k: reduce(lambda rest, i, k=k: F.when(F.col(f"g{i}") == 0, F.col(f"{k}{i}")).otherwise(rest), range(len(answers)), F.lit(None)) for k in "vr"}
    return counted.select("cohort", which.alias("predicate"), pick["v"].alias("v"), pick["r"].alias("r"), "n")


def shared_units(frame: Frame, cohorts: dict[str, Clause]) -> DataFrame:
    """(a, b, n) for each pair of cohorts: units that are in both. One aggregation."""
    truths = {name: frame.truth(c) for name, c in cohorts.items()}
    names = list(truths)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = frame.df.agg(*[F.count_if((truths[a].v == TRUE) & (truths[b].v == TRUE)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def population(frame: Frame, cohorts: dict[str, Clause]) -> Truth:
    """The union of cohorts as one answer."""
    return any_of([frame.truth(c) for c in cohorts.values()])
