"""Clauses to DataFrames.

Every table that a question touches is one working frame. Leaves and combinators
are columns of it; only a step along a relationship shuffles: down steps
aggregate the children by their foreign key, all questions over one relationship
in one aggregation, and lookups join the parent's few needed columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlake.model import NOT_APPLICABLE, NOT_ASSESSED, PRESENT, Coverage, Refusal, Release, state_of
from quorumlake.operators.truth import BIT, FALSE, TRUE, UNKNOWN, Truth, all_of, any_of, constant, known, not_, unknown
from quorumlake.plans.clauses import All, Any_, Clause, Covered, Exists, Ids, Known, Not, Unknown, Value, asks
from quorumlake.plans.graph import Step

#: Constants of a predicate up to which they are written into the plan; more are joined.
INLINE = 200
#: Reasons for which a lift leaves children out.
DROPS = {None: 0, "strict": BIT["OUT_OF_SCOPE"], "assessed": BIT["OUT_OF_SCOPE"] | BIT["NOT_COVERED"]}

#: Most constants that a document may list in one place.
MAX_CONSTANTS = 10_000


class Frame:
    """A table's working frame: its rows with the columns that clauses add."""

    _names = itertools.count()

    def __init__(self, release: Release, table: str, df: DataFrame | None = None):
        self.release, self.table = release, table
        self.df = release.tables[table].frame if df is None else df
        self.done: dict[object, object] = {}

    def fresh(self, stem: str) -> str:
        return f"_{stem}{next(self._names)}_"

    def keep(self, truth: Truth) -> Truth:
        """The answer as columns of the frame, so that it is computed once."""
        name = self.fresh("t")
        self.df = self.df.withColumns(dict(zip((f"{name}v", f"{name}r", f"{name}m"), (c for c in (truth.v.cast("int"), truth.r.cast("int"), truth.m.cast("long"))), strict=True)))
        return Truth.at(name)

    def looked_up(self, ups: Sequence[Step], columns: Sequence[str]) -> dict[str, Column]:
        """Columns of the row at the end of lookups, and ``found``."""
        prefix = self.fresh("up")
        keys: list[str] = list(ups[0].rel.columns)
        for i, step in enumerate(ups):
            parent = self.release.tables[step.end]
            last = i == len(ups) - 1
            wanted = list(columns) if last else list(ups[i + 1].rel.columns)
            here = f"{prefix}{i}_"
            have = [c for c in dict.fromkeys([*step.rel.parent_columns, *wanted]) if c in parent.frame.columns]
            right = parent.frame.select(*[F.col(c).alias(here + c) for c in have], F.lit(True).alias(here + "found"))
            kinds, above = dict(self.df.dtypes), dict(parent.frame.dtypes)
            on = reduce(lambda a, b: a & b, [same_key(F.col(k), F.col(here + c), (kinds[k], above[c])) for k, c in zip(keys, step.rel.parent_columns, strict=True)])
            self.df = self.df.join(right, on, "left")
            keys = [here + c for c in step.rel.columns] if last else [here + c for c in wanted]
        here = f"{prefix}{len(ups) - 1}_"
        return {c: F.col(here + c) for c in columns if here + c in self.df.columns} | {"found": F.coalesce(F.col(here + "found"), F.lit(False)), "prefix": here}

    # Clauses

    def truth(self, clause: Clause) -> Truth:
        if clause not in self.done:
            self.done[clause] = self._truth(clause)
        return self.done[clause]

    def _truth(self, clause: Clause) -> Truth:
        if isinstance(clause, All | Any_):
            self._ask_together([c for c in clause.members if isinstance(c, Exists)])
            operands = [self.truth(c) for c in clause.members]
            return (all_of if isinstance(clause, All) else any_of)(operands)
        if isinstance(clause, Not):
            return not_(self.truth(clause.member))
        if isinstance(clause, Known):
            return known(self.truth(clause.member))
        if isinstance(clause, Unknown):
            return unknown(self.truth(clause.member))
        if isinstance(clause, Value):
            return self.keep(self._value(clause))
        if isinstance(clause, Ids):
            return self.keep(self._ids(clause))
        if isinstance(clause, Exists):
            self._ask_together([clause])
            return self.done[clause]
        return self._covered(clause)

    def _value(self, leaf: Value) -> Truth:
        column, df_columns, prefix = leaf.column, self.df, ""
        found = None
        if leaf.ups:
            source = self.release.tables[leaf.table].frame
            extra = [c for c in (column.state, f"{column.name}__item_state") if c in source.columns]
            got = self.looked_up(leaf.ups, [column.name, *extra])
            prefix, found, df_columns = got["prefix"], got["found"], self.df
        if column.datatype == "list<category>":
            truth = self._list(leaf, prefix)
        else:
            truth = predicate(F.col(prefix + column.name), state_of(df_columns, column, prefix), leaf, self)
        if found is None:
            return truth
        missing = constant(UNKNOWN, BIT["NO_PARENT"])
        return Truth(*(F.when(found, a).otherwise(b) for a, b in ((truth.v, missing.v), (truth.r, missing.r), (truth.m, missing.m))))

    def _list(self, leaf: Value, prefix: str) -> Truth:
        """Item by item on the row: no explosion. An item's own state stands beside it where there are states."""
        name = prefix + leaf.column.name
        items, states = F.col(name), f"{name}__item_state"
        given = F.col(states) if states in self.df.columns else F.transform(items, lambda x: F.when(x.isNull(), "UNKNOWN").otherwise(PRESENT))
        hit = [F.lit(v) for v in leaf.values or ()]
        codes = F.zip_with(items, given, lambda x, s: F.when(s == PRESENT, F.when(x.isin(*hit), TRUE).otherwise(FALSE)).when(s == NOT_APPLICABLE, FALSE).otherwise(UNKNOWN))
        if leaf.negate:
            codes = F.transform(codes, lambda c: 2 - c)
        reasons = F.transform(given, lambda s: F.when(s == NOT_ASSESSED, BIT["NOT_ASSESSED"]).when(s.isin(PRESENT, NOT_APPLICABLE), 0).otherwise(BIT["NO_INFORMATION"]))
        joined = F.aggregate(reasons, F.lit(0), lambda a, b: a.bitwiseOR(b))
        v = F.array_max(codes) if leaf.match == "any" else F.array_min(codes)
        empty = FALSE if leaf.match == "any" else UNKNOWN
        v = F.when(F.size(items) == 0, empty).otherwise(v)
        r = F.when(v != UNKNOWN, 0).when(F.size(items) == 0, BIT["NO_ROWS"]).otherwise(joined)
        state = state_of(self.df, leaf.column, prefix)
        base = from_state(state)
        return Truth(F.when(state == PRESENT, v).otherwise(base.v), F.when(state == PRESENT, r).otherwise(base.r), F.lit(0).cast("long"))

    def _ids(self, leaf: Ids) -> Truth:
        key = self.release.tables[leaf.table].key
        if len(key) == 1 and len(leaf.keys) <= INLINE:
            hit = F.col(key[0]).isin([k[0] for k in leaf.keys])
        else:
            hit = self._listed([F.col(c) for c in key], leaf.keys)
        return Truth(F.when(hit, TRUE).otherwise(FALSE), F.lit(0), F.lit(0).cast("long"))

    def _listed(self, columns: list[Column], rows: Sequence[tuple]) -> Column:
        """Whether the columns are among constants, by a join: no more than MAX_CONSTANTS, so that they can be broadcast."""
        if len(rows) > MAX_CONSTANTS:
            raise Refusal("TOO_MANY_CONSTANTS", str(len(rows)))
        name = self.fresh("in")
        held = self.df.sparkSession.createDataFrame([tuple(r) for r in rows], [f"{name}{i}" for i in range(len(columns))]).distinct().withColumn(f"{name}hit", F.lit(True))
        on = reduce(lambda a, b: a & b, [same_key(c, F.col(f"{name}{i}")) for i, c in enumerate(columns)])
        self.df = self.df.join(F.broadcast(held), on, "left")
        return F.coalesce(F.col(f"{name}hit"), F.lit(False))

    # Existence

    def _ask_together(self, questions: list[Exists]) -> None:
        """Answers questions over one relationship from one aggregation of its children."""
        groups: dict[tuple, list[Exists]] = {}
        for q in questions:
            if q not in self.done:
                groups.setdefault((q.ups, q.down, q.exclude_self), []).append(q)
        for (ups, down, exclude_self), some in groups.items():
            some = list(dict.fromkeys(some))
            if exclude_self:
                for q in some:
                    self.done[q] = self._siblings(q)
            elif ups:
                answers = self._above(ups, some)
                self.done.update(zip(some, answers, strict=True))
            else:
                self._children(down, some)

    def _above(self, ups: tuple[Step, ...], questions: list[Exists]) -> list[Truth]:
        """Questions asked from a looked-up row: answered on its table once, then looked up."""
        top = Frame(self.release, ups[-1].end)
        bare = [Exists((), q.down, q.least, q.where, q.lift) for q in questions]
        top._ask_together(bare)
        names, answers = [], []
        for q in bare:
            name = self.fresh("a")
            top.df = top.df.withColumns(dict(zip((f"{name}v", f"{name}r", f"{name}m"), (top.done[q].v, top.done[q].r, top.done[q].m), strict=True)))
            names.append(name)
        key = self.release.tables[top.table].key or ups[-1].rel.parent_columns
        wanted = [f"{n}{c}" for n in names for c in "vrm"]
        right = top.df.select(*[F.col(k).alias(f"{names[0]}k{i}") for i, k in enumerate(key)], *wanted, F.lit(True).alias(f"{names[0]}found"))
        got = self.looked_up(ups, list(key))
        on = reduce(lambda a, b: a & b, [same_key(got[k], F.col(f"{names[0]}k{i}")) for i, k in enumerate(key)])
        self.df = self.df.join(right, on, "left")
        for n in names:
            found = F.coalesce(F.col(f"{names[0]}found"), F.lit(False))
            answers.append(self.keep(Truth(F.when(found, F.col(f"{n}v")).otherwise(UNKNOWN), F.when(found, F.col(f"{n}r")).otherwise(BIT["NO_PARENT"]), F.when(found, F.col(f"{n}m")).otherwise(0))))
        return answers

    def _children(self, down: Step, questions: list[Exists]) -> None:
        rel, coverage = down.rel, self.release.covered_by(down.rel)
        child = Frame(self.release, rel.child)
        sums: list[Column] = []
        plans = []
        for q in questions:
            stats = child._stats(q, coverage)
            name = self.fresh("x")
            sums += [c.alias(name + k) for k, c in stats.items()]
            plans.append((q, name))
        fk = [F.col(c).alias(f"{plans[0][1]}fk{i}") for i, c in enumerate(rel.columns)]
        grouped = child.df.groupBy(*fk).agg(*sums)
        kinds, below = dict(self.df.dtypes), dict(child.df.dtypes)
        on = reduce(lambda a, b: a & b, [same_key(F.col(c), F.col(f"{plans[0][1]}fk{i}"), (kinds[c], below[rel.columns[i]])) for i, c in enumerate(rel.parent_columns)])
        self.df = self.df.join(grouped, on, "left")
        for q, name in plans:
            self.done[q] = self.keep(self._answer(q, coverage, name))

    def _stats(self, q: Exists, coverage: Coverage) -> dict[str, Column]:
        """Aggregates over this (child) frame that an answer needs."""
        self._ask_together([c for c in q.where if isinstance(c, Exists)])
        w = all_of([self.truth(c) for c in q.where])
        if coverage.record_filter is not None:
            f = self.truth(coverage.record_filter)
            w = all_of([w, f]) if q.least is not None else any_of([not_(f), w])
        w = self.keep(w)
        conditions = [c for c in q.where if not asks(c)]
        met = self.keep(all_of([self.truth(c) for c in conditions])) if q.lift else constant(TRUE)
        return child_sums(w, met, q.lift)

    def _siblings(self, q: Exists) -> Truth:
        """The parent's other children: window totals less the row's own share, bit by bit."""
        if not q.ups or q.ups[-1].rel != q.down.rel or len(q.ups) != 1 or q.down.end != self.table:
            raise Refusal("EXCLUDE_SELF_NOT_ALLOWED", q.down.rel.id)
        rel, coverage = q.down.rel, self.release.covered_by(q.down.rel)
        parent = Frame(self.release, rel.parent)
        name = self.fresh("x")
        others = others_sums(self, q, coverage, rel.columns)
        self.df = self.df.withColumns({name + k: c for k, c in others.items()})
        closed = closedness(parent, q, coverage)
        key = [F.col(c).alias(f"{name}k{i}") for i, c in enumerate(rel.parent_columns)]
        right = parent.df.select(*key, *[c.alias(f"{name}c{k}") for k, c in closed.items()], F.lit(True).alias(f"{name}found"))
        on = reduce(lambda a, b: a & b, [same_key(F.col(c), F.col(f"{name}k{i}")) for i, c in enumerate(rel.columns)])
        self.df = self.df.join(right, on, "left")
        found = F.coalesce(F.col(f"{name}found"), F.lit(False))
        answer = self._answer(q, coverage, name, {k: F.col(f"{name}c{k}") for k in closed})
        return self.keep(Truth(F.when(found, answer.v).otherwise(UNKNOWN), F.when(found, answer.r).otherwise(BIT["NO_PARENT"]), F.when(found, answer.m).otherwise(0)))

    def _answer(self, q: Exists, coverage: Coverage, name: str, closed: dict[str, Column] | None = None) -> Truth:
        """The rule of one down step, from the children's sums and the parent's closedness."""
        n = {k: F.coalesce(F.col(name + k), F.lit(0)) for k in SUMS}
        closed = closed or closedness(self, q, coverage)
        is_closed, why, restricted, scoped_out = (closed[k] for k in ("closed", "why", "restricted", "out"))
        partial = F.lit(1 << self.release.flag_bit(q.down.rel, 0)).cast("long")
        proposed = F.lit((1 << self.release.flag_bit(q.down.rel, 1)) if coverage.proposed else 0).cast("long")
        zero = F.lit(0).cast("long")
        marks = F.when(restricted, partial).otherwise(zero).bitwiseOR(proposed)
        open_r = F.when(is_closed, 0).otherwise(why)
        open_m = F.when(is_closed, zero).otherwise(proposed).bitwiseOR(n["mu"])
        if q.least is not None:
            short = F.when(n["met"] > 0, 0).otherwise(n["rc"].bitwiseOR(F.lit(BIT["NOT_COVERED"]))) if q.lift else F.lit(0)
            nothing = is_closed & (n["met"] > 0) if q.lift else is_closed
            v = F.when(n["t"] >= q.least, TRUE).when(n["t"] + n["u"] >= q.least, UNKNOWN).when(nothing, FALSE).otherwise(UNKNOWN)
            r = F.when(v != UNKNOWN, 0).when(n["t"] + n["u"] >= q.least, n["ru"].bitwiseOR(open_r)).otherwise(short.bitwiseOR(open_r))
            m = F.when(v == TRUE, n["mt"]).when(v == FALSE, n["ma"].bitwiseOR(marks)).otherwise(open_m)
        else:
            kept = n["t"] + n["f"] + n["u"]
            v = F.when(n["f"] > 0, FALSE).when(kept == 0, UNKNOWN).when(n["u"] > 0, UNKNOWN).when(is_closed, TRUE).otherwise(UNKNOWN)
            none = BIT["NOT_COVERED"] if q.lift else BIT["NO_ROWS"]
            r = F.when(v != UNKNOWN, 0).when(kept == 0, F.lit(none).bitwiseOR(open_r)).when(n["u"] > 0, n["ru"].bitwiseOR(open_r)).otherwise(open_r)
            m = F.when(v == FALSE, n["mf"]).when(v == TRUE, n["ma"].bitwiseOR(marks)).otherwise(open_m)
        return Truth(F.when(scoped_out, UNKNOWN).otherwise(v), F.when(scoped_out, BIT["OUT_OF_SCOPE"]).otherwise(r), F.when(scoped_out, zero).otherwise(m))

    # Coverage as a predicate

    def _covered(self, leaf: Covered) -> Truth:
        ups = tuple(itertools.takewhile(lambda s: not s.down, leaf.path))
        down, rest = leaf.path[len(ups)], leaf.path[len(ups) + 1 :]
        coverage = self.release.covered_by(down.rel)
        here = self if not ups else Frame(self.release, down.start)
        proposed = F.lit((1 << self.release.flag_bit(down.rel, 1)) if coverage.proposed else 0).cast("long")
        partial = F.lit(1 << self.release.flag_bit(down.rel, 0)).cast("long")
        zero = F.lit(0).cast("long")
        if not rest:
            closed = closedness(here, Exists((), down, 1), coverage, dict(leaf.scope))
            v = F.when(closed["closed"], TRUE).when(F.lit(coverage.parents == "undeclared") | (closed["scope_r"] > 0), UNKNOWN).otherwise(FALSE)
            r = F.when(v == UNKNOWN, F.when(F.lit(coverage.parents == "undeclared"), BIT["NO_INFORMATION"]).otherwise(closed["scope_r"])).otherwise(0)
            m = F.when(v == TRUE, F.when(closed["restricted"], partial).otherwise(zero).bitwiseOR(proposed)).when(v == FALSE, proposed).otherwise(zero)
        else:
            child = Frame(self.release, down.end)
            inner = child.truth(Covered(rest, leaf.scope, leaf.lift))
            sums = child_sums(child.keep(inner), constant(TRUE), leaf.lift)
            name = self.fresh("x")
            fk = [F.col(c).alias(f"{name}fk{i}") for i, c in enumerate(down.rel.columns)]
            grouped = child.df.groupBy(*fk).agg(*[c.alias(name + k) for k, c in sums.items()])
            here.df = here.df.join(grouped, reduce(lambda a, b: a & b, [same_key(F.col(c), F.col(f"{name}fk{i}")) for i, c in enumerate(down.rel.parent_columns)]), "left")
            n = {k: F.coalesce(F.col(name + k), F.lit(0)) for k in SUMS}
            closed = closedness(here, Exists((), down, None if leaf.lift == "strict" else 1), coverage, {})
            kept, is_closed = n["t"] + n["f"] + n["u"], closed["closed"]
            marks = F.when(closed["restricted"], partial).otherwise(zero).bitwiseOR(proposed)
            if leaf.lift == "strict":
                v = F.when(kept == 0, UNKNOWN).when(n["f"] > 0, FALSE).when(n["u"] > 0, UNKNOWN).when(is_closed, TRUE).otherwise(UNKNOWN)
                m = F.when(v == FALSE, n["mf"]).when(v == TRUE, n["ma"].bitwiseOR(marks))
            else:
                v = F.when(kept == 0, UNKNOWN).when(is_closed & (n["t"] > 0), TRUE).when(is_closed & (n["f"] == kept), FALSE).otherwise(UNKNOWN)
                m = F.when(v == TRUE, n["mt"].bitwiseOR(marks)).when(v == FALSE, n["ma"].bitwiseOR(marks))
            open_r = F.when(is_closed, 0).otherwise(closed["why"])
            r = F.when(v != UNKNOWN, 0).when(kept == 0, F.lit(BIT["NOT_COVERED"]).bitwiseOR(open_r)).otherwise(n["ru"].bitwiseOR(open_r))
            m = m.otherwise(F.when(is_closed, zero).otherwise(proposed).bitwiseOR(n["mu"]))
        out = closed["out"]
        answer = here.keep(Truth(F.when(out, UNKNOWN).otherwise(v), F.when(out, BIT["OUT_OF_SCOPE"]).otherwise(r), F.when(out, zero).otherwise(m)))
        if not ups:
            return answer
        name = self.fresh("c")
        key = self.release.tables[here.table].key
        right = here.df.select(*[F.col(k).alias(f"{name}k{i}") for i, k in enumerate(key)], *answer.named(name), F.lit(True).alias(f"{name}found"))
        got = self.looked_up(ups, list(key))
        self.df = self.df.join(right, reduce(lambda a, b: a & b, [same_key(got[k], F.col(f"{name}k{i}")) for i, k in enumerate(key)]), "left")
        found = F.coalesce(F.col(f"{name}found"), F.lit(False))
        a = Truth.at(name)
        return self.keep(Truth(F.when(found, a.v).otherwise(UNKNOWN), F.when(found, a.r).otherwise(BIT["NO_PARENT"]), F.when(found, a.m).otherwise(0)))


#: What a question needs of its children: counts by answer, children that meet the conditions, reasons, flags.
SUMS = ("t", "f", "u", "met", "ru", "rc", "mt", "mf", "mu", "ma")


def child_sums(w: Truth, met: Truth, lift: str | None) -> dict[str, Column]:
    drop = DROPS[lift]
    dropped = (w.v == UNKNOWN) & (w.r.bitwiseAND(F.lit(~drop & 0xFF)) == 0) if drop else F.lit(False)
    kept = ~dropped
    return {
        "t": F.count_if(w.v == TRUE),
        "f": F.count_if(w.v == FALSE),
        "u": F.count_if((w.v == UNKNOWN) & kept),
        "met": F.count_if(kept & (met.v == TRUE)),
        "ru": F.bit_or(F.when((w.v == UNKNOWN) & kept, w.r)),
        "rc": F.bit_or(F.when(kept & (met.v == UNKNOWN), met.r)),
        "mt": F.bit_or(F.when(w.v == TRUE, w.m)),
        "mf": F.bit_or(F.when(w.v == FALSE, w.m)),
        "mu": F.bit_or(F.when(w.v == UNKNOWN, w.m)),
        "ma": F.bit_or(w.m),
    }


def others_sums(frame: Frame, q: Exists, coverage: Coverage, fk: Sequence[str]) -> dict[str, Column]:
    """The same sums over a row's siblings: each is a count by bit over the group less the row's own."""
    w = all_of([frame.truth(c) for c in q.where])
    if coverage.record_filter is not None:
        f = frame.truth(coverage.record_filter)
        w = all_of([w, f]) if q.least is not None else any_of([not_(f), w])
    w = frame.keep(w)
    group = Window.partitionBy(*fk)

    def count(test: Column) -> Column:
        one = F.when(test, 1).otherwise(0)
        return F.sum(one).over(group) - one

    def bits(test: Column, value: Column, width: int) -> Column:
        found = [F.when(count(test & (F.shiftright(value, b).bitwiseAND(F.lit(1)) == 1)) > 0, F.lit(1 << b)).otherwise(0) for b in range(width)]
        return reduce(lambda a, b: a.bitwiseOR(b), found)

    flags = 2 * len(frame.release.relationships)
    everyone = F.lit(True)
    return {
        "t": count(w.v == TRUE), "f": count(w.v == FALSE), "u": count(w.v == UNKNOWN), "met": count(everyone), "ru": bits(w.v == UNKNOWN, w.r, 6), "rc": F.lit(0),
        "mt": bits(w.v == TRUE, w.m, flags), "mf": bits(w.v == FALSE, w.m, flags), "mu": bits(w.v == UNKNOWN, w.m, flags), "ma": bits(everyone, w.m, flags),
    }


def admitted(q: Exists) -> dict[str, tuple]:
    """The values that a question's own conditions admit on each column of the child."""
    found: dict[str, tuple] = {}
    for c in q.where:
        if isinstance(c, Value) and not c.ups and not c.negate and c.values is not None and c.table == q.down.end:
            name = c.column.name
            found[name] = tuple(v for v in found[name] if v in c.values) if name in found else c.values
    return found


def closedness(frame: Frame, q: Exists, coverage: Coverage, given: dict[str, tuple] | None = None) -> dict[str, Column]:
    """Columns of the parent's frame: closed, why not (reasons), restricted, out (of scope), scope_r."""
    rel = q.down.rel
    scope = frame.truth(coverage.parent_scope) if coverage.parent_scope is not None else constant(TRUE)
    out = {"out": scope.v == FALSE, "scope_r": F.when(scope.v == UNKNOWN, scope.r).otherwise(0)}
    false = F.lit(False)
    if coverage.parents == "undeclared":
        return out | {"closed": false, "why": F.lit(BIT["NO_INFORMATION"]), "restricted": false}
    if coverage.parents == "all":
        return out | {"closed": scope.v == TRUE, "why": out["scope_r"], "restricted": false}
    allowed = admitted(q) if given is None else given
    mentioned = [pair for pair in coverage.scope if pair[0] in allowed]
    name = frame.fresh("l")
    listing = _listing(frame.release, coverage, mentioned, {c: allowed[c] for c, _ in mentioned}, name)
    on = reduce(lambda a, b: a & b, [same_key(F.col(c), F.col(f"{name}p{i}")) for i, c in enumerate(rel.parent_columns)])
    frame.df = frame.df.join(listing, on, "left")
    listed = F.coalesce(F.col(f"{name}listed"), F.lit(False))
    why = F.lit(BIT["NOT_COVERED"])
    if not coverage.scope:
        return out | {"closed": listed, "why": why, "restricted": false}
    every = F.coalesce(F.col(f"{name}every"), F.lit(False))
    some = F.coalesce(F.col(f"{name}tuples"), F.lit(0)) > 0
    if q.least is None:
        return out | {"closed": every | some, "why": why, "restricted": ~every & some}
    wanted = 1
    for c, _ in mentioned:
        wanted *= len(allowed[c])
    enough = F.lit(True) if wanted == 0 else some if not mentioned else F.coalesce(F.col(f"{name}combos"), F.lit(0)) >= wanted
    partial = F.lit(len(mentioned) < len(coverage.scope))
    return out | {"closed": every | enough, "why": why, "restricted": ~every & enough & partial}


def _listing(release: Release, coverage: Coverage, mentioned: list, allowed: dict[str, tuple], name: str) -> DataFrame:
    """By parent: listed, every, tuples, combos (distinct admitted combinations of the mentioned columns)."""
    base = release.tables[coverage.table].frame
    parents = [F.col(c).alias(f"{name}p{i}") for i, c in enumerate(coverage.parent_columns)]
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in coverage.parent_columns])
    scope = [c for _, c in coverage.scope]
    if coverage.parents == "grouped":
        groups = release.tables[coverage.groups].frame
        every = F.col(coverage.covers_all) if coverage.covers_all else F.lit(False)
        inner = groups.select(F.col(coverage.groups_key).alias(f"{name}g"), F.coalesce(every, F.lit(False)).alias(f"{name}e"), *[F.col(c).alias(f"{name}s{i}") for i, c in enumerate(scope)])
        rows = base.where(keyed).select(*parents, F.col(coverage.group).alias(f"{name}h")).join(inner, F.col(f"{name}h") == F.col(f"{name}g"))
    else:
        rows = base.where(keyed).select(*parents, F.lit(False).alias(f"{name}e"), *[F.col(c).alias(f"{name}s{i}") for i, c in enumerate(scope)])
    s = {child: F.col(f"{name}s{i}") for i, (child, _) in enumerate(coverage.scope)}
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in s.values()], F.lit(True))
    inside = reduce(lambda a, b: a & b, [s[c].isin(list(allowed[c])) for c, _ in mentioned], whole)
    combos = F.count_distinct(F.when(inside, F.struct(*[s[c] for c, _ in mentioned]))) if mentioned else F.lit(0)
    return rows.groupBy(*[F.col(f"{name}p{i}") for i in range(len(parents))]).agg(
        F.lit(True).alias(f"{name}listed"), F.bool_or(f"{name}e").alias(f"{name}every"), F.count_if(whole).alias(f"{name}tuples"), combos.alias(f"{name}combos")
    )


# Predicates on one cell


def from_state(state: Column) -> Truth:
    """What a cell that isn't present answers."""
    v = F.when(state == NOT_APPLICABLE, FALSE).otherwise(UNKNOWN)
    r = F.when(state == NOT_APPLICABLE, 0).when(state == NOT_ASSESSED, BIT["NOT_ASSESSED"]).otherwise(BIT["NO_INFORMATION"])
    return Truth(v, r, F.lit(0).cast("long"))


def predicate(cell: Column, state: Column, leaf: Value, frame: Frame | None = None) -> Truth:
    present = state == PRESENT
    base = from_state(state)
    listed = F.lit(True)
    if leaf.values is not None:
        hit = cell.isin(list(leaf.values)) if frame is None or len(leaf.values) <= INLINE else frame._listed([cell], [(v,) for v in leaf.values])
    elif leaf.column.datatype == "category":
        order = {v: i for i, v in enumerate(leaf.column.permissible)}
        within = [v for v, i in order.items() if all(_holds(op, i, order[c]) for op, c in leaf.bounds)]
        hit, listed = cell.isin(within) if within else F.lit(False), cell.isin(list(order))
    else:
        tests = {"gt": lambda c: cell > c, "gte": lambda c: cell >= c, "lt": lambda c: cell < c, "lte": lambda c: cell <= c}
        hit = reduce(lambda a, b: a & b, [tests[op](F.lit(c)) for op, c in leaf.bounds])
    v = F.when(~present, base.v).when(~listed, UNKNOWN).when(hit, TRUE).otherwise(FALSE)
    if leaf.negate:
        v = 2 - v
    r = F.when(~present, base.r).when(~listed, BIT["NO_INFORMATION"]).otherwise(0)
    return Truth(v, r, F.lit(0).cast("long"))


def _holds(op: str, a: int, b: int) -> bool:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


_NUMERIC = {"bigint", "int", "smallint", "tinyint", "double", "float"}


def same_key(a: Column, b: Column, kinds: tuple[str | None, str | None] = (None, None)) -> Column:
    """Equality of key values.

    Integers meet doubles exactly, where a plain comparison would round the integer;
    values of different families are never equal. Of one type it is a plain equality.
    """
    ka, kb = kinds
    if ka is None or kb is None or ka == kb or {ka, kb} <= _NUMERIC - {"double", "float"}:
        return a == b
    if {ka, kb} <= _NUMERIC:
        whole, real = (a, b) if kb in ("double", "float") else (b, a)
        return (a == b) & (real.cast("bigint") == whole)
    return F.lit(False)
