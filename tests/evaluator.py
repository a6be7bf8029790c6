"""The meaning of clauses, row by row in plain Python: what the compiled plans are held to."""

from __future__ import annotations

from collections import defaultdict
from itertools import product

from quorumlake.operators.truth import BIT
from quorumlake.plans.clauses import All, Any_, Covered, Exists, Ids, Known, Not, Unknown, Value, asks

F, U, T = 0, 1, 2
DROP = {None: 0, "strict": BIT["OUT_OF_SCOPE"], "assessed": BIT["OUT_OF_SCOPE"] | BIT["NOT_COVERED"]}


def both(values, v):
    r = 0
    for x in values:
        r |= x[1] if x[0] == U else 0
    m = 0
    for x in values:
        m |= x[2] if x[0] == v else 0
    return v, r if v == U else 0, m


def bits(values, k):
    out = 0
    for x in values:
        out |= x[k]
    return out


class Evaluator:
    def __init__(self, release):
        self.release = release
        self.rows = {n: [r.asDict() for r in t.frame.collect()] for n, t in release.tables.items()}
        self.children = {}
        for rel in release.relationships:
            index = defaultdict(list)
            for row in self.rows[rel.child]:
                key = tuple(row[c] for c in rel.columns)
                if None not in key:
                    index[key].append(row)
            self.children[rel.id] = index

    def up(self, ups, row):
        for step in ups:
            key = tuple(row[c] for c in step.rel.columns)
            found = [p for p in self.rows[step.end] if tuple(p[c] for c in step.rel.parent_columns) == key and None not in key]
            if not found:
                return None
            row = found[0]
        return row

    def state(self, row, column):
        if row.get(column.state) not in (None, "PRESENT"):
            return row[column.state]
        return "UNKNOWN" if row[column.name] is None else "PRESENT"

    def truth(self, c, row):
        if isinstance(c, All | Any_):
            values = [self.truth(m, row) for m in c.members]
            if not values:
                return (T if isinstance(c, All) else F), 0, 0
            return both(values, (min if isinstance(c, All) else max)(x[0] for x in values))
        if isinstance(c, Not):
            v, r, m = self.truth(c.member, row)
            return 2 - v, r, m
        if isinstance(c, Known | Unknown):
            v, _, m = self.truth(c.member, row)
            return (T if (v == U) == isinstance(c, Unknown) else F), 0, m
        if isinstance(c, Value):
            row = self.up(c.ups, row)
            return (U, BIT["NO_PARENT"], 0) if row is None else self.value(c, row)
        if isinstance(c, Ids):
            return (T if tuple(row[k] for k in self.release.tables[c.table].key) in c.keys else F), 0, 0
        if isinstance(c, Covered):
            return self.covered(c.path, c, row)
        return self.exists(c, row)

    def value(self, c, row):
        state = self.state(row, c.column)
        if state != "PRESENT":
            v, r = {"NOT_APPLICABLE": (F, 0), "NOT_ASSESSED": (U, BIT["NOT_ASSESSED"])}.get(state, (U, BIT["NO_INFORMATION"]))
        else:
            x, r = row[c.column.name], 0
            tests = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
            order = c.column.permissible
            if c.values is not None:
                v = T if x in c.values else F
            elif c.column.datatype == "category" and x not in order:
                v, r = U, BIT["NO_INFORMATION"]
            else:
                at = order.index if c.column.datatype == "category" else lambda y: y
                v = T if all(tests[op](at(x), at(b)) for op, b in c.bounds) else F
        return (2 - v if c.negate else v), r, 0

    def scope(self, coverage, parent):
        return (T, 0, 0) if coverage.parent_scope is None else self.truth(coverage.parent_scope, parent)

    def closed(self, coverage, rel, parent, scope, allowed, every):
        if coverage.parents == "undeclared":
            return False, BIT["NO_INFORMATION"], False
        if coverage.parents == "all":
            return (True, 0, False) if scope[0] != U else (False, scope[1], False)
        key = tuple(parent[c] for c in rel.parent_columns)
        listed, tuples, whole = False, set(), False
        columns = [c for _, c in coverage.scope]
        for row in self.rows[coverage.table]:
            if tuple(row[c] for c in coverage.parent_columns) != key:
                continue
            entries = [(row, False)]
            if coverage.parents == "grouped":
                entries = [(g, bool(coverage.covers_all and g[coverage.covers_all])) for g in self.rows[coverage.groups] if g[coverage.groups_key] == row[coverage.group]]
            for g, e in entries:
                listed, whole = True, whole or e
                t = tuple(g[c] for c in columns)
                if None not in t:
                    tuples.add(t)
        if not columns:
            return listed, 0 if listed else BIT["NOT_COVERED"], False
        if whole:
            return True, 0, False
        if every:
            return (True, 0, True) if tuples else (False, BIT["NOT_COVERED"], False)
        at = [i for i, (c, _) in enumerate(coverage.scope) if c in allowed]
        have = {tuple(t[i] for i in at) for t in tuples}
        if all(c in have for c in product(*(allowed[coverage.scope[i][0]] for i in at))):
            return True, 0, len(at) < len(columns)
        return False, BIT["NOT_COVERED"], False

    def exists(self, c, row):
        rel, coverage = c.down.rel, self.release.covered_by(c.down.rel)
        parent = self.up(c.ups, row)
        if parent is None:
            return U, BIT["NO_PARENT"], 0
        scope = self.scope(coverage, parent)
        if scope[0] == F:
            return U, BIT["OUT_OF_SCOPE"], 0
        kept, dropped, conditions = [], [], []
        for child in self.children[rel.id][tuple(parent[k] for k in rel.parent_columns)]:
            if c.exclude_self and child is row:
                continue
            w = self.truth(All(c.where), child)
            if coverage.record_filter is not None:
                f = self.truth(coverage.record_filter, child)
                pair = [w, f] if c.least is not None else [(2 - f[0], f[1], f[2]), w]
                w = both(pair, (min if c.least is not None else max)(x[0] for x in pair))
            out = c.lift and w[0] == U and not w[1] & ~DROP[c.lift]
            (dropped if out else kept).append(w)
            if not out:
                conditions.append(self.truth(All(tuple(x for x in c.where if not asks(x))), child))
        allowed = {}
        for x in c.where:
            if isinstance(x, Value) and not x.ups and not x.negate and x.values is not None:
                allowed[x.column.name] = [v for v in allowed.get(x.column.name, x.values) if v in x.values]
        closed, why, restricted = self.closed(coverage, rel, parent, scope, allowed, c.least is None)
        return self.answer(c.least, c.lift, kept, dropped, conditions, closed, why, restricted, rel, coverage)

    def answer(self, least, lift, kept, dropped, conditions, closed, why, restricted, rel, coverage):
        partial, proposed = 1 << self.release.flag_bit(rel, 0), (1 << self.release.flag_bit(rel, 1)) if coverage.proposed else 0
        by = {v: [x for x in kept if x[0] == v] for v in (F, U, T)}
        marks = (partial if restricted else 0) | proposed
        unknown = lambda r: (U, r | (0 if closed else why), bits(by[U] + dropped, 2) | (0 if closed else proposed))
        if least is not None:
            if len(by[T]) >= least:
                return T, 0, bits(by[T], 2)
            if len(by[T]) + len(by[U]) >= least:
                return unknown(bits(by[U], 1))
            met = not lift or any(x[0] == T for x in conditions)
            if closed and met:
                return F, 0, bits(kept + dropped, 2) | marks
            return unknown(0 if met else BIT["NOT_COVERED"] | bits([x for x in conditions if x[0] == U], 1))
        if by[F]:
            return F, 0, bits(by[F], 2)
        if not kept:
            return unknown(BIT["NOT_COVERED" if lift else "NO_ROWS"])
        if by[U]:
            return unknown(bits(by[U], 1))
        return (T, 0, bits(kept + dropped, 2) | marks) if closed else unknown(0)

    def covered(self, path, c, row):
        ups = ()
        while not path[0].down:
            ups, path = (*ups, path[0]), path[1:]
        down, rest = path[0], path[1:]
        rel, coverage = down.rel, self.release.covered_by(down.rel)
        parent = self.up(ups, row)
        if parent is None:
            return U, BIT["NO_PARENT"], 0
        scope = self.scope(coverage, parent)
        if scope[0] == F:
            return U, BIT["OUT_OF_SCOPE"], 0
        partial, proposed = 1 << self.release.flag_bit(rel, 0), (1 << self.release.flag_bit(rel, 1)) if coverage.proposed else 0
        if not rest:
            closed, _, restricted = self.closed(coverage, rel, parent, scope, dict(c.scope), False)
            if closed:
                return T, 0, (partial if restricted else 0) | proposed
            if coverage.parents == "undeclared":
                return U, BIT["NO_INFORMATION"], 0
            return (U, scope[1], 0) if scope[0] == U else (F, 0, proposed)
        values = [self.covered(rest, c, child) for child in self.children[rel.id][tuple(parent[k] for k in rel.parent_columns)]]
        kept = [x for x in values if x[0] != U or x[1] & ~DROP[c.lift]]
        closed, why, restricted = self.closed(coverage, rel, parent, scope, {}, c.lift == "strict")
        marks = (partial if restricted else 0) | proposed
        unknown = lambda r: (U, r | (0 if closed else why), bits([x for x in values if x[0] == U], 2) | (0 if closed else proposed))
        by = {v: [x for x in kept if x[0] == v] for v in (F, U, T)}
        if not kept:
            return unknown(BIT["NOT_COVERED"])
        if c.lift == "strict":
            if by[F]:
                return F, 0, bits(by[F], 2)
            if by[U]:
                return unknown(bits(by[U], 1))
            return (T, 0, bits(values, 2) | marks) if closed else unknown(0)
        if closed and by[T]:
            return T, 0, bits(by[T], 2) | marks
        if closed and len(by[F]) == len(kept):
            return F, 0, bits(values, 2) | marks
        return unknown(bits(by[U], 1))
