"""Documents in, results out: cohort counts, crossings, members and analyses over a release."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake import disclosure, ids
from quorumlake.functions import stats, survival
from quorumlake.model import Endpoint, Refusal, Release
from quorumlake.operators import counts
from quorumlake.operators.compile import Frame
from quorumlake.operators.truth import BIT, REASONS, TRUE, Truth
from quorumlake.operators.variables import Variable, joint, materialised, variable
from quorumlake.plans.clauses import Clause
from quorumlake.plans.document import MAX_PREDICATES, MAX_VARIABLES, Document, parse
from quorumlake.plans.resolve import Resolver

MIN_GROUP_N, MIN_EVENTS, EVENTS_PER_TERM, PH_LEVEL = 10, 5, 10, 0.05
MAX_CATEGORIES, BINS, MAX_PAGE = 150, 10, 1_000

#: Analyses that packs add: name -> function of (engine, document, view).
Analysis = Callable[["Engine", Document, Mapping[str, Any]], dict]


class Engine:
    def __init__(self, release: Release, leaf_kinds: Mapping[str, Callable[[Mapping], Any]] | None = None, analyses: Mapping[str, Analysis] | None = None, least: int = 0):
        """``least``: counts from 1 to least - 1 are not disclosed; 0 discloses all."""
        self.release, self.leaf_kinds, self.least = release, leaf_kinds or {}, least
        self.analyses: dict[str, Analysis] = {
            "compare.existence": Engine.compare_existence, "summary.distribution": Engine.summary_distribution, "compare.columns": Engine.compare_columns,
            "summary.members": Engine.summary_members, "survival.km": Engine.survival_km, "survival.cox": Engine.survival_cox,
        } | dict(analyses or {})

    # Plans

    def resolver(self, document: Document) -> Resolver:
        return Resolver(self.release, document.unit, document.cohorts, self.leaf_kinds)

    def cohorts(self, document: str | Mapping | Document, names: list[str] | None = None) -> tuple[Document, Frame, dict[str, Clause]]:
        doc = document if isinstance(document, Document) else parse(document)
        if doc.dataset != self.release.name:
            raise Refusal("UNKNOWN_DATASET", doc.dataset)
        made = self.resolver(doc)
        return doc, Frame(self.release, doc.unit), {n: made.cohort(n) for n in names or doc.cohorts}

    def count(self, document: str | Mapping, name: str) -> DataFrame:
        """One row: the cohort's accounting."""
        _, frame, clauses = self.cohorts(document, [name])
        return counts.account(frame, clauses[name])

    def answers(self, document: str | Mapping) -> DataFrame:
        """Every unit's key with each cohort's answer: <cohort>_v and <cohort>_r."""
        doc, frame, clauses = self.cohorts(document)
        truths = {n: frame.truth(c) for n, c in clauses.items()}
        return frame.df.select(*self.release.tables[doc.unit].key, *[c.cast("int").alias(f"{n}_{k}") for n, t in truths.items() for k, c in (("v", t.v), ("r", t.r))])

    def units(self, document: str | Mapping, name: str) -> DataFrame:
        """The unit rows of a cohort."""
        _, frame, clauses = self.cohorts(document, [name])
        return counts.selected(frame, clauses[name])

    def explain(self, document: str | Mapping) -> dict[str, dict[str, str]]:
        """Each cohort's id and what it says."""
        doc, _, clauses = self.cohorts(document)
        return {n: {"id": ids.cohort_id(doc.dataset, doc.unit, c), "says": ids.readback(c)} for n, c in clauses.items()}

    # Tools

    def count_cohort(self, document: str | Mapping, name: str) -> dict:
        row = self.count(document, name).first().asDict()
        shown = disclosure.suppressed_counts(row["n_true"], row["n_false"], row["n_unknown"], self.least)
        hidden = shown != (row["n_true"], row["n_false"], row["n_unknown"])
        known = row["n_true"] + row["n_false"]
        reasons = {r: row[f"u_{r.lower()}"] for r in counts.ANSWER_REASONS if row[f"u_{r.lower()}"]}
        caveats = [c for c, on in (("UNKNOWN_EXCLUDED", row["n_unknown"]), ("LIFT_DIFFERS", row["lift_differs"]), ("SUPPRESSED", hidden)) if on]
        for kind, code in enumerate(("SCOPE_PARTIAL", "COVERAGE_PROPOSED")):
            if any(row["flags"] >> self.release.flag_bit(rel, kind) & 1 for rel in self.release.relationships):
                caveats.append(code)
        size = None if hidden or not known else {"k": row["n_true"], "n": known, "share": row["n_true"] / known, "interval": stats.wilson(row["n_true"], known)}
        return {"n_true": shown[0], "n_false": shown[1], "n_unknown": shown[2], "unknown_by_reason": {} if hidden else reasons, "size": size, "caveats": caveats}

    def run(self, document: str | Mapping) -> dict:
        """A document's cohorts counted and its views run."""
        doc, _, _ = self.cohorts(document)
        out = {"cohorts": {n: self.count_cohort(document, n) for n in doc.cohorts}, "views": []}
        for view in doc.views:
            if view.get("analysis") not in self.analyses:
                raise Refusal("UNKNOWN_ANALYSIS", str(view.get("analysis")))
            values = self.analyses[view["analysis"]](self, doc, view)
            out["views"].append({"analysis": view["analysis"], "values": values, "digest": ids.hashed(_plain(values))})
        return out

    def _view(self, doc: Document, view: Mapping[str, Any]) -> tuple[Frame, dict[str, Truth], Resolver]:
        names = view.get("cohorts") or list(doc.cohorts)
        _, frame, clauses = self.cohorts(doc, names)
        return frame, {n: frame.truth(c) for n, c in clauses.items()}, self.resolver(doc)

    # Analyses

    def existence_counts(self, doc: Document, view: Mapping[str, Any]) -> DataFrame:
        """(cohort, predicate, v, r, n) of a view's predicates."""
        names = view.get("cohorts") or list(doc.cohorts)
        predicates = view["params"]["predicates"]
        if not 1 <= len(predicates) <= MAX_PREDICATES:
            raise Refusal("TOO_MANY_PREDICATES", str(len(predicates)))
        _, frame, clauses = self.cohorts(doc, names)
        made = self.resolver(doc)
        return counts.crossing(frame, clauses, [made.clause(p, doc.unit) for p in predicates])

    def compare_existence(self, doc: Document, view: Mapping[str, Any]) -> dict:
        level, names = view["params"].get("level", 0.95), view.get("cohorts") or list(doc.cohorts)
        reference = view.get("reference", names[-1])
        seen: dict[tuple[str, int], list[int]] = {}
        for r in self.existence_counts(doc, view).collect():  # at most cohorts x predicates x answers x reasons
            k = seen.setdefault((r["cohort"], r["predicate"]), [0, 0, 0])
            k[r["v"]] += r["n"]
        out = []
        for i in range(len(view["params"]["predicates"])):
            table = {n: seen.get((n, i), [0, 0, 0]) for n in names}
            row: dict[str, Any] = {"cohorts": {n: {"k": t[2], "n": t[0] + t[2], "unknown": t[1], "interval": stats.wilson(t[2], t[0] + t[2], level)} for n, t in table.items()}}
            if len(names) == 2:
                a, b = table[next(n for n in names if n != reference)], table[reference]
                row["p"] = stats.fisher_exact(a[2], a[0], b[2], b[0]) if sum(a[::2]) and sum(b[::2]) else None
                row["risk_difference"] = stats.risk_difference(a[2], a[0] + a[2], b[2], b[0] + b[2], level)
                row["risk_ratio"] = stats.risk_ratio(a[2], a[0] + a[2], b[2], b[0] + b[2], level)
            elif len(names) > 2:
                test = stats.chi_squared([[t[2], t[0]] for t in table.values()])
                row |= {"chi2": test and test[0], "p": test and test[2], "small_n": bool(test and test[3])}
            if self.least and not all(disclosure.shown_split(t[2], t[0] + t[2], self.least) for t in table.values()):
                row = {"suppressed": True}
            elif self.least:
                for n, t in table.items():
                    row["cohorts"][n]["unknown"] = t[1] if disclosure.shown_counts([t[1]], self.least) else None
            out.append(row)
        tested = [r for r in out if r.get("p") is not None]
        for r, q in zip(tested, stats.benjamini_hochberg([r["p"] for r in tested]), strict=True):
            r["q"] = q
        return {"predicates": out}

    def values_of(self, doc: Document, view: Mapping[str, Any]) -> tuple[Frame, dict[str, Truth], list[Variable]]:
        specs = view["params"]["variables"]
        if not 1 <= len(specs) <= MAX_VARIABLES:
            raise Refusal("TOO_MANY_VARIABLES", str(len(specs)))
        frame, truths, made = self._view(doc, view)
        return frame, truths, [variable(frame, s, made) for s in specs]

    def _weighted(self, frame: Frame, truth: Truth, v: Variable) -> tuple[list[tuple[Any, int]], dict[str, int]]:
        found, left = [], dict.fromkeys(REASONS, 0)
        for r in materialised(frame, truth.v == TRUE, v).toLocalIterator():
            if r["excluded"] == 0:
                found.append((r["val"], r["n"]))
            else:
                for reason, bit in BIT.items():
                    left[reason] += r["n"] if r["excluded"] & bit else 0
        return sorted(found, key=lambda x: x[0]), {k: n for k, n in left.items() if n}

    def summary_distribution(self, doc: Document, view: Mapping[str, Any]) -> dict:
        frame, truths, variables = self.values_of(doc, view)
        out = []
        for v in variables:
            by = {}
            for name, t in truths.items():
                values, left = self._weighted(frame, t, v)
                if self.least:
                    by[name] = self._disclosed(values, left, view["params"].get("edges"))
                    continue
                by[name] = (_numbers(values, view["params"].get("edges")) if values and _is_number(values[0][0]) else _categories(values)) | {"excluded": left}
            out.append(by)
        if self.least:
            return {"variables": out}
        row = {n: joint(frame, t.v == TRUE, variables).first().asDict() for n, t in truths.items()}
        return {"variables": out, "joint": row}

    def _disclosed(self, values: list[tuple[Any, int]], left: dict[str, int], edges: Any) -> dict:
        """A distribution under a least count: merged bins without extremes or quantiles; categories only where all counts may be shown."""
        if not disclosure.shown_counts([sum(n for _, n in values), *left.values()], self.least):
            return {"suppressed": True}
        if values and _is_number(values[0][0]):
            made = _numbers(values, edges)
            merged = disclosure.merged_bins(made["bins"], self.least)
            if not disclosure.shown_counts([n for _, _, n in merged], self.least):
                return {"suppressed": True}
            return {"edges": [made["edges"][a] for a, _, _ in merged] + made["edges"][-1:], "bins": [n for _, _, n in merged], "excluded": left}
        return _categories(values) | {"excluded": left} if disclosure.shown_counts([n for _, n in values], self.least) else {"suppressed": True}

    def compare_columns(self, doc: Document, view: Mapping[str, Any]) -> dict:
        frame, truths, variables = self.values_of(doc, view)
        level, out = view["params"].get("level", 0.95), []
        for v in variables:
            groups = {n: self._weighted(frame, t, v)[0] for n, t in truths.items()}
            values = [x for g in groups.values() for x, _ in g]
            sizes = [sum(n for _, n in g) for g in groups.values()]
            if self.least and not disclosure.shown_counts(sizes if values and _is_number(values[0]) else [n for g in groups.values() for _, n in g], self.least):
                out.append({"suppressed": True})
            elif not values or any(not g for g in groups.values()):
                out.append({"reason": "no_units"})
            elif _is_number(values[0]):
                gs = [[(float(x), n) for x, n in g] for g in groups.values()]
                if len(gs) == 2:
                    out.append({"welch": stats.welch_t(*gs, level), "mann_whitney": stats.mann_whitney(*gs), "median_difference": stats.bootstrap_medians(*gs, ids.canonical(_plain(view)), level)})
                else:
                    out.append({"anova": stats.welch_anova(gs), "kruskal_wallis": stats.kruskal_wallis(gs)})
            else:
                names = sorted({str(x) for x in values}, key=lambda s: s.encode("utf-16-be"))
                if len(names) > MAX_CATEGORIES:
                    raise Refusal("TOO_MANY_CATEGORIES", str(len(names)))
                table = [[dict((str(x), n) for x, n in g).get(c, 0) for c in names] for g in groups.values()]
                if len(table) == 2 and len(names) == 2:
                    out.append({"categories": names, "table": table, "p": stats.fisher_exact(*table[0], *table[1])})
                else:
                    test = stats.chi_squared(table)
                    out.append({"categories": names, "table": table, "chi2": test and test[0], "p": test and test[2], "small_n": bool(test and test[3])})
        ps = [(o, k) for o in out for k in ("p",) if o.get("p") is not None]
        for (o, _), q in zip(ps, stats.benjamini_hochberg([o["p"] for o, _ in ps]), strict=True):
            o["q"] = q
        return {"variables": out}

    def page(self, doc: Document, name: str, offset: int = 0, limit: int = 100) -> DataFrame:
        """Unit keys of a cohort in canonical order."""
        if not 0 < limit <= MAX_PAGE:
            raise Refusal("PAGE_TOO_LARGE", str(limit))
        key = self.release.tables[doc.unit].key
        rows = self.units(doc, name).select(*key)
        kinds = dict(rows.dtypes)
        return rows.orderBy(*[ids.utf16_order(F.col(c)) if kinds[c] == "string" else F.col(c) for c in key]).offset(offset).limit(limit)

    def summary_members(self, doc: Document, view: Mapping[str, Any]) -> dict:
        if self.least:
            raise Refusal("DISCLOSURE", "members are not listed under a least count")
        name, p = (view.get("cohorts") or list(doc.cohorts))[0], view.get("params", {})
        return {"keys": [list(r) for r in self.page(doc, name, p.get("offset", 0), p.get("limit", 100)).collect()]}

    def endpoint_rows(self, doc: Document, names: list[str], endpoint: Endpoint) -> DataFrame:
        """(cohort, time, event[, entry]) of members with a sound outcome: not negative, entered before it."""
        frame, truths, _ = self._view(doc, {"cohorts": names})
        status = F.col(endpoint.status)
        event = F.when(status.isin(list(endpoint.events)), 1).when(status.isin(list(endpoint.censored)), 0)
        inside = F.array_compact(F.array(*[F.when(t.v == TRUE, F.lit(n)) for n, t in truths.items()]))
        columns = [F.explode(inside).alias("cohort"), F.col(endpoint.time).cast("double").alias("time"), event.alias("event")]
        rows = frame.df.select(*columns, *([F.col(endpoint.entry).cast("double").alias("entry")] if endpoint.entry else []))
        sound = F.col("event").isNotNull() & (F.col("time") >= 0)
        return rows.where(sound & (F.col("entry") < F.col("time")) if endpoint.entry else sound)

    def risks(self, doc: Document, names: list[str], endpoint: Endpoint) -> dict[str, list[tuple[float, int, int, int]]]:
        out: dict[str, list] = {n: [] for n in names}
        for r in survival.risk_table(self.endpoint_rows(doc, names, endpoint)).orderBy("cohort", "time").toLocalIterator():
            out[r["cohort"]].append((r["time"], r["d"], r["c"], r["n"]))
        return out

    def _endpoint(self, view: Mapping[str, Any]) -> Endpoint:
        if self.least:
            raise Refusal("DISCLOSURE", "times of single units are not disclosed under a least count")
        id_ = view["params"]["endpoint"]
        if id_ not in self.release.endpoints:
            raise Refusal("UNKNOWN_ENDPOINT", id_)
        return self.release.endpoints[id_]

    def survival_km(self, doc: Document, view: Mapping[str, Any]) -> dict:
        names, p = view.get("cohorts") or list(doc.cohorts), view["params"]
        risks = self.risks(doc, names, self._endpoint(view))
        curves = {n: survival.kaplan_meier([x for x in r if x[1] or x[2]], p.get("level", 0.95)) for n, r in risks.items()}
        marks = {n: [survival.landmark(c, t) for t in p.get("landmarks", ())] for n, c in curves.items()}
        small = [n for n, r in risks.items() if not r or r[0][3] < MIN_GROUP_N or sum(x[1] for x in r) < MIN_EVENTS]
        return {"curves": curves, "median": {n: survival.median(c) for n, c in curves.items()}, "landmarks": marks, "log_rank": survival.log_rank(list(risks.values())) if len(names) > 1 else None, "small": small}

    def survival_cox(self, doc: Document, view: Mapping[str, Any]) -> dict:
        name, endpoint = (view.get("cohorts") or list(doc.cohorts))[0], self._endpoint(view)
        frame, truths, made = self._view(doc, {"cohorts": [name]})
        terms = [variable(frame, s, made) for s in view["params"]["variables"]]
        strata = [variable(frame, s, made) for s in view["params"].get("strata", ())]
        status = F.col(endpoint.status)
        event = F.when(status.isin(list(endpoint.events)), 1).when(status.isin(list(endpoint.censored)), 0)
        whole = truths[name].v == TRUE
        for t in [*terms, *strata]:
            whole = whole & (t.x == 0)
        rows = frame.df.where(whole & event.isNotNull() & (F.col(endpoint.time) >= 0))
        late = []
        if endpoint.entry:
            late = [F.col(endpoint.entry).cast("double").alias("entry")]
            rows = rows.where(F.col(endpoint.entry) < F.col(endpoint.time))
        stratum = F.to_json(F.array(*[t.val.cast("string") for t in strata])) if strata else F.lit("")
        rows = rows.select(stratum.alias("stratum"), F.col(endpoint.time).cast("double").alias("time"), event.alias("event"), *[t.val.cast("double").alias(f"x{i}") for i, t in enumerate(terms)], *late).persist()
        try:
            model = survival.CoxRows(rows, len(terms))
            model.prepare()
            if not model.n:
                return {"reason": "no_units"}
            fit = model.fit()
            if "reason" in fit:
                return fit
            ph = model.proportional_hazards(fit)
        finally:
            rows.unpersist()
        z = stats.z_of(view["params"].get("level", 0.95))
        bounds = [(float(np.exp(b - z * s)), float(np.exp(b + z * s))) for b, s in zip(fit["beta"], fit["se"], strict=True)]
        return fit | {"n": model.n, "events": model.events, "intervals": bounds, "ph_p": ph, "ph_violated": [p < PH_LEVEL for p in ph], "few_events": model.events < EVENTS_PER_TERM * len(terms)}


def _is_number(v: Any) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool) or type(v).__name__ == "Decimal"


def _numbers(values: list[tuple[Any, int]], edges: list[float] | None) -> dict:
    w = [(float(v), n) for v, n in values]
    n, mean, sd = stats.moments(w)
    lo, hi = w[0][0], w[-1][0]
    edges = edges or ([lo + (hi - lo) * i / BINS for i in range(BINS + 1)] if hi > lo else [lo, lo])
    bins = [0] * (len(edges) - 1)
    for v, k in w:  # the last bin holds its upper edge
        if edges[0] <= v <= edges[-1]:
            bins[min(bisect_right(edges, v), len(edges) - 1) - 1] += k
    return {"n": n, "mean": mean, "sd": sd, "quartiles": [stats.quantile(w, q) for q in (0.25, 0.5, 0.75)], "min": lo, "max": hi, "edges": edges, "bins": bins}


def _categories(values: list[tuple[Any, int]]) -> dict:
    if len(values) > MAX_CATEGORIES:
        raise Refusal("TOO_MANY_CATEGORIES", str(len(values)))
    total = sum(n for _, n in values)
    return {"n": total, "shares": {str(v): {"k": n, "share": n / total} for v, n in values}}


def _plain(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    if isinstance(value, bool) or value is None or isinstance(value, str | int):
        return value
    return float(value) if np.isfinite(float(value)) else str(value)
