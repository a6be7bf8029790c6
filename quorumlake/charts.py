"""Charts of results as Vega-Lite specifications."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"


def _spec(mark: Any, rows: list[dict], **encoding: Any) -> dict:
    return {"$schema": SCHEMA, "data": {"values": rows}, "mark": mark, "encoding": encoding}


def existence(values: Mapping[str, Any]) -> dict:
    """Shares with their intervals, by predicate and cohort."""
    rows = [
        {"predicate": i, "cohort": name, "share": c["k"] / c["n"], "low": c["interval"][0], "high": c["interval"][1]}
        for i, p in enumerate(values["predicates"]) if "cohorts" in p for name, c in p["cohorts"].items() if c["n"]
    ]
    bars = _spec("bar", rows, x={"field": "cohort", "type": "nominal"}, y={"field": "share", "type": "quantitative"}, column={"field": "predicate", "type": "ordinal"})
    return bars


def distribution(values: Mapping[str, Any], variable: int = 0) -> dict:
    """A histogram of numbers, or bars of categories' shares."""
    rows: list[dict] = []
    for name, d in values["variables"][variable].items():
        if "bins" in d:
            rows += [{"cohort": name, "from": a, "to": b, "n": n} for a, b, n in zip(d["edges"], d["edges"][1:], d["bins"], strict=False)]
        else:
            rows += [{"cohort": name, "category": c, "share": s["share"]} for c, s in d["shares"].items()]
    if rows and "from" in rows[0]:
        return _spec({"type": "bar", "binSpacing": 0}, rows, x={"field": "from", "type": "quantitative", "bin": "binned"}, x2={"field": "to"}, y={"field": "n", "type": "quantitative"}, row={"field": "cohort", "type": "nominal"})
    return _spec("bar", rows, x={"field": "category", "type": "nominal"}, y={"field": "share", "type": "quantitative"}, row={"field": "cohort", "type": "nominal"})


def survival(values: Mapping[str, Any]) -> dict:
    """Curves as steps from 1 at time 0."""
    rows = [{"cohort": n, "time": 0.0, "survival": 1.0} for n in values["curves"]]
    rows += [{"cohort": n, "time": p["time"], "survival": p["survival"]} for n, curve in values["curves"].items() for p in curve]
    return _spec({"type": "line", "interpolate": "step-after"}, rows, x={"field": "time", "type": "quantitative"}, y={"field": "survival", "type": "quantitative", "scale": {"domain": [0, 1]}}, color={"field": "cohort", "type": "nominal"})


CHARTS = {"compare.existence": existence, "summary.distribution": distribution, "survival.km": survival}
