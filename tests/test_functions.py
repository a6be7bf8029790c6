"""Statistics against known values, canonical text, disclosure, cells and derived columns."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake import disclosure, ids
from quorumlake.functions import cells, derive, stats, survival
from quorumlake.functions.units import factor
from quorumlake.model import Refusal
from quorumlake.plans.document import parse, substituted


def close(a, b, tolerance=1e-10):
    return a == pytest.approx(b, rel=tolerance)


def test_intervals():
    assert close(stats.wilson(81, 263), (0.25528851987827428, 0.36620957698280016))
    assert stats.wilson(0, 10)[0] == 0.0 and stats.wilson(10, 10)[1] == 1.0 and stats.wilson(0, 0) is None
    d, low, high = stats.risk_difference(56, 70, 48, 80)
    assert close(d, 0.2) and close((low, high), (0.0524, 0.3339), 1e-3)
    assert stats.risk_ratio(0, 5, 1, 5) is None


def test_exact_and_chi_squared():
    assert close(stats.fisher_exact(3, 1, 1, 3), 0.48571428571428565)
    assert close(stats.fisher_exact(10, 2, 3, 15), 0.0005367241191434514, 1e-9)
    x, df, p, small = stats.chi_squared([[10, 20], [20, 10]])
    assert close(x, 6.666666666666667) and df == 1 and close(p, 0.009823274507519247, 1e-9) and not small
    assert close(stats.upper_gamma(0.5, 3.841458820694124 / 2), 0.05, 1e-9) and close(stats.upper_gamma(5, 2.0), 0.9473469826562889, 1e-9)


def test_tails():
    assert close(stats.t_tail(2.0, 10), 0.07338803477074037, 1e-9)
    assert close(stats.f_tail(4.0, 2, 12), 0.04665600000000001, 1e-9)
    assert close(stats.t_quantile(0.95, 10), 2.2281388519649385, 1e-8)


def test_adjusted():
    assert close(stats.benjamini_hochberg([0.01, 0.04, 0.03, 0.5]), [0.04, 0.05333333333333334, 0.05333333333333334, 0.5])


def test_moments_and_quantiles():
    w = [(1.0, 1), (2.0, 1), (4.0, 1), (8.0, 1)]
    assert [stats.quantile(w, q) for q in (0.25, 0.5, 0.75)] == [1.75, 3.0, 5.0]
    assert stats.exact_mean([(0.1, 1), (0.2, 1), (0.3, 1)]) == pytest.approx(0.2, abs=0) and stats.moments([(3.0, 1)])[2] is None


def test_ranks():
    a, b = [(v, 1) for v in (1.1, 2.2, 3.3)], [(v, 1) for v in (4.4, 5.5, 6.6)]
    assert stats.mann_whitney(a, b) == {"w": 0.0, "p": pytest.approx(0.1), "exact": True}
    k = stats.kruskal_wallis([[(2.9, 1), (3.0, 1), (2.5, 1), (2.6, 1), (3.2, 1)], [(3.8, 1), (2.7, 1), (4.0, 1), (2.4, 1)], [(2.8, 1), (3.4, 1), (3.7, 1), (2.2, 1), (2.0, 1)]])
    assert close(k["h"], 0.7714285714285722, 1e-9) and close(k["p"], 0.6799647735788936, 1e-8)
    low, high = stats.bootstrap_medians(a, b, "x")
    assert low <= -3.3 <= high and (low, high) == stats.bootstrap_medians(a, b, "x")


def test_welch():
    a = [(v, 1) for v in (27.5, 21.0, 19.0, 23.6, 17.0, 17.9, 16.9, 20.1, 21.9, 22.6, 23.1, 19.6, 19.0, 21.7, 21.4)]
    b = [(v, 1) for v in (27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8, 22.0, 24.8, 20.2, 21.9, 22.1, 22.9, 30.3)]
    got = stats.welch_t(a, b)
    assert close(got["t"], -2.8, 0.05) and got["low"] < got["difference"] < got["high"] < 0
    f = stats.welch_anova([a, b])
    assert close(f["f"], got["t"] ** 2, 1e-9) and close(f["p"], got["p"], 1e-8)


def test_survival_curve_and_log_rank():
    risk = [(1, 1, 0, 5), (2, 0, 1, 4), (3, 1, 0, 3), (4, 1, 1, 2)]
    curve = survival.kaplan_meier(risk)
    assert [round(p["survival"], 6) for p in curve] == [0.8, 0.8, 0.533333, 0.266667]
    assert survival.median(curve)[0] == 4 and survival.landmark(curve, 2.5)["time"] == 2 and survival.landmark(curve, 9) is None
    same = survival.log_rank([risk, risk])
    assert same["chi2"] == pytest.approx(0) and same["p"] == pytest.approx(1)


def test_risk_table_with_late_entry(spark):
    rows = [("a", 5.0, 1, 0.0), ("a", 3.0, 0, None), ("a", 4.0, 1, 3.5), ("a", 6.0, 1, 5.0)]
    got = survival.risk_table(spark.createDataFrame(rows, "cohort string, time double, event int, entry double")).orderBy("time").collect()
    want = [(t, sum(1 for _, u, _, e in rows if u >= t and (e is None or e < t))) for t in (3.0, 4.0, 5.0, 6.0)]
    assert [(r["time"], r["n"]) for r in got] == want


@pytest.mark.parametrize(("late", "strata"), [(False, 1), (True, 1), (True, 3)])
def test_cox_of_rows_in_spark(spark, monkeypatch, late, strata):
    """The same as of arrays, with many blocks of times, and with deaths at one time that are summed in parts."""
    monkeypatch.setattr(survival, "BLOCK", 4)
    monkeypatch.setattr(survival, "TOGETHER", 3)
    rng = np.random.default_rng(5)
    n = 300
    x = np.column_stack([rng.normal(40, 3, n), rng.integers(0, 2, n)])
    time = np.where(rng.random(n) < 0.3, 2.0, np.round(rng.exponential(2 / np.exp(0.2 * (x[:, 0] - 40) + 0.5 * x[:, 1])), 2) + 0.01)
    event, stratum = (rng.random(n) < 0.7).astype(int), rng.integers(0, strata, n)
    entry = np.where(rng.random(n) < 0.5, -1.0, np.round(time * rng.random(n) * 0.9, 3) - 0.001)
    rows = [(str(stratum[i]), float(time[i]), int(event[i]), float(x[i, 0]), float(x[i, 1])) + ((float(entry[i]),) if late else ()) for i in range(n)]
    model = survival.CoxRows(spark.createDataFrame(rows, "stratum string, time double, event int, x0 double, x1 double" + ", entry double" * late).persist(), 2)
    model.prepare()
    got = model.fit()
    sets = {"entry": entry if late else None, "strata": stratum}
    want = survival.cox(time, event, x, **sets)
    assert model.n == n and model.events == event.sum() and len(model.edges) > 4
    for k in ("beta", "se", "log_likelihood", "null_log_likelihood", "score"):
        assert got[k] == pytest.approx(want[k], rel=1e-7)
    assert model.proportional_hazards(got) == pytest.approx(survival.proportional_hazards(time, event, x, want, **sets), rel=1e-6)


@pytest.mark.parametrize(("event", "x", "reason"), [([0] * 10 + [1] * 10, [0.0] * 10 + [1.0] * 10, "separation"), ([1] * 20, [0.1] * 20, "separation"), ([0] * 20, [0.0] * 10 + [1.0] * 10, "no_events")])
def test_cox_of_rows_without_a_fit(spark, event, x, reason):
    model = survival.CoxRows(spark.createDataFrame([("", float(i // 2), event[i], x[i]) for i in range(20)], "stratum string, time double, event int, x0 double"), 1)
    model.prepare()
    assert model.fit() == {"reason": reason}


def test_date_difference_in_every_unit_of_time(spark):
    frame = spark.sql("SELECT date'2001-01-01' AS a, timestamp_ntz'2001-01-08 12:00:00' AS b")
    for unit, seconds in {"s": 1, "min": 60, "h": 3600, "d": 86400, "wk": 604800, "mo": 2629800, "a": 31557600}.items():
        assert frame.select(derive.date_diff(F.col("a"), F.col("b"), unit)).first()[0] == 648000 / seconds
    with pytest.raises(Refusal):
        derive.date_diff(F.col("a"), F.col("b"), "kg")


def test_cox_finds_the_effect_and_separation():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1))
    t = rng.exponential(1 / np.exp(0.8 * x[:, 0]))
    fit = survival.cox(np.round(t, 2), np.ones(400), x)
    assert abs(fit["beta"][0] - 0.8) < 0.2 and fit["log_likelihood"] > fit["null_log_likelihood"]
    assert survival.proportional_hazards(np.round(t, 2), np.ones(400), x, fit)[0] > 0.001
    flag = np.array([[0.0]] * 10 + [[1.0]] * 10)
    assert survival.cox(np.arange(20.0), np.array([0] * 10 + [1] * 10), flag).get("reason") == "separation"
    assert survival.cox(np.arange(20.0), np.zeros(20), flag) == {"reason": "no_events"}


@pytest.mark.parametrize("x,text", [(1, "1"), (1.0, "1"), (-0.0, "0"), (0.1, "0.1"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (1.5e300, "1.5e+300"), (12.25, "12.25")])
def test_canonical_numbers(x, text):
    assert ids.canonical_number(x) == text


def test_canonical_order_is_utf16(spark):
    assert ids.canonical({"�": 1, "\U0001f600": 2}) == '{"\U0001f600":2,"�":1}'
    rows = spark.createDataFrame([("�",), ("\U0001f600",)], "v string")
    assert [r.v for r in rows.orderBy(ids.utf16_order(F.col("v"))).collect()] == ["\U0001f600", "�"]


def test_suppression_never_shows_one_missing_count():
    rng = random.Random(1)
    for _ in range(2000):
        n = [rng.choice([0, 1, 3, 5, 9, 40]) for _ in range(3)]
        shown = disclosure.suppressed_counts(*n, 5)
        assert sum(s is None for s in shown) != 1
        assert all(s is None or s == 0 or s >= 5 for s in shown)


def test_bins_merge_to_the_least_count():
    assert disclosure.merged_bins([2, 1, 9, 0, 7, 1], 5) == [(0, 2, 12), (3, 3, 0), (4, 5, 8)]
    assert sum(n for *_, n in disclosure.merged_bins([1, 1], 5)) == 2


def test_units():
    assert factor("kg", "g") == 1000 and factor("a", "d") == 365.25
    with pytest.raises(Refusal):
        factor("kg", "s")


def test_cells(spark):
    text = ["1", "1.0", "1e3", "x", "", None, "9007199254740993", "NA", "-0", "1.5", "nan", "yes", "2020-02-30", "2020-02-29", '["a","b"]', "a; b"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, c string")

    def typed(kind):
        return [(r["c"], r["c__state"]) for r in cells.typed_column(frame, "c", kind, {"NA": "NOT_ASSESSED"}).orderBy("i").collect()]

    whole = typed("integer")
    assert [v for v, _ in whole[:9]] == [1, 1, 1000, None, None, None, 9007199254740993, None, 0] and whole[7][1] == "NOT_ASSESSED"
    numbers = typed("number")
    assert numbers[9] == (1.5, "PRESENT") and numbers[10] == (None, "UNKNOWN") and math.copysign(1, numbers[8][0]) == 1
    assert typed("boolean")[11] == (True, "PRESENT")
    assert typed("date")[12:14] == [(None, "UNKNOWN"), (dt.date(2020, 2, 29), "PRESENT")]
    assert typed("list<category>")[14:] == [(["a", "b"], "PRESENT"), (["a", "b"], "PRESENT")]


def test_derived_states_and_order(spark):
    frame = spark.createDataFrame([(6, 3, "PRESENT"), (5, 0, "PRESENT"), (None, 1, "NOT_ASSESSED")], "a long, b long, a__state string")
    made = derive.derived(frame, "q", ["a", "b"], derive.arith("/", F.col("a"), F.col("b"), True))
    assert [(r["q"], r["q__state"]) for r in made.collect()] == [(2, "PRESENT"), (None, "UNKNOWN"), (None, "NOT_ASSESSED")]
    big = spark.createDataFrame([(2**62, 2**62)], "a long, b long").select(derive.arith("+", F.col("a"), F.col("b"), True).alias("s")).first()
    assert big["s"] is None
    assert derive.in_order({"c": (["b"], None), "b": (["a"], None)}) == ["b", "c"]
    with pytest.raises(Refusal):
        derive.in_order({"a": (["b"], None), "b": (["a"], None)})


def test_documents():
    assert substituted({"x": ["$a", "$$b"]}, {"a": 1}) == {"x": [1, "$b"]}
    for bad, code in (({"dataset": "d", "unit": "u"}, "MISSING_MEMBER"), ({"dataset": "d", "unit": "u", "cohorts": {"A": {"all": []}}}, "INVALID_NAME"), ({"dataset": "d", "unit": "u", "cohorts": {"a": {"all": [], "any": []}}}, "INVALID_CLAUSE"), ({"dataset": "d", "unit": "u", "cohorts": {"a": {"kind": "value", "value": 2**60}}}, "NUMBER_TOO_LARGE")):
        with pytest.raises(Refusal) as refused:
            parse(bad)
        assert refused.value.code == code
    with pytest.raises(Refusal):
        parse('{"dataset": "d", "dataset": "e", "unit": "u", "cohorts": {}}')


def test_log_rank_with_delayed_entry_counts_who_is_there(spark):
    """Those at risk at each event, counted row by row."""
    rows = [("a", 3.0, 1, 0.0), ("a", 8.0, 1, 5.0), ("a", 9.0, 0, 0.0), ("b", 4.0, 1, 0.0), ("b", 6.0, 1, 3.5), ("b", 10.0, 1, 7.0), ("b", 12.0, 0, 1.0)]
    risks = {"a": [], "b": []}
    for r in survival.risk_table(spark.createDataFrame(rows, "cohort string, time double, event int, entry double")).orderBy("cohort", "time").collect():
        risks[r.cohort].append((r.time, r.d, r.c, r.n))
    expected = [0.0, 0.0]
    for t in sorted({r[1] for r in rows if r[2]}):
        n = [sum(c == g and e < t <= u for c, u, _, e in rows) for g in "ab"]
        d = sum(u == t and v for _, u, v, _ in rows)
        for i in range(2):
            expected[i] += d * n[i] / sum(n)
    assert survival.log_rank(list(risks.values()))["expected"] == pytest.approx(expected)


def test_unit_factors_are_rounded_once():
    assert (factor("mg", "ug"), factor("ug", "kg"), factor("cm", "km")) == (1000.0, 1e-9, 1e-5)


def test_bootstrap_of_a_large_multiset_is_quick_and_near():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = [[(float(v), 1) for v in rng.normal(m, 1, 301)] for m in (2, 0)]
    low, high = stats.bootstrap_medians(a, b, "seed")
    assert low < 2 < high and high - low < 1
    huge = [(0.0, 10**12), (1.0, 10**12 + 1)]
    assert stats.bootstrap_medians(huge, [(0.0, 10**12)], "seed")[0] in (0.0, 0.5, 1.0)


def test_suppression_leaves_no_complement():
    from quorumlake import disclosure

    assert disclosure.suppressed_counts(500, 3, 2, 10) == (None, None, None)
    assert disclosure.suppressed_counts(500, 3, 0, 10) == (None, None, 0)
    assert disclosure.suppressed_counts(500, 30, 20, 10) == (500, 30, 20)
    assert disclosure.merged_bins([0, 3, 0], 10) == [(0, 0, 0), (1, 1, 3), (2, 2, 0)]
