"""Time-to-event statistics: Kaplan-Meier, log-rank and Cox models.

The heavy part, the table of times with their events and numbers at risk, is an
aggregation and a window in Spark (:func:`risk_table`); what is left is a recursion
over distinct times. A Cox model's rows stay in Spark (:class:`CoxRows`); :func:`cox` and
:func:`proportional_hazards` say the same of arrays.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlake.functions.stats import upper_gamma, z_of


def risk_table(rows: DataFrame) -> DataFrame:
    """rows (cohort, time, event 0/1, optional entry) -> (cohort, time, d, c, n): events, censored, at risk.

    At risk at t: entered before t and not yet left. One aggregation by time, then windows
    over the distinct times of a cohort. With delayed entry a cohort also has the times of the others' events, with those at risk then.
    """
    counts = rows.groupBy("cohort", "time").agg(F.sum(F.col("event").cast("long")).alias("d"), F.count(F.lit(1)).alias("ended"))
    entered = None
    if "entry" in rows.columns:
        entered = rows.where(F.col("entry").isNotNull()).groupBy("cohort", F.col("entry").alias("time")).agg(F.count(F.lit(1)).alias("late"))
        counts = counts.join(entered, ["cohort", "time"], "full_outer")
        names = F.array(*[F.lit(r[0]) for r in rows.select("cohort").distinct().collect()])  # a few cohorts
        events = counts.where("d > 0").select("time").distinct().select(F.explode(names).alias("cohort"), "time", F.lit(1).alias("asked"))
        counts = counts.join(events, ["cohort", "time"], "full_outer").fillna(0, ["d", "ended", "late", "asked"])
    onward = Window.partitionBy("cohort").orderBy("time").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = F.sum("ended").over(onward)
    if entered is not None:
        n = n - F.sum("late").over(onward)
    out = counts.withColumn("n", n)
    return out.where("ended > 0" if entered is None else "ended > 0 OR asked > 0").select("cohort", "time", "d", (F.col("ended") - F.col("d")).alias("c"), "n")


Risk = Sequence[tuple[float, int, int, int]]  # (time, events, censored, at risk), by time


def kaplan_meier(risk: Risk, level: float = 0.95) -> list[dict]:
    """Survival, Greenwood's sum and log-log bounds after each time."""
    z, s, g, out = z_of(level), 1.0, 0.0, []
    for t, d, c, n in risk:
        if d:
            s *= (n - d) / n
            g = math.inf if n == d else g + d / (n * (n - d))
        if s == 1:
            low = high = 1.0
        elif s == 0:
            low = high = None
        else:
            spread = z * math.sqrt(g) / math.log(s)
            centre = math.log(-math.log(s))
            low, high = sorted((math.exp(-math.exp(centre - spread)), math.exp(-math.exp(centre + spread))))
        out.append({"time": t, "events": d, "censored": c, "at_risk": n, "survival": s, "low": low, "high": high})
    return out


def _first_half(curve: list[dict], key: str) -> float | None:
    near = math.sqrt(np.finfo(float).eps)
    for i, p in enumerate(curve):
        value = p[key]
        if value is not None and value < 0.5 + near:
            if abs(value - 0.5) < near:
                later = next((q["time"] for q in curve[i + 1 :] if q[key] is not None and q[key] < 0.5 - near), None)
                return p["time"] if later is None else (p["time"] + later) / 2
            return p["time"]
    return None


def median(curve: list[dict]) -> tuple[float | None, float | None, float | None]:
    """When survival reaches a half, and when its bounds do."""
    return _first_half(curve, "survival"), _first_half(curve, "low"), _first_half(curve, "high")


def landmark(curve: list[dict], t: float) -> dict | None:
    """The step at or before t; none after the last follow-up."""
    if not curve or t > curve[-1]["time"]:
        return None
    return next((p for p in reversed(curve) if p["time"] <= t), {"time": 0.0, "survival": 1.0, "low": 1.0, "high": 1.0})


def log_rank(groups: Sequence[Risk]) -> dict | None:
    """Observed less expected events of each group, against their hypergeometric covariance."""
    times = sorted({t for g in groups for t, d, _, _ in g if d})
    k = len(groups)
    starts, deaths = [[r[0] for r in g] for g in groups], [{r[0]: r[1] for r in g} for g in groups]
    observed, expected, cov = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for t in times:
        d = np.array([g.get(t, 0) for g in deaths], float)
        at = [bisect_left(ts, t) for ts in starts]  # without delayed entry nobody joins before the next time
        n = np.array([g[i][3] if i < len(g) else 0 for g, i in zip(groups, at, strict=True)], float)
        all_n, all_d = n.sum(), d.sum()
        if all_n == 0:
            continue
        p = n / all_n
        observed, expected = observed + d, expected + all_d * p
        if all_n > 1:
            cov += all_d * (all_n - all_d) / (all_n - 1) * (np.diag(p) - np.outer(p, p))
    used = [i for i in range(k) if expected[i] > 0]
    if len(used) < 2:
        return None
    u, v = (observed - expected)[used[1:]], cov[np.ix_(used[1:], used[1:])]
    x = float(u @ np.linalg.pinv(v) @ u)
    return {"chi2": x, "df": len(used) - 1, "p": upper_gamma((len(used) - 1) / 2, x / 2), "observed": observed.tolist(), "expected": expected.tolist()}


Derivatives = Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]  # coefficients -> log likelihood, its gradient, information


def _newton(derivatives: Derivatives, spread: np.ndarray, rounds: int) -> dict:
    """The largest likelihood by Newton's method with halved steps; ``spread``: the covariates' deviations."""
    beta = np.zeros(len(spread))
    value, grad, hess = start = derivatives(beta)
    if not math.isfinite(value):
        return {"reason": "not_converged"}
    for _ in range(rounds):
        try:
            step = np.linalg.solve(hess, grad)
        except np.linalg.LinAlgError:
            return {"reason": "separation"}
        scale = 1.0
        while scale > 1e-6:
            new = derivatives(beta + scale * step)
            if new[0] >= value - 1e-12 * (1 + abs(value)):
                break
            scale /= 2
        beta = beta + scale * step
        done = abs(new[0] - value) < 1e-9 * (abs(value) + 1e-9)
        value, grad, hess = new
        if np.abs(beta * spread).max() > 15:
            return {"reason": "separation"}
        if done:
            break
    else:
        return {"reason": "not_converged"}
    cov = np.linalg.inv(hess)
    se = np.sqrt(np.diag(cov))
    return {"beta": beta.tolist(), "se": se.tolist(), "hazard_ratio": np.exp(beta).tolist(), "log_likelihood": value, "null_log_likelihood": start[0], "score": float(start[1] @ np.linalg.pinv(start[2]) @ start[1]), "covariance": cov.tolist()}


def cox(time: np.ndarray, event: np.ndarray, x: np.ndarray, entry: np.ndarray | None = None, strata: np.ndarray | None = None, rounds: int = 30) -> dict:
    """A Cox model by Newton's method with Efron's ties; ``reason`` says why there is none."""
    n, p = x.shape
    if not event.sum():
        return {"reason": "no_events"}
    entry = np.full(n, -np.inf) if entry is None else entry
    strata = np.zeros(n, int) if strata is None else strata
    xc = x - x.mean(0)

    def derivatives(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, grad, hess = 0.0, np.zeros(p), np.zeros((p, p))
        risk = np.exp(np.clip(xc @ b, -500, 500))
        for s in np.unique(strata):
            own = strata == s
            for t in np.unique(time[own & (event == 1)]):
                at = own & (time >= t) & (entry < t)
                died = own & (time == t) & (event == 1)
                w, z = risk[at], xc[at]
                s0, s1, s2 = w.sum(), w @ z, (z * w[:, None]).T @ z
                wd, zd = risk[died], xc[died]
                d0, d1, d2 = wd.sum(), wd @ zd, (zd * wd[:, None]).T @ zd
                m = int(died.sum())
                value += float((xc[died] @ b).sum())
                grad += zd.sum(0)
                for j in range(m):
                    a0, a1, a2 = s0 - j / m * d0, s1 - j / m * d1, s2 - j / m * d2
                    value -= math.log(a0)
                    grad -= a1 / a0
                    hess += a2 / a0 - np.outer(a1, a1) / a0**2
        return value, grad, hess

    return _newton(derivatives, x.std(0), rounds)


def proportional_hazards(time: np.ndarray, event: np.ndarray, x: np.ndarray, fit: dict, entry: np.ndarray | None = None, strata: np.ndarray | None = None) -> list[float]:
    """p-value of each covariate's scaled Schoenfeld residuals, within the risk sets of the fit, against event time ranks."""
    beta, order = np.array(fit["beta"]), np.argsort(time, kind="stable")
    t, e, z = time[order], event[order], x[order]
    since = np.full(len(t), -np.inf) if entry is None else entry[order]
    own = np.zeros(len(t), int) if strata is None else strata[order]
    w = np.exp(z @ beta)
    residuals, places = [], []
    for i in np.flatnonzero(e == 1):
        at = (t >= t[i]) & (since < t[i]) & (own == own[i])
        residuals.append(z[i] - (w[at] @ z[at]) / w[at].sum())
        places.append(t[i])
    r, g = np.array(residuals), np.unique(np.array(places), return_inverse=True)[1].astype(float)
    g -= g.mean()
    v = np.array(fit["covariance"])
    scaled = r @ v * len(r)
    top = (g @ scaled) ** 2
    return [upper_gamma(0.5, float(top[j] / (len(r) * v[j, j] * (g @ g))) / 2) if g @ g > 0 else 1.0 for j in range(x.shape[1])]


#: Blocks of times, and the times of one, grow as the square root of all times; deaths at one time that are summed in one go.
BLOCK, TOGETHER = 100, 4096


class CoxRows:
    """:func:`cox` of rows (stratum, time, event 0/1, x0 .. x<p-1>, optional entry) that stay in Spark.

    For given coefficients: one aggregation by stratum and time, then sums over a stratum's later times, within blocks
    of times and with the sums of the later blocks; the driver sees the likelihood's derivatives. With delayed entry
    the weights of those who enter later are taken off the weights of those who leave later, so a risk set that holds
    a share s of its stratum's weight is known to about 1e-16 / s.
    """

    def __init__(self, rows: DataFrame, p: int):
        self.rows, self.p, self.late = rows, p, "entry" in rows.columns
        self.pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def prepare(self) -> None:
        """Numbers, centres and deviations, and the edges of the blocks of times: quantiles of the distinct ones."""
        over = [f(f"x{i}").alias(f"{k}{i}") for i in range(self.p) for k, f in (("avg", F.avg), ("sd", F.stddev_pop), ("low", F.min), ("high", F.max))]
        ends = [F.approx_count_distinct(c).alias(f"of_{c}") for c in ("time", "entry")[: 1 + self.late]]
        r = self.rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("event"), F.lit(0)).alias("events"), *ends, *over).first()
        self.n, self.events, self.edges = r["n"], int(r["events"]), []
        if self.events:
            self.centre = [r[f"low{i}"] if r[f"low{i}"] == r[f"high{i}"] else r[f"avg{i}"] for i in range(self.p)]
            self.spread = np.array([r[f"sd{i}"] for i in range(self.p)])
            blocks = 1 + math.isqrt((r["of_time"] + (r["of_entry"] if self.late else 0)) // BLOCK)
            if blocks > 1:
                times = self.rows.select("time").union(self.rows.select("entry")) if self.late else self.rows.select("time")
                quantiles = times.distinct().approxQuantile("time", [i / blocks for i in range(1, blocks)], 0.2 / blocks)
                self.edges = sorted({q for q in quantiles if math.isfinite(q)})

    def risk_sets(self, beta: Sequence[float]) -> DataFrame:
        """A row for each stratum and time with deaths. s: sums of weights, of weighted covariates and of their products over those at risk; d: over the dead; m: their number; z, eta: plain sums."""
        z = [(F.col(f"x{i}") - F.lit(c)).alias(f"x{i}") for i, c in enumerate(self.centre)]
        keys = [F.struct(F.col("time").alias("at"), F.lit(1.0).alias("sign"), F.col("event").cast("double").alias("died"))]
        if self.late:
            keys.append(F.struct(F.col("entry").alias("at"), F.lit(-1.0).alias("sign"), F.lit(0.0).alias("died")))
        eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        rows = self.rows.select("stratum", F.explode(F.array(*keys)).alias("k"), *z).select("stratum", "k.*", *[f"x{i}" for i in range(self.p)], eta.alias("eta"))
        w = F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), "eta")))
        of = {"": F.lit(1.0)} | {f"{i}": F.col(f"x{i}") for i in range(self.p)} | {f"{i}_{j}": F.col(f"x{i}") * F.col(f"x{j}") for i, j in self.pairs}
        risk = {f"s{k}": F.sum(F.col("w") * F.col("sign") * v) for k, v in of.items()}
        dead = {f"d{k}": F.sum(F.col("w") * F.col("died") * v) for k, v in of.items()}
        plain = {"m": F.sum("died"), "eta": F.sum(F.col("died") * F.col("eta"))} | {f"z{i}": F.sum(F.col("died") * F.col(f"x{i}")) for i in range(self.p)}
        sums = rows.withColumn("w", w).groupBy("stratum", "at").agg(*[v.alias(k) for k, v in (risk | dead | plain).items()])
        if self.edges:
            sums = Bucketizer(splits=[-math.inf, *self.edges, math.inf], inputCol="at", outputCol="block", handleInvalid="keep").transform(sums)
        else:
            sums = sums.withColumn("block", F.lit(0.0))
        later = Window.partitionBy("stratum", "block").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = sums.withColumns({k: F.sum(k).over(later) for k in risk}).where("m > 0")
        if self.edges:
            blocks = sums.groupBy("stratum", "block").agg(*[F.sum(k).alias(k) for k in risk])
            beyond = Window.partitionBy("stratum").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
            blocks = blocks.select("stratum", "block", *[F.coalesce(F.sum(k).over(beyond), F.lit(0.0)).alias(f"{k}_beyond") for k in risk])
            out = out.join(blocks, ["stratum", "block"]).withColumns({k: F.col(k) + F.col(f"{k}_beyond") for k in risk})
        return out

    def derivatives(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """As in :func:`cox`, from shares of the weight at risk: Efron's sums over the dead of a time are of 1, f and f^2 over powers of 1 - f d, f = 0, 1/m .. (m-1)/m."""
        c, m = F.col, F.col("m").cast("long")
        shares = [f"{k}{v}" for k in "sd" for v in ("", *range(self.p), *[f"{i}_{j}" for i, j in self.pairs]) if k + str(v) != "s"]
        sets = self.risk_sets(beta).withColumns({k: c(k) / c("s") for k in shares})
        sets = sets.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), m - 1, F.lit(TOGETHER).cast("long"))))

        def add(e: Column, j: Column) -> Column:
            f = j / c("m")
            a = 1 - f * c("d")
            return F.struct((e["l"] + F.log(a)).alias("l"), (e["a"] + 1 / a).alias("a"), (e["b"] + f / a).alias("b"), (e["aa"] + 1 / (a * a)).alias("aa"), (e["ab"] + f / (a * a)).alias("ab"), (e["bb"] + f * f / (a * a)).alias("bb"))

        none = F.struct(*[F.lit(0.0).alias(k) for k in ("l", "a", "b", "aa", "ab", "bb")])
        sets = sets.withColumn("e", F.aggregate(F.sequence("first", F.least(c("first") + TOGETHER - 1, m - 1)), none, add))
        once = F.when(c("first") == 0, 1.0).otherwise(0.0)
        value = once * (c("eta") - c("m") * F.log("s")) - c("e.l")
        grad = [once * c(f"z{i}") - (c(f"s{i}") * c("e.a") - c(f"d{i}") * c("e.b")) for i in range(self.p)]
        hess = [
            c(f"s{i}_{j}") * c("e.a") - c(f"d{i}_{j}") * c("e.b") - (c(f"s{i}") * c(f"s{j}") * c("e.aa") - (c(f"s{i}") * c(f"d{j}") + c(f"d{i}") * c(f"s{j}")) * c("e.ab") + c(f"d{i}") * c(f"d{j}") * c("e.bb"))
            for i, j in self.pairs
        ]
        squares = [c(f"s{i}_{i}") * c("e.a") for i in range(self.p)]
        got = np.array(sets.agg(*[F.sum(v) for v in (value, *grad, *squares, *hess)]).first(), float)
        grad_, squares_, information = got[1 : 1 + self.p], got[1 + self.p : 1 + 2 * self.p], np.zeros((self.p, self.p))
        for (i, j), v in zip(self.pairs, got[1 + 2 * self.p :], strict=True):
            information[i, j] = information[j, i] = v
        nothing = np.diag(information) <= 1e-13 * squares_  # what rounding leaves of a covariate that is equal in each risk set
        information[nothing], information[:, nothing] = 0, 0
        return float(got[0]), grad_, information

    def fit(self, rounds: int = 30) -> dict:
        return _newton(self.derivatives, self.spread, rounds) if self.events else {"reason": "no_events"}

    def proportional_hazards(self, fit: dict) -> list[float]:
        """As :func:`proportional_hazards`, from sums over the times with deaths and their ranks, which go through all strata."""
        sets, v = self.risk_sets(fit["beta"]), np.array(fit["covariance"])
        times = sets.groupBy("block", "at").agg(F.lit(1).alias("one"))
        before = [0] * (len(self.edges) + 2)
        for block, k in times.groupBy("block").count().collect():
            before[int(block) + 1 :] = [x + k for x in before[int(block) + 1 :]]
        place = F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1
        ranks = times.select("at", (place + F.element_at(F.array(*[F.lit(x) for x in before]), F.col("block").cast("int") + 1)).cast("double").alias("g"))
        c = F.col
        left = [c(f"z{i}") - c("m") * c(f"s{i}") / c("s") for i in range(self.p)]
        got = sets.join(ranks, "at").agg(*[F.sum(x) for x in (c("m"), c("m") * c("g"), c("m") * c("g") * c("g"), *left, *[x * c("g") for x in left])]).first()
        n, g1, g2 = got[:3]
        g, r = g2 - g1 * g1 / n, np.array(got[3 + self.p :]) - g1 / n * np.array(got[3 : 3 + self.p])
        return [upper_gamma(0.5, float(n * (r @ v)[j] ** 2 / (v[j, j] * g)) / 2) if g > 0 else 1.0 for j in range(self.p)]
