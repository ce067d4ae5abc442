"""Survival analysis: curves and tests from counts by time, regressions from distributed sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, micros
from stroma.operators.bootstrap import resampled_sums
from stroma.operators.ordered import next_with, running_sums, triple
from stroma.operators.var import chi2_tail
from stroma.sources.tables import materialise, ship_package


def counts(df: DataFrame, by: list[str], time: str, event: str) -> DataFrame:
    """(by, time, d, c, n): events, censored and at risk at each time. Times are counted before any order is needed; no task holds all times of a group."""
    at = df.where(F.col(time).isNotNull()).groupBy(*by, time).agg(F.count_if(F.col(event)).alias("d"), F.count_if(~F.col(event)).alias("c"))
    return running_sums(at, by, time, {"n": F.col("d") + F.col("c")}, reverse=True)


def kaplan_meier(df: DataFrame, by: list[str], time: str, event: str) -> DataFrame:
    """(by, time, d, n, survival) at every time with an event: the product of 1 - d / n, as a sum of logarithms; 0 once all at risk have gone."""
    at = counts(df, by, time, event).where("d > 0")
    left = F.when(F.col("d") < F.col("n"), F.log(1 - F.col("d") / F.col("n"))).otherwise(0.0)
    curve = running_sums(at, by, time, {"_log": left, "_gone": (F.col("d") >= F.col("n")).cast("int")})
    return curve.select(*by, time, "d", "n", F.when(F.col("_gone") > 0, 0.0).otherwise(F.exp("_log")).alias("survival"))


def survival_quantile(curve: DataFrame, by: list[str], time: str, q: float) -> DataFrame:
    """First time with survival <= q (up to rounding), infinite where there is none."""
    return curve.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("survival") <= q + 1e-12, F.col(time).cast("double"))), F.lit(float("inf"))).alias("quantile"))


def _at_risk(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """(group, time, d, n, all_d, all_n) at every time with an event, one row a group, groups without anyone at risk included. Groups are few; times may be many."""
    by_group = df.where(F.col(time).isNotNull()).groupBy(group, time).agg(F.count_if(F.col(event)).alias("d"), F.count(F.lit(1)).alias("m"))
    total = by_group.groupBy(time).agg(F.sum("d").alias("all_d"), F.sum("m").alias("all_m"))
    total = running_sums(total, [], time, {"all_n": "all_m"}, reverse=True)
    groups = df.select(group).distinct()
    grid = total.crossJoin(F.broadcast(groups)).join(by_group, [group, time], "left").na.fill(0, ["d", "m"])
    return running_sums(grid, [group], time, {"n": "m"}, reverse=True).where("all_d > 0")


def logrank(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """(group, observed, expected, variance): the sums of the log-rank test over times; for two groups chi2 = (O - E)^2 / V."""
    at = _at_risk(df, group, time, event)
    e = F.col("all_d") * F.col("n") / F.col("all_n")
    v = F.when(F.col("all_n") > 1, e * (1 - F.col("n") / F.col("all_n")) * (F.col("all_n") - F.col("all_d")) / (F.col("all_n") - 1)).otherwise(0.0)
    return at.groupBy(group).agg(F.sum("d").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))


def logrank_covariance(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """(group_a, group_b, covariance) of observed less expected events, for any number of groups."""
    at = _at_risk(df, group, time, event).where("all_n > 1")
    a, b = at.select(time, "all_d", "all_n", F.col(group).alias("group_a"), F.col("n").alias("_na")), at.select(time, F.col(group).alias("group_b"), F.col("n").alias("_nb"))
    share = F.col("_na") / F.col("all_n")
    own = F.when(F.col("group_a") == F.col("group_b"), 1.0).otherwise(0.0)
    v = F.col("all_d") * (F.col("all_n") - F.col("all_d")) / (F.col("all_n") - 1) * share * (own - F.col("_nb") / F.col("all_n"))
    return a.join(b, time).groupBy("group_a", "group_b").agg(F.sum(v).alias("covariance"))


def logrank_test(df: DataFrame, group: str, time: str, event: str) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p) over all groups; the driver gets groups squared numbers."""
    sums = {r[group]: r["observed"] - r["expected"] for r in logrank(df, group, time, event).collect()}
    names = sorted(sums)[:-1]
    cov = {(r["group_a"], r["group_b"]): r["covariance"] for r in logrank_covariance(df, group, time, event).collect()}
    if not names:
        return 0.0, 0, 1.0
    v = np.array([[cov.get((a, b), 0.0) for b in names] for a in names])
    z = np.array([sums[a] for a in names])
    stat = float(z @ np.linalg.pinv(v) @ z)
    return stat, len(names), chi2_tail(stat, len(names))


def pairwise_logrank(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """(group_a, group_b, observed, expected, variance, chi2) of the first of each two groups against the other alone. Pairs of groups are exploded: few groups."""
    groups = df.select(group).distinct()
    pairs = groups.select(F.col(group).alias("group_a")).crossJoin(F.broadcast(groups.select(F.col(group).alias("group_b")))).where("group_a < group_b")
    counted = df.where(F.col(time).isNotNull()).groupBy(group, time).agg(F.count_if(F.col(event)).alias("d"), F.count(F.lit(1)).alias("m"))
    both = pairs.join(counted, (F.col(group) == F.col("group_a")) | (F.col(group) == F.col("group_b")))
    first = F.col(group) == F.col("group_a")
    at = both.groupBy("group_a", "group_b", time).agg(F.sum("d").alias("all_d"), F.sum("m").alias("_m"), F.sum(F.when(first, F.col("d")).otherwise(0)).alias("d"), F.sum(F.when(first, F.col("m")).otherwise(0)).alias("_f"))
    at = running_sums(at, ["group_a", "group_b"], time, {"all_n": "_m", "n": "_f"}, reverse=True).where("all_d > 0")
    e = F.col("all_d") * F.col("n") / F.col("all_n")
    v = F.when(F.col("all_n") > 1, e * (1 - F.col("n") / F.col("all_n")) * (F.col("all_n") - F.col("all_d")) / (F.col("all_n") - 1)).otherwise(0.0)
    sums = at.groupBy("group_a", "group_b").agg(F.sum("d").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    return sums.withColumn("chi2", F.try_divide(F.pow(F.col("observed") - F.col("expected"), 2), F.col("variance")))


def logrank_robust(df: DataFrame, by: list[str], group: str, time: str, event: str, cluster: str) -> DataFrame:
    """(by, n, events, score, information, robust, chi2, log_ratio, robust_se): the two-sample log-rank score with errors by cluster.

    A row's share of the score is what its own event adds, group less the group's share of
    those at risk, less what the pooled hazard made it expect up to its time: differences
    of prefix sums over times. ``robust`` is the sum over clusters of their squared shares,
    ``information`` the hypergeometric variance; ``log_ratio`` is one Newton step from 0,
    above 0 where the group (a boolean) has its events sooner. Rows with a null in any
    column but ``by`` are left out. Rows of one cluster, time, group and event are counted
    first, so what is joined with the times has a row for each of these.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(cluster).isNotNull())
    cells = rows.groupBy(*by, F.col(cluster).alias("_c"), F.col(time).alias("_t"), F.col(group).cast("int").alias("_z"), F.col(event).cast("int").alias("_e")).agg(F.count(F.lit(1)).alias("_m"))
    at = cells.groupBy(*by, "_t").agg(F.sum(F.col("_m") * F.col("_e")).alias("_d"), F.sum("_m").alias("_n"), F.sum(F.col("_m") * F.col("_z")).alias("_nz"))
    at = running_sums(at, by, "_t", {"_risk": "_n", "_risk_z": "_nz"}, reverse=True)
    at = at.withColumns({"_share": F.col("_risk_z") / F.col("_risk"), "_hazard": F.col("_d") / F.col("_risk")})
    n, share = F.col("_risk"), F.col("_share")
    information = F.when(n > 1, F.col("_d") * (n - F.col("_d")) / (n - 1) * share * (1 - share)).otherwise(0.0)
    at = running_sums(at.withColumn("_v", information), by, "_t", {"_all": "_hazard", "_own": F.col("_share") * F.col("_hazard")})
    at = at.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_t").alias("_at"), "_share", "_v", "_all", "_own")
    same = F.col("_t") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    part = F.col("_e") * (F.col("_z") - F.col("_share")) - F.when(F.col("_z") > 0, F.col("_all") - F.col("_own")).otherwise(-F.col("_own"))
    clusters = cells.join(at, same).groupBy(*by, "_c").agg(F.sum(part * F.col("_m")).alias("_u"), F.sum("_m").alias("_rows"), F.sum(F.col("_m") * F.col("_e")).alias("_events"))
    sums = clusters.groupBy(*by).agg(F.sum("_rows").alias("n"), F.sum("_events").alias("events"), F.sum("_u").alias("score"), F.sum(F.col("_u") * F.col("_u")).alias("robust"))
    model = at.groupBy(*[f"_by_{c}" for c in by]).agg(F.sum("_v").alias("information"))
    if by:
        match = F.lit(True)
        for c in by:
            match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        both = sums.join(model, match)
    else:
        both = sums.crossJoin(F.broadcast(model))  # one row each
    return both.select(*by, "n", "events", "score", "information", "robust", F.try_divide(F.col("score") * F.col("score"), F.col("robust")).alias("chi2"), F.try_divide("score", "information").alias("log_ratio"), F.try_divide(F.sqrt("robust"), F.col("information")).alias("robust_se"))


def recovery_times(stream: DataFrame, keys: list[str], day: str, ts: str, tie: str, onset: Column, calm: Column, foreign: Column) -> DataFrame:
    """Each ``onset`` row with ``minutes`` to its recovery and whether it was seen (``recovered``).

    Recovered is the first of three rows in a row of one key and day where ``calm`` holds,
    at the onset or later that day. Before it, the next ``foreign`` row of the key that day
    ends the watch, and so does the day's last row.
    """
    by = [*keys, day]
    marked = triple(stream.withColumn("_foreign", F.coalesce(foreign, F.lit(False))).withColumn("_onset", F.coalesce(onset, F.lit(False))), by, [ts, tie], calm, F.lit(1), "_ok")
    found = next_with(marked, by, [ts, tie], F.col("_ok"), [ts], "_calm_")
    later = W.partitionBy(*by).orderBy(F.col(ts).desc(), F.col(tie).desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    found = found.withColumn("_other", F.last(F.when(F.col("_foreign"), F.col(ts)), ignorenulls=True).over(later)).withColumn("_end", F.max(ts).over(whole))
    stop = F.least("_other", "_end")
    seen = F.col(f"_calm_{ts}").isNotNull() & (F.col("_other").isNull() | (F.col(f"_calm_{ts}") <= F.col("_other")))
    until = F.when(seen, F.col(f"_calm_{ts}")).otherwise(stop)
    minutes = (micros(until) - micros(F.col(ts))) / (60.0 * MICROS)
    return found.where("_onset").withColumn("minutes", minutes).withColumn("recovered", seen).drop("_foreign", "_onset", "_ok", f"_calm_{ts}", "_other", "_end")


def holm(ps: list[float]) -> list[float]:
    """Holm's adjusted p-values, in the order given."""
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, top = [0.0] * len(ps), 0.0
    for rank, i in enumerate(order):
        top = max(top, min(1.0, ps[i] * (len(ps) - rank)))
        out[i] = top
    return out


def km_bootstrap(df: DataFrame, cluster: str, time: str, event: str, q: float, draws: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(by, estimate, lo, hi) of the first time with survival <= q over resamples of the clusters, weighed on the executors; infinite where a curve stays above.

    The bounds are the draws next to the 2.5 and 97.5 % places of their order, as there may be infinite ones.
    """
    by = by or []
    rows = df.where(F.col(time).isNotNull()).withColumn("_d", F.when(F.col(event), 1.0).otherwise(0.0)).withColumn("_m", F.lit(1.0))
    sums = resampled_sums(rows, cluster, [*by, time], ["_d", "_m"], draws, seed)
    at = running_sums(sums, ["draw", *by], time, {"_n": "_m"}, reverse=True).where("_d > 0")
    left = F.when(F.col("_d") < F.col("_n"), F.log(1 - F.col("_d") / F.col("_n")))
    gone = (F.col("_d") >= F.col("_n")).cast("int")
    curve = running_sums(at, ["draw", *by], time, {"_log": F.coalesce(left, F.lit(0.0)), "_gone": gone}).withColumn("survival", F.when(F.col("_gone") > 0, 0.0).otherwise(F.exp("_log")))
    found = survival_quantile(curve, ["draw", *by], time, q)
    drawn = F.array_sort(F.collect_list(F.when(F.col("draw") >= 0, F.col("quantile"))))  # one number a draw
    near = lambda p: F.get("_all", F.floor((F.size("_all") - 1) * p + 0.5).cast("int"))
    return found.groupBy(*by).agg(F.max(F.when(F.col("draw") < 0, F.col("quantile"))).alias("estimate"), drawn.alias("_all")).select(*by, "estimate", near(0.025).alias("lo"), near(0.975).alias("hi"))


# --- Cox regression ---------------------------------------------------------


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _risk_table(rows: DataFrame, x: list[str], b: np.ndarray, strata: list[str]) -> DataFrame:
    """(strata, t, d, s0, s1_i, s2_i_j, e0, e1_i, e2_i_j, x_i) at each time with an event.

    s are sums of w, w x and w x x' (w = exp(x b)) over those at risk: who leaves at t or
    later and entered before t. They are running sums from the last time back over rows of
    leaving (plus) and of entry (minus). e are those of the events at t.
    """
    k = len(x)
    weighed = rows.withColumn("_w", F.exp(sum((F.col(c) * float(v) for c, v in zip(x, b)), F.lit(0.0))))
    terms = {"s0": F.col("_w")} | {f"s1_{i}": F.col("_w") * F.col(x[i]) for i in range(k)} | {f"s2_{i}_{j}": F.col("_w") * F.col(x[i]) * F.col(x[j]) for i, j in _pairs(k)}
    out = F.struct(F.col("_t").alias("t"), F.lit(1.0).alias("sign"), F.col("_e").alias("e"))
    into = F.struct(F.col("_entry").alias("t"), F.lit(-1.0).alias("sign"), F.lit(False).alias("e"))
    ends = weighed.withColumn("_end", F.explode(F.when(F.col("_entry").isNull(), F.array(out)).otherwise(F.array(out, into))))
    signed = F.col("_end.sign")
    hit = lambda c: F.sum(F.when(F.col("_end.e"), c).otherwise(0.0))
    sums = [F.sum(signed * c).alias(n) for n, c in terms.items()] + [hit(c).alias("e" + n[1:]) for n, c in terms.items()]
    at = ends.groupBy(*strata, F.col("_end.t").alias("t")).agg(F.count_if("_end.e").alias("d"), *sums, *[hit(F.col(c)).alias(f"x_{i}") for i, c in enumerate(x)])
    return running_sums(at, strata, "t", {n: n for n in terms}, reverse=True).where("d > 0")


def _efron(table: DataFrame, k: int) -> DataFrame:
    """One row for each event of a tie: ``part`` (l / d), z0, and the means z1_i of the reduced risk set."""
    each = table.withColumn("_l", F.explode(F.sequence(F.lit(0), (F.col("d") - 1).cast("int")))).withColumn("part", F.col("_l") / F.col("d"))
    each = each.withColumn("z0", F.col("s0") - F.col("part") * F.col("e0"))
    return each.withColumns({f"z1_{i}": (F.col(f"s1_{i}") - F.col("part") * F.col(f"e1_{i}")) / F.col("z0") for i in range(k)})


def cox_sums(rows: DataFrame, x: list[str], b: np.ndarray, strata: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, gradient, minus the Hessian) at ``b`` with Efron's ties. One row reaches the driver."""
    k = len(x)
    table = _risk_table(rows, x, b, strata)
    each = _efron(table, k)
    mean = [F.sum(-F.log("z0")).alias("ll"), *[F.sum(-F.col(f"z1_{i}")).alias(f"g_{i}") for i in range(k)]]
    mean += [F.sum((F.col(f"s2_{i}_{j}") - F.col("part") * F.col(f"e2_{i}_{j}")) / F.col("z0") - F.col(f"z1_{i}") * F.col(f"z1_{j}")).alias(f"h_{i}_{j}") for i, j in _pairs(k)]
    r = each.agg(*mean).first()
    xs = rows.agg(*[F.coalesce(F.sum(F.when(F.col("_e"), F.col(c))), F.lit(0.0)).alias(f"x_{i}") for i, c in enumerate(x)]).first()
    total = np.array([xs[f"x_{i}"] for i in range(k)], float)
    hess = np.zeros((k, k))
    for i, j in _pairs(k):
        hess[i, j] = hess[j, i] = r[f"h_{i}_{j}"] or 0.0
    return (r["ll"] or 0.0) + float(total @ b), total + np.array([r[f"g_{i}"] or 0.0 for i in range(k)]), hess


def cox_rows(df: DataFrame, x: list[str], time: str, event: str, strata: list[str] | None = None, entry: str | None = None, cluster: str | None = None) -> DataFrame:
    """The columns that the regression reads, rows with a NULL in any of them left out (an entry may be NULL: at risk from the start)."""
    own = df.select(*(strata or []), F.col(time).cast("double").alias("_t"), F.col(event).alias("_e"), *[F.col(c).cast("double").alias(c) for c in x], (F.col(entry) if entry else F.lit(None)).cast("double").alias("_entry"), (F.col(cluster) if cluster else F.lit(None)).cast("string").alias("_cluster"))
    return own.na.drop(subset=[c for c in own.columns if c not in ("_entry", "_cluster")])


def score_residuals(rows: DataFrame, x: list[str], b: np.ndarray, strata: list[str]) -> DataFrame:
    """``rows`` with u_i, each row's share of the score: they add up to the gradient.

    A row's share is x less the mean at its own event, less what it could expect while it
    was at risk; the expectation is a difference of running sums along the times.
    """
    k = len(x)
    each = _efron(_risk_table(rows, x, b, strata), k)
    sums = [F.sum(1 / F.col("z0")).alias("c0"), F.sum((1 - F.col("part")) / F.col("z0")).alias("o0")]
    for i in range(k):
        sums += [F.sum(F.col(f"z1_{i}") / F.col("z0")).alias(f"c1_{i}"), F.sum((1 - F.col("part")) * F.col(f"z1_{i}") / F.col("z0")).alias(f"o1_{i}"), F.avg(f"z1_{i}").alias(f"m_{i}")]
    at = each.groupBy(*strata, "t").agg(*sums)
    names = ["c0", *[f"c1_{i}" for i in range(k)]]
    times = rows.select(*strata, F.col("_t").alias("t")).unionByName(rows.where("_entry is not null").select(*strata, F.col("_entry").alias("t"))).distinct()
    all_times = times.join(at, [*strata, "t"], "left").na.fill(0.0)
    summed = running_sums(all_times.withColumns({f"own_{n}": F.col(n) for n in names}), strata, "t", {n: n for n in names})
    leave = summed.withColumnRenamed("t", "_t")
    joined = rows.join(leave, [*strata, "_t"])
    enter = summed.select(*strata, F.col("t").alias("_entry"), *[F.col(n).alias(f"in_{n}") for n in names])
    joined = joined.join(enter, [*strata, "_entry"], "left").na.fill(0.0, [f"in_{n}" for n in names])
    w = F.exp(sum((F.col(c) * float(v) for c, v in zip(x, b)), F.lit(0.0)))
    passed = lambda n, o: F.col(n) - F.col(f"in_{n}") - F.when(F.col("_e"), F.col(f"own_{n}") - F.col(o)).otherwise(0.0)
    out = [(F.when(F.col("_e"), F.col(c) - F.col(f"m_{i}")).otherwise(0.0) - w * (F.col(c) * passed("c0", "o0") - passed(f"c1_{i}", f"o1_{i}"))).alias(f"u_{i}") for i, c in enumerate(x)]
    return joined.select(*rows.columns, *out)


def meat(rows: DataFrame, k: int) -> np.ndarray:
    """Sum over clusters of the outer products of their summed shares u_0, u_1, ...; rows without a cluster stand alone."""
    alone = rows.where("_cluster is null").select(*[f"u_{i}" for i in range(k)])
    together = rows.where("_cluster is not null").groupBy("_cluster").agg(*[F.sum(f"u_{i}").alias(f"u_{i}") for i in range(k)]).drop("_cluster")
    r = alone.unionByName(together).agg(*[F.coalesce(F.sum(F.col(f"u_{i}") * F.col(f"u_{j}")), F.lit(0.0)).alias(f"m_{i}_{j}") for i, j in _pairs(k)]).first()
    out = np.zeros((k, k))
    for i, j in _pairs(k):
        out[i, j] = out[j, i] = r[f"m_{i}_{j}"]
    return out


def cox(df: DataFrame, x: list[str], time: str, event: str, strata: list[str] | None = None, entry: str | None = None, cluster: str | None = None, steps: int = 25, tolerance: float = 1e-9) -> dict:
    """Cox regression with Efron's ties: coefficients, standard errors, robust ones by cluster, Wald statistic, log-likelihood.

    Each Newton step is one aggregate over running sums, so the driver gets one row a step,
    however many times and ties there are. ``entry``: at risk after that time only.
    ``strata``: baselines of their own. ``robust_se`` sums the score's shares by ``cluster``
    (by row without one).
    """
    by = strata or []
    rows, k = materialise(cox_rows(df, x, time, event, by, entry, cluster), "cox-rows"), len(x)
    b = np.zeros(k)
    for _ in range(steps):
        ll, grad, hess = cox_sums(rows, x, b, by)
        move = np.linalg.solve(hess, grad)
        b = b + move
        if np.abs(move).max() < tolerance:
            break
    covariance = np.linalg.inv(hess)
    wald = float(b @ hess @ b)
    robust = covariance @ meat(score_residuals(rows, x, b, by), k) @ covariance
    return {"coefficients": b, "se": np.sqrt(np.diag(covariance)), "robust_se": np.sqrt(np.diag(robust)), "wald": wald, "p": chi2_tail(wald, k), "loglik": ll}


def proportionality(df: DataFrame, x: list[str], time: str, event: str, b: np.ndarray, strata: list[str] | None = None) -> DataFrame:
    """(term, n, covariance, variance_t, variance_r) of Schoenfeld residuals with the rank of their times: what the test of proportional hazards is made of."""
    by = strata or []
    rows = cox_rows(df, x, time, event, by)
    each = _efron(_risk_table(rows, x, b, by), len(x))
    at = each.groupBy(*by, "t").agg(*[F.avg(f"z1_{i}").alias(f"m_{i}") for i in range(len(x))])
    hits = rows.where("_e").join(at.withColumnRenamed("t", "_t"), [*by, "_t"])
    times = running_sums(hits.groupBy("_t").agg(F.count(F.lit(1)).alias("_m")), [], "_t", {"_upto": "_m"})
    ranked = hits.join(times.select("_t", "_m", "_upto"), "_t").withColumn("_rank", F.col("_upto") - (F.col("_m") - 1) / 2.0)
    long = ranked.select("_rank", F.explode(F.array(*[F.struct(F.lit(c).alias("term"), (F.col(c) - F.col(f"m_{i}")).alias("r")) for i, c in enumerate(x)])).alias("s")).select("_rank", "s.*")
    return long.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_rank", "r").alias("covariance"), F.var_pop("_rank").alias("variance_t"), F.var_pop("r").alias("variance_r"))


def early_late(df: DataFrame, x: list[str], time: str, event: str, split: float | None = None, cluster: str | None = None) -> tuple[float, list[tuple[str, float, float, float, float]]]:
    """(split, (term, early, its error, late, its error) for each term): Cox coefficients up to the time ``split`` and after it, by default the median of the events' times.

    Whoever is still at risk at the split is censored there for the first, and enters
    there for the second: how far the two lie apart shows the size of a hazard that isn't proportional.
    """
    if split is None:
        split = float(df.where(F.col(event)).agg(F.median(F.col(time).cast("double"))).first()[0])
    early = df.withColumns({"_until": F.least(F.col(time), F.lit(split)), "_hit": F.col(event) & (F.col(time) <= split)})
    late = df.where(F.col(time) > split).withColumn("_from", F.lit(split))
    one, two = cox(early, x, "_until", "_hit", cluster=cluster), cox(late, x, time, event, entry="_from", cluster=cluster)
    error = "robust_se" if cluster else "se"
    return split, [(c, float(one["coefficients"][i]), float(one[error][i]), float(two["coefficients"][i]), float(two[error][i])) for i, c in enumerate(x)]


def aft(df: DataFrame, x: list[str], time: str, event: str, law: str = "weibull", steps: int = 60, cluster: str | None = None) -> dict:
    """Accelerated failure time regression (``weibull`` or ``lognormal``) by Newton steps on distributed sums.

    Log time = a + x b + s * error. Each step sums value, gradient and Hessian over Arrow
    batches; derivatives in the scaled residual are exact. ``robust_se`` is the sandwich
    of the Hessian and the rows' gradients, summed by ``cluster`` if there is one.
    """
    import math

    ship_package(df.sparkSession)
    named = df.select(F.log(F.col(time).cast("double")).alias("_y"), F.col(event).cast("double").alias("_e"), *[F.col(c).cast("double").alias(c) for c in x], (F.col(cluster) if cluster else F.lit(None)).cast("string").alias("_cluster"))
    named = named.na.drop(subset=[c for c in named.columns if c != "_cluster"]).where(~F.isnan("_y"))
    rows = named.drop("_cluster")
    k = len(x) + 1

    def pieces(z: np.ndarray) -> tuple[np.ndarray, ...]:
        """log density and log survival at z, with first and second derivatives."""
        if law == "weibull":
            ez = np.exp(np.clip(z, -700, 60))
            return z - ez, 1 - ez, -ez, -ez, -ez, -ez
        erfc = np.vectorize(math.erfc)
        tail = np.maximum(0.5 * erfc(z / math.sqrt(2)), 1e-300)
        h = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        return -z * z / 2 - 0.5 * math.log(2 * math.pi), -z, -np.ones_like(z), np.log(tail), -h, -h * (h - z)

    def sums(beta: np.ndarray, log_s: float) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
                y, e = cols[0], cols[1]
                design = np.stack([np.ones_like(y), *cols[2:]], 1)
                s = math.exp(log_s)
                z = (y - design @ beta) / s
                f, f1, f2, g, g1, g2 = pieces(z)
                value = (e * (f - log_s) + (1 - e) * g).sum()
                d1, d2 = e * f1 + (1 - e) * g1, e * f2 + (1 - e) * g2
                jac = np.hstack([-design / s, -z[:, None]])  # dz by (beta, log s)
                grad = jac.T @ d1 + np.append(np.zeros(k), -e.sum())
                hess = (jac * d2[:, None]).T @ jac
                cross = (design / s).T @ d1  # second derivatives of z
                hess[:k, k] += cross
                hess[k, :k] += cross
                hess[k, k] += (d1 * z).sum()
                flat = np.concatenate([[value], grad, hess.ravel()])
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(flat), dtype=np.int32)), "v": pa.array(flat)})

        out = np.zeros(1 + (k + 1) + (k + 1) ** 2)
        for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out[0], out[1 : k + 2], out[k + 2 :].reshape(k + 1, k + 1)

    m = rows.agg(F.avg("_y").alias("m"), F.stddev_pop("_y").alias("s")).first()
    theta = np.zeros(k + 1)
    theta[0], theta[k] = m["m"], math.log(max(m["s"], 1e-3))
    value, grad, hess = sums(theta[:k], theta[k])
    for _ in range(steps):
        move = np.linalg.solve(hess - 1e-8 * np.eye(k + 1), -grad)
        if grad @ move < 0:
            move = grad / np.linalg.norm(grad)
        scale = 1.0
        while scale > 1e-6:
            new = theta + scale * move
            v2, g2, h2 = sums(new[:k], new[k])
            if np.isfinite(v2) and v2 >= value - 1e-12:
                break
            scale /= 2
        done = abs(v2 - value) < 1e-9 * (1 + abs(value))
        theta, value, grad, hess = new, v2, g2, h2
        if done:
            break
    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns - 1)]
            y, e, s = cols[0], cols[1], math.exp(theta[k])
            design = np.stack([np.ones_like(y), *cols[2:]], 1)
            z = (y - design @ theta[:k]) / s
            _, f1, _, _, g1, _ = pieces(z)
            u = np.hstack([-design / s, -z[:, None]]) * (e * f1 + (1 - e) * g1)[:, None]
            u[:, k] -= e
            yield pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1), *[pa.array(u[:, i]) for i in range(k + 1)]], ["_cluster", *[f"u_{i}" for i in range(k + 1)]])

    inverse = np.linalg.inv(-hess)
    middle = meat(named.mapInArrow(shares, ", ".join(["_cluster string", *[f"u_{i} double" for i in range(k + 1)]])), k + 1)
    root = lambda m: np.sqrt(np.maximum(np.diag(m), 0))[:k]
    return {"coefficients": theta[:k], "scale": float(math.exp(theta[k])), "se": root(inverse), "robust_se": root(inverse @ middle @ inverse), "loglik": float(value), "gradient": grad, "rows": named.count()}
